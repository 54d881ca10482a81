"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import audio, decontaminate, hpylm, near_dup, piece_bpe, pii, quality, token_files, toxicity, warc
from quillmill.llm.common import fresh, written
from quillmill.sources.tables import spread


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; where they come in fewer splits than there are cores, dealt over the cores."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text, found by anchor expansion."""
    found = pii.find(_documents(spark, sf_dir).select("doc_id", "text"), drop=("text",))
    return found.select(
        "doc_id",
        *(pii.count(F.col("spans"), k).alias(f"n_{k}") for k in pii.BASE_KINDS),
        F.sha2(pii.joined(pii.base(F.col("spans"))), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_all"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back from the archives."""
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as 8-bit audio in Parquet, read back, and a digest of their tensors as stored and read back."""
    stored = written(audio.store(_documents(spark, sf_dir).select("doc_id", "text")), "media")
    manifest = audio.write_features(stored, fresh(spark, "tensors"))
    return audio.read_features(manifest, stored.drop("media").schema).drop("windows")


def op4_bit_packed(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Ids of all texts in bit-packed files, read back."""
    return token_files.round_trip(_documents(spark, sf_dir), tokenizer_path or _vocabulary("byte_bpe_50k.json"), 2)


def op5_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts by the hierarchical Pitman-Yor model and by the smoothed unigram base."""
    return hpylm.score(_documents(spark, sf_dir))


def op6_piece_bpe(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Encode every text, decode its ids, and digest both."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    both = piece_bpe.encode(docs, model_path or _vocabulary("piece_bpe_32k.model"), decoded="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_dup.near_duplicates(_documents(spark, sf_dir), percent=85)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of test items, substitutions tolerated."""
    return decontaminate.overlaps(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_anchor_pii": op1_anchor_pii,
    "op2_warc": op2_warc,
    "op3_audio": op3_audio,
    "op4_bit_packed": op4_bit_packed,
    "op5_hpylm": op5_hpylm,
    "op6_piece_bpe": op6_piece_bpe,
    "op7_minhash": op7_minhash,
    "op8_quality": op8_quality,
    "op9_nnpu": op9_nnpu,
    "op10_spaced_seeds": op10_spaced_seeds,
}

#: DuckDB has no base32: five hexadecimal digits are four characters of it.
_BASE32 = "||".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(sha, {1 + 5 * k}, 5))::INT >> {down}) % 32, 1)" for k in range(8) for down in (15, 10, 5, 0))

#: Tokens in the SQL of op10.
_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op2_warc": f"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS sha FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS keep FROM d)
        SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keep THEN keep END AS refers_to
        FROM g""",
    "op7_minhash": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                                  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (n - k)),
        d AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, d.b FROM r JOIN d ON r.reach = d.a),
        c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
        SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON id = doc_id""",
    "op10_spaced_seeds": f"""
        WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), i0 AS (SELECT item_id, {_TOKENS} AS iw FROM benchmark), i AS (SELECT iw, min(item_id) AS item_id, count(*) AS n_items FROM i0 WHERE len(iw) >= 8 GROUP BY iw),
        m AS (SELECT * FROM (VALUES (0, [0, 1, 3, 6, 7]), (1, [0, 2, 4, 5, 7])) v(mask, offs)),
        dp AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 7, 0))) AS p FROM t),
        dk AS (SELECT doc_id, p, mask, array_to_string(list_transform(offs, lambda o: w[p + o + 1]), ' ') AS seed FROM dp, m),
        ip AS (SELECT item_id, iw, unnest(range(0, greatest(len(iw) - 7, 0))) AS q FROM i),
        ik AS (SELECT item_id, q, mask, array_to_string(list_transform(offs, lambda o: iw[q + o + 1]), ' ') AS seed FROM ip, m),
        h AS (SELECT DISTINCT doc_id, item_id, p - q AS shift FROM dk JOIN ik USING (mask, seed)),
        x AS (SELECT doc_id, item_id, n_items, len(iw) AS whole, shift, list_filter(range(0, len(iw)), lambda j: shift + j >= 0 AND w[shift + j + 1] = iw[j + 1]) AS e FROM h JOIN t USING (doc_id) JOIN i USING (item_id)),
        a AS (SELECT *, unnest(range(1, len(e) + 1)) AS a FROM x WHERE len(e) >= least(10, whole)),
        b AS (SELECT *, unnest(range(a, len(e) + 1)) AS b FROM a),
        g AS (SELECT doc_id, item_id, n_items, whole, (b - a + 1)::BIGINT AS n_equal, (e[b] - e[a] + 1)::BIGINT AS n_overlap, (shift + e[a])::BIGINT AS doc_start, e[a]::BIGINT AS item_start FROM b)
        SELECT doc_id, item_id, n_items, unnest(max_by({{'n_equal': n_equal, 'n_overlap': n_overlap, 'doc_start': doc_start, 'item_start': item_start}}, (n_equal, -n_overlap, -doc_start, -item_start)))
        FROM g WHERE (n_equal >= 10 OR n_equal = whole) AND 5 * n_equal >= 4 * n_overlap GROUP BY doc_id, item_id, n_items""",
}
