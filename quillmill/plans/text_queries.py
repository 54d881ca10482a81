"""Queries of the prose operators over ``documents`` and ``conversations``, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as tx
from quillmill.operators import lint
from quillmill.sources.tables import spread, table

# ---- SQL pieces: RE2 has no lookaround, so groups of thousands are joined by two replacements

_JOIN = r"regexp_replace(regexp_replace(replace(lower({0}), 'ё', 'е'), '(\d)[ \x{{A0}}](\d{{3}})\b', '\1\2', 'g'), '(\d)[ \x{{A0}}](\d{{3}})\b', '\1\2', 'g')"
_WORDS = "regexp_extract_all(" + _JOIN + ", '[а-яa-z0-9]+(?:[-.,][а-яa-z0-9]+)*')"
_BARE = r"regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '^\s*(?:[•\-*]|\d+[.)])\s*', '')"
_SPLIT = r"string_split(regexp_replace({0}, '([.!?…])\s+([«\"A-ZА-ЯЁ0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))"


def clean_words(x: str) -> str:
    return _WORDS.format(x)


words = clean_words
_SENTENCES = SENTENCES = f"flatten(list_transform(string_split(trim(text), chr(10)), lambda l: list_filter({_SPLIT.format(_BARE.format('l'))}, lambda s: len({words('s')}) > 0)))"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text, over all cores."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def doc_word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    w = tx.words(F.col("text"))
    return docs.select("doc_id", F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("distinct_words"), tx.paragraphs(F.col("text")).cast("long").alias("paragraphs"))


def doc_structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = lint.structure(_documents(spark, sf_dir))
    return counts.select("doc_id", "dashes", "bolds", "emojis", "headers", "parens", "latin_words", "sentences", "longest_sentence", "long_sentences")


def doc_lint_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural rules only: the lexical packs are Russian, and these documents are not."""
    out = lint.lint(_documents(spark, sf_dir), lexical=False)
    return out.select("doc_id", "words", "penalty", "score")


def doc_lint_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules with all packs; most find nothing in these languages, and ``russian_queries`` has rows where they do."""
    out = lint.lint(_documents(spark, sf_dir), greeting=True, max_words=2000, min_score=50)
    return out.select("doc_id", "penalty", "score", F.array_join("fail", ",").alias("fail"))


_PACK = {"article": ("the ", "des "), "link": (" and ",)}


def doc_hits_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hits of two categories, pattern after pattern, with their context."""
    found = lint.hits(_documents(spark, sf_dir), _PACK)
    return found.select("doc_id", "category", "ordinal", "total", "pos", "line", "hit", "context")


def doc_category_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lint.hits(_documents(spark, sf_dir), _PACK, top=1)
    return found.groupBy("category").agg(F.sum("total").alias("hits"), F.count(F.lit(1)).alias("documents"))


def doc_numbers_not_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a document that are in no form in the one before it, list numbers aside. Number forms move, texts don't."""
    docs = _documents(spark, sf_dir)
    forms = docs.select((F.col("doc_id") + 1).alias("doc_id"), tx.number_variants(F.coalesce("text", F.lit(""))).alias("known"))
    found = docs.select("doc_id", lint.numbers_in_lists(F.col("text")).alias("numbers"))
    wrong = lint.not_among(F.col("numbers"), F.col("known"))
    return found.join(forms, "doc_id").select("doc_id", F.size(wrong).cast("long").alias("n_foreign"), F.array_join(F.array_sort(F.array_distinct(wrong)), "|").alias("foreign"))


def doc_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    checks = F.expr(
        "named_struct('min_score', 60, 'max_words', 900, 'max_paragraphs', 3, 'max_emoji', 0, 'required', array('the'), 'forbidden', array('idiot', 'loser'),"
        " 'required_any', array(array('and', 'und', 'et')), 'first_line_any', cast(null as array<string>), 'last_block_any', array('.'), 'judgments', array('reads well'))"
    )
    graded = lint.grade(lint.lint(docs, lexical=False).withColumn("checks", checks))
    return graded.select("doc_id", "summary.passed", "summary.failed", "summary.total", "summary.pass_rate")


QUERIES = {f.__name__: f for f in (doc_word_stats, doc_structure_counts, doc_lint_score, doc_lint_full, doc_hits_topk, doc_category_hits, doc_numbers_not_in_source, doc_grades)}



def scored_counts(source: str) -> str:
    """The counts and structural findings of the documents in ``source`` (doc_id, text in normal form C)."""
    lengths = f"list_transform(s, lambda x: len({words('x')}))"
    return f"""
    WITH c0 AS (SELECT doc_id, text, len({words('text')}) AS words, {_SENTENCES} AS s,
           len(regexp_extract_all(text, '\\s[—–]\\s')) AS dashes, len(regexp_extract_all(text, '\\*\\*[^*]+\\*\\*')) AS bolds,
           len(regexp_extract_all(text, '[\\x{{1F300}}-\\x{{1FAFF}}☀-➿]')) AS emojis, len(regexp_extract_all(text, '(?m)^#{{1,6}}\\s')) AS headers,
           length(text) - length(replace(text, '(', '')) AS parens,
           len(regexp_extract_all(replace(lower(text), 'ё', 'е'), '[\\p{{L}}\\p{{N}}_«»\"-]+, [\\p{{L}}\\p{{N}}_«»\"-]+ и [\\p{{L}}\\p{{N}}_«»\"-]+')) AS triads,
           len(regexp_extract_all(replace(lower(text), 'ё', 'е'), 'не только .{{2,60}}?, но и')) AS not_onlies,
           len(list_filter({words('text')}, lambda w: regexp_full_match(w, '[a-z]{{4,}}'))) AS latin_words
        FROM {source})
    SELECT doc_id, words, emojis, greatest(words, 1) AS nw, dashes, bolds, headers, parens, latin_words, len(s) AS sentences, coalesce(list_max({lengths}), 0) AS longest_sentence,
           len(list_filter({lengths}, lambda n: n > 25)) AS long_sentence,
           CASE WHEN dashes * 100 / greatest(words, 1) > 4 THEN 1 ELSE 0 END AS dash_excess,
           CASE WHEN triads > greatest(2, greatest(words, 1) // 150) THEN 1 ELSE 0 END AS triad_excess,
           CASE WHEN bolds > 3 AND greatest(words, 1) < 400 THEN 1 ELSE 0 END AS bold_excess,
           CASE WHEN emojis > 3 THEN 1 ELSE 0 END AS emoji_excess,
           CASE WHEN headers > 0 AND greatest(words, 1) < 200 THEN 1 ELSE 0 END AS header_in_short,
           CASE WHEN parens > greatest(2, greatest(words, 1) // 100) THEN 1 ELSE 0 END AS paren_excess,
           CASE WHEN not_onlies > 1 THEN 1 ELSE 0 END AS not_only,
           CASE WHEN latin_words > greatest(words, 1) * 0.15 THEN 1 ELSE 0 END AS english_prose
    FROM c0"""


_COUNTS = scored_counts("documents")
_POINTS = "2 * long_sentence + dash_excess + triad_excess + bold_excess + emoji_excess + 2 * header_in_short + paren_excess + 2 * not_only + 3 * english_prose"
_SCORED = f"""
    WITH c AS ({_COUNTS}), p AS (SELECT c.*, d.text, {_POINTS} AS penalty FROM c JOIN documents d USING (doc_id))
    SELECT *, greatest(0, round_even(100 - penalty * 100 / nw, 0))::BIGINT AS score FROM p"""
_BLOCKS = r"len(list_filter(regexp_split_to_array(trim({0}), '\n\s*\n'), lambda p: regexp_replace(p, '\s+', '', 'g') <> ''))"
_HITS = """
    WITH lits AS (SELECT * FROM (VALUES ('article', 0, 'the '), ('article', 1, 'des '), ('link', 0, ' and ')) v(category, rank, lit)),
    parts AS (SELECT doc_id, text, category, rank, lit, string_split(lower(text), lit) AS p FROM documents, lits),
    each AS (SELECT *, unnest(range(1, len(p))) AS k FROM parts WHERE len(p) > 1),
    places AS (SELECT doc_id, text, category, rank, k, lit AS hit, (list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(lit))::BIGINT AS pos FROM each),
    hits AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY rank, k) AS ordinal, count(*) OVER (PARTITION BY doc_id, category) AS total FROM places)"""
_NUMS = r"regexp_extract_all({0}, '[0-9][0-9 \x{{A0}}.,]*[0-9]|[0-9]')"
_CLEAN = r"regexp_replace(regexp_replace({0}, '[ \x{{A0}}]', '', 'g'), '[.,]+$', '')"
_FORMS = f"[{_CLEAN}, replace({_CLEAN}, ',', '.'), regexp_replace({_CLEAN}, '[.,]', '', 'g')]"


def numbers(x: str) -> tuple[str, str]:
    """SQL of the numbers of a text and of the forms of a number."""
    return _NUMS.format(x), _FORMS.format(x)


def blocks(x: str) -> str:
    return _BLOCKS.format(x)


ORACLE_SQL = {
    "doc_word_stats": f"SELECT doc_id, len({words('text')})::BIGINT AS words, len(list_distinct({words('text')}))::BIGINT AS distinct_words, {_BLOCKS.format('text')}::BIGINT AS paragraphs FROM documents",
    "doc_structure_counts": f"""WITH c AS ({_COUNTS}) SELECT doc_id, dashes::BIGINT AS dashes, bolds::BIGINT AS bolds, emojis::BIGINT AS emojis, headers::BIGINT AS headers, parens::BIGINT AS parens,
        latin_words::BIGINT AS latin_words, sentences::BIGINT AS sentences, longest_sentence::BIGINT AS longest_sentence, long_sentence::BIGINT AS long_sentences FROM c""",
    "doc_lint_score": f"SELECT doc_id, words::BIGINT AS words, penalty::BIGINT AS penalty, score FROM ({_SCORED})",
    "doc_hits_topk": f"{_HITS} SELECT doc_id, category, ordinal, total, pos, (1 + length(substr(text, 1, pos)) - length(replace(substr(text, 1, pos), chr(10), '')))::BIGINT AS line, hit, CASE WHEN pos > 30 THEN '…' ELSE '' END || replace(text[greatest(0, pos - 30) + 1:least(length(text), pos + 30)], chr(10), ' ') || CASE WHEN pos + 30 < length(text) THEN '…' ELSE '' END AS context FROM hits WHERE ordinal <= 12",
    "doc_category_hits": f"{_HITS} SELECT category, sum(total)::BIGINT AS hits, count(*)::BIGINT AS documents FROM hits WHERE ordinal = 1 GROUP BY category",
    "doc_numbers_not_in_source": f"""
        WITH pairs AS (SELECT d.doc_id, d.text, flatten(list_transform({_NUMS.format('s.text')}, lambda y: {_FORMS.format('y')})) AS known FROM documents d JOIN documents s ON s.doc_id = d.doc_id - 1),
        p AS (SELECT doc_id, text, known, string_split_regex(text, '[0-9][0-9 \\x{{A0}}.,]*[0-9]|[0-9]') AS gaps, {_NUMS.format('text')} AS hits FROM pairs),
        x AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM p WHERE len(hits) > 0),
        y AS (SELECT doc_id, known, text, hits[i] AS h, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0))::BIGINT AS place FROM x),
        z AS (SELECT doc_id, known, trim(h) AS n, {_FORMS.format('h')} AS forms, substr(text, greatest(place, 1), CASE WHEN place > 0 THEN 4 ELSE 3 END) AS near FROM y),
        w AS (SELECT doc_id, n FROM z WHERE NOT list_has_any(forms, known) AND NOT (regexp_matches(forms[1], '^0*[0-3]$') AND regexp_matches(near, '^\\s*\\d[.)]'))),
        g AS (SELECT doc_id, count(*) AS n_foreign, array_to_string(list_sort(list_distinct(list(n))), '|') AS "foreign" FROM w GROUP BY doc_id)
        SELECT pairs.doc_id, coalesce(n_foreign, 0) AS n_foreign, coalesce("foreign", '') AS "foreign" FROM pairs LEFT JOIN g USING (doc_id)""",
    "doc_grades": f"""
        WITH s AS (SELECT *, replace(lower(text), chr(160), ' ') AS flat FROM ({_SCORED})),
        g AS (SELECT doc_id, [score >= 60, words <= 900, true, {_BLOCKS.format('text')} <= 3, contains(flat, 'the'), NOT (contains(flat, 'idiot') OR contains(flat, 'loser')),
                     contains(trim(flat)[-400:], '.'), contains(flat, 'and') OR contains(flat, 'und') OR contains(flat, 'et')] AS e FROM s)
        SELECT doc_id, len(list_filter(e, lambda x: x))::INT AS passed, len(list_filter(e, lambda x: NOT x))::INT AS failed, 9 AS total, round_even(len(list_filter(e, lambda x: x)) / 9.0, 3)::DOUBLE AS pass_rate FROM g""",
}
