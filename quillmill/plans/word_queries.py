"""Queries of the timed-word operators over ``conversations``, with their DuckDB twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import words as wd
from quillmill.sources.tables import table

TURN = ["conv_id", "turn"]


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all turns on a line of 0.3 s a word."""
    w = wd.script(_turns(spark, sf_dir), TURN)
    return w.withColumn("t0", F.round(F.col("ord") * 0.3, 3)).withColumn("t1", F.round(F.col("ord") * 0.3 + 0.25, 3))


def turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wd.script(_turns(spark, sf_dir), TURN).groupBy(*TURN).agg(F.count(F.lit(1)).alias("n_words"), F.max_by("word", "ord").alias("last_word"))


def nth_word_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wd.nth_word(_timed(spark, sf_dir), TURN, "the", 2).select(*TURN, "ord", "t0")


def phrase_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wd.phrases(_timed(spark, sf_dir), TURN, "of the").select(*TURN, "ord", "occurrence")


def folded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns cut into tokens of a space and up to three characters, and folded again."""
    tokens = _turns(spark, sf_dir).select(*TURN, F.posexplode(F.regexp_extract_all(F.concat(F.lit(" "), F.regexp_replace("text", r"\s+", " ")), F.lit(" ?[^ ]{1,3}"), F.lit(0))).alias("ord", "token"))
    folded = wd.fold_tokens(tokens.withColumn("t", F.col("ord") * 0.1), TURN)
    return folded.groupBy(*TURN).agg(F.count(F.lit(1)).alias("n_words"), F.sum(F.length("word")).alias("n_chars"))


def typing_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = wd.typing_gaps(_turns(spark, sf_dir), TURN)
    return g.groupBy(*TURN).agg(F.count(F.lit(1)).alias("n_keys"), F.round(F.max("gap_ms"), 3).alias("longest"), F.round(F.sum("gap_ms"), 2).alias("total"))


def resolved_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues that name words of all turns laid end to end, a time, and each other."""
    place = F.col("conv_id") * 1_000_000_000 + F.col("turn") * 1_000_000 + F.col("ord")
    words = _timed(spark, sf_dir).select("word", place.alias("ord"), "t0")
    cues = [("intro", "1.25"), ("hit", "cue:intro + 2"), ("tail", "cue:hit - 0.25"), ("word", "word:the + 0.5"), ("third", "word:the#3"), ("late", "cue:third + 1")]
    return wd.resolve(spark.createDataFrame(cues, "name string, ref string"), words).select("name", F.round("t", 3).alias("t"))


def captions_from_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of all turns, with their speed."""
    c = wd.captions(_timed(spark, sf_dir), TURN)
    return c.select(*TURN, "ord", "text", "t0", "t1", "first_word", "last_word", F.round("rate", 4).alias("rate"))


def fast_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wd.too_fast(wd.captions(_timed(spark, sf_dir), TURN)).groupBy(*TURN).agg(F.count(F.lit(1)).alias("fast"))


def caption_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions as JSON, one text a turn."""
    c = wd.captions(_timed(spark, sf_dir), TURN)
    rows = c.groupBy(*TURN).agg(F.sort_array(F.collect_list(F.struct("ord", "text", F.array("first_word", "last_word").alias("words")))).alias("captions"))
    return rows.select(*TURN, F.to_json("captions").alias("json"))


def _numbered(i) -> F.Column:
    """A word for each place that no other place has, without digits."""
    return F.concat(F.lit("w"), F.translate(i.cast("string"), "0123456789", "abcdefghij"))


def _heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as numbered words, and as they are heard: every seventh word lost, every eleventh another one."""
    n = F.size(F.split("text", " "))
    every = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), _numbered(i).alias("w")))
    heard = F.transform(F.filter(every, lambda x: x["i"] % 7 != 3), lambda x: F.when(x["i"] % 11 == 5, F.concat(F.lit("zz"), x["w"])).otherwise(x["w"]))
    return _turns(spark, sf_dir).select(*TURN, F.array_join(F.transform(every, lambda x: x["w"]), " ").alias("text"), F.array_join(heard, " ").alias("heard"))


def turn_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates of heard turns against the wanted ones."""
    r = wd.align_texts(_heard(spark, sf_dir), TURN, "text", "heard")
    return r.select(*TURN, "n_words", "errors", "soft", "extra", F.round("wer", 6).alias("wer"))


def timed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of all words of turns of which every seventh word was not heard."""
    words = _turns(spark, sf_dir).select(*TURN, F.posexplode(F.split("text", " ")).alias("i", "_w")).select(*TURN, F.col("i").cast("long").alias("ord"), _numbered(F.col("i")).alias("word"))
    heard = words.where("ord % 7 <> 3").select(*TURN, (F.col("ord") - F.floor((F.col("ord") + 3) / 7)).alias("ord"), "word", (F.col("ord") * 0.3).alias("t0"), (F.col("ord") * 0.3 + 0.25).alias("t1"))
    t = wd.timed_script(words, heard, TURN)
    return t.select(*TURN, "ord", F.round("t0", 4).alias("t0"), F.round("t1", 4).alias("t1"), "missed")


def take_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a recording on the clock of the recorded app."""
    k = _turns(spark, sf_dir).select(*TURN, (F.length("text") / 7.0).alias("wall"))
    return wd.take(k, F.lit(20.0), 4.0).select(*TURN, F.round("t", 4).alias("t"))


QUERIES = {f.__name__: f for f in (turn_words, nth_word_time, phrase_starts, folded_tokens, typing_gaps, resolved_cues, captions_from_turns, fast_captions, caption_documents, turn_error_rates, timed_turns, take_times)}

_KEY = r"regexp_replace(replace(lower({0}), 'ё', 'е'), '[^\p{{L}}\p{{N}}]', '', 'g')"
_TURNS = rf"""
    s AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(text, '(?m)^[^\S\n]*#.*\n?', '', 'g'), '\n\s*\n'), lambda b: regexp_matches(b, '\S')) AS bs FROM conversations),
    sb AS (SELECT conv_id, turn, unnest(bs) AS b, unnest(range(1, len(bs) + 1)) AS section FROM s),
    st AS (SELECT conv_id, turn, section, list_filter(regexp_split_to_array(b, '\s+'), lambda x: x <> '') AS ts FROM sb),
    tk AS (SELECT conv_id, turn, section, unnest(ts) AS w, unnest(range(len(ts))) AS i FROM st),
    nm AS (SELECT *, sum(CASE WHEN {_KEY.format('w')} <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY section, i) - 1 AS ord FROM tk),
    w AS (SELECT conv_id, turn, ord::BIGINT AS ord, min(section) AS section, string_agg(w, ' ' ORDER BY section, i) AS word FROM nm WHERE ord >= 0 GROUP BY ALL)"""

#: Captions: phrases, over-long ones cut word by word, pieces packed, times.
_CAPTIONS = f"""{_TURNS},
    cw AS (SELECT *, round(ord * 0.3, 3) AS t0, round(ord * 0.3 + 0.25, 3) AS t1, regexp_replace(word, '["\'\'»”)]+$', '') AS bare FROM w),
    cf AS (SELECT *, (lead(ord) OVER v IS NULL OR lead(section) OVER v <> section OR regexp_matches(bare, '[.!?…]$')) AS hard FROM cw WINDOW v AS (PARTITION BY conv_id, turn ORDER BY ord)),
    cp AS (SELECT *, coalesce(sum(CASE WHEN hard OR regexp_matches(bare, '[,;:—–]$') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ph FROM cf),
    cl AS (SELECT *, row_number() OVER v AS i, count(*) OVER u AS n, sum(length(word)) OVER u + count(*) OVER u - 1 AS whole FROM cp WINDOW u AS (PARTITION BY conv_id, turn, ph), v AS (PARTITION BY conv_id, turn, ph ORDER BY ord)),
    cr AS (SELECT conv_id, turn, ph, i, ord, length(word) AS cur, 0 AS closed, whole, n FROM cl WHERE i = 1
        UNION ALL SELECT cl.conv_id, cl.turn, cl.ph, cl.i, cl.ord,
            CASE WHEN {{shut}} THEN length(cl.word) ELSE cur + 1 + length(cl.word) END, CASE WHEN {{shut}} THEN closed + 1 ELSE closed END, cr.whole, cr.n
        FROM cr JOIN cl ON cl.conv_id = cr.conv_id AND cl.turn = cr.turn AND cl.ph = cr.ph AND cl.i = cr.i + 1),
    cq AS (SELECT conv_id, turn, ph, closed, min(ord) AS a, max(ord) AS b, max(cur) AS width FROM cr GROUP BY ALL),
    ch AS (SELECT cq.*, row_number() OVER (PARTITION BY cq.conv_id, cq.turn ORDER BY a) AS k, cp.hard FROM cq JOIN cp ON cp.conv_id = cq.conv_id AND cp.turn = cq.turn AND cp.ord = cq.b),
    cm AS (SELECT conv_id, turn, k, a, b, hard, width AS held, 0 AS cap FROM ch WHERE k = 1
        UNION ALL SELECT ch.conv_id, ch.turn, ch.k, ch.a, ch.b, ch.hard, CASE WHEN cm.hard OR held + 1 + width > 42 THEN width ELSE held + 1 + width END, CASE WHEN cm.hard OR held + 1 + width > 42 THEN cap + 1 ELSE cap END
        FROM cm JOIN ch ON ch.conv_id = cm.conv_id AND ch.turn = cm.turn AND ch.k = cm.k + 1),
    cc AS (SELECT conv_id, turn, cap, min(a) AS first_word, max(b) AS last_word FROM cm GROUP BY ALL),
    ct AS (SELECT cc.*, (SELECT string_agg(word, ' ' ORDER BY ord) FROM cw WHERE cw.conv_id = cc.conv_id AND cw.turn = cc.turn AND cw.ord BETWEEN first_word AND last_word) AS text, x.t0 AS a0, y.t1 AS a1
        FROM cc JOIN cw x ON x.conv_id = cc.conv_id AND x.turn = cc.turn AND x.ord = first_word JOIN cw y ON y.conv_id = cc.conv_id AND y.turn = cc.turn AND y.ord = last_word),
    cs AS (SELECT *, CASE WHEN cap = 0 THEN greatest(a0 - 0.05, 0) ELSE a0 - 0.05 END AS b0 FROM ct),
    ce AS (SELECT *, greatest(a1 + 0.15, b0 + 0.7) AS b1, lead(b0) OVER (PARTITION BY conv_id, turn ORDER BY cap) AS nx FROM cs),
    cz AS (SELECT conv_id, turn, cap::BIGINT AS ord, text, round(b0, 3)::DOUBLE AS t0, round(CASE WHEN nx - b1 < 0.3 THEN nx ELSE b1 END, 3)::DOUBLE AS t1, first_word, last_word FROM ce)"""
_CAPTIONS = _CAPTIONS.replace("{shut}", "cr.whole > 42 AND (cur + 1 + length(cl.word) > 42 OR (closed < ceil(cr.whole / 42) - 1 AND abs(cur + 1 + length(cl.word) - cr.whole / ceil(cr.whole / 42)) > abs(cur - cr.whole / ceil(cr.whole / 42))))")

ORACLE_SQL = {
    "resolved_cues": f"""WITH {_TURNS}, h AS (SELECT ord * 0.3 AS t, row_number() OVER (ORDER BY conv_id, turn, ord) AS n FROM w WHERE {_KEY.format('word')} = 'the')
        SELECT * FROM (VALUES ('intro', 1.25::DOUBLE), ('hit', 3.25::DOUBLE), ('tail', 3.0::DOUBLE)) v(name, t)
        UNION ALL SELECT 'word', round(t + 0.5, 3)::DOUBLE FROM h WHERE n = 1 UNION ALL SELECT 'third', round(t, 3)::DOUBLE FROM h WHERE n = 3 UNION ALL SELECT 'late', round(t + 1, 3)::DOUBLE FROM h WHERE n = 3""",
    "turn_words": f"WITH {_TURNS} SELECT conv_id, turn, count(*) AS n_words, arg_max(word, ord) AS last_word FROM w GROUP BY ALL",
    "folded_tokens": f"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(' ' || regexp_replace(text, '\\s+', ' ', 'g'), ' ?[^ ]{{1,3}}') AS ts FROM conversations),
        u AS (SELECT conv_id, turn, unnest(ts) AS tok, unnest(range(len(ts))) AS i FROM t), f AS (SELECT *, {_KEY.format('tok')} AS k, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS r FROM u WHERE NOT starts_with(tok, '[_') AND trim(tok) <> ''),
        g AS (SELECT *, sum(CASE WHEN (starts_with(tok, ' ') AND k <> '') OR r = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS g FROM f),
        v AS (SELECT conv_id, turn, g, trim(string_agg(CASE WHEN k = '' THEN trim(tok) ELSE tok END, '' ORDER BY i)) AS word FROM g GROUP BY ALL)
        SELECT conv_id, turn, count(*) AS n_words, sum(length(word))::BIGINT AS n_chars FROM v WHERE {_KEY.format('word')} <> '' GROUP BY ALL""",
    "captions_from_turns": f"WITH RECURSIVE {_CAPTIONS} SELECT *, round(length(text) / greatest(t1 - t0, 0.01), 4) AS rate FROM cz",
    "fast_captions": f"WITH RECURSIVE {_CAPTIONS} SELECT conv_id, turn, count(*) AS fast FROM cz WHERE length(text) / greatest(t1 - t0, 0.01) > 17 GROUP BY ALL",
    "caption_documents": f"WITH RECURSIVE {_CAPTIONS} SELECT conv_id, turn, to_json(list({{'ord': ord, 'text': text, 'words': [first_word, last_word]}} ORDER BY ord))::VARCHAR AS json FROM cz GROUP BY conv_id, turn",
    "turn_error_rates": """WITH n AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS n FROM conversations), e AS (SELECT *, len(list_filter(range(n), lambda i: i % 7 = 3 OR i % 11 = 5)) AS errors FROM n)
        SELECT conv_id, turn, n::BIGINT AS n_words, errors::BIGINT AS errors, 0::BIGINT AS soft, 0::BIGINT AS extra, round(errors / n, 6) AS wer FROM e""",
    "timed_turns": """WITH i AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS n, unnest(range(len(string_split(text, ' ')))) AS ord FROM conversations)
        SELECT conv_id, turn, ord, round(CASE WHEN ord % 7 <> 3 THEN ord * 0.3 ELSE (ord - 1) * 0.3 + 0.25 END, 4)::DOUBLE AS t0, round(CASE WHEN ord % 7 <> 3 THEN ord * 0.3 + 0.25 WHEN ord = n - 1 THEN (ord - 1) * 0.3 + 0.55 ELSE (ord + 1) * 0.3 END, 4)::DOUBLE AS t1, ord % 7 = 3 AS missed FROM i""",
    "take_times": "SELECT conv_id, turn, round(greatest(0, (length(text) / 7.0 - 20) * 1000 / 4), 4)::DOUBLE AS t FROM conversations",
    "nth_word_time": f"""WITH {_TURNS}, h AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY ord) AS n FROM w WHERE {_KEY.format('word')} = 'the')
        SELECT conv_id, turn, ord, round(ord * 0.3, 3)::DOUBLE AS t0 FROM h WHERE n = 2""",
    "phrase_starts": f"""WITH {_TURNS}, k AS (SELECT *, {_KEY.format('word')} AS k, lead({_KEY.format('word')}) OVER (PARTITION BY conv_id, turn ORDER BY ord) AS nxt FROM w)
        SELECT conv_id, turn, ord, row_number() OVER (PARTITION BY conv_id, turn ORDER BY ord) AS occurrence FROM k WHERE k = 'of' AND nxt = 'the'""",
    "typing_gaps": r"""
        WITH c AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS i FROM conversations),
        p AS (SELECT *, coalesce(lag(ch) OVER (PARTITION BY conv_id, turn ORDER BY i), '') AS prev FROM c),
        g AS (SELECT *, ((CASE WHEN i = 0 THEN 1.4 WHEN prev = chr(10) THEN 4 WHEN regexp_full_match(prev, '[.!?…]') THEN 3.2 WHEN regexp_full_match(prev, '[,;:—–)]') THEN 2.2 WHEN regexp_full_match(prev, '\s') THEN 1.6 ELSE 1 END)
                           * (CASE WHEN regexp_full_match(ch, '\p{Lu}') AND NOT regexp_full_match(prev, '\p{Lu}') THEN 1.35 ELSE 1 END)
                           * (CASE WHEN regexp_full_match(ch, '\s') AND i > 0 AND NOT regexp_full_match(prev, '\s') THEN 0.85 ELSE 1 END))::DOUBLE AS w FROM p),
        k AS (SELECT conv_id, turn, w * count(*) OVER q / 12.0 * 1000 / sum(w) OVER q AS gap FROM g WINDOW q AS (PARTITION BY conv_id, turn))
        SELECT conv_id, turn, count(*) AS n_keys, round(max(gap), 3) AS longest, round(sum(gap), 2) AS total FROM k GROUP BY ALL""",
}
