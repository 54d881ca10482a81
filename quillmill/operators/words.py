"""Timed words: scripts, tokens, phrases, references, alignment, error rates, captions, typing.

Alignment and the cutting of captions look at one text at a time in an Arrow function that sees keys or
word lengths and returns places only; times, rates and texts are windows and joins.
"""

from __future__ import annotations

import difflib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions import packs, text as tx


def word_key(col: Column) -> Column:
    """Letters and digits in lower case, io as ie; empty for marks. ``tx.composed(df, c, "NFKC")`` goes before where it matters."""
    return F.regexp_replace(F.translate(F.lower(col), "ё", "е"), r"[^\p{L}\p{N}]", "")


def script(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row for each word of a script, numbered from 0, with its section, numbered from 1.

    Lines that begin with ``#`` are comments, blank lines part sections, and marks that stand alone
    belong to the word before; marks before the first word are left out.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?dm)^[^\S\n]*#.*\n?", "")
    blocks = F.filter(F.split(clean, r"\n\s*\n"), lambda s: s.rlike(r"\S"))
    tokens = df.select(*key, F.posexplode(blocks).alias("_s", "_block"))
    tokens = tokens.select(*key, (F.col("_s") + 1).alias("section"), F.posexplode(F.filter(F.split("_block", r"(?U)\s+"), lambda w: w != "")).alias("_i", "_w"))
    at = W.partitionBy(*key).orderBy("section", "_i")
    tokens = tokens.withColumn("ord", F.sum((word_key(F.col("_w")) != "").cast("long")).over(at) - 1).where("ord >= 0")
    pieces = F.array_sort(F.collect_list(F.struct("section", "_i", "_w")))
    return tokens.groupBy(*key, "ord").agg(F.min("section").alias("section"), F.array_join(F.transform(pieces, lambda x: x["_w"]), " ").alias("word")).select(*key, "ord", "section", "word")


def fold_tokens(df: DataFrame, key: list[str], token: str = "token", t: str = "t") -> DataFrame:
    """Tokens to words: a token with a space in front and a letter or digit begins a word, others stick to the one before."""
    rows = df.where(~F.col(token).startswith("[_") & (F.trim(token) != ""))
    w = W.partitionBy(*key).orderBy("ord")
    begins = (F.col(token).startswith(" ") & (word_key(F.col(token)) != "")) | (F.row_number().over(w) == 1)
    rows = rows.withColumn("_w", F.sum(begins.cast("int")).over(w)).withColumn("_piece", F.when(word_key(F.col(token)) == "", F.trim(token)).otherwise(F.col(token)))
    whole = rows.groupBy(*key, "_w").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_piece"))), lambda x: x["_piece"]), "")).alias("word"), F.min_by(t, "ord").alias("t0"))
    return whole.where(word_key(F.col("word")) != "").withColumn("ord", (F.row_number().over(W.partitionBy(*key).orderBy("_w")) - 1).cast("long")).select(*key, "ord", "word", "t0")


def nth_word(words: DataFrame, key: list[str], want: str, n: int) -> DataFrame:
    """The ``n``-th place of a word in each text."""
    hits = words.where(word_key(F.col("word")) == word_key(F.lit(want)))
    return hits.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("ord"))).where(F.col("_n") == n).drop("_n")


def phrases(words: DataFrame, key: list[str], phrase: str) -> DataFrame:
    """The places where the words of a phrase follow each other, numbered from 1."""
    w = W.partitionBy(*key).orderBy("ord")
    wanted = [p for p in phrase.split()]
    rows = words.withColumn("_k", word_key(F.col("word")))
    test = F.lit(True)
    for i, p in enumerate(wanted):
        rows = rows.withColumn(f"_{i}", F.lead("_k", i).over(w))
        test = test & (F.col(f"_{i}") == word_key(F.lit(p)))
    out = rows.where(F.coalesce(test, F.lit(False))).withColumn("occurrence", F.row_number().over(w).cast("long"))
    return out.select(*words.columns, "occurrence")


def reference(col: Column) -> Column:
    """``cue:name + 1.5`` or ``word:name#2 - 0.1`` as kind, name, ordinal and offset."""
    pattern = r"^(cue|word):(.+?)\s*([+-]\s*\d+(?:\.\d+)?)?$"
    name = F.regexp_extract(col, pattern, 2)
    return F.struct(
        F.nullif(F.regexp_extract(col, pattern, 1), F.lit("")).alias("kind"),
        F.regexp_replace(name, r"#\d+$", "").alias("name"),
        F.coalesce(F.nullif(F.regexp_extract(name, r"#(\d+)$", 1), F.lit("")).cast("int"), F.lit(1)).alias("nth"),
        F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(col, pattern, 3), " ", ""), F.lit("")).cast("double"), F.lit(0.0)).alias("shift"),
    )


MOST_CUES = 100_000


def resolve(cues: DataFrame, words: DataFrame, depth: int = 4) -> DataFrame:
    """name and seconds of cues whose ``ref`` is a number, another cue or a word; an unknown name is an error.

    ``cues`` is (name, ref), a sheet of at most ``MOST_CUES`` rows, ``words`` (word, ord, t0). A chain of
    cues may be ``depth`` long. Only words that some cue names are kept and numbered, for each name the
    ``nth`` least places alone; the chains are followed inside one row that holds the sheet.
    """
    if cues.limit(MOST_CUES + 1).count() > MOST_CUES:
        raise ValueError("too many cues")
    sheet = cues.withColumn("r", reference(F.trim("ref"))).withColumn("t", F.col("ref").try_cast("double"))
    asked = sheet.where("r.kind = 'word'").select(word_key(F.col("r.name")).alias("_w"), F.col("r.nth").alias("_nth")).distinct()
    deepest = asked.groupBy(F.col("_w").alias("_k")).agg(F.max("_nth").alias("_most"))
    # least places first on each side of the shuffle: a frequent word moves as few rows as its cue asks for
    spoken = words.select(word_key(F.col("word")).alias("_k"), "ord", "t0").join(F.broadcast(deepest), "_k")
    spoken = spoken.withColumn("_n", F.row_number().over(W.partitionBy("_k").orderBy("ord"))).where("_n <= _most")
    times = spoken.join(F.broadcast(asked), (F.col("_k") == F.col("_w")) & (F.col("_n") == F.col("_nth"))).select("_w", "_nth", "t0")
    at = sheet.join(times, (F.col("r.kind") == "word") & (word_key(F.col("r.name")) == F.col("_w")) & (F.col("r.nth") == F.col("_nth")), "left")
    at = at.select("name", "ref", F.when(F.col("r.kind") == "cue", F.col("r.name")).alias("on"), F.col("r.shift").alias("shift"), F.coalesce("t", F.col("t0") + F.col("r.shift")).alias("t"))
    all_ = at.agg(F.collect_list(F.struct("name", "ref", "on", "shift", "t")).alias("c"))
    known = F.map_from_entries(F.filter(F.transform("c", lambda x: F.struct(x["name"], x["t"])), lambda x: x["t"].isNotNull()))
    step = F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["ref"].alias("ref"), x["on"].alias("on"), x["shift"].alias("shift"), F.coalesce(x["t"], F.try_element_at(F.col("k"), x["on"]) + x["shift"]).alias("t")))
    for _ in range(depth):
        all_ = all_.withColumn("k", known).withColumn("c", step)
    lost = F.raise_error(F.concat(F.lit("unknown reference: "), F.col("x.ref"))).cast("double")
    return all_.select(F.explode("c").alias("x")).select("x.name", F.coalesce("x.t", lost).alias("t"))


# ---- alignment


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType(), False), *(T.StructField(c, T.IntegerType(), False) for c in ("a0", "a1", "b0", "b1"))]), False)


def with_spans(df: DataFrame, wanted: str, heard: str, name: str = "spans") -> DataFrame:
    """Adds how two arrays of word keys lie over each other: spans [a0, a1) of the one and [b0, b1) of the other.

    Kinds are equal, replace, delete (wanted only) and insert (heard only). Null arrays count as empty.
    """
    out = T.StructType([f for f in df.schema.fields if f.name != name])
    kept, kind = list(out.names), pa.list_(pa.struct([pa.field("kind", pa.string()), *(pa.field(c, pa.int32()) for c in ("a0", "a1", "b0", "b1"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(wanted).to_pylist(), batch.column(heard).to_pylist(), strict=True)
            found = [[dict(zip(("kind", "a0", "a1", "b0", "b1"), code, strict=True)) for code in difflib.SequenceMatcher(None, a or [], b or [], autojunk=False).get_opcodes()] for a, b in pairs]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, kind)], names=[*kept, name])

    return df.mapInArrow(run, out.add(name, SPANS))


def _keys(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""), word_key)


def align_texts(df: DataFrame, key: list[str], wanted: str, heard: str) -> DataFrame:
    """n_words, errors, soft, extra, and wer, of a heard text against the wanted one of the same row.

    A span counts with its longer side; replaced spans with a digit on either side are ``soft``, and what is
    heard before or after all wanted words is ``extra``; neither is an error.
    """
    rows = with_spans(df.select(*key, _keys(F.col(wanted)).alias("_a"), _keys(F.col(heard)).alias("_b")), "_a", "_b")
    size = lambda s: F.greatest(s["a1"] - s["a0"], s["b1"] - s["b0"])
    digit = lambda a, first, end: F.exists(F.slice(F.col(a), first + 1, F.greatest(end - first, F.lit(0))), lambda w: w.rlike(r"\p{Nd}"))
    outside = lambda s: (s["kind"] == "insert") & ((s["a0"] == 0) | (s["a0"] == F.size("_a")))
    loose = lambda s: (s["kind"] == "replace") & (digit("_a", s["a0"], s["a1"]) | digit("_b", s["b0"], s["b1"]))
    wrong = F.filter("spans", lambda s: (s["kind"] != "equal") & ~outside(s) & ~loose(s))
    errors = F.aggregate(wrong, F.lit(0), lambda n, s: n + size(s))
    out = rows.select(
        *key, F.size("_a").cast("long").alias("n_words"), errors.cast("long").alias("errors"), F.size(F.filter("spans", loose)).cast("long").alias("soft"), F.size(F.filter("spans", outside)).cast("long").alias("extra")
    )
    return out.withColumn("wer", F.col("errors") / F.greatest(F.col("n_words"), F.lit(1)))


def timed_script(wanted: DataFrame, heard: DataFrame, key: list[str]) -> DataFrame:
    """Script words (key, ord, word) with the times of heard ones (key, ord, word, t0, t1): adds t0, t1 and missed.

    Spans of equal length give their times word by word. Other replaced spans share the time from the
    first to the last heard word by the lengths of the keys. Words that were not heard share the time
    between their neighbours evenly, and take 0.3 s each at the end.
    """
    listed = lambda df, name: df.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", word_key(F.col("word")).alias("k")))), lambda x: x["k"]).alias(name))
    spans = with_spans(listed(wanted, "_a").join(listed(heard, "_b"), key, "left"), "_a", "_b").select(*key, F.explode("spans").alias("s")).select(*key, "s.*")
    spans = spans.where("a1 > a0 and b1 > b0").withColumn("ord", F.explode(F.sequence("a0", F.col("a1") - 1))).withColumn("ord", F.col("ord").cast("long"))
    single = F.col("a1") - F.col("a0") == F.col("b1") - F.col("b0")
    spans = spans.select(*key, "ord", "a0", F.when(single, F.col("b0") + F.col("ord") - F.col("a0")).otherwise(F.col("b0")).cast("long").alias("_first"), F.when(single, F.col("b0") + F.col("ord") - F.col("a0")).otherwise(F.col("b1") - 1).cast("long").alias("_last"))
    start, end = heard.select(*key, F.col("ord").alias("_first"), F.col("t0").alias("_from")), heard.select(*key, F.col("ord").alias("_last"), F.col("t1").alias("_to"))
    rows = wanted.join(spans.join(start, [*key, "_first"]).join(end, [*key, "_last"]), [*key, "ord"], "left")
    # shares of a span by the lengths of its keys; a span of one word has it all
    shared = W.partitionBy(*key, "a0", "_first", "_last")
    size = F.greatest(F.length(word_key(F.col("word"))), F.lit(1))
    rows = rows.withColumn("_size", size).withColumn("_all", F.sum("_size").over(shared)).withColumn("_done", F.sum("_size").over(shared.orderBy("ord").rowsBetween(W.unboundedPreceding, 0)))
    along = lambda part: F.col("_from") + (F.col("_to") - F.col("_from")) * part / F.col("_all")
    rows = rows.withColumn("_t0", along(F.col("_done") - F.col("_size"))).withColumn("_t1", F.when(F.col("_done") == F.col("_all"), F.col("_to")).otherwise(along(F.col("_done"))))
    # islands of words that were not heard lie between the known neighbours
    back, ahead = W.partitionBy(*key).orderBy("ord").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*key).orderBy("ord").rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumn("_island", F.count("_t0").over(back)).withColumn("_p", F.last("_t1", True).over(back)).withColumn("_q", F.first("_t0", True).over(ahead))
    first = heard.groupBy(*key).agg(F.min_by("t0", "ord").alias("_begin"))
    rows = rows.join(first, key, "left").withColumn("_p", F.coalesce("_p", "_begin", F.lit(0.0)))
    gap = W.partitionBy(*key, "_island", F.col("_t0").isNull())
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(gap)).withColumn("_k", F.row_number().over(gap.orderBy("ord")))
    step = (F.coalesce(F.col("_q"), F.col("_p") + packs.VOICE["unheard"] * F.col("_n")) - F.col("_p")) / F.col("_n")
    missed = F.col("_t0").isNull()
    return rows.select(*wanted.columns, F.when(missed, F.col("_p") + step * (F.col("_k") - 1)).otherwise(F.col("_t0")).alias("t0"), F.when(missed, F.col("_p") + step * F.col("_k")).otherwise(F.col("_t1")).alias("t1"), missed.alias("missed"))


# ---- captions


class Line:
    """Words of one text laid on a line, a space between neighbours; widths come from prefix sums."""

    def __init__(self, lengths: list[int]):
        self.at = [0, *accumulate(n + 1 for n in lengths)]

    def width(self, a: int, b: int) -> int:
        """Characters of the words a to b (exclusive) with the spaces between them."""
        return self.at[b] - self.at[a] - 1

    def reach(self, a: int, most: int) -> int:
        """The end of the longest run of words from ``a`` that fits in ``most`` characters, one word at least."""
        return max(a + 1, bisect_right(self.at, self.at[a] + most + 1) - 1)

    def even(self, a: int, b: int, goal: float) -> int:
        """The end of a run from ``a`` that is as wide as ``goal`` as nearly as words allow, one word at least."""
        # a run is left alone once the widths with and without the next word lie on average beyond the goal
        middles = bisect_right(range(a + 1, b), 2 * goal, key=lambda e: self.width(a, e) + self.width(a, e + 1))
        return a + 1 + middles


def pieces(line: Line, a: int, b: int, most: int) -> list[int]:
    """Ends of the pieces of the words a to b: as few as the limit allows, and as even as words allow."""
    if line.width(a, b) <= most:
        return [b]
    fewest = -(-line.width(a, b) // most)
    for count in range(fewest, max(fewest, b - a + 1) + 1):
        ends, goal = [a], line.width(a, b) / count
        while ends[-1] < b:
            start, more = ends[-1], len(ends) < count
            ends.append(min(b, line.reach(start, most), line.even(start, b, goal) if more else b))
        if all(line.width(x, y) <= most for x, y in zip(ends, ends[1:], strict=False)):
            break
    return ends[1:]


def caption_ends(lengths: list[int], phrase_ends: list[int], hard: list[bool], most: int) -> list[int]:
    """Ends of the captions of a text: phrases cut to the limit, then packed while they fit and no sentence ends between them."""
    line, cuts, sentence = Line(lengths), [0], [0]
    for end, stop in zip(phrase_ends, hard, strict=True):
        cuts += pieces(line, cuts[-1], end, most)
        if stop:
            sentence.append(len(cuts) - 1)
    out = []
    for lo, hi in zip(sentence, sentence[1:], strict=False):
        at = lo
        while at < hi:
            # the farthest cut that is still on the caption
            limit = line.reach(cuts[at], most)
            at = max(at + 1, bisect_right(cuts, limit, at, hi + 1) - 1)
            out.append(cuts[at])
    return out


def captions(words: DataFrame, key: list[str], most: int = packs.CAPTION["most"]) -> DataFrame:
    """Captions of each text's timed words (ord from 0, section, word, t0, t1): ord, text, t0, t1, first_word, last_word, rate.

    Phrases end at marks, at pauses and with sections. A caption begins a little before its first word,
    lasts 0.7 s at least, and reaches to the next one if that follows closely; ``rate`` is characters a second.
    """
    c, w = packs.CAPTION, W.partitionBy(*key).orderBy("ord")
    bare = F.regexp_replace("word", "[\"'»”)]+$", "")
    gap = F.coalesce(F.lead("t0").over(w) - F.col("t1"), F.lit(0.0))
    last = F.lead("ord").over(w).isNull()
    hard = last | (F.lead("section").over(w) != F.col("section")) | bare.rlike("[.!?…]$") | (gap >= c["hard_gap"])
    marked = words.withColumn("_hard", hard).withColumn("_soft", hard | bare.rlike("[,;:—–]$") | (gap >= c["soft_gap"]))
    texts = marked.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", F.length("word").alias("n"), "_hard", "_soft"))).alias("_w"))
    out = T.StructType([*(words.schema[k] for k in key), T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("caption", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, firsts, ends, numbers = [], [], [], []
            for k, ws in enumerate(batch.column("_w").to_pylist()):
                cut = [(i + 1, x["_hard"]) for i, x in enumerate(ws) if x["_soft"]]
                found = caption_ends([x["n"] for x in ws], [e for e, _ in cut], [h for _, h in cut], most)
                rows += [k] * len(found)
                firsts += [0, *found[:-1]] if found else []
                ends += found
                numbers += range(len(found))
            taken = [batch.column(c).take(pa.array(rows, pa.int64())) for c in key]
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array(x, pa.int64()) for x in (firsts, ends, numbers))], names=out.names)

    # each word gets the caption that it is in
    ranges = texts.mapInArrow(run, out).select(*key, "caption", F.explode(F.sequence("first", F.col("end") - 1)).alias("ord"))
    sized = words.join(ranges, [*key, "ord"]).groupBy(*key, "caption").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "word"))), lambda x: x["word"]), " ").alias("text"),
        F.min("ord").alias("first_word"), F.max("ord").alias("last_word"), F.min_by("t0", "ord").alias("_from"), F.max_by("t1", "ord").alias("_to"),
    )
    v = W.partitionBy(*key).orderBy("caption")
    begin = F.col("_from") - c["lead"]
    start = F.when(F.lag("caption").over(v).isNull(), F.greatest(begin, F.lit(0.0))).otherwise(begin)
    end = F.greatest(F.col("_to") + c["tail"], F.col("t0") + c["least"])
    follows = F.lead("t0").over(v)
    timed = sized.withColumn("t0", start).withColumn("t1", F.when(follows - end < c["join"], follows).otherwise(end))
    timed = timed.select(*key, F.col("caption").alias("ord"), "text", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"), "first_word", "last_word")
    return timed.withColumn("rate", F.length("text") / F.greatest(F.col("t1") - F.col("t0"), F.lit(0.01)))


def too_fast(captions_: DataFrame, most: float = packs.CAPTION["fast"]) -> DataFrame:
    """Captions with more characters a second than can be read."""
    return captions_.where(F.col("rate") > most)


# ---- typing


def typing_gaps(df: DataFrame, key: list[str], text: str = "text", rate: float = 12.0) -> DataFrame:
    """The wait before each key of a typed text, without chance: weights by the character before, scaled to the mean rate."""
    t = packs.TYPING
    chars = df.select(*key, F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("i", "char"))
    w = W.partitionBy(*key).orderBy("i")
    prev = F.coalesce(F.lag("char").over(w), F.lit(""))
    space = lambda c: c.rlike(r"(?U)^\s$")
    weight = (
        F.when(F.col("i") == 0, t["first"]).when(prev == "\n", t["line"]).when(prev.rlike("^[.!?…]$"), t["stop"]).when(prev.rlike("^[,;:—–)]$"), t["comma"]).when(space(prev), t["space"]).otherwise(1.0)
        * F.when(F.col("char").rlike(r"^\p{Lu}$") & ~prev.rlike(r"^\p{Lu}$"), t["capital"]).otherwise(1.0)
        * F.when(space(F.col("char")) & (F.col("i") > 0) & ~space(prev), t["before_space"]).otherwise(1.0)
    )
    rows = chars.withColumn("_w", weight)
    whole = W.partitionBy(*key)
    return rows.withColumn("gap_ms", F.col("_w") * F.count(F.lit(1)).over(whole) / rate * 1000 / F.sum("_w").over(whole)).drop("_w")


def take(frames: DataFrame, start: Column, slow: float, wall: str = "wall") -> DataFrame:
    """Wall-clock seconds of a recording as milliseconds of the recorded app, whose clock ran ``slow`` times slower; never before 0."""
    return frames.withColumn("t", F.greatest(F.lit(0.0), (F.col(wall) - start) * 1000 / slow))


