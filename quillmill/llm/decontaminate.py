"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Fixed masks pick some of the token positions of a short span and ignore the others, so a seed still
matches when an ignored token was substituted. Seeds of the test items and of the documents are
joined by hash; each joined hit lays the two texts over each other with a shift. The whole overlap at
that shift is then looked at, however long it is: a stretch begins and ends with equal tokens, at
least ``identity`` of its tokens are equal, and the one with the most equal tokens counts.

Before the join, document seeds are tested against a bit map of the test seeds. The map has a fixed
size whatever the test set holds: a larger test set lets more false seeds through to the join, which
is exact, and changes no result. Hits are made distinct by text, item and shift before anything is
verified, so a copied passage is verified once whatever the number of its seeds, texts that several
documents share are verified once, and items with equal tokens are one class. Only tokens of texts with hits move.

The best stretch needs no pair of positions: with E the equal positions, a stretch from the a-th to the
b-th of them is good if K(a) <= K(b) + den - num, where K(i) = den * i - num * E(i) and identity =
num / den. For each b the smallest such a is the last record of the running minimum of K at or below
the bound, found by one sort.

An overlap without a common seed isn't found: in ten tokens that can be so if every fourth one is another.

Tokens are runs of letters and digits in lower case. A pair is reported when its best stretch has at
least ``min_words`` equal tokens, or holds the whole item.

Defined results: null and empty texts hold no tokens and match nothing; items and documents of fewer
tokens than a mask spans have no seeds and match nothing; of items with equal tokens the smallest id
is returned with their number; repeated rows of a document count as one (their best stretch is
returned); rows with a null id are compared and returned with the null id; of equally good stretches
the shortest, then the first in the document, then in the item counts; further columns are ignored.
"""

from __future__ import annotations

import json
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.llm.common import sized, written

#: Positions that count, within a span of eight tokens.
MASKS = ((0, 1, 3, 6, 7), (0, 2, 4, 5, 7))
#: Test tables of up to so many rows are broadcast; larger ones are joined by a shuffle of the hits.
BROADCAST_ROWS = 200_000
#: 64-bit words of the bit map: 2 ** 15, so that three positions of 21 bits come from one hash.
MAP_BITS = 15


def token_hashes(text: Column) -> Column:
    """One 64-bit hash for each token."""
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(h: Column) -> Column:
    """``array<struct<seed, at>>`` of all masks at all positions. ``h`` must be a column of its own, not an expression."""
    span = 1 + max(map(max, MASKS))
    starts = F.when(F.size(h) >= span, F.sequence(F.lit(0), F.size(h) - span)).otherwise(F.array().cast("array<int>"))

    def of(k: int, mask: tuple[int, ...]) -> Column:
        return F.transform(starts, lambda i: F.struct(F.xxhash64(F.lit(k), *(F.get(h, i + o) for o in mask)).alias("seed"), i.alias("at")))

    each = [of(k, mask) for k, mask in enumerate(MASKS)]
    return F.concat(*each)


def _slots(seed: Column) -> list[tuple[Column, Column]]:
    """Three (word, bit) places of a seed in the bit map."""
    words = (1 << MAP_BITS) - 1
    places = [F.shiftrightunsigned(seed, 21 * k) if k else seed for k in range(3)]
    return [(F.shiftrightunsigned(p, 6).bitwiseAND(F.lit(words)).cast("int"), p.bitwiseAND(F.lit(63)).cast("int")) for p in places]


def _bit_map(seeds: DataFrame) -> Column:
    """The bit map of the seeds as one literal array; at most 2 ** 15 rows reach the driver."""
    places = F.array(*(F.struct(w.alias("w"), b.alias("b")) for w, b in _slots(F.col("seed"))))
    rows = (
        seeds.select(F.explode(places).alias("p"))
        .groupBy("p.w")
        .agg(F.bit_or(F.expr("shiftleft(1L, p.b)")).alias("bits"))
        .collect()
    )
    words = [0] * (1 << MAP_BITS)
    for row in rows:
        words[row["w"]] = row["bits"]
    return F.from_json(F.lit(json.dumps(words)), "array<bigint>")


def _classes(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_key, item_id (the smallest), n_items and item_h of each class of items with equal tokens that are long enough for a seed."""
    span = 1 + max(map(max, MASKS))
    test = items.select(F.col(item_id).alias("item_id"), token_hashes(F.col(text)).alias("item_h")).where(F.size("item_h") >= span)
    test = test.withColumn("item_key", F.xxhash64("item_h")).groupBy("item_key").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items"), F.first("item_h").alias("item_h"))
    return written(test, "items")


def _hits(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct doc_id, text_key, item_key and shift (the position in the document of the item's first token) of all seeds that both hold."""
    seeds = classes.select("item_key", F.explode_outer(_seeds(F.col("item_h"))).alias("s")).where("s is not null")
    seeds = written(seeds.select("item_key", F.col("s.seed").alias("seed"), F.col("s.at").alias("q")), "seeds")
    bits = _bit_map(seeds.select("seed"))
    tests = F.broadcast if seeds.count() <= BROADCAST_ROWS else lambda x: x.hint("merge")

    def known(x: Column) -> Column:
        hit = None
        for w, b in _slots(x["seed"]):
            one = F.getbit(F.get(bits, w), b) == F.lit(1).cast("tinyint")
            hit = one if hit is None else hit & one
        return hit

    hashed = docs.select("doc_id", text_key("text").alias("text_key"), token_hashes(F.col("text")).alias("h"))
    # explode_outer, since explode would have the seeds computed once more for a filter on their number
    hits = hashed.select("doc_id", "text_key", F.explode_outer(F.filter(_seeds(F.col("h")), known)).alias("s")).where("s is not null")
    hits = hits.select("doc_id", "text_key", F.col("s.seed").alias("seed"), F.col("s.at").alias("p"))
    return written(hits.join(tests(seeds), "seed").select("doc_id", "text_key", "item_key", (F.col("p") - F.col("q")).alias("shift")).distinct(), "hits")


def text_key(text: str) -> Column:
    """What texts are told apart by."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _stretches(hits: DataFrame, docs: DataFrame, classes: DataFrame, min_words: int, identity: float) -> DataFrame:
    """text_key, item_key and the best stretch of each text and class that overlap."""
    share = Fraction(identity).limit_denominator(1000)
    num, den = share.numerator, share.denominator
    laid = hits.select("text_key", "item_key", "shift").distinct()
    wanted = written(laid.select(F.col("text_key").alias("_key")).distinct(), "texts")
    texts = docs.select(text_key("text").alias("text_key"), F.col("text")).join(sized(wanted), F.col("text_key") == F.col("_key"), "left_semi")
    texts = texts.groupBy("text_key").agg(F.first("text").alias("text")).select("text_key", token_hashes(F.col("text")).alias("h"))
    pairs = laid.join(texts, "text_key").join(classes.select("item_key", "item_h"), "item_key")
    low, high = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("item_h"), F.size("h") - F.col("shift")) - 1
    # one position after the other; a shift that leaves no overlap can't have had a seed
    equal = F.filter(F.sequence(low, high), lambda j: F.get("h", F.col("shift") + j) == F.get("item_h", j))
    whole = F.size("item_h")
    pairs = pairs.select("text_key", "item_key", "shift", whole.alias("whole"), equal.alias("equal")).where(F.size("equal") >= F.least(F.lit(min_words), F.col("whole")))
    at = pairs.select("text_key", "item_key", "shift", "whole", F.posexplode("equal").alias("i", "e")).withColumn("k", den * F.col("i") - num * F.col("e"))
    lane = W.partitionBy("text_key", "item_key", "shift")
    before = F.min("k").over(lane.orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    at = at.withColumn("record", F.coalesce(F.col("k") < before, F.lit(True)))
    # each position asks at its bound for the last record at or below it; a record stands before what asks at its value
    both = at.select("*", F.explode(F.when(F.col("record"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("asks"))
    both = both.withColumn("value", F.when(F.col("asks") == 1, F.col("k") + den - num).otherwise(F.col("k")))
    first = F.last(F.when(F.col("asks") == 0, F.struct("i", "e")), True).over(lane.orderBy("value", "asks").rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumn("a", first).where("asks = 1 and a is not null and a.i <= i")
    found = found.select(
        "text_key", "item_key", "whole", (F.col("i") - F.col("a.i") + 1).cast("long").alias("n_equal"), (F.col("e") - F.col("a.e") + 1).cast("long").alias("n_overlap"),
        (F.col("shift") + F.col("a.e")).cast("long").alias("doc_start"), F.col("a.e").cast("long").alias("item_start"),
    )
    good = found.where((F.col("n_equal") >= min_words) | (F.col("n_equal") == F.col("whole")))
    return written(good.groupBy("text_key", "item_key").agg(_best()).select("text_key", "item_key", "b.*"), "stretches")


def _best() -> Column:
    fields = ("n_equal", "n_overlap", "doc_start", "item_start")
    key = F.struct(F.col("n_equal"), -F.col("n_overlap"), -F.col("doc_start"), -F.col("item_start"))
    return F.max_by(F.struct(*fields), key).alias("b")


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", min_words: int = 10, identity: float = 0.8) -> DataFrame:
    """One row for each contaminated document and class of items: the best stretch and where it starts, in tokens."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    classes = _classes(items, item_id, text)
    hits = _hits(docs, classes)
    best = _stretches(hits, docs, classes, min_words, identity).join(classes.select("item_key", "item_id", "n_items"), "item_key")
    # documents of a text: those that had its hits
    members = hits.select("doc_id", "text_key").distinct()
    rows = members.join(best, "text_key")
    return rows.groupBy("doc_id", "item_id", "n_items").agg(_best()).select("doc_id", "item_id", "n_items", "b.*")


def clean(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", min_words: int = 10, identity: float = 0.8) -> DataFrame:
    """The rows whose text overlaps with no item, with all their columns; rows are decided by their texts, whatever their ids."""
    plain = docs.select(F.lit(0).alias("doc_id"), F.col(text).alias("text"))
    classes = _classes(items, item_id, text)
    found = _stretches(_hits(plain, classes), plain, classes, min_words, identity)
    leaked = written(found.select(F.col("text_key").alias("_leaked")).distinct(), "leaked")
    return docs.join(sized(leaked), text_key(text) == F.col("_leaked"), "left_anti")
