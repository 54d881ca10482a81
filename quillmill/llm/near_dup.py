"""Near-duplicate documents by one-permutation MinHash with optimal densification.

A document's set holds the hashes of its distinct runs of five words (ASCII letters in lower case;
with fewer words the whole sequence is its one member). One pass over a set fills ``BINS`` bins with
the least hash of each; an empty bin borrows from bins drawn by a fixed hash sequence until one is
filled, independently for each empty bin. Bands of ``ROWS`` bins are hashed to buckets.

Documents with equal sets are one class from the start. In each bucket one class is the centre and
the first candidate pairs are a star from it to the others, so there are at most as many pairs as
bucket members. The centre is the member that shares most buckets with others, as the text does that
the others were copied from. Pairs are confirmed on the full sets.

Buckets whose members are then still in several components are looked at pair by pair: the members
meet with a mark each, a bit map of their set and for larger sets the sketch, and all pairs of
different components are compared in place, so only pairs that the marks let through move. The map
gives a least size of the difference of two sets and so excludes no link. For each member the
``BEST`` closest partners are confirmed, and buckets with more are looked at once more with the new
components and a larger number, until no bucket holds back a pair. Buckets of over ``BLOCK`` members
are cut into blocks and each two blocks meet. So a link is lost only if its two texts share no
bucket or if their sketches exclude it (below; ``exact=True`` leaves that out).

With 44 bands of 7 rows a pair with a similarity of 0.8 misses all buckets three times in 100,000, and
one of 0.85 four times in 100 million.
Shingles are compared by 64-bit hashes, classes by a 64-bit hash of their sets.

Defined results: null, empty and blank texts have empty sets and are linked with nothing; ids may
repeat, and each row is then looked at by its own text; rows with a null id link like others, count
last for the smallest id, and are kept if their group has no id; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import releasing, sized, slices, written

SHINGLE, BANDS, ROWS = 5, 44, 7
BINS = BANDS * ROWS
MARK_BITS, LARGE = 4096, 256
#: Partners of a member in each pass; the last is over the members that can meet.
BLOCK, BEST = 1024, (8, 128, 2048)
KEPT_WORDS = 100_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_words = _WordHash()


def forget() -> None:
    """Empty the worker's table of word hashes."""
    _words.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    # bytes know ASCII only: lower() takes A-Z, and split() the six white-space bytes
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(_words.__getitem__, words)), np.uint64)
    if len(h) < SHINGLE:
        h = np.append(np.zeros(SHINGLE - len(h), np.uint64), h)
    out = h[: len(h) - SHINGLE + 1] * _ODD[0]
    for k in range(1, SHINGLE):
        out = out + h[k : len(h) - SHINGLE + 1 + k] * _ODD[k]
    return np.unique(_mix(out))


@lru_cache(maxsize=1)
def _probes() -> np.ndarray:
    """For each attempt, the bin that each empty bin looks at."""
    n = np.arange(BINS * 4096, dtype=np.uint64).reshape(4096, BINS)
    return (_mix(n + np.uint64(0x5851F42D4C957F2D)) % np.uint64(BINS)).astype(np.int64)


def sketch(s: np.ndarray) -> np.ndarray:
    """The least hash in each bin, empty bins densified; ``s`` is sorted and not empty."""
    bins = ((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    out, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]], filled[bins[first]] = s[first], True
    empty = np.flatnonzero(~filled)
    attempt, probes = 0, _probes()
    while len(empty):
        at = probes[attempt % len(probes), empty]
        ok = filled[at]
        out[empty[ok]] = out[at[ok]]
        empty = empty[~ok]
        attempt += 1
    return out


def buckets(k: np.ndarray) -> np.ndarray:
    """One 64-bit bucket for each band."""
    rows = _mix(k).reshape(BANDS, ROWS)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[0]
    for r in range(ROWS):
        acc = _mix(acc + rows[:, r])
    return acc


FEATURES = T.StructType(
    [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("class", T.LongType()),
        T.StructField("sketch", T.BinaryType()),
        T.StructField("buckets", T.ArrayType(T.LongType(), False)),
    ]
)


def features(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried columns, size and class of the set, sketch (16 bits a bin) and buckets; null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            n, cls, sk, bk = [], [], [], []
            for t in batch.column("text").to_pylist():
                s = shingle_set(t)
                n.append(len(s))
                if not len(s):
                    cls.append(None), sk.append(None), bk.append(None)
                    continue
                k = sketch(s)
                cls.append(_class_of(s))
                sk.append((k & np.uint64(0xFFFF)).astype("<u2").tobytes())
                bk.append(buckets(k).view(np.int64))
            arrays = [batch.column("doc_id"), *map(batch.column, carried), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sk, pa.binary()), pa.array(bk, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *carried, *FEATURES.names])

    return docs.mapInArrow(lambda batches: releasing(run(batches), forget), T.StructType([T.StructField("doc_id", T.LongType()), *(docs.schema[c] for c in carried), *FEATURES.fields]))


def _similar_sketches(pairs: DataFrame, exact: bool) -> DataFrame:
    """Pairs whose sketches agree in at least two thirds of the bins; sets of under 256 members always pass, and all do with ``exact``.

    At a similarity of 0.8 the share of agreeing bins has a deviation of 0.023; two thirds are
    nearly six deviations below.
    """
    if exact:
        return pairs.select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, BINS) for c in ("a_sketch", "b_sketch"))
            small = np.minimum(batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy()) < 256
            good = small | ((a == b).sum(axis=1) * 3 >= 2 * BINS)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.mapInArrow(lambda batches: releasing(run(batches)), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """The smallest node reachable from each node of ``links`` (a, b): alternating large and small stars."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("class"), "least")
        before = now


def _class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(needed: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """class and its full set, for the classes in ``needed``. Only their texts are made into sets."""
    needed = written(needed.join(classes.select("class", "rep"), "class"), "needed")
    ids = written(needed.select(F.col("rep").alias("_rep")).distinct(), "ids")
    texts = docs.join(sized(ids), F.col("doc_id").eqNullSafe(F.col("_rep"))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            sets = [s for t in batch.column("text").to_pylist() if len(s := shingle_set(t))]
            yield pa.RecordBatch.from_arrays([pa.array(map(_class_of, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["class", "set"])

    # an id may stand for several texts: of these, the classes that are asked for
    sets = texts.mapInArrow(lambda batches: releasing(run(batches), forget), "class long, set array<long>").join(needed.select("class"), "class", "left_semi").dropDuplicates(["class"])
    return written(sets, "sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    a = sets.select(F.col("class").alias("a"), F.col("set").alias("a_set"))
    b = sets.select(F.col("class").alias("b"), F.col("set").alias("b_set"))
    same = F.size(F.array_intersect("a_set", "b_set"))
    whole = F.size("a_set") + F.size("b_set") - same
    return written(pairs.join(b, "b").join(a, "a").where(100 * same >= percent * whole).select("a", "b"), "links")


# ---- all pairs of the buckets that are left


def mark(s: np.ndarray) -> bytes:
    """A bit map of a set, and its sketch where the set is large enough for it to exclude pairs."""
    bits = np.zeros(MARK_BITS, np.uint8)
    bits[(s & np.uint64(MARK_BITS - 1)).astype(np.int64)] = 1
    out = np.packbits(bits).tobytes()
    return out + (sketch(s) & np.uint64(0xFFFF)).astype("<u2").tobytes() if len(s) >= LARGE else out


def _marks(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            marks = [mark(np.array(s, np.int64).view(np.uint64)) for s in batch.column("set").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(marks, pa.binary())], names=["class", "mark"])

    return sets.select("class", "set").mapInArrow(lambda batches: releasing(run(batches)), "class long, mark binary")


def _meeting(members: DataFrame, percent: int) -> DataFrame:
    """Members of open buckets once for each two blocks that meet (x <= y); ``part`` is the member's own.

    Blocks follow the components and sizes, so that blocks of one component or of unlike sizes need not meet.
    """
    small = members.where(F.col("m") <= BLOCK).select("bucket", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("part"), "class", "n", "least")
    large = members.where(F.col("m") > BLOCK)
    if large.isEmpty():
        return small
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("least", "n", "class")) - 1
    large = written(large.select("bucket", F.floor(place / BLOCK).cast("int").alias("part"), "class", "n", "least"), "blocks")
    blocks = written(large.groupBy("bucket", "part").agg(F.min("least").alias("lo"), F.max("least").alias("hi"), F.min("n").alias("few"), F.max("n").alias("many")), "ranges")
    x, y = (blocks.select("bucket", F.col("part").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("lo", "hi", "few", "many"))) for k in "xy")
    several = F.least("x_lo", "y_lo") != F.greatest("x_hi", "y_hi")
    alike = (F.col("x_many") * 100 >= percent * F.col("y_few")) & (F.col("y_many") * 100 >= percent * F.col("x_few"))
    met = x.join(y, "bucket").where((F.col("x") <= F.col("y")) & several & alike).select("bucket", "x", "y")
    met = met.select("*", F.explode(F.array_distinct(F.array("x", "y"))).alias("part"))
    return small.unionByName(large.join(met, ["bucket", "part"]).select(*small.columns))


def _block_pairs(part: np.ndarray, cls: np.ndarray, n: np.ndarray, least: np.ndarray, marks: list[bytes], percent: int, best: int, exact: bool = False) -> tuple[set[tuple[int, int]], bool]:
    """Pairs of different components that the marks let through, the closest ``best`` of each member; and whether there were more."""
    maps = np.frombuffer(b"".join(x[: MARK_BITS // 8] for x in marks), np.uint64).reshape(len(marks), -1)
    sketches, many = None, np.flatnonzero(n >= LARGE)
    if len(many) > 1 and not exact:
        sketches = np.zeros((len(n), BINS), np.uint16)
        sketches[many] = np.frombuffer(b"".join(marks[i][MARK_BITS // 8 :] for i in many), "<u2").reshape(-1, BINS)
    crossed = part[0] != part[-1] or (part != part[0]).any()
    out, more = set(), False
    for i in range(len(n)):
        ok = (least != least[i]) & (np.minimum(n, n[i]) * 100 >= percent * np.maximum(n, n[i]))
        if crossed:
            ok &= part != part[i]
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        both, apart = n[at] + n[i], np.bitwise_count(maps[at] ^ maps[i]).sum(axis=1, dtype=np.int64)
        good = 100 * (both - apart) >= percent * (both + apart)
        at, far = at[good], (apart / both)[good]
        if sketches is not None and n[i] >= LARGE and len(at):
            good = (n[at] < LARGE) | ((sketches[at] == sketches[i]).sum(axis=1) * 3 >= 2 * BINS)
            at, far = at[good], far[good]
        if len(at) > best:
            more, at = True, at[np.argsort(far, kind="stable")[:best]]
        out.update((min(cls[i], c), max(cls[i], c)) for c in cls[at].tolist())
    return out, more


def _open_pairs(meeting: DataFrame, percent: int, best: int, exact: bool) -> DataFrame:
    """Candidate pairs (a, b) of all buckets, and a row with ``bucket`` alone for each that holds back pairs."""
    key = ["bucket", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def answer() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([t.column(k).to_numpy().astype(np.int64) for k in key])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            cols, marks = [t.column(c).to_numpy() for c in ("part", "class", "n", "least")], t.column("mark").to_pylist()
            pairs, left = set(), set()
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), t.num_rows], strict=True):
                if hi - lo > 1:
                    found, more = _block_pairs(*(c[lo:hi] for c in cols), marks[lo:hi], percent, best, exact)
                    pairs |= found
                    if more:
                        left.add(int(keys[0, lo]))
            pairs, left = sorted(pairs), sorted(left)
            none = [None] * len(left)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs] + none, pa.int64()), pa.array([p[1] for p in pairs] + none, pa.int64()), pa.array([None] * len(pairs) + left, pa.int64())], names=["a", "b", "bucket"])

        for batch in slices(batches, 4096):
            if not batch.num_rows:
                continue
            ids = [batch.column(k).to_numpy() for k in key]
            last = np.flatnonzero(np.any([i != i[-1] for i in ids], axis=0))
            # whole groups are answered: those before the last one of the batch
            cut = int(last[-1]) + 1 if len(last) else 0
            if not cut and held and any(held[-1].column(k)[-1].as_py() != i[0] for k, i in zip(key, ids, strict=True)):
                yield answer()
                held.clear()
            if cut:
                held.append(batch.slice(0, cut))
                yield answer()
                held.clear()
            held.append(batch.slice(cut))
        if held:
            yield answer()

    return meeting.repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda batches: releasing(run(batches)), "a long, b long, bucket long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, carried: tuple[str, ...] = (), exact: bool = False) -> DataFrame:
    """doc_id, the columns ``carried``, n_shingles, component_id (the smallest doc_id reachable over links) and kept, a row for each row.

    With ``exact`` no pair that shares a bucket is excluded by its sketches.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *carried)
    facts = written(features(docs, carried), "features")
    # any member's sketch and buckets will do, as they are made from the set alone
    classes = written(
        facts.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("buckets").alias("buckets")),
        "classes",
    )
    rows = classes.select("class", "n", F.explode("buckets").alias("bucket"))
    crowded = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = written(rows.join(crowded, "bucket").select("bucket", "class", "n", "m"), "buckets")
    fame = rows.groupBy("class").agg(F.sum("m").alias("fame"))
    rows = written(rows.join(fame, "class").select("bucket", "class", "n", "fame"), "buckets")

    centre = rows.groupBy("bucket").agg(F.max(F.struct("fame", F.negative("class").alias("x"), "class", "n")).alias("c"))
    centre = written(centre.select("bucket", F.col("c.class").alias("a"), F.col("c.n").alias("a_n")), "centres")
    pairs = rows.select("bucket", F.col("class").alias("b"), F.col("n").alias("b_n")).join(centre, "bucket")
    pairs = pairs.where((F.col("a") != F.col("b")) & (F.least("a_n", "b_n") * 100 >= percent * F.greatest("a_n", "b_n")))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = classes.select("class", "n", "sketch")
    close = pairs.join(side.select(F.col("class").alias("b"), F.col("n").alias("b_n"), F.col("sketch").alias("b_sketch")), "b")
    close = close.join(side.select(F.col("class").alias("a"), F.col("n").alias("a_n"), F.col("sketch").alias("a_sketch")), "a")
    tested = written(_similar_sketches(close, exact), "candidates")
    links = _confirmed(tested, _sets(_ends(tested), docs, classes), percent)
    labels = None if links.isEmpty() else components(links)

    sets = None
    for best in BEST:
        labelled = rows.select("bucket", "class", "n")
        labelled = labelled.withColumn("least", F.col("class")) if labels is None else labelled.join(labels, "class", "left").withColumn("least", F.coalesce("least", "class"))
        # buckets with members of several components
        open_ = labelled.groupBy("bucket").agg(F.min("least").alias("lo"), F.max("least").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("bucket", "m")
        members = written(labelled.join(open_, "bucket"), "open")
        if members.isEmpty():
            break
        if sets is None:
            sets = _sets(members.select("class").distinct(), docs, classes)
            marks = written(_marks(sets), "marks")
        found = written(_open_pairs(_meeting(members, percent).join(marks, "class"), percent, best, exact), "pairs")
        close = written(found.where("bucket is null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "candidates")
        if not close.isEmpty():
            tested = tested.unionByName(close)
            more = _confirmed(close, sets, percent)
            if not more.isEmpty():
                links = links.unionByName(more)
                labels = components(links)
        left = found.where("bucket is not null").select("bucket").distinct()
        if left.isEmpty():
            break
        rows = members.select("bucket", "class", "n").join(left, "bucket", "left_semi")

    named = classes.select("class", "rep")
    named = named.withColumn("least", F.col("class")) if labels is None else named.join(labels, "class", "left").withColumn("least", F.coalesce("least", "class"))
    named = written(named, "named")
    groups = named.groupBy("least").agg(F.min("rep").alias("component_id"))
    of_class = named.join(groups, "least").select("class", "component_id")
    out = facts.select("doc_id", *carried, "n_shingles", "class").join(of_class, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", *carried, "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
