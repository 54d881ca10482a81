"""Document quality: random Fourier features, ridge regression and isotonic calibration.

Statistics of a whole text (lengths, character classes, repetition, markup) are standardised and
mapped to random Fourier features, whose inner products approximate a Gaussian kernel. Each
partition of labelled rows sums its part of the normal equations; the parts are added up in a tree,
so the driver gets ``PARTS`` of them at most, each of a fixed size. Ridge scores of rows left out of
the equations are calibrated by pooling adjacent violators over ``STEPS`` score bins.

A label is learnt only from the rows that ``learn`` marks; ids, languages and sources are no inputs.

Defined results: null is the empty text, which is scored by its statistics like any other; rows of an
id with several labels count with the mean of them; labels that are null, not 0 or 1, or without a
document are left out; with labels of one kind only (or none) all scores are that kind's share (0.5);
repeated documents get equal scores; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import BROADCAST_ROWS, slices, text_of, written

DIMENSIONS, GAMMA, RIDGE, SEED = 512, 0.02, 1.0, 20240501
PARTS, STEPS = 32, 512

_CLASSES = np.zeros((256, 9), np.float32)  # of bytes: lower, upper, digit, space, sentence marks, line feed, other marks, beyond ASCII, control
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b, 0 if "a" <= _c <= "z" else 1 if "A" <= _c <= "Z" else 2 if "0" <= _c <= "9" else 5 if _c == "\n" else 3 if _c in " \t\r\x0b\x0c" else 4 if _c in ".,;:?'\"-" else 7 if _b > 127 else 6 if 33 <= _b <= 126 else 8] = 1

NAMES = ("bytes", "lower", "upper", "digits", "spaces", "marks", "lines", "symbols", "foreign", "control", "words", "word_length", "distinct_words", "repeats", "distinct_lines", "line_length", "shouts", "tripled", "bars", "top_symbol", "sentences", "links", "distinct_bytes", "long_words")


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of ``NAMES``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = (counts @ _CLASSES / n).tolist()
    words = raw.split()
    w = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x]
    k = max(1, len(lines))
    symbols = counts[[33, 35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 124, 126]]
    tripled = sum(raw.count(bytes((b, b, b))) for b in b"*#&%$!.=-_~")
    return [
        np.log1p(len(raw)),
        *shares[:5],
        min(1.0, shares[5] * 20),
        *shares[6:],
        np.log1p(len(words)),
        min(20.0, len(raw) / w),
        len(set(words)) / w,
        sum(map(eq, words, words[1:])) / w,
        len(set(lines)) / k,
        np.log1p(len(raw) / k),
        raw.count(b"!!") / w,
        tripled / w,
        raw.count(b"|") / w,
        float(symbols.max()) / n,
        raw.count(b". ") / w,
        (raw.count(b"http") + raw.count(b"www.")) / w,
        float((counts > 0).sum()) / 100,
        float(np.log1p(max(map(len, words), default=0))),
    ]


def with_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the statistics of the text."""
    source = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("_text"))
    out = T.StructType([source.schema["doc_id"]]).add("statistics", T.ArrayType(T.FloatType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            got = np.array([statistics(t) for t in batch.column("_text").to_pylist()], np.float32).reshape(-1, len(NAMES))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * len(NAMES), pa.int32()), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], names=["doc_id", "statistics"])

    return source.mapInArrow(run, out)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; between the middles of bins they rise linearly, so order is kept."""
        if not len(self.weights):
            return np.full(len(x), self.values[0])
        return np.clip(np.interp(self.raw(x), self.edges, self.values), 0, 1)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel, with a constant and the statistics themselves."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, np.sqrt(2 * GAMMA), (x.shape[1], DIMENSIONS))
    b = rng.uniform(0, 2 * np.pi, DIMENSIONS)
    x = np.clip(x, -8, 8)
    return np.concatenate([np.cos(x @ w + b) * np.sqrt(2 / DIMENSIONS) * 4, x / 8, np.ones((len(x), 1))], axis=1)


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The rising step function nearest to means ``y`` with weights ``n``, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for value, weight in zip(y.tolist(), n.tolist(), strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, k = blocks.pop()
            u = blocks[-1]
            u[0], u[1], u[2] = (u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, u[2] + k
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def _summed(parts: DataFrame, arrays: int) -> list[np.ndarray]:
    """The sum of rows of float64 blobs: added up in ``PARTS`` tasks, then on the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(arrays)), strict=True):
                row = [np.frombuffer(v, "<f8") for v in row]
                total = row if total is None else [a + b for a, b in zip(total, row, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()], pa.binary()) for t in total], names=[f"x{k}" for k in range(arrays)])

    rows = parts.repartition(PARTS).mapInArrow(add, ", ".join(f"x{k} binary" for k in range(arrays))).collect()
    return [sum(np.frombuffer(bytes(r[k]), "<f8") for r in rows) if rows else np.zeros(0) for k in range(arrays)]


def _each_partition(rows: DataFrame, sums, arrays: int) -> DataFrame:
    """One row of blobs for each partition: the sum of ``sums(x, y)`` over its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices(batches, 4096):
            if batch.num_rows:
                x = batch.column("statistics").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                got = sums(x, batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64))
                total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(t, "<f8").tobytes()], pa.binary()) for t in total], names=[f"x{k}" for k in range(arrays)])

    return rows.select("statistics", "label").mapInArrow(run, ", ".join(f"x{k} binary" for k in range(arrays)))


def fit(labelled: DataFrame) -> Model:
    """Fit on rows of ``statistics``, ``label`` (0 to 1) and ``spare`` (kept for calibration)."""
    d, size = len(NAMES), DIMENSIONS + len(NAMES) + 1
    n, s1, s2, y = _summed(_each_partition(labelled, lambda x, y: [np.array([len(x)]), x.sum(0), (x * x).sum(0), np.array([y.sum()])], 4), 4)
    share = float(y[0] / n[0]) if len(n) else 0.5
    flat = Model(np.zeros(d), np.ones(d), np.zeros(0), np.zeros(0), np.array([share]))
    if not len(n) or share in (0.0, 1.0):
        return flat
    mean = s1 / n[0]
    scale = np.sqrt(np.maximum(s2 / n[0] - mean**2, 1e-8))

    def equations(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        z = fourier((x - mean) / scale)
        weight = np.where(y >= 0.5, 0.5 / share, 0.5 / (1 - share))[:, None]
        return [((z * weight).T @ z).ravel(), (z * weight).T @ (2 * y - 1)]

    a, b = _summed(_each_partition(labelled.where("not spare"), equations, 2), 2)
    if not len(a):
        return flat
    flat.mean, flat.scale = mean, scale
    flat.weights = np.linalg.solve(a.reshape(size, size) + RIDGE * np.eye(size), b)

    def bins(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        at = np.clip(((flat.raw(x) + 2) / 4 * STEPS).astype(int), 0, STEPS - 1)
        return [np.bincount(at, minlength=STEPS), np.bincount(at, y, minlength=STEPS)]

    n, y = _summed(_each_partition(labelled.where("spare"), bins, 2), 2)
    if not len(n):
        flat.edges, flat.values = np.array([-1.0, 1.0]), np.array([0.0, 1.0])
        return flat
    used = np.flatnonzero(n)
    middles = (used + 0.5) / STEPS * 4 - 2
    values = isotonic(y[used] / n[used], n[used])
    # beyond the ends, and inside steps, a slight slope keeps the order of scores
    flat.edges = np.concatenate([[-4.0], middles, [4.0]])
    flat.values = 0.998 * np.concatenate([[values[0]], values, [values[-1]]]) + 0.002 * (flat.edges + 4) / 8
    return flat


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learnt: the crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def _known(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label of the rows that may be learnt; labels that contradict each other are averaged."""
    rows = labels.where(learnable(F.col("doc_id")) & F.col("doc_id").isNotNull())
    return rows.select("doc_id", F.col(label).cast("double").alias("label")).where("label in (0, 1)").groupBy("doc_id").agg(F.avg("label").alias("label"))


def _spared(labelled: DataFrame) -> Model:
    return fit(written(labelled.withColumn("spare", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).select("statistics", "label", "spare"), "labelled"))


def train(facts: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on the rows of ``facts`` (doc_id, statistics) whose labels may be learnt."""
    return _spared(facts.select("doc_id", "statistics").where(learnable(F.col("doc_id"))).join(_known(labels, label), "doc_id"))


def train_on_texts(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Model:
    """As ``train``, from texts: only those that have a label to learn from are looked at.

    With more labels than can be broadcast the statistics are joined instead, so that no text moves.
    """
    known = written(_known(labels, label), "labels")
    source = docs.where(learnable(F.col(doc_id)))
    if known.count() > BROADCAST_ROWS:
        return _spared(with_statistics(source, doc_id, text).select("doc_id", "statistics").join(known, "doc_id"))
    labelled = source.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known), "doc_id")
    return _spared(with_statistics(labelled, "doc_id", "text").select("doc_id", "statistics").join(F.broadcast(known), "doc_id"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for each document."""
    facts = written(with_statistics(docs, doc_id, text), "statistics")
    model = train(facts, labels, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            x = batch.column("statistics").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    scored = facts.mapInArrow(run, T.StructType([facts.schema["doc_id"]]).add("score", T.DoubleType()))
    held_out = F.coalesce(~learnable(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that score ``least`` or more, with all their columns; texts are read twice and not moved."""
    model = train_on_texts(docs, labels, label, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            if batch.num_rows:
                x = np.array([statistics(t) for t in batch.column(text).to_pylist()], np.float32).astype(np.float64)
                yield batch.filter(pa.array(model.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)
