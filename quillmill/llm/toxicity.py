"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positive class. The unlabelled class are texts of the rows that may be
learnt, taken whatever their label says: no label but "toxic" is ever looked at. Features are the
presence of words and of word beginnings (four to seven letters) in the whole text. Features are
screened by document counts: with the class prior, the counts of both kinds give the rate at which a
clean text would hold the feature, and those that clean texts hold hardly ever are kept. A linear
classifier is then trained in numpy on the non-negative risk

    prior * R_positive(+) + max(0, R_unlabelled(-) - prior * R_positive(-))

where the prior is the share of confirmed toxic texts among the rows of the labels.

The classifier is fit on a bounded sample of labelled rows: at most about ``positives`` toxic ones and
``unlabelled`` others, picked by a hash of the id (a bounded table, broadcast), of which one text of each
group of copies counts, so that the words of a copied text are no evidence.

The score is the sigmoid of the classifier's margin, as the loss has it, so neither the training nor the
scores need a clean label. Every text is scored whole.

Defined results: null and empty texts hold no feature and get the score of the constant; without toxic labels
to learn from, every score is the prior (0 without any label); labels of an id that contradict each
other count as unlabelled, rows without an id are left out; repeated documents get equal scores;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import releasing, slices, written
from quillmill.llm.quality import learnable

_WORD = re.compile(r"[^\W\d_]+")
MOST_FEATURES = 4096
BEGINNINGS = (4, 5, 6, 7)


def forms(text: str | None) -> set[str]:
    """The features of a text: its distinct words, and their first four to seven letters with a star."""
    words = set(_WORD.findall((text or "").lower()))
    return words.union(*({w[:k] + "*" for w in words if len(w) > k} for k in BEGINNINGS))


@dataclass
class Model:
    prior: float
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def hits(self, text: str | None) -> list[int]:
        """The features of the model that a text holds."""
        index = self.index
        return sorted(index[f] for f in forms(text) if f in index)

    def margin(self, rows: list[list[int]]) -> np.ndarray:
        """The weights' sum; the last weight is the constant."""
        return Rows(rows).dot(self.weights)

    def score(self, rows: list[list[int]]) -> np.ndarray:
        return _sigmoid(self.margin(rows)) if self.index else np.full(len(rows), self.prior)


class Rows:
    """Distinct sets of features with their counts, kept sparse."""

    def __init__(self, rows: list[list[int]], counts: list[int] | None = None):
        self.n = len(rows)
        self.counts = np.ones(self.n) if counts is None else np.asarray(counts, np.float64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.feature = np.fromiter((i for r in rows for i in r), np.int64, len(self.row))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.feature], minlength=self.n) + w[-1]

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        """The transposed product; the last entry is the constant's."""
        return np.append(np.bincount(self.feature, g[self.row], minlength=size), g.sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk(positive: Rows, unlabelled: Rows, w: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk with the sigmoid loss: of the positive class, and of the negative one as the unlabelled rows tell it."""
    p, u = positive.counts / max(1.0, positive.counts.sum()), unlabelled.counts / max(1.0, unlabelled.counts.sum())
    sp, su = _sigmoid(positive.dot(w)), _sigmoid(unlabelled.dot(w))  # the loss of class + is 1 - s, of class - it is s
    return prior * float(p @ (1 - sp)), float(u @ su) - prior * float(p @ sp)


def train_nnpu(positive: Rows, unlabelled: Rows, size: int, prior: float, epochs: int = 500, rate: float = 0.05, decay: float = 1e-6) -> np.ndarray:
    """Weights (constant last) of a linear classifier by the non-negative risk with the sigmoid loss.

    When the corrected negative risk falls below zero, the step goes up that part's gradient, as the
    estimator asks.
    """
    p, u = positive.counts / max(1.0, positive.counts.sum()), unlabelled.counts / max(1.0, unlabelled.counts.sum())
    w = np.zeros(size + 1)
    w[-1] = -1.0
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, epochs + 1):
        sp, su = _sigmoid(positive.dot(w)), _sigmoid(unlabelled.dot(w))
        slope_p, slope_u = positive.back(p * sp * (1 - sp), size), unlabelled.back(u * su * (1 - su), size)
        negative = u @ su - prior * (p @ sp)
        corrected = slope_u - prior * slope_p
        gradient = (-prior * slope_p + corrected) if negative >= 0 else -corrected
        gradient = gradient + decay * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def _least_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three numbers of each of which copies and most near copies share, and others hardly ever: pairs of least hashes of the longer words."""
    for batch in slices(batches, 1024):
        rows = []
        for t in batch.column("text").to_pylist():
            words = [w for w in set(_WORD.findall((t or "").lower())) if len(w) > 5] or [t or ""]
            least = [min(xxhash.xxh3_64_intdigest(w, k) for w in words) for k in range(6)]
            rows.append([xxhash.xxh3_64_intdigest(f"{a} {b}") >> 1 for a, b in zip(least[::2], least[1::2], strict=True)])
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("row"), *(pa.array(c, pa.int64()) for c in cols)], names=["kind", "row", "g0", "g1", "g2"])


def _one_of_each_group(sample: DataFrame) -> DataFrame:
    """One text of each group of copies and near copies of a kind; of a bounded sample, so the rows kept may be broadcast."""
    sample = sample.withColumn("row", F.xxhash64("text"))
    left = sample.mapInArrow(_least_hashes, "kind int, row long, g0 long, g1 long, g2 long")
    for g in ("g0", "g1", "g2"):
        left = left.groupBy("kind", g).agg(F.min(F.struct("row", "g0", "g1", "g2")).alias("x")).select("kind", "x.row", "x.g0", "x.g1", "x.g2")
    left = written(left.select("kind", "row"), "rows")
    return written(sample.join(F.broadcast(left), ["kind", "row"]).dropDuplicates(["kind", "row"]).select("text", "kind"), "sample")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = 10_000, unlabelled: int = 20_000) -> Model:
    """Fit on ``docs`` (doc_id, text) and the labels that may be learnt."""
    known = labels.where(learnable(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("label"))
    known = known.groupBy("doc_id").agg(F.min("label").alias("least"), F.max("label").alias("most")).select("doc_id", ((F.col("least") == 1) & (F.col("most") == 1)).alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.count_if("toxic")).first()
    if not toxic or toxic == n:
        return Model(toxic / n if n else 0.0)
    cut_p, cut_u = min(1.0, positives / toxic), min(1.0, unlabelled / n)

    def some(rows: DataFrame, share: float, kind: int) -> DataFrame:
        return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1e6)).select("doc_id", F.lit(kind).alias("kind"))

    # kinds: 1 confirmed toxic, -1 any row of the labels
    wanted = some(known.where("toxic"), cut_p, 1).unionByName(some(known, cut_u, -1))
    sample = _one_of_each_group(docs.where(learnable(F.col("doc_id"))).join(F.broadcast(wanted), "doc_id").select("text", "kind"))
    sizes = {r["kind"]: r["count"] for r in sample.groupBy("kind").count().collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(-1, 0)
    prior = min(1.0, (n_p / cut_p) / max(1.0, n_u / cut_u))
    if not n_p or not n_u or prior >= 1:
        return Model(prior)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts: dict[str, list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["f", "p", "u"])

        counts: dict[str, list[int]] = {}
        for batch in slices(batches, 1024):
            for t, kind in zip(batch.column("text").to_pylist(), batch.column("kind").to_pylist(), strict=True):
                for f in forms(t):
                    counts.setdefault(f, [0, 0])[0 if kind == 1 else 1] += 1
            if len(counts) > 500_000:
                yield rows(counts)
                counts = {}
        yield rows(counts)

    counts = sample.mapInArrow(lambda batches: releasing(explode(batches)), "f string, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    p, u = F.col("p") / n_p, F.col("u") / n_u
    clean = F.greatest(F.lit(0.0), (u - prior * p) / (1 - prior))  # the rate in clean texts
    z = (p - u) / F.sqrt((u + 1 / n_u) / n_p)
    chosen = counts.where((F.col("p") >= max(4, n_p // 100)) & (z > 4) & (clean < 0.15 * p)).select("f", z.alias("z")).orderBy(F.desc("z"), "f").limit(MOST_FEATURES)
    model = Model(prior, {r["f"]: i for i, r in enumerate(chosen.collect())})
    if not model.index:
        return model

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            rows = [model.hits(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(rows, pa.list_(pa.int32()))], names=["kind", "hits"])

    rows = sample.mapInArrow(found, "kind int, hits array<int>").groupBy("kind", "hits").count().collect()  # at most a row for each row of the sample
    rows.sort(key=lambda r: (r["kind"], r["hits"]))
    confirmed, others = [r for r in rows if r["kind"] == 1], [r for r in rows if r["kind"] == -1]
    as_rows = lambda x: Rows([r["hits"] for r in x], [r["count"] for r in x])
    model.weights = train_nnpu(as_rows(confirmed), as_rows(others), len(model.index), prior)
    return model


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", least: float = 0.7, **bounds) -> DataFrame:
    """doc_id, held_out, score and predicted for each document."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    model = train(source, labels, label, **bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            if batch.num_rows:
                rows = [model.hits(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(rows), pa.float64())], names=["doc_id", "score"])

    scored = source.mapInArrow(run, T.StructType([source.schema["doc_id"]]).add("score", T.DoubleType()))
    held_out = F.coalesce(~learnable(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
