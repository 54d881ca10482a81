"""Boxes, frames, hashes and verdicts against hand-computed and plain-Python values."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quillmill.functions import motion as mo
from quillmill.operators import motion


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_hashes(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return h

    def lattice(x, y, s):
        h = (s ^ x * 0x27D4EB2D ^ y * 0x165667B1) % 2**32
        h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
        h = (h ^ h >> 12) * 0x297A2D39 % 2**32
        return h ^ h >> 15

    for s in ("", "a", "ant/body", "имя"):
        assert one(spark, mo.name_seed(F.lit(s))) == fnv(s)
    for x, y, s in ((0, 0, 0), (3, -7, 99), (-1, 2**31 - 1, 2**32 - 1)):
        assert one(spark, mo.lattice_hash(F.lit(x), F.lit(y), F.lit(s))) == lattice(x % 2**32, y % 2**32, s)
    assert abs(one(spark, mo.noise(F.lit(1.0), F.lit(2.0), F.lit(5)))) < 1e-12  # zero on the lattice


def test_scalars(spark):
    assert one(spark, mo.quantised(F.lit(0.5 / 30), 30)) == pytest.approx(1 / 30)
    assert one(spark, mo.looped(F.lit(-1.0), 4)) == 3
    assert one(spark, mo.smooth(F.lit(0.5), 0, 1)) == 0.5
    assert one(spark, mo.short_id(F.lit("div>p#a>span>b"))) == "p#a>span>b"
    assert one(spark, mo.short_id(F.lit("a>b>c>d>e"))) == "c>d>e"
    r = [F.lit(float(v)) for v in (0, 0, 2, 2, 1, 1, 5, 5)]
    assert one(spark, mo.overlap(tuple(r[:4]), tuple(r[4:]))) == 1
    w = one(spark, mo.worst_side((F.lit(-3.0), F.lit(0.0), F.lit(12.0), F.lit(5.0)), (F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0))))
    assert (w["px"], w["side"]) == (3.0, "left")


def test_shift_and_difference(spark):
    a = [0.0, 0.0, 5.0, 9.0, 5.0, 0.0, 0.0, 0.0, 0.0]
    b = [0.0, 0.0, 0.0, 0.0, 5.0, 9.0, 5.0, 0.0, 0.0]
    row = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(mo.best_shift(F.col("a"), F.col("b"), 3).alias("s"), mo.mean_difference(F.col("a"), F.col("b")).alias("d")).first()
    assert row["s"]["shift"] == pytest.approx(2) and row["s"]["residual"] == 0
    assert row["d"] == row["s"]["still"] == pytest.approx(sum(abs(x - y) for x, y in zip(a, b, strict=True)) / 9)


BOX = "i long, t double, id string, key string, cx double, cy double, w double, h double, opacity double, is_on boolean"


def test_visible_and_fast(spark):
    rows = [(0, 0.0, "a", "k", 0.0, 0.0, 10.0, 10.0, 1.0, True), (1, 0.1, "a", "k", 100.0, 0.0, 10.0, 10.0, 1.0, True), (0, 0.0, "a>b", "k", 0.0, 0.0, 5.0, 5.0, 1.0, True), (1, 0.1, "a>b", "k", 100.0, 0.0, 5.0, 5.0, 1.0, True)]
    rows += [(0, 0.0, "bg", "k", 0.0, 0.0, 100.0, 90.0, 1.0, True), (0, 0.0, "faint", "k", 0.0, 0.0, 9.0, 9.0, 0.01, True), (0, 0.0, "thin", "k", 0.0, 0.0, 1.0, 9.0, 1.0, True)]
    df = spark.createDataFrame(rows, BOX)
    assert {r["id"] for r in motion.visible(df, 100, 100).collect()} == {"a", "a>b"}
    assert [(r["id"], r["px"]) for r in motion.fast_moves(df, 10, 50).collect()] == [("a", 100.0)]
    assert motion.fast_moves(df, 10, 50, [0.1]).count() == 0


def test_spans_survivors_outside(spark):
    df = spark.createDataFrame([(i, i / 10, "k", float(v)) for i, v in ((1, 2), (2, 9), (3, 4), (7, 1))], "i long, t double, id string, v double")
    got = sorted((r["i0"], r["i1"], r["peak"], r["at"]) for r in motion.consecutive(df, ["id"], "v").collect())
    assert got == [(1, 3, 9.0, 0.2), (7, 7, 1.0, 0.7)]
    cut = "cut double, id string, key string, cx double, cy double, area double, vis double"
    a = spark.createDataFrame([(1.0, "p", "x", 0.0, 0.0, 100.0, 100.0), (1.0, "p>q", "y", 0.0, 0.0, 50.0, 50.0), (1.0, "r", "old", 0.0, 0.0, 50.0, 50.0), (1.0, "s", "z", 0.0, 0.0, 1.0, 1.0)], cut)
    b = spark.createDataFrame([(1.0, "p", "x", 3.0, 4.0, 121.0, 100.0), (1.0, "p>q", "y", 0.0, 0.0, 50.0, 50.0), (1.0, "r", "new", 0.0, 0.0, 50.0, 50.0), (1.0, "s", "z", 0.0, 0.0, 1.0, 1.0)], cut)
    kept = motion.survivors(a, b, 10).collect()
    assert [(r["id"], r["moved"], round(r["scale"], 2), r["moves"]) for r in kept] == [("p", 5.0, 1.1, True)]
    boxes = spark.createDataFrame([(0, 0.0, ".x", 5.0, 5.0, 12.0, 4.0), (1, 9.0, ".x", 5.0, 5.0, 12.0, 4.0), (0, 0.0, ".y", 5.0, 5.0, 10.9, 4.0)], "i long, t double, sel string, cx double, cy double, w double, h double")
    rules = spark.createDataFrame([(".x", None, None, None, None, 0.0, 5.0), (".y", None, None, None, None, None, None), (".z", 0.0, 0.0, 1.0, 1.0, None, None)], "sel string, x0 double, y0 double, x1 double, y1 double, `from` double, `to` double")
    assert [(r["i"], r["sel"], r["px"], r["side"]) for r in motion.outside(boxes, rules, 10, 10).collect()] == [(0, ".x", 1.0, "left")]
    assert [r["sel"] for r in motion.unmatched(rules, boxes).collect()] == [".z"]


@pytest.mark.parametrize(("d", "seam", "want"), [([2, 2, 2, 2], 2, "ok"), ([2, 2, 2, 2], 9, "JUMP"), ([2, 2, 2, 2], 0.1, "HOLD"), ([1, 3, 3, 5], 3, "SPEED BREAK")])
def test_loop_seam(spark, d, seam, want):
    df = spark.createDataFrame([(1, i + 1, float(v), float(seam)) for i, v in enumerate(d)], "k long, n long, d double, seam double")
    assert motion.loop_seam(df, "k").first()["verdict"] == want


def test_levels(spark):
    m = spark.createDataFrame([(-14.0, -1.0, 3.0, 9.0, 0.2, 0.3, False, 20.0, 20.0, 5.0, 1.0, 0.5, 0.1), (-12.0, 0.0, 1.0, 2.0, 2.0, 0.1, True, 50.0, 0.0, 9.0, 0.0, 0.1, 0.7)], "integrated double, true_peak double, hero_lead double, phone_lead double, mono_loss double, quiet double, voice boolean, sub double, bass double, presence double, brilliance double, air double, gap double")
    good, bad = motion.verdicts(m, -14, -1).orderBy("integrated").collect()
    assert good["fails"] == [] and good["warnings"] == []
    assert bad["fails"] == ["loudness", "true peak", "hero", "phone", "mono"] and bad["warnings"] == ["sub", "harsh", "dull", "gap"]
    e = spark.createDataFrame([(1, 0, 1.0), (1, 200, 3.0), (1, 399, 5.0), (1, 600, 7.0)], "k long, ms long, e double")
    assert [round(10 ** (r["level"] / 10), 6) for r in motion.momentary(e, "k").orderBy("ms").collect()] == [1, 2, 3, 6]


def test_duck(spark):
    on = [False] * 30 + [True] * 5 + [False] * 40
    got = spark.createDataFrame([(on,)], "on array<boolean>").select(motion.duck(F.col("on"), -12, 0.06, 0.3).alias("g")).first()["g"]
    target = [-12.0 if any(on[max(0, i - 15) : i + 7]) else 0.0 for i in range(len(on))]
    g, want = 0.0, []
    for x in target:
        g = x + (g - x) * math.exp(-0.01 / (0.02 if x < g else 0.1))
        want.append(g)
    assert got == pytest.approx(want)


def test_held_drawings(spark):
    df = spark.createDataFrame([(0.0,), (1.05,), (2.5,), (9.0,)], "t double")
    got = [(round(r["shown"], 4), r["drawing"]) for r in motion.drawing(df, [(1.0, 2.0, 3)], 24).collect()]
    assert got == [(0.0, 0), (1.0, 12), (2.5, 26), (9.0, 104)]
