from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quillmill.operators import catalog, series


def test_springs(spark):
    def one(tau, f=2.0, z=0.5):
        if tau <= 0:
            return 0.0
        w = 2 * math.pi * f
        d = w * math.sqrt(1 - z * z)
        return 1 - math.exp(-z * w * tau) * (math.cos(d * tau) + z * w / d * math.sin(d * tau))

    df = spark.createDataFrame([(1, t) for t in (0.0, 0.6, 1.3)] + [(2, 0.5)], "k long, t double")
    changes = spark.createDataFrame([(1, 1.0, 3.0), (1, 0.5, 10.0)], "k long, at double, target double")
    got = {(r["k"], r["t"]): r["value"] for r in series.springs(df, changes, "k", "t", 1.0, 2.0, 0.5).collect()}
    assert got == pytest.approx({(1, t): 1 + 9 * one(t - 0.5) - 7 * one(t - 1.0) for t in (0.0, 0.6, 1.3)} | {(2, 0.5): 1.0})


def test_lines(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 2, 3.0, 4.0), (1, 3, 3.0, 10.0)], "k long, i long, x double, y double")
    got = sorted((r["n"], round(r["x"], 6), round(r["y"], 6)) for r in series.resampled(df, "k", ["i"], "x", "y", 2.5).collect())
    assert got == [(0, 0.0, 0.0), (1, 1.65, 2.2), (2, 3.0, 4.5), (3, 3.0, 7.25), (4, 3.0, 10.0)]
    curve = series.spline(df.where("i <> 2"), "k", ["i"], "x", "y", 1.25).collect()
    at = {(r["stretch"], r["k"]): (r["x"], r["y"]) for r in curve}
    assert at[1, 0] == (0.0, 0.0) and at[2, 0] == (3.0, 4.0) and at[3, 0] == (3.0, 10.0) and len(at) == 4 + 5 + 1
    part = sorted((r["i"], r["x"], r["y"]) for r in series.prefix(df, "k", ["i"], "x", "y", 0.5).collect())
    assert part[-1] == pytest.approx((3, 3.0, 4.5)) and len(part) == 4
    assert at[1, 2] == pytest.approx(((9 * 3 - 3) / 16, (9 * 4 - 10) / 16))


def test_offsets_and_windows(spark):
    beats = spark.createDataFrame([(1, t / 2, 8.0, 10.0) for t in range(20)], "k long, t double, `drop` double, duration double")
    w = series.best_window(beats, "k", "t", "drop", 4.0, 1.0).first()
    assert w["start"] == 6.0 and w["beats"] == [x / 2 for x in range(8)]
    c = spark.createDataFrame([(0.0, 1.0), (0.25, 1.0), (0.1, 1.9)], "offset double, lift double")
    keys = spark.createDataFrame([(0.25,), (1.25,)], "t double")
    assert series.best_offset(c, keys, beats.select("t")).first()["offset"] == 0.25


def test_files(spark):
    files = spark.createDataFrame([("Drums/Legacy/kick 1.wav",), ("Drums/kick-2.WAV",), ("Drums/kicker.wav",), ("Keys/kick.wav",), ("Drums/kick.txt",)], "path string")
    assert [r["path"] for r in catalog.matching_files(files, "drums", "kick").collect()] == ["Drums/kick-2.WAV", "Drums/Legacy/kick 1.wav"]
    assert catalog.listed(spark.createDataFrame([("Keys/kick.wav", 1), ("gone", 2)], "path string, n long"), files).count() == 1
    page = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert sorted(r["id"] for r in catalog.paged([page(1, 2), page(2, 3), page(1, 3), page(9)], "id").collect()) == [1, 2, 3]
    last = page(7)
    assert catalog.keep_last_good(page(1).limit(0), last) is last
    cues = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, t double")
    new = spark.createDataFrame([("b", 3.0), ("c", 4.0)], "name string, t double")
    assert sorted(map(tuple, catalog.cue_update(cues, new, "name", "t").select("name", F.col("t")).collect())) == [("a", 1.0), ("b", 3.0), ("c", 4.0)]


def test_safe_writers(spark, tmp_path):
    from quillmill.sources import files

    path = str(tmp_path / "table")
    assert files.current_table(spark, path) is None
    for n in (3, 5, 4):
        assert files.replace_table(spark.range(n), path).count() == n
        assert files.current_table(spark, path).count() == n
    with pytest.raises(Exception):  # noqa: B017, PT011
        files.replace_table(spark.range(3).select(F.raise_error(F.lit("broken")).alias("x")), path)
    assert files.current_table(spark, path).count() == 4
    kept = str(tmp_path / "kept")
    spark.range(10).withColumn("part", F.col("id") % 5).withColumn("v", F.lit(0)).write.partitionBy("part").parquet(kept)
    files.overwrite_part(spark.range(10).where("id % 5 = 2").withColumn("part", F.col("id") % 5).withColumn("v", F.lit(1)), kept, "part", "id", 10)
    assert {(r["id"], r["v"]) for r in spark.read.parquet(kept).collect()} == {(i, int(i % 5 == 2)) for i in range(10)}
    with pytest.raises(ValueError, match="whole first"):
        files.overwrite_part(spark.range(1).withColumn("part", F.lit(0)).withColumn("v", F.lit(1)), kept, "part", "id", 11)


def test_text_and_json_sources(spark, tmp_path):
    from quillmill.sources import files

    (tmp_path / "a.txt").write_text("one\ntwo", encoding="utf-8")
    (tmp_path / "b.json").write_text('{"rows": [{"id": 1, "t": "x"}, {"id": 2}]}', encoding="utf-8")
    (tmp_path / "bad.json").write_text("{", encoding="utf-8")
    assert [r["text"] for r in files.texts(spark, str(tmp_path / "a.txt")).collect()] == ["one\ntwo"]
    schema = "rows array<struct<id:long,t:string>>"
    assert sorted(map(tuple, files.json_documents(spark, str(tmp_path / "b.json"), schema, "rows").collect())) == [(1, "x"), (2, None)]
    with pytest.raises(Exception):  # noqa: B017, PT011
        files.json_documents(spark, str(tmp_path / "bad.json"), schema).collect()
    files.write_json(spark.range(3), str(tmp_path / "out"), "id")
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    with pytest.raises(RuntimeError, match="all sources"):
        files.fetch_all(spark, {"a": lambda: spark.range(0)}, {"a": "id long"})


def test_steepest_and_sections(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 3.0), (1, 2.0, 5.0), (2, 0.0, 1.0)], "k long, t double, e double")
    assert [tuple(r) for r in series.steepest(df, "k", "t", "e").collect()] == [(1, 1.0, 2.0)]
    beats = df.select("k", "t")
    assert series.section_lifts(df, beats, "k", "t", "e", reach=4.0).count() == 0


def test_camera_edges(spark):
    frames = spark.createDataFrame([(1, t) for t in (-1.0, 0.0, 1.0, 2.0, 9.0)], "k long, t double")
    keys = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 0.0), (1, 2.0, 4.0, 10.0, 20.0)], "k long, t double, zoom double, x double, y double")
    got = {r["t"]: (round(r["zoom"], 6), r["x"], r["y"]) for r in series.camera(frames, keys, "k").collect()}
    assert got == {-1.0: (1.0, 0.0, 0.0), 0.0: (1.0, 0.0, 0.0), 1.0: (2.0, 5.0, 10.0), 2.0: (4.0, 10.0, 20.0), 9.0: (4.0, 10.0, 20.0)}
