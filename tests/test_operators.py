"""Edges of the series, catalogue, word and streaming operators."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import catalog as cat
from quillmill.operators import catalog, series, words as wd
from quillmill.streaming import sessions as stream


def test_session_edge(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 10.0), (1, 2, 20.001)], "k long, id long, s double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["session"] for r in series.sessions(df, "k", "ts", 10.0, "id").collect()}
    assert got == {0: 1, 1: 1, 2: 2}  # a gap of just the limit holds together


def test_pop_thresholds(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.0, 4.0, 0.0, 4.1, 0.0, 3.0, 9.0, 3.0])], "k long, i long, v double")
    assert sorted(r["i"] for r in series.pops(df, "k", ["i"], "v").collect()) == [3]


def test_interval_edges(spark):
    rows = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 4)], "t double")
    spans = spark.createDataFrame([(1.0, 3.0), (100.0, 200.0)], "t0 double, t1 double")
    assert sorted(r["t"] for r in series.in_intervals(rows, spans, "t", 1.0).collect()) == [1.0, 2.0]
    assert sorted(r["t"] for r in series.in_intervals(rows, spans, "t", 7.0, "left_anti").collect()) == [0.0, 3.0, 4.0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.booleans(), min_size=1, max_size=20))
def test_runs_rebuild_the_series(spark, flags):
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "k long, i long, f boolean")
    out = []
    for r in sorted(series.runs(df, "k", "i", "f").collect(), key=lambda r: r["first"]):
        assert r["last"] - r["first"] + 1 == r["length"]
        out += [r["f"]] * r["length"]
    assert out == flags


def test_filled(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "k long, i long, v double")
    assert [r["filled"] for r in series.filled(df, "k", "i", "v").orderBy("i").collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_merge_rules(spark):
    a = spark.createDataFrame([(1, 0, "", 0, ["x"]), (1, 1, "two", 5, ["y", "x"])], "id long, o long, title string, n long, tags array<string>")
    b = spark.createDataFrame([(1, 0, "three", 9, ["z", ""]), (None, 1, "lost", 1, [])], "id long, o long, title string, n long, tags array<string>")
    m = catalog.merge([("a", a), ("b", b)], "id", {"title": "first", "n": "max", "tags": "union"}, "o").collect()
    assert len(m) == 1 and m[0]["title"] == "two" and m[0]["n"] == 9 and m[0]["tags"] == ["x", "y", "z"] and m[0]["sources"] == ["a", "a", "b"]


@pytest.mark.parametrize(("n", "want"), [(None, "?"), (999, "999"), (1_500, "1.5k"), (15_000, "15k"), (1_200_000, "1.2M")])
def test_human(spark, n, want):
    assert spark.createDataFrame([(n,)], "n long").select(cat.human(F.col("n")).alias("x")).first()["x"] == want


def test_small_functions(spark):
    df = spark.createDataFrame([("https://x.y/a/status/123?s=1", "1:05", "lib:drum/kick@2", "&lt;a&gt; &amp; &eacute;&#x41;")], "url string, d string, uri string, t string")
    r = df.select(cat.status_id(F.col("url")).alias("id"), cat.duration(F.col("d")).alias("d"), cat.asset(F.col("uri")).alias("a"), cat.unescape(F.col("t")).alias("t"), cat.duration(F.lit("x")).alias("bad")).first()
    assert (r["id"], r["d"], r["t"], r["bad"]) == ("123", 65.0, "<a> & éA", 0.0)
    assert tuple(r["a"]) == ("lib", "drum/kick", 2)
    assert [tuple(x)[0] for x in spark.createDataFrame([("true",), ("none",), ("-3",), ("2.5",), ("1e",)], "v string").select(cat.parsed(F.col("v")).alias("p")).select("p.kind").collect()] == ["bool", "none", "int", "float", "text"]


def test_search_tiers(spark):
    rows = [(0, "line-art film", "", 5), (1, "film", "a line art", 9), (2, "art and line", "", 7), (3, "art", "line", None), (4, "start line", "", 1)]
    df = spark.createDataFrame(rows, "id long, a string, b string, n long")
    got = catalog.search(df, ["line", "art"], F.col("a"), F.concat_ws(" ", "a", "b"), F.col("n"), "id").collect()
    assert [(r["id"], r["tier"]) for r in got] == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_unknown_cue_fails(spark):
    cues = spark.createDataFrame([("a", "cue:b")], "name string, ref string")
    words = spark.createDataFrame([("x", 0, 1.0)], "word string, ord long, t0 double")
    with pytest.raises(Exception, match="unknown reference"):
        wd.resolve(cues, words).collect()


def _words(text: str) -> list[tuple]:
    return [(1, i, w) for i, w in enumerate(text.split())]


def test_timed_script(spark):
    heard = [(1, i, w, a, b) for i, (w, a, b) in enumerate([("one", 0.0, 0.4), ("too", 0.5, 0.9), ("three", 1.0, 1.4), ("four", 1.5, 2.0), ("tea", 2.0, 2.5)])]
    wanted = spark.createDataFrame(_words("One two three 4 really tea and more") + [(2, 0, "alone")], "k long, ord long, word string")
    got = {(r["k"], r["ord"]): r for r in wd.timed_script(wanted, spark.createDataFrame(heard, "k long, ord long, word string, t0 double, t1 double"), ["k"]).collect()}
    times = lambda i: (got[1, i]["t0"], got[1, i]["t1"])
    assert [got[1, i]["missed"] for i in range(8)] == [False] * 6 + [True] * 2
    assert times(0) == (0.0, 0.4) and times(1) == (0.5, 0.9) and times(5) == (2.0, 2.5)
    # "4 really" was heard as "four": the span is shared by the lengths of the keys
    assert times(3) == pytest.approx((1.5, 1.5 + 0.5 / 7)) and times(4) == pytest.approx((1.5 + 0.5 / 7, 2.0))
    assert times(6) == pytest.approx((2.5, 2.8)) and times(7) == pytest.approx((2.8, 3.1))
    assert got[2, 0]["missed"] and (got[2, 0]["t0"], got[2, 0]["t1"]) == pytest.approx((0.0, 0.3))


def test_error_rates(spark):
    rows = [("a b c d", "a x c"), ("take 20 now", "take twenty now oh"), ("", ""), (None, "x y"), ("a b", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, a string, b string")
    got = {r["k"]: (r["n_words"], r["errors"], r["soft"], r["extra"]) for r in wd.align_texts(df, ["k"], "a", "b").collect()}
    assert got == {0: (4, 2, 0, 0), 1: (3, 0, 1, 1), 2: (0, 0, 0, 0), 3: (0, 0, 0, 1), 4: (2, 2, 0, 0)}
    assert wd.align_texts(df.limit(0), ["k"], "a", "b").count() == 0


@pytest.mark.parametrize("most", [12, 30, 42])
def test_captions_fit(spark, most):
    random.seed(3)
    text = [random.choice(["word", "longer", "a,", "end.", "extraordinary"]) for _ in range(120)]
    rows = [(1, i, i // 50, w, i * 0.3, i * 0.3 + 0.25) for i, w in enumerate(text)] + [(2, 0, 0, "x" * 100, 0.0, 0.1), (2, 1, 0, "y", 5.0, 5.1)]
    words = spark.createDataFrame(rows, "k long, ord long, section int, word string, t0 double, t1 double")
    got = sorted(wd.captions(words, ["k"], most).collect(), key=lambda r: (r["k"], r["ord"]))
    made = [r for r in got if r["k"] == 1]
    assert [m["first_word"] for m in made] == [0, *(m["last_word"] + 1 for m in made[:-1])] and made[-1]["last_word"] == 119
    assert all(len(m["text"]) <= most or " " not in m["text"] for m in made)
    assert all(m["text"] == " ".join(text[m["first_word"] : m["last_word"] + 1]) for m in made)
    assert all(a["t1"] <= b["t0"] + 1e-9 for a, b in zip(made, made[1:], strict=False))
    # a sentence end inside a caption is the last word of it
    assert not any("end." in m["text"].split()[:-1] for m in made)
    assert [(r["text"], r["t0"]) for r in got if r["k"] == 2] == [("x" * 100, 0.0), ("y", 4.95)]
    assert wd.captions(words.limit(0), ["k"]).count() == 0


def test_pieces_are_even():
    line = wd.Line([4] * 12)  # 59 characters
    assert wd.pieces(line, 0, 12, 42) == [6, 12]
    assert wd.pieces(line, 0, 12, 20) == [4, 8, 12]
    assert wd.pieces(wd.Line([100]), 0, 1, 42) == [1]


def test_script_words(spark):
    text = "# a comment\n— One — two\n  # more\nthree\n \n\n* four *\n\n"
    got = [(r["section"], r["word"]) for r in wd.script(spark.createDataFrame([(1, text), (2, None), (3, "— —")], "k long, text string"), ["k"]).orderBy("ord").collect()]
    assert got == [(1, "One —"), (1, "two"), (1, "three *"), (2, "four *")]


def test_chained_cues(spark):
    words = spark.createDataFrame([("The", 0, 1.0), ("end", 1, 2.0), ("the", 2, 3.0)], "word string, ord long, t0 double")
    cues = spark.createDataFrame([("a", "word:the#2 + 0.5"), ("b", "cue:a - 1"), ("c", "cue:b"), ("d", "cue:c + 0.25"), ("n", "7")], "name string, ref string")
    assert {r["name"]: r["t"] for r in wd.resolve(cues, words).collect()} == {"a": 3.5, "b": 2.5, "c": 2.5, "d": 2.75, "n": 7.0}


def test_stream_equals_batch(spark, sf, tmp_path):
    src = tmp_path / "in"
    events = spark.read.parquet(f"{sf}/events.parquet")
    last = events.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.expr("ts + interval 30 days")).withColumn("user_id", F.lit(-1).cast("long"))
    events.coalesce(1).write.parquet(str(src))
    last.coalesce(1).write.mode("append").parquet(str(src))  # a late mark that closes all windows
    out = stream.run_once(stream.sessions(stream.event_stream(spark, str(src), 10)), str(tmp_path / "out"), str(tmp_path / "check"))
    assert out.exception() is None
    want = stream.sessions(events.withColumn("ts", F.col("ts").cast("timestamp")))
    got = spark.read.parquet(str(tmp_path / "out")).where("user_id >= 0")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
