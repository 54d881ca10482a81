"""Queries against their SQL on small tables where rounding decides."""

from __future__ import annotations

import duckdb
from compare import same

from quillmill.operators import series
from quillmill.plans import registry


def twin(spark, path, name, table, rows, schema):
    """Runs ``name`` and its SQL over ``rows``, and returns what the query gave."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{table}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")  # sums of doubles in one order
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(path))
    same(df, con, registry.ORACLE_SQL[name])
    return df


def events(values, user=1):
    """Events of one user, a second apart; ``ts`` counts them."""
    return [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", user, "view", float(v)) for i, v in enumerate(values)]


EVENTS = "event_id long, ts string, user_id long, event_type string, value double"


def test_squeezed_pause_at_its_limit(spark, tmp_path):
    """A pause of 0.3 s, by rounding a little more, is over 0.28 + 0.02."""
    r = twin(spark, tmp_path, "squeezed_pauses", "events", events([0.16, 1.02, 0.25, 0.92, 0.5]), EVENTS).first()
    assert (r["runs"], r["kept"], r["last"]) == (4, 2.37, 2.32)


def test_cut_entities_stay(spark, tmp_path):
    """An entity without its semicolon, as cut titles end with, is text; one made by another's replacement too."""
    html = ["<title>ver&amp</title><h1>a &amp; b</h1>", "<title>&amp;lt; &#39;&nbsp;</title><h1>&copy; &#65;</h1>", "<title></title>", "", None]
    rows = [(i, "u", h) for i, h in enumerate(html)]
    got = {r["page_id"]: (r["title"], r["heading"]) for r in twin(spark, tmp_path, "page_cards", "pages", rows, "page_id long, url string, html string").collect()}
    assert got == {0: ("ver&amp", "a & b"), 1: ("&lt; '\xa0", "&copy; &#65;"), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_limit_between_frames(spark, tmp_path):
    """The first frame is the limit itself, by a percentile rounded once; by one rounded twice it is over it."""
    quiet, loud = [13.43, 10.23, 5.02, 11.32, 9.12, 2.25], [22.37, 21.54, 22.52, 16.25, 17.94, 13.47]
    r = twin(spark, tmp_path, "voiced_frames", "events", events(quiet + loud), EVENTS).first()
    assert (r["voiced"], r["first"]) == (8, 4)


def test_limit_inside_a_pause(spark, tmp_path):
    """A frame in a pause is over the limit by the last bit, and the pause ends there."""
    quiet = [4.79, 1.09, 1.89, 5.81, 3.09, 3.55, 4.29, 3.8, 10.73, 5.26, 4.12, 5.33]
    r = twin(spark, tmp_path, "voice_pauses", "events", events([23.04, 30.37, 39.5, *quiet, 34.04, 21.8, 22.22]), EVENTS).collect()
    assert [(x["t0"], x["t1"]) for x in r] == [(0.06, 0.09)]


def test_pauses_with_events_without_a_time(spark, tmp_path):
    """Events without a time are the last frames of their user, those without an id the last of their time."""
    rows = events([90 if i in (0, 10, 30) else 0 for i in range(40)])
    rows[0] = (0, None, *rows[0][2:])
    rows.append((None, *rows[20][1:4], 90.0))
    r = twin(spark, tmp_path, "voice_pauses", "events", rows, EVENTS).orderBy("t0").collect()
    assert [(x["t0"], x["t1"]) for x in r] == [(0.13, 0.18), (0.24, 0.28), (0.34, 0.38)]


RISES = [4.8, 8.0, 5.4, 0.3, 7.5, 0.1, 8.9, 5.2, 5.6, 2.1, 7.8, 3.3, 5.2, 0.5, 6.1, 7.6, 5.5, 7.3]


def test_equal_rises_by_the_last_bit(spark, tmp_path):
    """Rises that are equal on paper have the rank that the order of addition gives them in the SQL.

    DuckDB adds in this order from some thousand rows on; in smaller tables it joins the other way round.
    """
    rows = [e for user in range(600) for e in events(RISES, user)]
    r = twin(spark, tmp_path, "downbeat_sections", "events", rows, EVENTS).where("user_id = 7").orderBy("rank").collect()
    assert [x["t"] for x in r] == [13.0, 5.0, 9.0]


STEPS = [[40.93, 80.04, 98.77, 137.88], [24.54, 58.81, 84.76, 119.03], [67.54, 112.25, 74.52, 119.23], [82.55, 130.81, 99.64, 147.9], [7.13, 63.47, 78.16, 134.5], [29.81, 74.0, 38.85, 83.04]]


def test_peak_of_equal_steps(spark, tmp_path):
    """Two steps of a span are equal on paper; the last bit says which is its peak."""
    rows = [e for i, v in enumerate(STEPS) for e in events(v, 2 * i + 1)]
    r = twin(spark, tmp_path, "fast_spans", "events", rows, EVENTS).where("i0 = 0 and i1 = 2").collect()
    assert {x["id"]: round(x["at"] * 30) for x in r} == {f"root>u{2 * i + 1}": at for i, at in enumerate((2, 2, 0, 0, 0, 0))}


def test_drop_of_equal_rises(spark):
    """The drop among rises that are equal on paper, with both means added backwards, as the SQL of ``beat_sheets`` does from sf0.01 on."""
    values = [4.6, 4.0, 4.2, 1.0, 6.4, 1.1, 6.1, 1.1, 2.9, 6.2, 2.4, 2.9, 2.8, 8.5, 2.9, 2.9, 3.1, 4.6]
    e = spark.createDataFrame([(1, float(t), v) for t, v in enumerate(values)], "k long, t double, v double")
    r = series.beat_sheet(e.withColumnRenamed("v", "low"), e, "k", "t", "v", 10.0, 3.0, 0.5).first()
    assert (r["drop"], r["downbeats"]) == (9.0, [1.0, 5.0, 9.0, 13.0, 17.0])
