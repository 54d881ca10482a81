"""Queries of the series operators over ``events``, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import series
from quillmill.sources.tables import table

DAY = 86_400.0


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _six(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def user_event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series.sessions(_events(spark, sf_dir), "user_id", "ts", DAY, "event_id")
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def event_type_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = series.runs(_events(spark, sf_dir), "user_id", "ts", "event_type", "event_id")
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.max("length").alias("longest"))


def long_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = series.gaps(_events(spark, sf_dir), "user_id", "ts", DAY)
    return g.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))


def event_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = series.collisions(_events(spark, sf_dir), "user_id", "ts", 600.0, "event_id")
    return c.select("event_id", "user_id", *_six("wait"))


def value_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.pops(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "value").select("event_id", "value")


def value_flashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.flashes(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "value").select("event_id", "value")


def error_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("bad", F.col("event_type") == "error")
    return series.dilate(e, "user_id", ["ts", "event_id"], "bad").groupBy("user_id").agg(F.count_if("wide").alias("near_errors"))


def value_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of large values whose event numbers within a user follow each other by two at most."""
    e = _events(spark, sf_dir)
    n = F.row_number().over(series._w("user_id", "ts", "event_id")).cast("long")
    hits = e.withColumn("n", n).where("value > 20")
    return series.spans(hits, "user_id", "n", "value", 2).select("user_id", "span", "t0", "t1", "peak", "at")


def purchase_last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    out = series.as_of(left, e.where("event_type = 'view'"), "user_id", "ts", "value", "last_view")
    return out.select("event_id", "user_id", "last_view")


def nearest_view_to_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return series.nearest(left, e.where("event_type = 'view'").select("user_id", "ts"), "user_id", "ts", DAY).select("event_id", *_six("offset"))


def events_outside_quiet_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events outside the half hour after every signup of anybody."""
    e = _events(spark, sf_dir).withColumn("t", series.seconds("ts"))
    quiet = e.where("event_type = 'signup'").select(F.col("t").alias("t0"), (F.col("t") + 1800).alias("t1"))
    return series.in_intervals(e, quiet, "t", 1800.0, "left_anti").select("event_id", "user_id")


def session_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = series.rhythm(_events(spark, sf_dir), "user_id", "ts")
    return r.select("user_id", "gaps", *(F.round(c, 3).alias(c) for c in ("mean_gap", "min_gap", "max_gap", "cv")))


def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.adaptive_threshold(_events(spark, sf_dir), "user_id", "value").select("user_id", *_six("floor", "peak", "threshold"))


def phase_of_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.phase_of_most(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "value")


def raised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.raised(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "value").select("event_id", "raised")


def filled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events lose their value and get one from their neighbours."""
    e = _events(spark, sf_dir).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return series.filled(e, "user_id", "event_id", "value").select("event_id", *_six("filled"))


def timeline_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.offsets(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.least(F.col("value"), F.lit(10.0))).select("event_id", F.round("offset", 4).alias("offset"))


def arc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("x", series.seconds("ts") / 3600)
    return series.arc_length(e, "user_id", ["ts", "event_id"], "x", "value").groupBy("user_id").agg(F.round(F.max("arc"), 4).alias("arc"))


def strongest_lifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.lift(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", *_six("lift"))


def eased_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    p = F.col("value") / 50
    cols = [F.round(series.ease(k, p), 10).alias(f"ease_{k}") for k in ("linear", "in", "out", "in_out", "smooth", "out5", "expo_out", "in4")]
    return e.select("event_id", *cols, F.round(series.spring(p, 2.0, 0.5), 6).alias("spring"))


QUERIES = {
    f.__name__: f
    for f in (
        user_event_sessions, event_type_runs, long_pauses, event_collisions, value_spikes, value_flashes, error_neighbourhoods, value_spans, purchase_last_view,
        nearest_view_to_purchase, events_outside_quiet_windows, session_rhythm, adaptive_threshold, phase_of_most, raised_values, filled_values, timeline_offsets,
        arc_lengths, strongest_lifts, eased_values,
    )
}

_E = "e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events)"
_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"

ORACLE_SQL = {
    "user_event_sessions": f"""WITH {_E}, n AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {DAY} THEN 0 ELSE 1 END AS new FROM e {_W}),
        s AS (SELECT *, sum(new) OVER w AS session FROM n {_W})
        SELECT user_id, session::BIGINT AS session, count(*) AS events, min(event_id) AS first_event, max(event_id) AS last_event FROM s GROUP BY ALL""",
    "event_type_runs": f"""WITH n AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events {_W}), s AS (SELECT *, sum(new) OVER w AS run FROM n {_W}),
        r AS (SELECT user_id, run, count(*) AS length FROM s GROUP BY ALL) SELECT user_id, count(*) AS runs, max(length) AS longest FROM r GROUP BY user_id""",
    "long_pauses": f"WITH g AS (SELECT user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS a, ts AS b FROM events) SELECT user_id, epoch_us(a) AS start_us, epoch_us(b) AS end_us FROM g WHERE epoch_us(b) - epoch_us(a) >= {DAY} * 1e6",
    "event_collisions": f"WITH {_E}, n AS (SELECT *, lead(t) OVER w - t AS wait FROM e {_W}) SELECT event_id, user_id, round(wait, 6) AS wait FROM n WHERE wait < 600",
    "value_spikes": f"WITH n AS (SELECT *, (lag(value) OVER w + lead(value) OVER w) / 2 AS a FROM events {_W}) SELECT event_id, value FROM n WHERE value > 4 AND value > 3 * greatest(a, 1.0) AND a IS NOT NULL OR (a IS NULL AND value > 4 AND value > 3)",
    "value_flashes": f"""WITH n AS (SELECT *, abs(value - lag(value) OVER w) AS d, abs(lead(value) OVER w - value) AS x, abs(lead(value) OVER w - lag(value) OVER w) AS b FROM events {_W})
        SELECT event_id, value FROM n WHERE d > 4 AND x > 4 AND b < 0.25 * least(d, x)""",
    "error_neighbourhoods": """WITH n AS (SELECT user_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS wide FROM events)
        SELECT user_id, count(*) FILTER (wide > 0) AS near_errors FROM n GROUP BY user_id""",
    "value_spans": f"""WITH h AS (SELECT *, row_number() OVER w AS n FROM events {_W}), k AS (SELECT * FROM h WHERE value > 20),
        m AS (SELECT *, CASE WHEN n - lag(n) OVER (PARTITION BY user_id ORDER BY n) <= 2 THEN 0 ELSE 1 END AS new FROM k),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY n) AS span FROM m)
        SELECT user_id, span::BIGINT AS span, min(n) AS t0, max(n) AS t1, max(value) AS peak, arg_max(n, (value, -n)) AS "at" FROM s GROUP BY user_id, span""",
    "purchase_last_view": """WITH v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)
        SELECT p.event_id, p.user_id, v.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "nearest_view_to_purchase": f"""WITH {_E}, v AS (SELECT user_id, t FROM e WHERE event_type = 'view'), p AS (SELECT * FROM e WHERE event_type = 'purchase'),
        b AS (SELECT p.event_id, p.t, p.user_id, v.t AS before FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t),
        a AS (SELECT b.*, v.t AS after FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.t <= v.t),
        o AS (SELECT event_id, CASE WHEN after - t < t - before THEN after - t ELSE coalesce(before - t, after - t) END AS step FROM a)
        SELECT event_id, CASE WHEN abs(step) <= {DAY} THEN round(step, 6) END AS "offset" FROM o""",
    "events_outside_quiet_windows": f"""WITH {_E} SELECT event_id, user_id FROM e WHERE NOT EXISTS (SELECT 1 FROM e q WHERE q.event_type = 'signup' AND e.t >= q.t AND e.t < q.t + 1800)""",
    "session_rhythm": f"""WITH {_E}, g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM e)
        SELECT user_id, count(gap) AS gaps, round(avg(gap), 3) AS mean_gap, round(min(gap), 3) AS min_gap, round(max(gap), 3) AS max_gap, round(stddev_pop(gap) / avg(gap), 3) AS cv FROM g WHERE gap IS NOT NULL GROUP BY user_id""",
    "adaptive_threshold": """WITH q AS (SELECT user_id, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.95) AS b FROM events GROUP BY user_id)
        SELECT user_id, round(a, 6) AS floor, round(b, 6) AS peak, round(a + 0.4 * (b - a), 6) AS threshold FROM q""",
    "phase_of_most": f"""WITH n AS (SELECT *, (row_number() OVER w - 1) % 4 AS phase FROM events {_W}), m AS (SELECT user_id, phase, avg(value) AS mean, count(*) AS n FROM n GROUP BY ALL)
        SELECT user_id, CASE WHEN sum(n) < 8 THEN 0 ELSE arg_max(phase, (mean, -phase)) END::BIGINT AS phase FROM m GROUP BY user_id""",
    "raised_values": f"SELECT event_id, max(value) OVER w AS raised FROM events {_W}",
    "filled_values": """WITH n AS (SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        k AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS va, last_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER b AS na,
                     first_value(v IGNORE NULLS) OVER a AS vb, first_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER a AS nb FROM n
              WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN va IS NULL THEN vb WHEN vb IS NULL THEN va ELSE va + (vb - va) * (n - na) / (nb - na) END, 6) AS filled FROM k""",
    "timeline_offsets": """SELECT event_id, round(coalesce(sum(least(value, 10.0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS "offset" FROM events""",
    "arc_lengths": f"""WITH {_E}, s AS (SELECT user_id, sqrt(pow(t / 3600 - lag(t / 3600) OVER w, 2) + pow(value - lag(value) OVER w, 2)) AS step FROM e {_W}) SELECT user_id, round(coalesce(sum(step), 0), 4) AS arc FROM s GROUP BY user_id""",
    "strongest_lifts": """WITH l AS (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)
                     - avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS lift FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lift DESC, ts, event_id) AS r FROM l WHERE lift IS NOT NULL) SELECT event_id, user_id, round(lift, 6) AS lift FROM r WHERE r <= 4""",
    "eased_values": """WITH p AS (SELECT event_id, value / 50 AS u, least(1.0, greatest(0.0, value / 50)) AS p FROM events)
        SELECT event_id, round(p, 10) AS ease_linear, round(p * p * p, 10) AS ease_in, round(1 - pow(1 - p, 3), 10) AS ease_out,
               round(CASE WHEN p < 0.5 THEN 4 * p * p * p ELSE 1 - pow(2 - 2 * p, 3) / 2 END, 10) AS ease_in_out,
               round(p * p * (3 - 2 * p), 10) AS ease_smooth, round(1 - pow(1 - p, 5), 10) AS ease_out5, round(CASE WHEN p >= 1 THEN 1 ELSE 1 - pow(2, -10 * p) END, 10)::DOUBLE AS ease_expo_out, round(p * p * p * p, 10) AS ease_in4,
               round(CASE WHEN u <= 0 THEN 0 ELSE 1 - exp(-0.5 * 4 * pi() * u) * (cos(4 * pi() * sqrt(0.75) * u) + 0.5 / sqrt(0.75) * sin(4 * pi() * sqrt(0.75) * u)) END, 6) AS spring FROM p""",
}
