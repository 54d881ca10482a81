"""Queries over time lines made of ``events``: springs, lines, cameras, beats, voice, spectra; with their DuckDB twins.

Events of a user are numbered from 0; ``t`` is that number on some scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.operators import motion, series, voice
from quillmill.plans.literal import frame, values
from quillmill.sources.tables import table
from quillmill.streaming import sessions


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    w = W.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))  # where DuckDB has nulls
    return e.withColumn("n", (F.row_number().over(w) - 1).cast("long"))


def _at(spark: SparkSession, sf_dir: str, step: float) -> DataFrame:
    return _events(spark, sf_dir).withColumn("t", F.col("n") * step)


def _r(places: int, *names: str):
    return [F.round(n, places).alias(n) for n in names]


def spring_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spring to each purchase's value, the changes of a loop of 4 s repeated before it."""
    e = _at(spark, sf_dir, 0.1)
    changes = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("at"), F.col("value").alias("target"))
    out = series.springs(e.drop("value"), series.loop_changes(changes, 4.0), "user_id", "t", 1.0, 2.6, 0.7)
    return out.select("event_id", *_r(5, "value"))


def even_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all users at even distances."""
    p = series.resampled(_events(spark, sf_dir), "user_id", ["n"], "n", "value", 5.0)
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("x"), 2).alias("x"), F.round(F.sum("y"), 2).alias("y"))


def line_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = series.prefix(_events(spark, sf_dir), "user_id", ["n"], "n", "value", 0.37)
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.max_by("x", "n"), 4).alias("x"), F.round(F.max_by("y", "n"), 4).alias("y"))


def smooth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = series.spline(_events(spark, sf_dir), "user_id", ["n"], "n", "value", 4.0)
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("x"), 2).alias("x"), F.round(F.sum("y"), 2).alias("y"))


def paced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a pen has come after a quarter, a half and all of its time."""
    p = series.paced(_events(spark, sf_dir), "user_id", "n", "n", "value")
    return series.reached(p, "user_id", "n", [0.25, 0.5, 1.0]).select("user_id", "u", *_r(6, "share"))


def cut_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut of ten seconds that has the loudest event three seconds in, and its beats."""
    e = _at(spark, sf_dir, 0.5)
    whole = e.groupBy("user_id").agg(F.max("t").alias("duration"), F.max_by("t", F.struct("value", F.negative("t").alias("x"))).alias("drop"))
    out = series.best_window(e.select("user_id", "t").join(whole, "user_id"), "user_id", "t", "drop", 10.0, 3.0)
    return out.select("user_id", "start", F.array_join(F.transform("beats", lambda b: F.format_string("%.2f", b)), "|").alias("beats"))


KEY_TIMES = [(0.0,), (1.5,), (2.6,), (3.9,), (5.4,)]


def music_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset of a track that lays most key times on beats, with its lift."""
    e = _events(spark, sf_dir)
    candidates = e.where("user_id = 1").select((F.col("n") * 0.37).alias("offset"), (F.col("value") / 50).alias("lift"))
    beats = e.where("user_id = 2").select((F.col("n") * 0.41 + F.col("value") / 500).alias("t"))
    best = series.best_offset(candidates, frame(spark, KEY_TIMES, "t double"), beats)
    return best.select(*_r(6, "offset", "score"))


def downbeat_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four downbeats with the largest rise in level, by time."""
    e = _at(spark, sf_dir, 1.0)
    s = series.section_lifts(e.select("user_id", "t", "value"), e.where("n % 4 = 1").select("user_id", "t"), "user_id", "t", "value")
    return s.select("user_id", "t", *_r(6, "lift"), F.col("rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place"))


def steepest_rises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.steepest(_at(spark, sf_dir, 0.02), "user_id", "t", "value").select("user_id", *_r(6, "t", "rise"))


def spikes_off_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spikes that are not near a cut."""
    p = series.pops(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "value")
    return series.away_from(p, F.col("n") / 30, [5 / 30, 20 / 30], 2 / 30 + 1e-9).select("event_id", "value")


def beat_punches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last live beat still adds; beats inside quiet spans are none."""
    e = _at(spark, sf_dir, 0.05)
    quiet = frame(spark, [(0.5, 1.0), (2.0, 2.2)], "t0 double, t1 double")
    beats = series.in_intervals(e.where("event_type = 'view'").select("user_id", "t"), quiet, "t", 0.5, "left_anti")
    return series.punch(e.select("event_id", "user_id", "t"), beats, "user_id", "t", 0.03).select("event_id", *_r(9, "bump"))


def camera_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _at(spark, sf_dir, 0.1)
    keys = e.where("event_type = 'signup'").select("user_id", "t", (1 + F.col("value") / 100).alias("zoom"), F.col("value").alias("x"), (-F.col("value")).alias("y"))
    c = series.camera(e.join(keys.select("user_id").distinct(), "user_id", "left_semi").select("event_id", "user_id", "t"), keys, "user_id")
    return c.select("event_id", *_r(6, "zoom", "x", "y"))


def beat_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats, downbeats, sections, drop and cut of the track of each user."""
    e = _at(spark, sf_dir, 1.0)
    b = series.beat_sheet(e.select("user_id", "t", F.col("value").alias("low")), e.select("user_id", "t", "value"), "user_id", "t", "value", 10.0, 3.0, 0.5)
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.1f", x)), "|")
    w = F.col("window")
    return b.select("user_id", "duration", "bar", F.size("beats").cast("long").alias("beats"), flat("downbeats").alias("downbeats"), flat("sections").alias("sections"), "drop", w["start"].alias("start"), w["drop_in_film"].alias("drop_in_film"), flat(w["downbeats_in_film"]).alias("film"))


# ---- voice and levels


def frame_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of frames of four samples."""
    s = _events(spark, sf_dir).select("user_id", F.col("n").alias("i"), (F.col("value") / 500).alias("x"))
    return voice.frame_energy(s, "user_id", 4).select("user_id", "frame", *_r(6, "db"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _events(spark, sf_dir).select("user_id", F.col("n").alias("frame"), (F.col("value") - 60).alias("db"))
    return voice.voiced(f, "user_id")


def voiced_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).groupBy("user_id").agg(F.count_if("voice").alias("voiced"), F.min(F.when(F.col("voice"), F.col("frame"))).alias("first"))


def voice_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voice.pauses(_frames(spark, sf_dir), "user_id", 0.01, 0.02).select("user_id", *_r(4, "t0", "t1"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of voice and silence that follow each other."""
    e = _events(spark, sf_dir).withColumn("len", F.col("value") % 1.3 + 0.05)
    end = F.sum("len").over(W.partitionBy("user_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    return e.withColumn("t1", F.round(end, 6)).withColumn("t0", F.coalesce(F.lag("t1").over(W.partitionBy("user_id").orderBy("n")), F.lit(0.0))).select("user_id", "t0", "t1", (F.col("n") % 2 == 1).alias("voice"))


def squeezed_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = voice.squeezed(_runs(spark, sf_dir), "user_id")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("kept"), 4).alias("kept"), F.round(F.max("at"), 4).alias("last"))


def section_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = voice.sections(_events(spark, sf_dir).where("n < 5").withColumn("i", F.col("n") + 1), "user_id", "i", "value", holds={3: 1.25})
    return s.select("user_id", "i", *_r(4, "begin", "end"))


def _heard(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words that a recogniser hears about 0.2 s late, the pauses before every fifth, and the bounds of the voice."""
    e = _events(spark, sf_dir)
    words = e.select("user_id", F.col("n").alias("ord"), F.when(F.col("n") % 5 == 4, F.lit("x.")).otherwise(F.lit("x")).alias("word"), F.round(F.col("n") * 0.3 + 0.2 + (F.col("value") % 1) * 0.05, 6).alias("t"))
    gaps = e.where("n % 5 = 0 and n > 0").select("user_id", F.round(F.col("n") * 0.3 - 0.12, 6).alias("t0"), F.round(F.col("n") * 0.3, 6).alias("t1"))
    bounds = e.groupBy("user_id").agg(F.lit(0.0).alias("first"), F.round(F.max("n") * 0.3 + 0.25, 6).alias("last"))
    return words, gaps, bounds


def recogniser_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, gaps, bounds = _heard(spark, sf_dir)
    starts = bounds.select("user_id", F.col("first").alias("s")).unionByName(gaps.select("user_id", F.col("t1").alias("s")))
    return voice.bias(words, starts, "user_id").select("user_id", *_r(6, "bias"))


def calibrated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = voice.calibrated(*_heard(spark, sf_dir), "user_id")
    return c.select("user_id", "ord", *_r(5, "t0", "t1"))


def momentary_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "user_id", (F.col("n") * 100).alias("ms"), (F.col("value") / 500).alias("e"))
    return motion.momentary(e, "user_id").select("event_id", *_r(6, "level"))


def momentary_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest quiet stretch of series of 25 ms frames."""
    e = _events(spark, sf_dir).select("user_id", (F.col("n") * 25).alias("ms"), (F.col("value") / 1e6).alias("e"))
    return motion.momentary_gap(e, "user_id").select("user_id", *_r(4, "gap"))


def spiky_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", (F.col("value") / 100).alias("peak"), (F.col("value") / 1000).alias("energy"))
    return motion.spiky(e)


def energy_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _events(spark, sf_dir).select("user_id", (F.col("value") * 150 + 10).alias("f"), F.col("value").alias("p"))
    return motion.band_shares(s, "user_id").select("user_id", *_r(6, *(b[0] for b in motion.BANDS)))


def low_band_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _events(spark, sf_dir).select("user_id", F.floor(F.col("n") / 10).alias("frame"), (F.col("value") * 30).alias("f"), F.col("value").alias("m"))
    return motion.low_band(s, "user_id", "frame").select("user_id", "frame", *_r(6, "low"))


def event_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events against the quiet windows around them."""
    e = _at(spark, sf_dir, 0.05)
    at = e.where("event_type = 'purchase'").select("user_id", (F.col("t") + 0.01).alias("t"), F.col("value").alias("level"))
    return motion.local_floor(e.select("user_id", "t", F.col("value").alias("db")), at, "user_id").select("user_id", *_r(4, "t", "floor", "lead"))


# ---- streams


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the session stream."""
    s = sessions.sessions(_events(spark, sf_dir))
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the window stream."""
    return sessions.counts(_events(spark, sf_dir)).select(F.unix_micros("start").alias("start_us"), "event_type", "events")


QUERIES = {
    f.__name__: f
    for f in (
        spring_tracks, even_points, line_prefixes, smooth_lines, paced_lines, cut_windows, music_offsets, downbeat_sections, steepest_rises, spikes_off_cuts, beat_punches, camera_moves, beat_sheets, frame_levels,
        voiced_frames, voice_pauses, squeezed_pauses, section_times, recogniser_bias, calibrated_words, momentary_levels, momentary_gaps, spiky_events, energy_shares, low_band_levels, event_floors,
        session_windows, daily_counts,
    )
}

_N = "n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)"
_V = "WINDOW v AS (PARTITION BY user_id ORDER BY n)"
_SPRING = "CASE WHEN {0} <= 0 THEN 0 ELSE 1 - exp(-0.7 * 5.2 * pi() * ({0})) * (cos(5.2 * pi() * sqrt(0.51) * ({0})) + 0.7 / sqrt(0.51) * sin(5.2 * pi() * sqrt(0.51) * ({0}))) END"
_ARC = f"""{_N}, s AS (SELECT user_id, n, value, coalesce(sqrt(1 + pow(value - lag(value) OVER v, 2)), 0) AS step FROM n {_V}),
    a AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY n) AS arc FROM s), l AS (SELECT *, max(arc) OVER (PARTITION BY user_id) AS whole, lead(arc) OVER v AS b, lead(n) OVER v AS nx, lead(value) OVER v AS ny, count(*) OVER (PARTITION BY user_id) AS k FROM a {_V})"""
_TURN = "CASE WHEN n = 0 OR ny IS NULL THEN 0 ELSE abs(atan2(sin(w), cos(w))) END"
_HEARD = f"""{_N}, w AS (SELECT user_id, n AS ord, CASE WHEN n % 5 = 4 THEN 'x.' ELSE 'x' END AS word, round(n * 0.3 + 0.2 + (value % 1) * 0.05, 6)::DOUBLE AS t FROM n),
    g AS (SELECT user_id, round(n * 0.3 - 0.12, 6)::DOUBLE AS t0, round(n * 0.3, 6)::DOUBLE AS t1 FROM n WHERE n % 5 = 0 AND n > 0),
    bd AS (SELECT user_id, 0::DOUBLE AS first, round(max(n) * 0.3 + 0.25, 6)::DOUBLE AS last FROM n GROUP BY user_id),
    st AS (SELECT user_id, first AS s FROM bd UNION ALL SELECT user_id, t1 FROM g),
    c AS (SELECT user_id, t FROM w WHERE ord % 5 = 0 OR (SELECT count(*) FROM w x WHERE x.user_id = w.user_id AND x.ord % 5 = 0) < 2),
    m1 AS (SELECT c.user_id, c.t, arg_min(c.t - s, (abs(c.t - s), s)) AS m FROM c JOIN st USING (user_id) GROUP BY c.user_id, c.t),
    b1 AS (SELECT user_id, CASE WHEN count(*) FILTER (abs(m) < 0.45) >= 2 THEN median(m) FILTER (abs(m) < 0.45) ELSE 0 END AS b FROM m1 GROUP BY user_id),
    m2 AS (SELECT c.user_id, c.t, arg_min(c.t - b - s, (abs(c.t - b - s), s)) AS m FROM c JOIN b1 USING (user_id) JOIN st USING (user_id) GROUP BY c.user_id, c.t),
    b2 AS (SELECT user_id, any_value(b) + CASE WHEN count(*) FILTER (abs(m) < 0.3) >= 2 THEN median(m) FILTER (abs(m) < 0.3) ELSE 0 END AS bias FROM m2 JOIN b1 USING (user_id) GROUP BY user_id)"""
_RUNS = f"""{_N}, rl AS (SELECT *, round(sum(value % 1.3 + 0.05) OVER (PARTITION BY user_id ORDER BY n), 6)::DOUBLE AS t1 FROM n), rn AS (SELECT user_id, n, coalesce(lag(t1) OVER v, 0) AS t0, t1, n % 2 = 1 AS voice FROM rl {_V}),
    ri AS (SELECT *, min(t0) FILTER (voice) OVER u AS i0, least(max(t1) FILTER (voice) OVER u + 0.05, max(t1) OVER u) AS i1 FROM rn WINDOW u AS (PARTITION BY user_id)),
    rc AS (SELECT * REPLACE (greatest(t0, i0) AS t0, least(t1, i1) AS t1) FROM ri),
    rk AS (SELECT *, CASE WHEN NOT voice AND t0 > i0 AND t1 < i1 THEN CASE WHEN t1 - t0 >= 0.6 THEN 0.45 WHEN t1 - t0 > 0.28 THEN 0.28 END END AS keep FROM rc WHERE t1 > t0),
    rq AS (SELECT *, CASE WHEN t1 - t0 > keep + 0.02 THEN floor(keep * 48000 / 2) * 2 / 48000 ELSE t1 - t0 END AS kept FROM rk)"""
_VOICED = f"""{_N}, fr AS (SELECT user_id, n AS frame, value - 60 AS db FROM n), lim AS (SELECT user_id, greatest(quantile_cont(db, 0.1) + 8, quantile_cont(db, 0.95) - 38) AS lim FROM fr GROUP BY user_id),
    vo AS (SELECT user_id, frame, max(CASE WHEN db > lim THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) > 0 AS voice FROM fr JOIN lim USING (user_id))"""
_E = "e AS (SELECT *, epoch_us(ts) AS us FROM events)"

ORACLE_SQL = {
    "spring_tracks": f"""WITH {_N}, c AS (SELECT user_id, n * 0.1::DOUBLE AS "at", value AS target FROM n WHERE event_type = 'purchase'), d AS (SELECT user_id, "at" - 4.0::DOUBLE AS "at", target FROM c UNION ALL SELECT * FROM c),
        p AS (SELECT *, target - coalesce(lag(target) OVER (PARTITION BY user_id ORDER BY "at", target), 1.0) AS jump FROM d)
        SELECT event_id, round(1.0 + coalesce(sum(jump * {_SPRING.format('n * 0.1::DOUBLE - "at"')}), 0), 5) AS value FROM n LEFT JOIN p USING (user_id) GROUP BY event_id""",
    "even_points": f"""WITH {_ARC}, m AS (SELECT *, greatest(1, floor(whole / 5.0 + 0.5)) AS c FROM l WHERE b > arc),
        q AS (SELECT *, unnest(range(CASE WHEN arc > 0 THEN floor(arc * c / whole + 1e-9) + 1 ELSE 0 END::BIGINT, floor(b * c / whole + 1e-9)::BIGINT + 1)) AS i FROM m)
        SELECT user_id, count(*) AS points, round(sum(n + (nx - n) * (i * whole / c - arc) / (b - arc)), 2) AS x, round(sum(value + (ny - value) * (i * whole / c - arc) / (b - arc)), 2) AS y FROM q GROUP BY user_id""",
    "line_prefixes": f"""WITH {_ARC}, p AS (SELECT *, whole * 0.37 AS cut, lag(arc) OVER v AS pa, lag(n) OVER v AS pn, lag(value) OVER v AS pv FROM l {_V}), k AS (SELECT * FROM p WHERE arc <= cut OR pa <= cut OR pa IS NULL)
        SELECT user_id, count(*) AS points, round(arg_max(CASE WHEN arc <= cut THEN n ELSE pn + (n - pn) * (cut - pa) / (arc - pa) END, n), 4)::DOUBLE AS x, round(arg_max(CASE WHEN arc <= cut THEN value ELSE pv + (value - pv) * (cut - pa) / (arc - pa) END, n), 4) AS y FROM k GROUP BY user_id""",
    "smooth_lines": f"""WITH {_N}, p AS (SELECT user_id, n, value, coalesce(lag(n) OVER v, n) AS x0, lead(n) OVER v AS x2, coalesce(lead(n, 2) OVER v, lead(n) OVER v) AS x3, coalesce(lag(value) OVER v, value) AS y0, lead(value) OVER v AS y2, coalesce(lead(value, 2) OVER v, lead(value) OVER v) AS y3 FROM n {_V}),
        m AS (SELECT *, CASE WHEN x2 IS NULL THEN 1 ELSE greatest(1, ceil(sqrt(pow(x2 - n, 2) + pow(y2 - value, 2)) / 4.0))::INT END AS m FROM p), q AS (SELECT *, unnest(range(m)) / m AS u FROM m),
        f AS (SELECT user_id, CASE WHEN x2 IS NULL THEN n ELSE 0.5 * (2 * n + (x2 - x0) * u + (2 * x0 - 5 * n + 4 * x2 - x3) * u * u + (3 * n - x0 - 3 * x2 + x3) * u * u * u) END AS x,
                     CASE WHEN y2 IS NULL THEN value ELSE 0.5 * (2 * value + (y2 - y0) * u + (2 * y0 - 5 * value + 4 * y2 - y3) * u * u + (3 * value - y0 - 3 * y2 + y3) * u * u * u) END AS y FROM q)
        SELECT user_id, count(*) AS points, round(sum(x), 2) AS x, round(sum(y), 2) AS y FROM f GROUP BY user_id""",
    "paced_lines": f"""WITH {_ARC}, t AS (SELECT *, atan2(ny - value, nx - n) - atan2(value - lag(value) OVER v, n - lag(n) OVER v) AS w FROM l {_V}), z AS (SELECT *, {_TURN} AS turn, whole / greatest(k - 1, 1) AS d FROM t),
        g AS (SELECT *, greatest(1e-3, 7.0 / d) AS sg FROM z), h AS (SELECT x.user_id, x.n, any_value(x.arc) AS arc, any_value(x.step) AS step, any_value(x.d) AS d, any_value(x.whole) AS whole, any_value(x.b) AS b,
            sum(y.turn * exp(-pow(y.n - x.n, 2) / (2 * x.sg * x.sg))) / sum(exp(-pow(y.n - x.n, 2) / (2 * x.sg * x.sg))) AS bend FROM g x JOIN z y ON x.user_id = y.user_id AND abs(y.n - x.n) <= ceil(x.sg * 3) GROUP BY x.user_id, x.n),
        u AS (SELECT *, sum(step * (1 + 9.0 * least(bend / d, 0.3))) OVER (PARTITION BY user_id ORDER BY n) AS tau FROM h), e AS (SELECT *, lead(tau) OVER v AS tb, max(tau) OVER (PARTITION BY user_id) AS tw FROM u {_V}),
        q AS (SELECT e.*, s.u AS share_of, row_number() OVER (PARTITION BY user_id, s.u ORDER BY tau DESC, n DESC) AS r FROM e, (VALUES (0.25), (0.5), (1.0)) s(u) WHERE tb IS NOT NULL AND tau <= s.u * tw)
        SELECT user_id, share_of::DOUBLE AS u, round((arc + (b - arc) * (share_of * tw - tau) / CASE WHEN tb = tau THEN 1 ELSE tb - tau END) / whole, 6) AS share FROM q WHERE r = 1""",
    "cut_windows": f"""WITH {_N}, e AS (SELECT user_id, n * 0.5 AS t, value FROM n), d AS (SELECT user_id, max(t) AS duration, arg_max(t, (value, -t)) AS drop_at FROM e GROUP BY user_id),
        s AS (SELECT user_id, greatest(0, least(drop_at - 3.0, duration - 10.0))::DOUBLE AS start FROM d)
        SELECT user_id, start, string_agg(format('{{:.2f}}', (t - start)::DOUBLE), '|' ORDER BY t) AS beats FROM s JOIN e USING (user_id) WHERE t >= start AND t < start + 10.0 GROUP BY user_id, start""",
    "music_offsets": f"""WITH {_N}, c AS (SELECT n * 0.37::DOUBLE AS o, value / 50 AS lift FROM n WHERE user_id = 1), b AS (SELECT n * 0.41::DOUBLE + value / 500 AS t FROM n WHERE user_id = 2), k AS {values(KEY_TIMES, 'k')},
        h AS (SELECT o, lift, k, min(abs(t - (k + o))) < 0.06 AS hit FROM c, k, b GROUP BY ALL), s AS (SELECT o, lift + 1.2 * avg(CASE WHEN hit THEN 1.0 ELSE 0 END) AS score FROM h GROUP BY o, lift)
        SELECT round(o, 6) AS "offset", round(score, 6) AS score FROM s ORDER BY s.score DESC, o LIMIT 1""",
    "downbeat_sections": f"""WITH {_N}, a AS (SELECT x.user_id, x.n, coalesce((SELECT avg(value) FROM n y WHERE y.user_id = x.user_id AND y.n >= x.n AND y.n < x.n + 4), -120) - coalesce((SELECT avg(value) FROM n y WHERE y.user_id = x.user_id AND y.n >= x.n - 4 AND y.n < x.n), -120) AS lift,
            max(x.n) OVER (PARTITION BY x.user_id) AS last FROM n x),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lift DESC, n DESC) AS rank FROM a WHERE n % 4 = 1 AND n >= 4 AND n <= last - 4)
        SELECT user_id, n::DOUBLE AS t, round(lift, 6) AS lift, rank, row_number() OVER (PARTITION BY user_id ORDER BY n) AS place FROM r WHERE rank <= 4""",
    "beat_sheets": f"""WITH {_N}, m AS (SELECT user_id, n % 4 AS p, avg(value) AS a FROM n GROUP BY ALL), ph AS (SELECT user_id, arg_max(p, (a, -p)) AS phase FROM m GROUP BY user_id),
        c AS (SELECT user_id, CASE WHEN count(*) < 8 THEN 0 ELSE any_value(phase) END AS phase, max(n)::DOUBLE AS duration, count(*) AS beats FROM n JOIN ph USING (user_id) GROUP BY user_id),
        d AS (SELECT n.user_id, n.n FROM n JOIN c USING (user_id) WHERE n.n >= phase AND (n.n - phase) % 4 = 0),
        a AS (SELECT d.user_id, d.n, (SELECT avg(value) FROM n y WHERE y.user_id = d.user_id AND y.n >= d.n AND y.n < d.n + 4) - (SELECT avg(value) FROM n y WHERE y.user_id = d.user_id AND y.n >= d.n - 4 AND y.n < d.n) AS lift FROM d JOIN c USING (user_id) WHERE d.n >= 4 AND d.n <= duration - 4),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lift DESC, n DESC) AS r FROM a), s AS (SELECT user_id, string_agg(format('{{:.1f}}', n::DOUBLE), '|' ORDER BY n) AS sections, arg_min(n, r)::DOUBLE AS drop_at FROM r WHERE r <= 4 GROUP BY user_id),
        j AS (SELECT c.*, s.sections, coalesce(drop_at, beats // 3)::DOUBLE AS drop_at FROM c LEFT JOIN s USING (user_id)), k AS (SELECT *, greatest(0, least(drop_at - 3, duration - 10))::DOUBLE AS start FROM j)
        SELECT k.user_id, duration, 2::DOUBLE AS bar, beats, string_agg(format('{{:.1f}}', d.n::DOUBLE), '|' ORDER BY d.n) AS downbeats, coalesce(sections, '') AS sections, drop_at AS "drop", start, drop_at - start AS drop_in_film,
               coalesce(string_agg(format('{{:.1f}}', (d.n - start)::DOUBLE), '|' ORDER BY d.n) FILTER (d.n >= start AND d.n < start + 10), '') AS film FROM k JOIN d USING (user_id) GROUP BY ALL""",
    "steepest_rises": f"WITH {_N}, d AS (SELECT user_id, n, value - lag(value) OVER v AS rise FROM n {_V}) SELECT user_id, round(arg_max(n, (rise, -n)) * 0.02, 6)::DOUBLE AS t, round(max(rise), 6) AS rise FROM d WHERE rise IS NOT NULL GROUP BY user_id",
    "spikes_off_cuts": f"""WITH {_N}, p AS (SELECT *, (lag(value) OVER v + lead(value) OVER v) / 2 AS a FROM n {_V})
        SELECT event_id, value FROM p WHERE value > 4 AND value > 3 * greatest(coalesce(a, 1.0), 1.0) AND abs(n - 5) > 2 AND abs(n - 20) > 2""",
    "beat_punches": f"""WITH {_N}, e AS (SELECT event_id, user_id, event_type, n * 0.05::DOUBLE AS t FROM n), b AS (SELECT user_id, t FROM e WHERE event_type = 'view' AND NOT (t >= 0.5 AND t < 1.0) AND NOT (t >= 2.0 AND t < 2.2)),
        l AS (SELECT e.event_id, e.t - b.t AS s FROM e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.t >= b.t)
        SELECT event_id, round(coalesce(0.03 * (1 - pow(1 - least(1, s / 0.03), 3)) * exp(-s / 0.12), 0), 9)::DOUBLE AS bump FROM l""",
    "camera_moves": f"""WITH {_N}, k AS (SELECT user_id, n * 0.1::DOUBLE AS t, 1 + value / 100 AS z, value AS x FROM n WHERE event_type = 'signup'), m AS (SELECT *, coalesce(lead(t) OVER w, t) AS t1, coalesce(lead(z) OVER w, z) AS z1, coalesce(lead(x) OVER w, x) AS x1 FROM k WINDOW w AS (PARTITION BY user_id ORDER BY t)),
        f AS (SELECT user_id, arg_min(t, t) AS t0, arg_min(z, t) AS z0, arg_min(x, t) AS x0 FROM k GROUP BY user_id), e AS (SELECT event_id, user_id, n * 0.1::DOUBLE AS t FROM n WHERE user_id IN (SELECT user_id FROM k)),
        j AS (SELECT e.event_id, e.t, e.user_id, m.t AS a, m.t1 AS b, m.z, m.z1, m.x, m.x1 FROM e ASOF LEFT JOIN m ON e.user_id = m.user_id AND e.t >= m.t),
        p AS (SELECT j.event_id, coalesce(z, z0) AS z, coalesce(z1, z0) AS z1, coalesce(x, x0) AS x, coalesce(x1, x0) AS x1, CASE WHEN a IS NULL OR a = b THEN 1 ELSE (j.t - a) / (b - a) END AS p FROM j JOIN f USING (user_id)),
        q AS (SELECT *, CASE WHEN p < 0.5 THEN 4 * p * p * p ELSE 1 - pow(2 - 2 * p, 3) / 2 END AS k FROM p)
        SELECT event_id, round(exp(ln(z) + (ln(z1) - ln(z)) * k), 6) AS zoom, round(x + (x1 - x) * k, 6) AS x, round(-(x + (x1 - x) * k), 6) AS y FROM q""",
    "frame_levels": f"WITH {_N} SELECT user_id, n // 4 AS frame, round(10 * log10(avg(pow(value / 500, 2)) + 1e-12), 6) AS db FROM n GROUP BY user_id, n // 4 HAVING count(*) = 4",
    "voiced_frames": f"WITH {_VOICED} SELECT user_id, count(*) FILTER (voice) AS voiced, min(frame) FILTER (voice) AS first FROM vo GROUP BY user_id",
    "voice_pauses": f"""WITH {_VOICED}, c AS (SELECT *, CASE WHEN lag(voice) OVER w = voice THEN 0 ELSE 1 END AS new FROM vo WINDOW w AS (PARTITION BY user_id ORDER BY frame)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY frame) AS run FROM c),
        s AS (SELECT user_id, run, voice, min(frame) AS a, max(frame) AS b FROM r GROUP BY ALL), q AS (SELECT *, min(a) FILTER (voice) OVER u AS lo, max(b) FILTER (voice) OVER u AS hi FROM s WINDOW u AS (PARTITION BY user_id))
        SELECT user_id, round(a * 0.01, 4)::DOUBLE AS t0, round((b + 1) * 0.01, 4)::DOUBLE AS t1 FROM q WHERE NOT voice AND a > lo AND b < hi AND b + 1 - a >= 2""",
    "squeezed_pauses": f"""WITH {_RUNS}, z AS (SELECT *, coalesce(sum(kept) OVER (PARTITION BY user_id ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM rq)
        SELECT user_id, count(*) AS runs, round(sum(kept), 4) AS kept, round(max(place), 4) AS last FROM z GROUP BY user_id""",
    "section_times": f"""WITH {_N}, l AS (SELECT user_id, n + 1 AS i, value, CASE WHEN n = 0 THEN 0.5 WHEN n = 2 THEN 1.25 ELSE 0.45 END AS wait FROM n WHERE n < 5), s AS (SELECT *, sum(wait + value) OVER (PARTITION BY user_id ORDER BY i) AS e FROM l)
        SELECT user_id, i, round(e - value, 4) AS begin, round(e, 4) AS "end" FROM s""",
    "recogniser_bias": f"WITH {_HEARD} SELECT user_id, round(bias, 6)::DOUBLE AS bias FROM b2",
    "calibrated_words": f"""WITH {_HEARD}, sh AS (SELECT w.user_id, ord, t - bias AS t FROM w JOIN b2 USING (user_id)),
        nr AS (SELECT st.user_id, st.s, arg_min(sh.ord, (abs(sh.t - st.s), sh.t, sh.ord)) AS ord, min(abs(sh.t - st.s)) AS far FROM st JOIN sh USING (user_id) GROUP BY st.user_id, st.s),
        sn AS (SELECT user_id, ord, max(s) AS s FROM nr WHERE far < 0.3 GROUP BY ALL), a AS (SELECT sh.user_id, sh.ord, coalesce(sn.s, sh.t) AS t FROM sh LEFT JOIN sn ON sh.user_id = sn.user_id AND sh.ord = sn.ord),
        i AS (SELECT a.user_id, a.ord, coalesce(max(g.t1), a.t) AS t FROM a LEFT JOIN g ON a.user_id = g.user_id AND a.t > g.t0 AND a.t < g.t1 GROUP BY a.user_id, a.ord, a.t),
        m AS (SELECT i.user_id, ord, last, max(greatest(first, least(last, t))) OVER (PARTITION BY i.user_id ORDER BY ord) AS t0 FROM i JOIN bd USING (user_id)),
        x AS (SELECT *, coalesce(lead(t0) OVER (PARTITION BY user_id ORDER BY ord), last) AS nxt FROM m),
        y AS (SELECT x.user_id, x.ord, x.t0, x.nxt, min(g.t0) AS stop FROM x LEFT JOIN g ON x.user_id = g.user_id AND g.t0 > x.t0 AND g.t0 <= x.nxt GROUP BY ALL)
        SELECT user_id, ord, round(t0, 5)::DOUBLE AS t0, round(greatest(coalesce(stop, nxt), t0 + 0.04), 5)::DOUBLE AS t1 FROM y""",
    "momentary_levels": f"WITH {_N} SELECT event_id, round(10 * log10(avg(value / 500) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) + 1e-12), 6) AS level FROM n",
    "momentary_gaps": f"""WITH {_N}, l AS (SELECT user_id, n * 25 AS ms, -0.691 + 10 * log10(2 * avg(value / 1e6) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) + 1e-20) AS l, max(n) OVER (PARTITION BY user_id) * 25 AS e FROM n),
        h AS (SELECT *, l < -45 AND ms / 1000 + 0.2 > 0.3 AND ms / 1000 + 0.2 < e / 1000 - 0.3 AS low FROM l WHERE ms % 50 = 0 AND ms < greatest(e - 400, 1)),
        g AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ms) AS g FROM h), k AS (SELECT user_id, g, count(*) FILTER (low) AS k FROM g GROUP BY ALL)
        SELECT user_id, round(max(k) * 0.05, 4)::DOUBLE AS gap FROM k GROUP BY user_id""",
    "spiky_events": "SELECT event_id, value / 100 AS peak, value / 1000 AS energy, 20 * log10(value / 100 + 1e-9) - 10 * log10(value / 1000 + 1e-12) > 12 AS spiky FROM events",
    "energy_shares": "WITH s AS (SELECT user_id, value * 150 + 10 AS f, value AS p FROM events), t AS (SELECT user_id, sum(CASE WHEN f BETWEEN 20 AND 20000 THEN p ELSE 0 END) + 1e-30 AS t FROM s GROUP BY user_id) SELECT s.user_id, "
    + ", ".join(f"round(100 * sum(CASE WHEN f >= {lo} AND f < {hi} THEN p ELSE 0 END) / any_value(t), 6) AS {name}" for name, lo, hi in motion.BANDS)
    + " FROM s JOIN t ON s.user_id = t.user_id GROUP BY s.user_id",
    "low_band_levels": f"WITH {_N} SELECT user_id, n // 10 AS frame, round(20 * log10(sum(CASE WHEN value * 30 < 150 THEN value ELSE 0 END) + 1e-9), 6) AS low FROM n GROUP BY user_id, n // 10",
    "event_floors": f"""WITH {_N}, e AS (SELECT user_id, n * 0.05::DOUBLE AS t, value, event_type FROM n), a AS (SELECT user_id, t + 0.01 AS t, value AS level FROM e WHERE event_type = 'purchase'),
        f AS (SELECT a.user_id, a.t, a.level, quantile_cont(e.value, 0.1) AS floor FROM a JOIN e ON a.user_id = e.user_id AND e.t >= greatest(0, a.t - 1.5) AND e.t < a.t + 1.5 GROUP BY ALL)
        SELECT user_id, round(t, 4) AS t, round(floor, 4) AS floor, round(level - floor, 4) AS lead FROM f""",
    "session_windows": f"""WITH {_E}, n AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 86400000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s FROM n)
        SELECT user_id, min(us) AS start_us, max(us) + 86400000000 AS end_us, count(*) AS events FROM s GROUP BY user_id, s""",
    "daily_counts": "SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS events FROM events GROUP BY ALL",
}
