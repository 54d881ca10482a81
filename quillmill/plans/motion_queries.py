"""Queries of the motion and level operators over ``events`` and ``documents``, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.functions import motion as mo
from quillmill.operators import motion
from quillmill.plans.literal import frame, values
from quillmill.sources.tables import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    return e.withColumn("n", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long"))


def frozen_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.frozen(_events(spark, sf_dir).withColumnRenamed("value", "d"), "user_id", 1.0, still=9.0, least=2.0, tail=3.0)


def quiet_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = motion.quiet_share(_events(spark, sf_dir), "user_id", "value")
    return q.select("user_id", F.round("quiet", 6).alias("quiet"))


def longest_quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.longest_gap(_events(spark, sf_dir), "user_id", ["n"], "value", 10.0, 0.05).select("user_id", F.round("gap", 4).alias("gap"))


def loudest_rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "user_id", (F.unix_micros("ts") / 1e6).alias("t"), F.col("value").alias("level"))
    return motion.rivals(e, "user_id", 86_400.0).select("event_id", "rival")


def name_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source").distinct()
    return d.select("source", mo.name_seed(F.col("source")).alias("seed"))


def held_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", (F.col("n") / 7).alias("t"))
    return motion.drawing(e, [(1.0, 2.0, 3), (3.0, 4.0, 1)]).select("event_id", F.round("shown", 6).alias("shown"), F.col("drawing").cast("long").alias("drawing"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each event, and one inside it for users with an even number."""
    v = F.col("value")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts").withColumn("n", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long"))
    rows = e.select(
        F.col("n").alias("i"), (F.col("n") / 30).alias("t"), F.concat(F.lit("root>u"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("key"), F.col("event_type").alias("sel"),
        (v * 3).alias("cx"), ((v * 7) % 50).alias("cy"), v.alias("w"), (v / 2).alias("h"), F.when(F.col("event_type") == "error", 0.01).otherwise(1.0).alias("opacity"), (v > 3).alias("is_on"),
        (v * v / 2).alias("area"), (v * v / 2).alias("vis"), "user_id",
    )
    return rows.unionByName(rows.where("user_id % 2 = 0").withColumn("id", F.concat("id", F.lit(">leaf"))))


def visible_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.visible(_boxes(spark, sf_dir), 100, 60).groupBy("user_id").agg(F.count(F.lit(1)).alias("boxes"))


def fast_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that move too far to the next frame, but those inside another such box."""
    f = motion.fast_moves(_boxes(spark, sf_dir), 30, 80.0, [0.31, 1.02])
    return f.select("i", "id", F.round("px", 4).alias("px"))


def fast_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = motion.consecutive(motion.fast_moves(_boxes(spark, sf_dir), 30, 40.0), ["id"], "px")
    return s.select("id", "i0", "i1", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"), F.round("peak", 4).alias("peak"), F.round("at", 6).alias("at"))


def severest_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve largest steps of a report, and how many there are."""
    f = motion.fast_moves(_boxes(spark, sf_dir), 30, 40.0)
    return motion.severest(f, "px", "id", "i").select("id", "i", F.round("px", 4).alias("px"), "in_all")


def cut_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still there after a cut between the fourth and the fifth frame."""
    b = _boxes(spark, sf_dir).withColumn("cut", F.lit(1))
    s = motion.survivors(b.where("i = 3"), b.where("i = 4"), 2.0)
    return s.select("id", F.round("moved", 4).alias("moved"), F.round("scale", 6).alias("scale"), "moves")


RULES = [("view", 0.0, 0.0, 80.0, 40.0, 0.0, 1.0), ("click", None, None, None, None, None, None), ("purchase", 10.0, 0.0, None, 30.0, 0.5, None), ("nothing", None, None, None, None, None, None)]


def _rules(spark: SparkSession) -> DataFrame:
    return frame(spark, RULES, "sel string, x0 double, y0 double, x1 double, y1 double, `from` double, `to` double")


def unmatched_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.unmatched(_rules(spark), _boxes(spark, sf_dir)).select("sel")


def boxes_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = motion.outside(_boxes(spark, sf_dir), _rules(spark), 100.0, 60.0)
    return o.groupBy("sel", "side").agg(F.count(F.lit(1)).alias("boxes"), F.round(F.max("px"), 4).alias("px"))


def loop_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumnRenamed("value", "d").withColumn("seam", F.first("d").over(W.partitionBy("user_id").orderBy("n").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return motion.loop_seam(e, "user_id").select("user_id", "into", "out", "median", "seam", "verdict")


def mix_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts and warnings from measures of each user's events."""
    v = F.col("value")
    m = _events(spark, sf_dir).groupBy("user_id").agg(
        (F.avg(v) - 24).alias("integrated"), (F.max(v) / 40 - 3).alias("true_peak"), (F.min(v) * 5).alias("hero_lead"), (F.avg(v)).alias("phone_lead"), (F.stddev_pop(v) / 20).alias("mono_loss"), (F.min(v) / 2).alias("quiet"),
        (F.count(F.lit(1)) % 2 == 0).alias("voice"), (F.max(v) / 2).alias("sub"), (F.avg(v)).alias("presence"), (F.min(v) / 10).alias("brilliance"), (F.min(v) / 10).alias("air"), F.min(v).alias("bass"), (F.avg(v) / 20).alias("gap"),
    )
    return motion.verdicts(m, -14.0, -1.5).select("user_id", F.array_join("fails", ",").alias("fails"), F.array_join("warnings", ",").alias("warnings"))


def ducked_beds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of a bed under the voice."""
    e = _events(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    on = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", (F.col("event_type") == "view").alias("on")))), lambda x: x["on"]).alias("on"))
    g = on.select("user_id", F.posexplode(motion.duck(F.col("on"), -9.0, 0.06, 0.3)).alias("n", "gain"))
    return g.select("user_id", F.col("n").cast("long").alias("n"), F.round("gain", 6).alias("gain"))


def fast_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves found by the shift of profiles: each frame shows the last twelve values."""
    w = W.partitionBy("user_id").orderBy("n")
    e = _events(spark, sf_dir).withColumn("d", F.abs(F.col("value") - F.lag("value").over(w))).withColumn("p", F.collect_list("value").over(w.rowsBetween(-11, 0)))
    f = motion.fast_by_profile(e.where("n >= 11").select("user_id", "n", "d", F.array("p").alias("profiles")), "user_id", 30.0, 30.0, [0.5], [(1.0, 1.2)], 20.0, 3)
    return f.select("user_id", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"), F.round("px", 4).alias("px"))


TAGS = [(1, "yuv420p", "tv", "bt709", "bt709", "bt709"), (2, "yuv420p", "pc", "bt709", "bt709", "bt709"), (3, "yuv420p", "tv", "bt709", None, "bt709")]


def colour_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("pix_fmt", "color_range", "color_space", "color_primaries", "color_transfer")
    s = frame(spark, TAGS, "k long, " + ", ".join(f"{n} string" for n in names))
    return motion.colours_ok(s.select("k", F.struct(*names).alias("tags"))).select("k", "ok")


def scalar_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains, clocks, phases, rectangles and paths of single events."""
    e, v = _events(spark, sf_dir), F.col("value")
    t = F.col("n") / 7
    box, area = (v - 5, v / 3 - 2, v + 20, v / 3 + 6), (F.lit(0.0), F.lit(0.0), F.lit(30.0), F.lit(10.0))
    pan = mo.pan(F.sin(v))
    worst = mo.worst_side(box, area)
    path = F.concat(F.lit("html>body>#a"), (F.col("n") % 3).cast("string"), F.when(F.col("n") % 2 == 0, F.lit(">div>p>span")).otherwise(F.lit(">b")))
    cols = {
        "gain": mo.db_to_gain(-v / 10), "left": pan["left"], "right": pan["right"], "cycle": mo.cycle(t, 1.7, 6.0), "looped": mo.looped(t - 3, 4.0), "quantised": mo.quantised(t, 30.0), "smooth": mo.smooth(v, 5.0, 40.0),
        "warped": mo.warped(t, F.lit(2.0), 4.0), "overlap": mo.overlap(box, area), "out_by": worst["px"], "clamped": mo.clamp(v / 20), "mixed": mo.lerp(F.lit(2.0), v, F.lit(0.25)),
    }
    return e.select("event_id", *(F.round(c, 7).alias(k) for k, c in cols.items()), worst["side"].alias("side"), mo.short_id(path).alias("short"))


def noise_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded draws, noise and moved points."""
    e, v = _events(spark, sf_dir), F.col("value")
    b = mo.boil(v * 9, v * 5, F.lit(7).cast("long"), F.col("n"))
    return e.select("event_id", F.round(mo.uniform(F.col("user_id"), F.col("n") + 1), 9).alias("draw"), F.round(mo.noise(v / 3, v / 7, F.lit(5).cast("long")), 7).alias("noise"), F.round(b["x"], 6).alias("x"), F.round(b["y"], 6).alias("y"))


def sub_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of the pictures of blurred frames around two cuts."""
    e = _events(spark, sf_dir).withColumn("t", F.col("n") / 30)
    return e.select("event_id", F.posexplode(mo.sub_times(F.col("t"), 30.0, 4, [0.1, 0.505])).alias("k", "at")).select("event_id", F.col("k").cast("long").alias("k"), F.round("at", 7).alias("at"))


def profile_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute difference of neighbouring frames, and the root mean square of a user's values."""
    w = W.partitionBy("user_id").orderBy("n")
    e = _events(spark, sf_dir).withColumn("p", F.collect_list("value").over(w.rowsBetween(-3, 0))).where("n >= 3")
    d = e.withColumn("d", mo.mean_difference(F.col("p"), F.lag("p").over(w)))
    return d.groupBy("user_id").agg(F.round(F.max("d"), 6).alias("d"), F.round(mo.rms(F.col("value")), 6).alias("rms"))


QUERIES = {
    f.__name__: f
    for f in (
        frozen_spans, quiet_share, longest_quiet, loudest_rivals, name_seeds, held_drawings, visible_boxes, fast_boxes, fast_spans, severest_moves, cut_survivors, unmatched_rules, boxes_outside, loop_seams,
        mix_verdicts, ducked_beds, fast_profiles, colour_tags, scalar_motion, noise_fields, sub_frames, profile_differences,
    )
}

_N = "n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)"
_FNV = "list_reduce([2166136261::HUGEINT] || list_transform(string_split(source, ''), lambda c: unicode(c)::HUGEINT), lambda h, c: (xor(h::UINTEGER, c::UINTEGER)::HUGEINT * 16777619) % 4294967296)"

_BOXES = f"""{_N}, b0 AS (SELECT user_id, n AS i, n / 30 AS t, 'root>u' || user_id AS id, event_type AS key, value * 3 AS cx, (value * 7) % 50 AS cy, value AS w, value / 2 AS h, CASE WHEN event_type = 'error' THEN 0.01 ELSE 1 END AS opacity, value > 3 AS is_on, value * value / 2 AS area FROM n),
    bx AS (SELECT * FROM b0 UNION ALL SELECT * REPLACE (id || '>leaf' AS id) FROM b0 WHERE user_id % 2 = 0)"""
#: Steps over a limit; a box inside another one has the same step, so that only outer ones are left.
_FAST = """st AS (SELECT id, i, t, sqrt(pow(lead(cx) OVER v - cx, 2) + pow(lead(cy) OVER v - cy, 2)) AS px, is_on OR coalesce(lead(is_on) OVER v, false) AS seen FROM bx WINDOW v AS (PARTITION BY id ORDER BY i)),
    fa AS (SELECT i, t, id, px FROM st WHERE px > {limit} AND seen AND {cuts} AND NOT ends_with(id, '>leaf'))"""
_MUL = lambda a, b: f"((({a})::UBIGINT * ({b})::UBIGINT) % 4294967296)"


def _hash(x: str, y: str, seed: str) -> str:
    """SQL of the lattice hash; the arguments are integers."""
    u = lambda c: f"((({c})::BIGINT + 4294967296) % 4294967296)"
    h = f"xor(xor({u(seed)}::UBIGINT, {_MUL(u(x), 0x27D4EB2D)}), {_MUL(u(y), 0x165667B1)})"
    for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
        h = f"list_transform([{h}], lambda q{shift}: {_MUL(f'xor(q{shift}, q{shift} >> {shift})', factor)})[1]"
    return f"list_transform([{h}], lambda z: xor(z, z >> 15))[1]"


def _noise(x: str, y: str, seed: str) -> str:
    fade = lambda k: f"({k}) * ({k}) * ({k}) * (({k}) * (({k}) * 6 - 15) + 10)"
    ix, iy = f"floor({x})::BIGINT", f"floor({y})::BIGINT"
    fx, fy = f"({x} - floor({x}))", f"({y} - floor({y}))"

    def corner(i: int, j: int) -> str:
        angle = f"{_hash(f'{ix} + {i}', f'{iy} + {j}', seed)} * 2 * pi() / 4294967296"
        return f"(cos({angle}) * ({fx} - {i}) + sin({angle}) * ({fy} - {j}))"

    row = lambda j: f"({corner(0, j)} + ({corner(1, j)} - {corner(0, j)}) * {fade(fx)})"
    return f"(1.4142 * ({row(0)} + ({row(1)} - {row(0)}) * {fade(fy)}))"


_DRAW = """d0 AS (SELECT *, (user_id + (n + 1) * 1831565813::HUGEINT) % 4294967296 AS a FROM n), d1 AS (SELECT *, ((xor(a::UBIGINT, a::UBIGINT >> 15)::HUGEINT * (a::UBIGINT | 1::UBIGINT)) % 4294967296) AS r FROM d0),
    d2 AS (SELECT *, xor(((r + (xor(r::UBIGINT, r::UBIGINT >> 7)::HUGEINT * (r::UBIGINT | 61::UBIGINT)) % 4294967296) % 4294967296)::UBIGINT, r::UBIGINT) AS s FROM d1)"""
_SEED = _hash("7", "n % 4", str(0x5EED))
_SUB = "CASE WHEN t < 0.1 AND {0} >= 0.1 THEN 0.1 - 1e-4 WHEN t >= 0.1 AND {0} < 0.1 THEN 0.1 ELSE {0} END"
_SUB2 = "CASE WHEN t < 0.505 AND {0} >= 0.505 THEN 0.505 - 1e-4 WHEN t >= 0.505 AND {0} < 0.505 THEN 0.505 ELSE {0} END"

ORACLE_SQL = {
    "frozen_spans": f"""WITH {_N}, r AS (SELECT *, sum(CASE WHEN value < 9 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS run, count(*) OVER (PARTITION BY user_id) AS total FROM n),
        l AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY n) AS len FROM r WHERE value < 9)
        SELECT user_id, (n - 2)::DOUBLE AS t FROM l WHERE len = 2 AND n < total - 3""",
    "quiet_share": "WITH t AS (SELECT user_id, value, max(value) OVER (PARTITION BY user_id) AS top FROM events) SELECT user_id, round(avg(CASE WHEN value < top - 20 THEN 1.0 ELSE 0.0 END), 6) AS quiet FROM t GROUP BY user_id",
    "longest_quiet": f"""WITH {_N}, g AS (SELECT *, sum(CASE WHEN value < 10 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS g FROM n),
        k AS (SELECT user_id, g, count(*) FILTER (value < 10) AS k FROM g GROUP BY ALL) SELECT user_id, round(max(k) * 0.05, 4)::DOUBLE AS gap FROM k GROUP BY user_id""",
    "loudest_rivals": """SELECT a.event_id, max(b.value) AS rival FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) >= 86400000000 GROUP BY a.event_id""",
    "name_seeds": f"SELECT DISTINCT source, {_FNV}::BIGINT AS seed FROM documents",
    "held_drawings": f"""WITH {_N}, f AS (SELECT event_id, floor(n / 7 * 24 + 1e-6)::BIGINT AS f FROM n),
        s AS (SELECT * FROM (VALUES (0, 24, 2, 0), (24, 48, 3, 12), (48, 72, 2, 20), (72, 96, 1, 32), (96, 1073741824, 2, 56)) v(a, b, h, k))
        SELECT event_id, round((a + (f - a) // h * h) / 24, 6) AS shown, (k + (f - a) // h)::BIGINT AS drawing FROM f JOIN s ON f >= a AND f < b""",
    "visible_boxes": f"WITH {_BOXES} SELECT user_id, count(*) AS boxes FROM bx WHERE w >= 2 AND h >= 2 AND opacity >= 0.05 AND w * h < 0.85 * 6000 GROUP BY user_id",
    "fast_boxes": f"WITH {_BOXES}, {_FAST.format(limit=80, cuts='NOT (t < 0.31 AND t + 1 / 30 >= 0.31) AND NOT (t < 1.02 AND t + 1 / 30 >= 1.02)')} SELECT i, id, round(px, 4) AS px FROM fa",
    "fast_spans": f"""WITH {_BOXES}, {_FAST.format(limit=40, cuts='true')}, g AS (SELECT *, i - row_number() OVER (PARTITION BY id ORDER BY i) AS g FROM fa)
        SELECT id, min(i) AS i0, max(i) AS i1, round(min(t), 6) AS t0, round(max(t), 6) AS t1, round(max(px), 4) AS peak, round(arg_max(t, (px, -t)), 6) AS "at" FROM g GROUP BY id, g""",
    "severest_moves": f"WITH {_BOXES}, {_FAST.format(limit=40, cuts='true')} SELECT id, i, round(px, 4) AS px, (SELECT count(*) FROM fa) AS in_all FROM fa ORDER BY fa.px DESC, id, i LIMIT 12",
    "cut_survivors": f"""WITH {_BOXES}, a AS (SELECT * FROM bx WHERE i = 3 AND area >= 2), b AS (SELECT * FROM bx WHERE i = 4 AND area >= 2),
        k AS (SELECT b.id, sqrt(pow(b.cx - a.cx, 2) + pow(b.cy - a.cy, 2)) AS moved, sqrt(b.area / a.area) AS scale FROM b JOIN a ON a.id = b.id AND a.key = b.key WHERE NOT ends_with(b.id, '>leaf'))
        SELECT id, round(moved, 4) AS moved, round(scale, 6) AS scale, moved > 2 OR abs(scale - 1) > 0.01 AS moves FROM k""",
    "unmatched_rules": "SELECT 'nothing' AS sel",
    "boxes_outside": f"""WITH {_BOXES}, r AS {values(RULES, 'sel', 'x0', 'y0', 'x1', 'y1', 'a', 'z')},
        o AS (SELECT sel, list_sort([{{'px': coalesce(x0, 0) - (cx - w / 2), 'k': 0}}, {{'px': cx + w / 2 - coalesce(x1, 100), 'k': -1}}, {{'px': coalesce(y0, 0) - (cy - h / 2), 'k': -2}}, {{'px': cy + h / 2 - coalesce(y1, 60), 'k': -3}}])[-1] AS s
              FROM bx JOIN r ON key = sel WHERE t BETWEEN coalesce(a, 0) AND coalesce(z, 1e18))
        SELECT sel, ['left', 'right', 'top', 'bottom'][1 - s.k] AS side, count(*) AS boxes, round(max(s.px), 4) AS px FROM o WHERE s.px > 0.5 GROUP BY ALL""",
    "loop_seams": f"""WITH {_N}, s AS (SELECT user_id, arg_max(value, n) AS "into", arg_min(value, n) AS "out", list_sort(list(value))[count(*) // 2 + 1] AS median FROM n WHERE n >= 1 GROUP BY user_id), f AS (SELECT user_id, value AS seam FROM n WHERE n = 0), j AS (SELECT * FROM s JOIN f USING (user_id))
        SELECT *, CASE WHEN seam > greatest(2.5 * median, 1.8 * greatest("into", "out"), 1.5) THEN 'JUMP' WHEN greatest("into", "out") > 0.5 AND seam < 0.25 * least("into", "out") THEN 'HOLD'
            WHEN abs("into" - "out") > greatest(1.0, 0.5 * greatest("into", "out")) OR abs(seam - ("into" + "out") / 2) > greatest(1.0, 0.6 * greatest("into", "out")) THEN 'SPEED BREAK' ELSE 'ok' END AS verdict FROM j""",
    "mix_verdicts": """WITH m AS (SELECT user_id, avg(value) AS a, max(value) AS x, min(value) AS i, stddev_pop(value) AS s, count(*) % 2 = 0 AS voice FROM events GROUP BY user_id)
        SELECT user_id, array_to_string(list_filter([CASE WHEN a - 24 > -13 OR a - 24 < -20 THEN 'loudness' END, CASE WHEN x / 40 - 3 > -1.2 THEN 'true peak' END, CASE WHEN i * 5 < 2 THEN 'hero' END, CASE WHEN a < 6 THEN 'phone' END,
                 CASE WHEN i / 2 < 0.15 AND NOT voice THEN 'quiet' END, CASE WHEN s / 20 > 1 THEN 'mono' END], lambda f: f IS NOT NULL), ',') AS fails,
               array_to_string(list_filter([CASE WHEN x / 2 > 45 THEN 'sub' END, CASE WHEN a > 7.5 THEN 'harsh' END, CASE WHEN i / 10 + i / 10 < 0.2 THEN 'dull' END, CASE WHEN x / 2 + i < 18 THEN 'thin' END, CASE WHEN a / 20 > 0.6 THEN 'gap' END], lambda f: f IS NOT NULL), ',') AS warnings FROM m""",
    "ducked_beds": f"""WITH RECURSIVE {_N}, g AS (SELECT user_id, n, min(CASE WHEN event_type = 'view' THEN -9.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 15 PRECEDING AND 6 FOLLOWING)::DOUBLE AS x FROM n),
        r AS (SELECT user_id, n, x + (0 - x) * CASE WHEN x < 0 THEN exp(-0.01 / (0.06 / 3)) ELSE exp(-0.01 / (0.3 / 3)) END AS gain FROM g WHERE n = 0
              UNION ALL SELECT g.user_id, g.n, x + (gain - x) * CASE WHEN x < gain THEN exp(-0.01 / (0.06 / 3)) ELSE exp(-0.01 / (0.3 / 3)) END FROM r JOIN g ON g.user_id = r.user_id AND g.n = r.n + 1)
        SELECT user_id, n, round(gain, 6) AS gain FROM r""",
    "fast_profiles": f"""WITH {_N}, p AS (SELECT user_id, n, abs(value - lag(value) OVER v) AS d, list(value) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS b FROM n WINDOW v AS (PARTITION BY user_id ORDER BY n)),
        q AS (SELECT *, lag(b) OVER v AS a, (lag(d) OVER v + lead(d) OVER v) / 2 AS around, row_number() OVER v > 2 AND lead(d, 2) OVER v IS NOT NULL AS inside, n / 30 AS t FROM p WHERE n >= 11 WINDOW v AS (PARTITION BY user_id ORDER BY n)),
        k AS (SELECT * FROM q WHERE a IS NOT NULL AND d >= 1 AND NOT abs(t - 0.5) <= 2 / 30 AND NOT coalesce(inside AND d > 4 AND d > 3 * greatest(around, 1.0), false) AND NOT t BETWEEN 1.0 - 1 / 30 AND 1.2 + 1 / 30),
        r AS (SELECT *, list_transform(range(-3, 4), lambda s: list_sum(list_transform(range(0, 12), lambda i: abs(a[i + 1] - b[least(11, greatest(0, i + s)) + 1]))) / 12) AS res FROM k),
        m AS (SELECT *, list_min(res) AS c, list_position(res, list_min(res)) AS j FROM r),
        o AS (SELECT *, CASE WHEN j > 1 AND j < 7 AND res[j - 1] - 2 * c + res[j + 1] > 0 THEN 0.5 * (res[j - 1] - res[j + 1]) / (res[j - 1] - 2 * c + res[j + 1]) ELSE 0 END AS f FROM m),
        h AS (SELECT user_id, t, abs(j - 4 + f) * 30 AS px FROM o WHERE res[4] > 0.8 AND c < 0.35 * res[4] AND abs(j - 4 + f) * 30 > 20),
        w AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 1.5 / 30 THEN 0 ELSE 1 END AS new FROM h), z AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS s FROM w)
        SELECT user_id, round(min(t), 6) AS t0, round(max(t), 6) AS t1, round(max(px), 4) AS px FROM z GROUP BY user_id, s""",
    "colour_tags": "SELECT * FROM (VALUES (1::BIGINT, true), (2, false), (3, false)) v(k, ok)",
    "scalar_motion": f"""WITH {_N}, b AS (SELECT *, n / 7 AS t, value - 5 AS x0, value / 3 - 2 AS y0, value + 20 AS x1, value / 3 + 6 AS y1, least(1, greatest(0, (value - 5) / 35)) AS k FROM n),
        s AS (SELECT *, list_sort([{{'px': -x0, 'k': 0}}, {{'px': x1 - 30, 'k': -1}}, {{'px': -y0, 'k': -2}}, {{'px': y1 - 10, 'k': -3}}])[-1] AS w FROM b)
        SELECT event_id, round(pow(10, -value / 10 / 20), 7) AS gain, round(cos((sin(value) + 1) * pi() / 4), 7) AS "left", round(sin((sin(value) + 1) * pi() / 4), 7) AS "right", round((t % 1.5) * 4 / 6, 7) AS cycle, round((t - 3 + 4) % 4, 7) AS looped,
               round(floor(t * 30 + 0.5) / 30, 7) AS quantised, round(k * k * (3 - 2 * k), 7) AS smooth, round(2 + (t - 2) / 4, 7) AS warped, round(greatest(0, least(x1, 30) - greatest(x0, 0)) * greatest(0, least(y1, 10) - greatest(y0, 0)), 7) AS overlap,
               round(w.px, 7) + 0 AS out_by, ['left', 'right', 'top', 'bottom'][1 - w.k] AS side, round(least(1, value / 20), 7)::DOUBLE AS clamped, round(2 + (value - 2) * 0.25, 7) AS mixed, CASE WHEN n % 2 = 0 THEN 'div>p>span' ELSE '#a' || (n % 3) || '>b' END AS short FROM s""",
    "noise_fields": f"""WITH {_N}, {_DRAW}, q AS (SELECT event_id, n, value, xor(s, s >> 14) / 4294967296 AS draw, value / 3 AS u, value / 7 AS v, value * 9 / 70 AS px, value * 5 / 70 AS py, value * 9 / 70 + 41.3 AS qx, value * 5 / 70 - 17.9 AS qy, {_SEED} AS seed FROM d2)
        SELECT event_id, round(draw, 9) AS draw, round({_noise('u', 'v', '5')}, 7) AS noise, round(value * 9 + 2.3 * {_noise('px', 'py', 'seed')}, 6) AS x, round(value * 5 + 2.3 * {_noise('qx', 'qy', 'seed')}, 6) AS y FROM q""",
    "sub_frames": f"""WITH {_N}, k AS (SELECT event_id, n / 30 AS t, unnest(range(4)) AS k FROM n), a AS (SELECT *, t + ((k + 0.5) / 4 - 0.5) * (0.5 / 30) AS p FROM k), b AS (SELECT *, {_SUB.format('p')} AS q FROM a)
        SELECT event_id, k, round({_SUB2.format('q')}, 7)::DOUBLE AS "at" FROM b""",
    "profile_differences": f"""WITH {_N}, l AS (SELECT *, abs(value - lag(value) OVER v) AS a, abs(lag(value) OVER v - lag(value, 2) OVER v) AS b, abs(lag(value, 2) OVER v - lag(value, 3) OVER v) AS c, abs(lag(value, 3) OVER v - lag(value, 4) OVER v) AS d FROM n WINDOW v AS (PARTITION BY user_id ORDER BY n))
        SELECT user_id, round(max((a + b + c + d) / 4), 6) AS d, round(sqrt(avg(value * value)) + 1e-12, 6) AS rms FROM l WHERE n >= 3 GROUP BY user_id""",
}
