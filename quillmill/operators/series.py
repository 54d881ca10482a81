"""Ordered-series operators: islands, gaps, anomalies, as-of, nearest and interval joins, thresholds.

Each takes the key that splits the series and the column that orders it, and is one window sort by
that key unless it says otherwise. Where the time axis must meet many intervals, both sides are put
into buckets of time, so the join is on equality and no side is compared with all of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seconds(ts: str) -> Column:
    """A timestamp as seconds, with microseconds."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def _w(key, *order):
    return W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)


def runs(df: DataFrame, key: str, order: str, value: str, tie: str | None = None) -> DataFrame:
    """Run-length encoding: consecutive rows with one value, with first, last and length."""
    w = _w(key, order, *([tie] if tie else []))
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = df.withColumn("_change", change).withColumn("run", F.sum("_change").over(w))
    return numbered.groupBy(key, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length"))


def sessions(df: DataFrame, key: str, ts: str, gap: float, tie: str | None = None) -> DataFrame:
    """Adds ``session``: a new one begins where the gap to the row before is over ``gap`` seconds."""
    w = _w(key, ts, *([tie] if tie else []))
    return df.withColumn("_new", F.when(seconds(ts) - F.lag(seconds(ts)).over(w) <= gap, 0).otherwise(1)).withColumn("session", F.sum("_new").over(w)).drop("_new")


def gaps(df: DataFrame, key: str, ts: str, least: float) -> DataFrame:
    """Pauses between neighbours of at least ``least`` seconds; the edges of a series are none."""
    w = _w(key, ts)
    out = df.select(key, F.lag(ts).over(w).alias("start"), F.col(ts).alias("end"))
    return out.where(seconds("end") - seconds("start") >= least)


def collisions(df: DataFrame, key: str, ts: str, under: float, tie: str) -> DataFrame:
    """Rows whose next neighbour follows in less than ``under`` seconds."""
    w = _w(key, ts, tie)
    return df.withColumn("wait", F.lead(seconds(ts)).over(w) - seconds(ts)).where(F.col("wait") < under)


def pops(df: DataFrame, key: str, order: list[str], value: str, least: float = 4.0, ratio: float = 3.0) -> DataFrame:
    """Values over ``least`` and over ``ratio`` times the mean of both neighbours, or of 1."""
    w = _w(key, *order)
    around = (F.lag(value).over(w) + F.lead(value).over(w)) / 2
    return df.withColumn("_around", around).where((F.col(value) > least) & (F.col(value) > ratio * F.greatest("_around", F.lit(1.0)))).drop("_around")


def flashes(df: DataFrame, key: str, order: list[str], value: str, least: float = 4.0, ratio: float = 0.25) -> DataFrame:
    """Two large differences in a row after which the value is nearly what it was before."""
    w = _w(key, *order)
    d, nxt = F.abs(F.col(value) - F.lag(value).over(w)), F.abs(F.lead(value).over(w) - F.col(value))
    back = F.abs(F.lead(value).over(w) - F.lag(value).over(w))
    flagged = df.withColumn("_f", (d > least) & (nxt > least) & (back < ratio * F.least(d, nxt)))
    return flagged.where("_f").drop("_f")


def dilate(df: DataFrame, key: str, order: list[str], flag: str, before: int = 3, after: int = 2) -> DataFrame:
    """Adds ``wide``: whether a row or one of its neighbours (``before`` rows back, ``after`` ahead) is flagged."""
    return df.withColumn("wide", F.max(F.col(flag).cast("int")).over(_w(key, *order).rowsBetween(-before, after)) > 0)


def spans(df: DataFrame, key: str, at: str, value: str, reach: float) -> DataFrame:
    """Hits merged into spans where the step from one to the next is at most ``reach``; the peak and its place stay."""
    w = _w(key, at)
    new = F.when(F.col(at) - F.lag(at).over(w) <= reach, 0).otherwise(1)
    numbered = df.withColumn("_new", new).withColumn("span", F.sum("_new").over(w))
    peak = F.max(F.struct(F.col(value).alias("v"), (-F.col(at)).alias("x")))
    return numbered.groupBy(key, "span").agg(F.min(at).alias("t0"), F.max(at).alias("t1"), peak.alias("p")).select(key, "span", "t0", "t1", F.col("p.v").alias("peak"), (-F.col("p.x")).alias("at"))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, name: str) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before its time (``name``), null if there is none.

    Both sides are one sorted stream: right rows go before left rows of the same time, so no pair of
    rows is ever formed. Of right rows with one time, the largest value counts.
    """
    cols = left.columns
    both = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    other = right.select(key, ts, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    w = _w(key, ts, "_side", "_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.unionByName(other, allowMissingColumns=True).withColumn(name, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*cols, name)


def nearest(left: DataFrame, right: DataFrame, key: str, ts: str, within: float) -> DataFrame:
    """Each left row with the distance in seconds to the nearest right row of its key within a tolerance, the earlier one on ties."""
    cols = left.columns
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(key, ts).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    t = F.when(F.col("_side") == 0, seconds(ts))
    back = F.last(t, ignorenulls=True).over(_w(key, ts, "_side").rowsBetween(W.unboundedPreceding, W.currentRow))
    ahead = F.first(t, ignorenulls=True).over(_w(key, ts, F.desc("_side")).rowsBetween(W.currentRow, W.unboundedFollowing))
    out = both.withColumn("_b", seconds(ts) - back).withColumn("_a", ahead - seconds(ts)).where("_side = 1")
    step = F.when(F.col("_a") < F.col("_b"), F.col("_a")).otherwise(F.coalesce(-F.col("_b"), F.col("_a")))
    return out.withColumn("offset", F.when(F.abs(step) <= within, step)).select(*cols, "offset")


def in_intervals(df: DataFrame, intervals: DataFrame, t: str, width: float, how: str = "left_semi") -> DataFrame:
    """Rows whose number ``t`` is in some interval ``[t0, t1)`` (``left_semi``) or in none (``left_anti``).

    Time is cut into buckets of ``width``; an interval is listed in the buckets that it touches, and rows meet
    the intervals of their own bucket only.
    """
    cut = intervals.select("t0", "t1", F.explode(F.sequence(F.floor(F.col("t0") / width), F.floor(F.col("t1") / width))).alias("_bucket"))
    rows = df.withColumn("_bucket", F.floor(F.col(t) / width))
    return rows.join(cut, (rows["_bucket"] == cut["_bucket"]) & (rows[t] >= cut["t0"]) & (rows[t] < cut["t1"]), how).drop("_bucket")


def rhythm(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Number, mean, extremes and coefficient of variation (population) of the gaps of each series."""
    w = _w(key, ts)
    steps = df.select(key, (seconds(ts) - F.lag(seconds(ts)).over(w)).alias("gap")).where("gap is not null")
    return steps.groupBy(key).agg(F.count("gap").alias("gaps"), F.avg("gap").alias("mean_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), (F.stddev_pop("gap") / F.avg("gap")).alias("cv"))


def adaptive_threshold(df: DataFrame, key: str, value: str, low: float = 0.1, high: float = 0.95, share: float = 0.4) -> DataFrame:
    """A threshold between the quiet and the loud percentile of each series, as linear percentiles."""
    p = df.groupBy(key).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("p"))
    return p.select(key, F.col("p")[0].alias("floor"), F.col("p")[1].alias("peak"), (F.col("p")[0] + share * (F.col("p")[1] - F.col("p")[0])).alias("threshold"))


def _fused(a: Column, b: Column, c: Column) -> Column:
    """``a * b + c`` rounded once, by the exact errors of the product and the sum."""
    head = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    p, (ah, bh) = a * b, (head(a), head(b))
    lost = ((ah * bh - p) + ah * (b - bh) + (a - ah) * bh) + (a - ah) * (b - bh)
    total = p + c
    rest = total - p
    return total + F.nanvl((p - (total - rest)) + (c - rest) + lost, F.lit(0.0))


def with_percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Adds linear percentiles of each series, as DuckDB's ``quantile_cont`` has them to the last bit; rows without a key go.

    One sort by key and value; no series is held as an array.
    """
    span = W.partitionBy(key)
    place = F.when(F.col(value).isNotNull(), F.row_number().over(_w(key, F.asc_nulls_last(value))) - 1)
    rows = df.where(F.col(key).isNotNull()).withColumn("_place", place).withColumn("_last", F.count(value).over(span) - 1)
    for name, share in shares.items():
        at = F.col("_last") * share
        lower, upper = (F.max(F.when(F.col("_place") == edge(at), F.col(value))).over(span) for edge in (F.floor, F.ceil))
        rows = rows.withColumn("_lower", lower).withColumn("_upper", upper).withColumn("_part", at - F.floor(at))
        between = _fused(1 - F.col("_part"), F.col("_lower"), F.col("_part") * F.col("_upper"))
        rows = rows.withColumn(name, F.when(F.col("_part") == 0, F.col("_lower")).otherwise(between))
    return rows.drop("_place", "_last", "_lower", "_upper", "_part")


def phase_of_most(df: DataFrame, key: str, order: list[str], value: str, phases: int = 4, least: int = 8) -> DataFrame:
    """The phase (row number modulo ``phases``) with the largest mean; phase 0 for short series, the first on ties."""
    numbered = df.withColumn("phase", (F.row_number().over(_w(key, *order)) - 1) % phases)
    means = numbered.groupBy(key, "phase").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    best = means.groupBy(key).agg(F.sum("n").alias("n"), F.max(F.struct("mean", (-F.col("phase")).alias("p"))).alias("b"))
    return best.select(key, F.when(F.col("n") < least, F.lit(0)).otherwise(-F.col("b.p")).cast("long").alias("phase"))


def raised(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Monotone repair: adds ``raised``, the largest value so far."""
    return df.withColumn("raised", F.max(value).over(_w(key, *order).rowsBetween(W.unboundedPreceding, W.currentRow)))


def filled(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds ``filled``: missing values on the line between the known neighbours, by the number of rows; beyond the ends, the nearest."""
    n = F.row_number().over(_w(key, order))
    df = df.withColumn("_n", n)
    known_n, known_v = F.when(F.col(value).isNotNull(), F.col("_n")), F.col(value)
    back, ahead = _w(key, order).rowsBetween(W.unboundedPreceding, 0), _w(key, order).rowsBetween(0, W.unboundedFollowing)
    df = df.withColumn("_a", F.last(known_v, True).over(back)).withColumn("_b", F.first(known_v, True).over(ahead)).withColumn("_na", F.last(known_n, True).over(back)).withColumn("_nb", F.first(known_n, True).over(ahead))
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_n") - F.col("_na")) / (F.col("_nb") - F.col("_na"))
    out = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).otherwise(line)
    return df.withColumn("filled", out).drop("_n", "_a", "_b", "_na", "_nb")


def offsets(df: DataFrame, key: str, order: list[str], length: Column, name: str = "offset") -> DataFrame:
    """Where each segment begins when they are laid end to end."""
    w = _w(key, *order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("_len", length).withColumn(name, F.coalesce(F.sum("_len").over(w), F.lit(0.0))).drop("_len")


def arc_length(df: DataFrame, key: str, order: list[str], x: str, y: str) -> DataFrame:
    """Adds ``arc``: the length of the line from the first point to each."""
    w = _w(key, *order)
    step = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0))
    return df.withColumn("_step", step).withColumn("arc", F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_step")


def lift(df: DataFrame, key: str, order: list[str], value: str, reach: int = 4, top: int = 4) -> DataFrame:
    """Rows with the largest rise of the mean of the ``reach`` rows from here on over the ``reach`` before; ``top`` a key."""
    w = _w(key, *order)
    after, before = F.avg(value).over(w.rowsBetween(0, reach - 1)), F.avg(value).over(w.rowsBetween(-reach, -1))
    out = df.withColumn("lift", after - before).where("lift is not null")
    return out.withColumn("_r", F.row_number().over(_w(key, F.desc("lift"), *order))).where(F.col("_r") <= top).drop("_r")


def ease(kind: str, p: Column) -> Column:
    """Easing curves over progress from 0 to 1, clamped."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
    curves = {
        "linear": p,
        "smooth": p * p * (3 - 2 * p),
        "out5": 1 - F.pow(1 - p, 5),
        "expo_out": F.when(p >= 1, 1.0).otherwise(1 - F.pow(F.lit(2.0), -10 * p)),
        "in4": p * p * p * p,
        "in": p * p * p,
        "out": 1 - F.pow(1 - p, 3),
        "in_out": F.when(p < 0.5, 4 * p * p * p).otherwise(1 - F.pow(2 - 2 * p, 3) / 2),
    }
    return curves[kind]


def spring(tau: Column, frequency: float, damping: float) -> Column:
    """The way of a damped spring towards 1 after ``tau`` seconds; 0 before."""
    w = 2 * 3.141592653589793 * frequency
    z = min(damping, 0.9999)
    wd = w * (1 - z * z) ** 0.5
    rest = F.exp(-z * w * tau) * (F.cos(wd * tau) + z * w / wd * F.sin(wd * tau))
    return F.when(tau <= 0, 0.0).otherwise(1 - rest)


def loop_changes(changes: DataFrame, length: float, at: str = "at") -> DataFrame:
    """Changes and the same ones a loop earlier, so that what is still settling at the end is so at the start."""
    return changes.withColumn(at, F.col(at) - length).unionByName(changes)


def springs(df: DataFrame, changes: DataFrame, key: str, t: str, base: float, frequency: float, damping: float) -> DataFrame:
    """Adds ``value``: ``base`` plus a spring from each target to the next, for changes (key, at, target).

    A key has few changes; they are one array beside each row.
    """
    steps = changes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "target"))).alias("_steps"))
    one = lambda s, i: (s["target"] - F.coalesce(F.get("_steps", i - 1)["target"], F.lit(base))) * spring(F.col(t) - s["at"], frequency, damping)
    total = F.aggregate(F.transform(F.coalesce("_steps", F.array().cast("array<struct<at:double,target:double>>")), one), F.lit(base), lambda a, x: a + x)
    return df.join(steps, key, "left").withColumn("value", total).drop("_steps")


def resampled(df: DataFrame, key: str, order: list[str], x: str, y: str, step: float) -> DataFrame:
    """Each line at even distances of about ``step``, both ends included: each stretch of the line lists the points that fall on it.

    Lines of no length give no points.
    """
    w = _w(key, *order)
    arcs = arc_length(df, key, order, x, y).withColumn("_all", F.max("arc").over(W.partitionBy(key)))
    ends = arcs.select(key, x, y, "_all", F.col("arc").alias("_a"), F.lead("arc").over(w).alias("_b"), F.lead(x).over(w).alias("_x"), F.lead(y).over(w).alias("_y")).where("_b > _a")
    count = F.greatest(F.lit(1), F.floor(F.col("_all") / step + 0.5))
    # point n lies at n / count of the way; a stretch has those after its begin up to its end, and the start if it is the first
    mark = lambda s: F.floor(s * count / F.col("_all") + 1e-9)
    first, last = F.when(F.col("_a") > 0, mark(F.col("_a")) + 1).otherwise(0), mark(F.col("_b"))
    marks = ends.withColumn("_m", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    k = (F.col("_m") * F.col("_all") / count - F.col("_a")) / (F.col("_b") - F.col("_a"))
    return marks.select(key, F.col("_m").alias("n"), (F.col(x) + (F.col("_x") - F.col(x)) * k).alias("x"), (F.col(y) + (F.col("_y") - F.col(y)) * k).alias("y"))


def prefix(df: DataFrame, key: str, order: list[str], x: str, y: str, share: float) -> DataFrame:
    """The first ``share`` of each line by its length, the last point between two of its points."""
    w = _w(key, *order)
    arcs = arc_length(df, key, order, x, y).withColumn("_all", F.max("arc").over(W.partitionBy(key)))
    cut = F.col("_all") * min(1.0, max(0.0, share))
    rows = arcs.withColumn("_cut", cut).withColumn("_a", F.lag("arc").over(w)).withColumn("_x", F.lag(x).over(w)).withColumn("_y", F.lag(y).over(w))
    rows = rows.where((F.col("arc") <= F.col("_cut")) | (F.col("_a") <= F.col("_cut")) | F.col("_a").isNull())
    k = F.when((F.col("arc") <= F.col("_cut")) | F.col("_a").isNull(), F.lit(1.0)).otherwise((F.col("_cut") - F.col("_a")) / (F.col("arc") - F.col("_a")))
    at = lambda c, before: F.when(k == 1, F.col(c)).otherwise(F.col(before) + (F.col(c) - F.col(before)) * k)
    return rows.select(key, *order, at(x, "_x").alias("x"), at(y, "_y").alias("y"))


def spline(df: DataFrame, key: str, order: list[str], x: str, y: str, step: float = 4.0) -> DataFrame:
    """Catmull-Rom points about every ``step`` on each stretch between neighbours, the ends doubled, and the last point."""
    w = _w(key, *order)
    p = df.withColumn("_n", F.row_number().over(w))
    for c, name in ((x, "x"), (y, "y")):
        p = p.withColumn(f"_{name}2", F.lead(c).over(w))
        p = p.withColumn(f"_{name}0", F.coalesce(F.lag(c).over(w), F.col(c))).withColumn(f"_{name}3", F.coalesce(F.lead(c, 2).over(w), F.col(f"_{name}2")))
    pieces = F.when(F.col("_x2").isNull(), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.hypot(F.col("_x2") - F.col(x), F.col("_y2") - F.col(y)) / step).cast("int")))
    p = p.withColumn("_m", pieces).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    u = F.col("k") / F.col("_m")

    def at(c: str, name: str) -> Column:
        a, b, d, e = F.col(f"_{name}0"), F.col(c), F.col(f"_{name}2"), F.col(f"_{name}3")
        curve = 0.5 * (2 * b + (d - a) * u + (2 * a - 5 * b + 4 * d - e) * u * u + (3 * b - a - 3 * d + e) * u * u * u)
        return F.when(d.isNull(), b).otherwise(curve)

    return p.select(key, F.col("_n").alias("stretch"), "k", at(x, "x").alias("x"), at(y, "y").alias("y"))


def paced(df: DataFrame, key: str, order: str, x: str, y: str, slow: float = 9.0, most: float = 0.3, sigma: float = 7.0) -> DataFrame:
    """Adds ``arc`` and ``tau``: the time by which a pen that slows into corners reaches each point of its line.

    Time grows with the length and with the turning, which is smoothed by a Gaussian of ``sigma`` along
    the line. The window is some points wide, and a row meets the rows inside it by their numbers.
    """
    w, whole = _w(key, order), W.partitionBy(key)
    rows = arc_length(df, key, [order], x, y).withColumn("_n", F.row_number().over(w).cast("long"))
    way = F.atan2(F.lead(y).over(w) - F.col(y), F.lead(x).over(w) - F.col(x)) - F.atan2(F.col(y) - F.lag(y).over(w), F.col(x) - F.lag(x).over(w))
    rows = rows.withColumn("_turn", F.coalesce(F.abs(F.atan2(F.sin(way), F.cos(way))), F.lit(0.0)))
    rows = rows.withColumn("_step", F.max("arc").over(whole) / F.greatest(F.count(F.lit(1)).over(whole) - 1, F.lit(1)))
    rows = rows.withColumn("_step", F.when(F.col("_step") == 0, F.lit(1.0)).otherwise(F.col("_step"))).withColumn("_sg", F.greatest(F.lit(1e-3), sigma / F.col("_step")))
    asks = rows.select(key, F.col("_n").alias("_i"), "_sg", F.explode(F.sequence(F.col("_n") - F.ceil(F.col("_sg") * 3), F.col("_n") + F.ceil(F.col("_sg") * 3))).alias("_n"))
    g = F.exp(-F.pow(F.col("_n") - F.col("_i"), 2) / (2 * F.col("_sg") * F.col("_sg")))
    smooth = asks.join(rows.select(key, "_n", "_turn"), [key, "_n"]).groupBy(key, F.col("_i").alias("_n")).agg((F.sum(F.col("_turn") * g) / F.sum(g)).alias("_bend"))
    rows = rows.join(smooth, [key, "_n"])
    step = (F.col("arc") - F.coalesce(F.lag("arc").over(w), F.col("arc"))) * (1 + slow * F.least(F.col("_bend") / F.col("_step"), F.lit(most)))
    rows = rows.withColumn("_dt", step).withColumn("tau", F.sum("_dt").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.select(*df.columns, "arc", "tau")


def reached(paced_: DataFrame, key: str, order: str, shares: list[float]) -> DataFrame:
    """The share of its length that a pen has drawn after each share ``u`` of the time of its line."""
    w, whole = _w(key, order), W.partitionBy(key)
    ends = paced_.select(key, order, "arc", "tau", F.lead("arc").over(w).alias("_arc"), F.lead("tau").over(w).alias("_tau"), F.max("arc").over(whole).alias("_all"), F.max("tau").over(whole).alias("_time"))
    asked = ends.where("_tau is not null").withColumn("u", F.explode(F.array(*(F.lit(float(s)) for s in shares)))).withColumn("_x", F.col("u") * F.col("_time"))
    # the last stretch that begins at or before the time
    best = asked.where("tau <= _x").groupBy(key, "u").agg(F.max(F.struct("tau", order, "arc", "_arc", "_tau", "_all", "_x")).alias("b"))
    k = (F.col("b._x") - F.col("b.tau")) / F.when(F.col("b._tau") == F.col("b.tau"), F.lit(1.0)).otherwise(F.col("b._tau") - F.col("b.tau"))
    return best.select(key, "u", ((F.col("b.arc") + (F.col("b._arc") - F.col("b.arc")) * k) / F.when(F.col("b._all") == 0, F.lit(1.0)).otherwise(F.col("b._all"))).alias("share"))


def best_window(beats: DataFrame, key: str, t: str, drop: str, length: float, before: float) -> DataFrame:
    """The start of a cut of ``length`` seconds that has the drop ``before`` seconds in, kept inside the track, and its beats."""
    start = F.greatest(F.lit(0.0), F.least(F.col(drop) - before, F.col("duration") - length))
    rows = beats.withColumn("start", start).where((F.col(t) >= F.col("start")) & (F.col(t) < F.col("start") + length))
    return rows.groupBy(key, "start").agg(F.array_sort(F.collect_list(F.round(F.col(t) - F.col("start"), 6))).alias("beats"))


def beat_sheet(beats: DataFrame, levels: DataFrame, key: str, t: str, value: str, length: float, before: float, beat_seconds: float) -> DataFrame:
    """One row a track: duration, bar, beats, downbeats, sections by time, the drop, and the cut with its own beats.

    ``beats`` is (key, t, low): the low-band level at each beat, which tells the phase of the downbeats. The
    drop is the downbeat with the largest rise; without one it is the beat a third of the way in.
    """
    n = F.row_number().over(_w(key, t)) - 1
    numbered = beats.withColumn("_n", n)
    phases = phase_of_most(beats, key, [t], "low")
    marked = numbered.join(phases, key).withColumn("_down", (F.col("_n") >= F.col("phase")) & ((F.col("_n") - F.col("phase")) % 4 == 0))
    rises = section_lifts(levels, marked.where("_down").select(key, t), key, t, value, outwards=False)
    found = rises.groupBy(key).agg(F.sort_array(F.collect_list(F.round(t, 3))).alias("sections"), F.min_by(t, "rank").alias("_drop"))
    times = lambda when: F.sort_array(F.collect_list(F.when(when, F.round(t, 3))))
    lists = marked.groupBy(key).agg(times(F.lit(True)).alias("beats"), times(F.col("_down")).alias("downbeats"))
    ends = levels.groupBy(key).agg(F.max(t).alias("duration"))
    out = lists.join(ends, key).join(found, key, "left")
    out = out.withColumn("drop", F.coalesce("_drop", F.get("beats", F.floor(F.size("beats") / 3).cast("int")))).withColumn("start", F.greatest(F.lit(0.0), F.least(F.col("drop") - before, F.col("duration") - length)))
    inside = lambda c: F.transform(F.filter(c, lambda b: (b >= F.col("start")) & (b < F.col("start") + length)), lambda b: F.round(b - F.col("start"), 3))
    window = F.struct(F.col("start"), (F.col("start") + length).alias("end"), (F.col("drop") - F.col("start")).alias("drop_in_film"), inside("beats").alias("beats_in_film"), inside("downbeats").alias("downbeats_in_film"))
    return out.select(key, "duration", F.lit(4 * beat_seconds).alias("bar"), "beats", "downbeats", F.coalesce("sections", F.array().cast("array<double>")).alias("sections"), "drop", window.alias("window"))


MOST_KEYS = 10_000


def best_offset(candidates: DataFrame, keys: DataFrame, beats: DataFrame, near: float = 0.06, weight: float = 1.2) -> DataFrame:
    """The candidate (offset, lift) with the largest lift plus ``weight`` times the share of key times that fall on a beat.

    Key times are a sheet of at most ``MOST_KEYS``. Shifted by a candidate they meet beats in buckets of time as
    wide as the tolerance, so each shifted time sees the beats of three buckets and no other.
    """
    width = near
    times = sorted(r["t"] for r in keys.select("t").limit(MOST_KEYS + 1).collect())
    if len(times) > MOST_KEYS:
        raise ValueError("too many key times")
    place = F.floor(F.col("_t") / width)
    asked = candidates.withColumn("_k", F.explode(F.array(*map(F.lit, times)).cast("array<double>"))).withColumn("_t", F.col("_k") + F.col("offset"))
    asked = asked.select("offset", "_k", "_t", F.explode(F.sequence(place - 1, place + 1)).alias("_b"))
    hits = asked.join(beats.select(F.col("t").alias("_beat"), F.floor(F.col("t") / width).alias("_b")), "_b").where(F.abs(F.col("_beat") - F.col("_t")) < near)
    on = hits.groupBy("offset").agg(F.countDistinct("_k").alias("_on"))
    rows = candidates.join(on, "offset", "left").withColumn("score", F.col("lift") + weight * F.coalesce(F.col("_on"), F.lit(0)) / max(1, len(times)))
    return rows.drop("_on").orderBy(F.desc("score"), "offset").limit(1)


# ---- series in seconds


def _micros(t: str) -> Column:
    return F.round(F.col(t) * 1e6).cast("long")


def section_lifts(levels: DataFrame, beats: DataFrame, key: str, t: str, value: str, reach: float = 4.0, top: int = 4, none: float = -120.0, outwards: bool = True) -> DataFrame:
    """The ``top`` beats with the largest rise of the mean level of the ``reach`` seconds from there on over those before, by time.

    Beats nearer to an end of their series than ``reach`` are left out. Beats and levels are one sorted stream. Both means
    add from the beat outwards, or else both from the last level to the first; the order decides between rises that differ in the last bit.
    """
    both = levels.select(key, t, F.col(value).alias("_v"), F.lit(False).alias("_beat")).unionByName(beats.select(key, t, F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_beat")))
    both = both.withColumn("_at", _micros(t)).withColumn("_end", F.max(F.when(~F.col("_beat"), F.col(t))).over(W.partitionBy(key)))
    ahead, back, width = W.partitionBy(key).orderBy("_at"), W.partitionBy(key).orderBy(F.desc("_at")), int(reach * 1e6)
    after = F.avg("_v").over(ahead.rangeBetween(0, width - 1) if outwards else back.rangeBetween(1 - width, 0))
    before = F.avg("_v").over(back.rangeBetween(1, width))
    rows = both.withColumn("lift", F.coalesce(after, F.lit(none)) - F.coalesce(before, F.lit(none))).where(F.col("_beat") & F.col(t).between(F.lit(reach), F.col("_end") - reach))
    best = rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("lift"), F.desc(t)))).where(F.col("_r") <= top)
    return best.select(key, t, "lift", F.col("_r").alias("rank"), F.row_number().over(W.partitionBy(key).orderBy(t)).alias("place"))


def steepest(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """The time of the largest rise from the row before; the first on ties."""
    rows = df.withColumn("_rise", F.col(value) - F.lag(value).over(_w(key, t))).where("_rise is not null")
    return rows.groupBy(key).agg(F.max(F.struct("_rise", F.negative(t).alias("n"))).alias("b")).select(key, F.negative("b.n").alias(t), F.col("b._rise").alias("rise"))


def away_from(df: DataFrame, t: Column, cuts: list[float], reach: float) -> DataFrame:
    """Rows that are farther than ``reach`` from every cut."""
    near = F.exists(F.array(*(F.lit(float(c)) for c in cuts)).cast("array<double>"), lambda c: F.abs(t - c) <= reach)
    return df.where(~near)


def punch(frames: DataFrame, beats: DataFrame, key: str, t: str, amp: float, decay: float = 0.12, attack: float = 0.03) -> DataFrame:
    """Adds ``bump``: what the last beat at or before each time still adds, a short rise and an exponential decay; 0 before the first."""
    marked = as_of(frames, beats.withColumn("_last", F.col(t)), key, t, "_last", "_last")
    since = F.col(t) - F.col("_last")
    return marked.withColumn("bump", F.coalesce(amp * ease("out", since / attack) * F.exp(-since / decay), F.lit(0.0))).drop("_last")


def camera(frames: DataFrame, keys: DataFrame, key: str, t: str = "t") -> DataFrame:
    """Adds zoom, x and y for each time from camera keys (t, zoom, x, y): eased moves between neighbours, the zoom in logarithms.

    Before the first key and after the last one their own values hold.
    """
    w = W.partitionBy(key).orderBy(t)
    own = [F.col(c).alias(f"{c}0") for c in (t, "zoom", "x", "y")]
    ahead = [F.coalesce(F.lead(c).over(w), F.col(c)).alias(f"{c}1") for c in (t, "zoom", "x", "y")]
    moves = keys.select(key, F.col(t), F.struct(*own, *ahead).alias("_m"))
    first = keys.groupBy(key).agg(F.min_by(F.struct(t, "zoom", "x", "y"), t).alias("f"))
    still = F.struct(*(F.col(f"f.{c}").alias(f"{c}0") for c in (t, "zoom", "x", "y")), *(F.col(f"f.{c}").alias(f"{c}1") for c in (t, "zoom", "x", "y")))
    moves = moves.unionByName(first.select(key, F.lit(-1e18).alias(t), still.alias("_m")))
    rows = as_of(frames, moves, key, t, "_m", "_m")
    m = lambda c: F.col(f"_m.{c}")
    k = F.when(m(f"{t}1") == m(f"{t}0"), F.lit(1.0)).otherwise(ease("in_out", (F.col(t) - m(f"{t}0")) / (m(f"{t}1") - m(f"{t}0"))))
    between = lambda a, b: a + (b - a) * k
    return rows.withColumns({"zoom": F.exp(between(F.log(m("zoom0")), F.log(m("zoom1")))), "x": between(m("x0"), m("x1")), "y": between(m("y0"), m("y1"))}).drop("_m")
