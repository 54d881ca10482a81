"""Checks over sampled boxes, frame differences and measured levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.functions import motion as mo

#: Energy shares and gaps beyond which a mix is warned of. Fixed values.
BALANCE = {"sub": 45.0, "presence": 7.5, "dull": 0.2, "thin": 18.0, "gap": 0.6}


def visible(boxes: DataFrame, width: float, height: float, ground: float = 0.85) -> DataFrame:
    """Boxes that can be seen: at least 2 px each way, opacity 0.05 or more, and not the ground that fills the frame."""
    return boxes.where((F.col("w") >= 2) & (F.col("h") >= 2) & (F.coalesce(F.col("opacity"), F.lit(1.0)) >= 0.05) & (F.col("w") * F.col("h") < ground * width * height))


def without_descendants(rows: DataFrame, key: list[str], path: str = "id") -> DataFrame:
    """Rows of which no ancestor is among the rows of the same key: each path meets its own prefixes only."""
    parts = F.split(path, ">")
    above = rows.select(*key, F.col(path).alias("_path"), F.explode_outer(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(n < F.size(parts), F.array_join(F.slice(parts, 1, n), ">")))).alias("_above"))
    flagged = rows.select(*key, F.col(path).alias("_above")).distinct()
    below = above.join(flagged, [*key, "_above"], "left_semi").select(*key, F.col("_path").alias(path)).distinct()
    return rows.join(below, [*key, path], "left_anti")


def fast_moves(boxes: DataFrame, fps: float, limit: float, cuts: list[float] = ()) -> DataFrame:
    """Boxes whose centre moves more than ``limit`` px to the next frame; steps over a cut and children of moving boxes aside."""
    w = W.partitionBy("id").orderBy("i")
    dx, dy = (F.lead(c).over(w) - F.col(c) for c in ("cx", "cy"))
    step = F.sqrt(dx * dx + dy * dy)  # rounded as in SQL, where equal steps are ranked by their last bit; hypot rounds otherwise
    rows = boxes.withColumn("px", F.when(F.lead("i").over(w) == F.col("i") + 1, step)).withColumn("seen", F.col("is_on") | F.coalesce(F.lead("is_on").over(w), F.lit(False)))
    crosses = F.exists(F.array(*(F.lit(float(c)) for c in cuts)).cast("array<double>"), lambda c: (F.col("t") < c) & (F.col("t") + 1 / fps >= c))
    return without_descendants(rows.where((F.col("px") > limit) & F.col("seen") & ~crosses).select("i", "t", "id", "px"), ["i"])


def consecutive(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows with consecutive ``i`` joined to spans with their peak and its time."""
    n = F.row_number().over(W.partitionBy(*key).orderBy("i"))
    peak = F.max(F.struct(F.col(value).alias("v"), F.negative("t").alias("x"))).alias("p")
    spans = rows.withColumn("_island", F.col("i") - n).groupBy(*key, "_island").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("t").alias("t0"), F.max("t").alias("t1"), peak)
    return spans.select(*key, "i0", "i1", "t0", "t1", F.col("p.v").alias("peak"), F.negative("p.x").alias("at"))


def survivors(before: DataFrame, after: DataFrame, least_area: float) -> DataFrame:
    """Boxes of the frame before a cut that are still there after it, by path and content, and how far they moved."""
    a = before.where(F.col("vis") >= least_area).select("cut", "id", "key", F.col("cx").alias("_x"), F.col("cy").alias("_y"), F.col("area").alias("_area"))
    both = after.where(F.col("vis") >= least_area).join(a, ["cut", "id", "key"])
    moved, scaled = F.hypot(F.col("cx") - F.col("_x"), F.col("cy") - F.col("_y")), F.sqrt(F.col("area") / F.col("_area"))
    kept = both.select("cut", "id", moved.alias("moved"), scaled.alias("scale"), ((moved > 2) | (F.abs(scaled - 1) > 0.01)).alias("moves"))
    return without_descendants(kept, ["cut"])


def unmatched(rules: DataFrame, matches: DataFrame, selector: str = "sel") -> DataFrame:
    """Rules whose selector met nothing."""
    return rules.join(matches.select(selector).distinct(), selector, "left_anti")


def outside(boxes: DataFrame, rules: DataFrame, width: float, height: float, tolerance: float = 0.5) -> DataFrame:
    """Boxes that leave the area of their rule (``sel``, ``x0``..``y1`` or null for the frame, ``from``, ``to``) by more than ``tolerance`` px."""
    r = rules.select("sel", *(F.coalesce(F.col(c), F.lit(v)).alias(f"_{c}") for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", width), ("y1", height), ("from", 0.0), ("to", 1e18))))
    rows = boxes.join(r, "sel").where(F.col("t").between(F.col("_from"), F.col("_to")))
    box = (F.col("cx") - F.col("w") / 2, F.col("cy") - F.col("h") / 2, F.col("cx") + F.col("w") / 2, F.col("cy") + F.col("h") / 2)
    worst = mo.worst_side(box, tuple(F.col(f"_{c}") for c in ("x0", "y0", "x1", "y1")))
    return rows.withColumn("_worst", worst).where(F.col("_worst.px") > tolerance).select("i", "t", "sel", F.col("_worst.px").alias("px"), F.col("_worst.side").alias("side"))


def frozen(frames: DataFrame, key: str, fps: float, still: float = 0.25, least: float = 2.0, tail: float = 3.0) -> DataFrame:
    """Starts of still stretches of ``least`` seconds or more that reach this length before the last ``tail`` seconds."""
    w = W.partitionBy(key).orderBy("n")
    rows = frames.withColumn("_still", F.col("d") < still).withColumn("_all", F.count(F.lit(1)).over(W.partitionBy(key)))
    rows = rows.withColumn("_run", F.sum((~F.col("_still")).cast("int")).over(w))
    rows = rows.where("_still").withColumn("_len", F.row_number().over(W.partitionBy(key, "_run").orderBy("n")))
    return rows.where((F.col("_len") == int(least * fps)) & (F.col("n") / fps < F.col("_all") / fps - tail)).select(key, (F.col("n") / fps - least).alias("t"))


def loop_seam(frames: DataFrame, key: str, seam: str = "seam") -> DataFrame:
    """Whether the step from the last frame to the first is like its neighbours: ok, JUMP, HOLD or SPEED BREAK.

    ``d`` holds the difference to the frame before (n from 1 on), ``seam`` the difference of last and first frame on any row.
    """
    body = frames.where("n >= 1")
    d = F.array_sort(F.collect_list("d"))
    m = body.groupBy(key).agg(F.max_by("d", "n").alias("into"), F.min_by("d", "n").alias("out"), F.get(d, F.floor(F.count(F.lit(1)) / 2).cast("int")).alias("median"), F.max(seam).alias("seam"))
    near = F.greatest("into", "out")
    verdict = (
        F.when(F.col("seam") > F.greatest(2.5 * F.col("median"), 1.8 * near, F.lit(1.5)), "JUMP")
        .when((near > 0.5) & (F.col("seam") < 0.25 * F.least("into", "out")), "HOLD")
        .when((F.abs(F.col("into") - F.col("out")) > F.greatest(F.lit(1.0), 0.5 * near)) | (F.abs(F.col("seam") - (F.col("into") + F.col("out")) / 2) > F.greatest(F.lit(1.0), 0.6 * near)), "SPEED BREAK")
        .otherwise("ok")
    )
    return m.withColumn("verdict", verdict)


def drawing(df: DataFrame, schedule: list[tuple[float, float, int]], fps: float = 24, fill: int = 2, t: str = "t") -> DataFrame:
    """Adds ``shown`` (the time a held drawing shows) and ``drawing`` (its number over the film) for each time.

    The schedule is a handful of intervals with the frames a drawing is held; between them ``fill`` holds.
    """
    spans, at, number = [], 0, 0
    for t0, t1, hold in [*schedule, (float("inf"), float("inf"), fill)]:
        a = int(t0 * fps + 0.5) if t0 != float("inf") else 1 << 30
        if a > at:
            spans.append((at, a, fill, number))
            number += -(-(a - at) // fill)
        if t0 == float("inf"):
            break
        at = int(t1 * fps + 0.5)
        spans.append((a, at, max(1, hold), number))
        number += -(-(at - a) // max(1, hold))
    f = F.floor(F.col(t) * fps + 1e-6)
    shown = number_ = None
    for a, b, hold, first in spans:
        k = F.floor((f - a) / hold)
        inside = (f >= a) & (f < b)
        shown = F.when(inside, (a + k * hold) / fps) if shown is None else shown.when(inside, (a + k * hold) / fps)
        number_ = F.when(inside, first + k) if number_ is None else number_.when(inside, first + k)
    return df.withColumn("shown", shown).withColumn("drawing", number_)


def colours_ok(streams: DataFrame, tags: str = "tags") -> DataFrame:
    """Adds ``ok``: whether the colour tags of a stream are those that players agree on. Fixed values."""
    want = {"pix_fmt": "yuv420p", "color_range": "tv", "color_space": "bt709", "color_primaries": "bt709", "color_transfer": "bt709"}
    wanted = F.struct(*(F.lit(v).alias(k) for k, v in want.items()))
    got = F.struct(*(F.col(f"{tags}.{k}").alias(k) for k in want))
    return streams.withColumn("ok", got.eqNullSafe(wanted))


def fast_by_profile(frames: DataFrame, key: str, fps: float, unit: float = 1.0, cuts: list[float] = (), blur: list[tuple[float, float]] = (), limit: float = 80.0, reach: int = 24) -> DataFrame:
    """Spans in which the picture moves more than ``limit`` px a frame, by the shift of its profiles.

    ``frames`` is (key, n, d, profiles): the difference to the frame before and an array of brightness
    profiles. A shift counts if it explains the change: what is left is under 0.35 of the still
    difference, which is over 0.8. Steps with hardly any change, pops, cuts and blurred stretches are aside.
    """
    w = W.partitionBy(key).orderBy("n")
    rows = frames.withColumn("_before", F.lag("profiles").over(w)).withColumn("_around", (F.lag("d").over(w) + F.lead("d").over(w)) / 2)
    rows = rows.withColumn("_inner", (F.row_number().over(w) > 2) & F.lead("d", 2).over(w).isNotNull()).withColumn("t", F.col("n") / fps)
    near = F.exists(F.array(*(F.lit(float(c)) for c in cuts)).cast("array<double>"), lambda c: F.abs(F.col("t") - c) <= 2 / fps)
    pop = F.col("_inner") & (F.col("d") > 4) & (F.col("d") > 3 * F.greatest("_around", F.lit(1.0)))
    blurred = F.lit(False)
    for a, b in blur:
        blurred = blurred | F.col("t").between(a - 1 / fps, b + 1 / fps)
    rows = rows.where(F.col("_before").isNotNull() & (F.col("d") >= 1) & ~near & ~F.coalesce(pop, F.lit(False)) & ~blurred)
    shifts = F.zip_with("_before", "profiles", lambda a, b: mo.best_shift(a, b, reach))
    real = F.filter(shifts, lambda s: (s["still"] > 0.8) & (s["residual"] < 0.35 * s["still"]))
    rows = rows.withColumn("px", F.array_max(F.transform(real, lambda s: F.abs(s["shift"]) * unit))).where(F.col("px") > limit)
    new = F.when(F.col("t") - F.lag("t").over(w) <= 1.5 / fps, 0).otherwise(1)
    spans = rows.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w))
    return spans.groupBy(key, "_s").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("px").alias("px")).drop("_s")


def severest(lines: DataFrame, severity: str, *order: str, n: int = 12) -> DataFrame:
    """The ``n`` severest lines of a report, and how many there are in all."""
    return lines.orderBy(F.desc(severity), *order).limit(n).withColumn("in_all", lines.agg(F.count(F.lit(1))).scalar())


# ---- levels


def quiet_share(levels: DataFrame, key: str, value: str = "db", under: float = 20.0) -> DataFrame:
    """The share of windows at least ``under`` below the loudest of their series."""
    top = F.max(value).over(W.partitionBy(key))
    return levels.withColumn("_top", top).groupBy(key).agg(F.avg(F.when(F.col(value) < F.col("_top") - under, 1.0).otherwise(0.0)).alias("quiet"))


def longest_gap(levels: DataFrame, key: str, order: list[str], value: str, under: float, hop: float) -> DataFrame:
    """The longest run under a level, in seconds of ``hop`` a row; 0 without one."""
    low = F.col(value) < under
    rows = levels.withColumn("_g", F.sum((~low).cast("int")).over(W.partitionBy(key).orderBy(*order))).withColumn("_low", low.cast("int"))
    return rows.groupBy(key, "_g").agg(F.sum("_low").alias("n")).groupBy(key).agg((F.max("n") * hop).alias("gap"))


def momentary(energy: DataFrame, key: str, ms: str = "ms", value: str = "e", reach: int = 400) -> DataFrame:
    """Adds ``level``: the mean energy of the ``reach`` milliseconds up to each row, in dB."""
    w = W.partitionBy(key).orderBy(ms).rangeBetween(-reach + 1, 0)
    return energy.withColumn("level", 10 * F.log10(F.avg(value).over(w) + 1e-12))


def momentary_gap(frames: DataFrame, key: str, ms: str = "ms", value: str = "e", hop: int = 50, reach: int = 400, under: float = -45.0, edge: float = 0.3) -> DataFrame:
    """The longest stretch in seconds whose momentary loudness is under a level, the ends of a series aside.

    ``frames`` hold the mean energy of one channel in short frames at ``ms``; every ``hop`` the mean of the ``reach``
    milliseconds from there on is taken, as twice the energy of a channel with the loudness offset.
    """
    w = W.partitionBy(key).orderBy(ms)
    rows = frames.withColumn("_l", -0.691 + 10 * F.log10(2 * F.avg(value).over(w.rangeBetween(0, reach - 1)) + 1e-20))
    end = F.max(ms).over(W.partitionBy(key))
    hops = rows.withColumn("_end", end).where((F.col(ms) % hop == 0) & (F.col(ms) < F.greatest(F.col("_end") - reach, F.lit(1))))
    at = F.col(ms) / 1000 + 0.2
    low = (F.col("_l") < under) & (at > edge) & (at < F.col("_end") / 1000 - edge)
    return longest_gap(hops.withColumn("_q", F.when(low, -1.0).otherwise(1.0)), key, [ms], "_q", 0.0, hop / 1000)


def spiky(events: DataFrame, peak: str = "peak", energy: str = "energy") -> DataFrame:
    """Adds ``spiky``: whether the peak is over 12 dB above the loudest 400 ms of an event."""
    return events.withColumn("spiky", 20 * F.log10(F.abs(F.col(peak)) + 1e-9) - 10 * F.log10(F.col(energy) + 1e-12) > 12)


BANDS = (("sub", 20, 60), ("bass", 60, 250), ("lowmid", 250, 2000), ("presence", 2000, 5000), ("brilliance", 5000, 12000), ("air", 12000, 20000))


def band_shares(spectrum: DataFrame, key: str, frequency: str = "f", power: str = "p") -> DataFrame:
    """The share of each band in the energy from 20 Hz to 20 kHz, in percent, from rows of frequency and power."""
    within = lambda lo, hi: F.sum(F.when((F.col(frequency) >= lo) & (F.col(frequency) < hi), F.col(power)).otherwise(0.0))
    whole = F.sum(F.when(F.col(frequency).between(20, 20000), F.col(power)).otherwise(0.0)) + 1e-30
    return spectrum.groupBy(key).agg(*((100 * within(lo, hi) / whole).alias(name) for name, lo, hi in BANDS))


def low_band(spectrum: DataFrame, key: str, frame: str, frequency: str = "f", magnitude: str = "m", under: float = 150.0) -> DataFrame:
    """The level of the lowest band in each frame, in dB, from rows of frequency and magnitude."""
    return spectrum.groupBy(key, frame).agg((20 * F.log10(F.sum(F.when(F.col(frequency) < under, F.col(magnitude)).otherwise(0.0)) + 1e-9)).alias("low"))


def local_floor(levels: DataFrame, events: DataFrame, key: str, t: str = "t", value: str = "db", reach: float = 1.5, share: float = 0.1) -> DataFrame:
    """Each event (key, t, level) with the quiet percentile of the windows within ``reach`` seconds, and its lead over it.

    Windows meet events in buckets of time as wide as the reach on both sides, so an event sees two buckets and no other.
    """
    width = 2 * reach
    place = lambda x: F.floor(x / width)
    asks = events.select(key, F.col(t).alias("_t"), "level", F.explode(F.array_distinct(F.array(place(F.greatest(F.lit(0.0), F.col(t) - reach)), place(F.col(t) + reach)))).alias("_b"))
    near = asks.join(levels.select(key, t, value, place(F.col(t)).alias("_b")), [key, "_b"]).where((F.col(t) >= F.greatest(F.lit(0.0), F.col("_t") - reach)) & (F.col(t) < F.col("_t") + reach))
    floors = near.groupBy(key, "_t", "level").agg(F.percentile(value, F.lit(share)).alias("floor"))
    return floors.select(key, F.col("_t").alias(t), "level", "floor", (F.col("level") - F.col("floor")).alias("lead"))


def rivals(events: DataFrame, key: str, apart: float = 0.3) -> DataFrame:
    """Adds ``rival``: the level of the loudest other event of the key at least ``apart`` seconds before or after, without forming pairs."""
    micros, step = F.round(F.col("t") * 1e6).cast("long"), int(apart * 1e6)
    before = W.partitionBy(key).orderBy(micros).rangeBetween(W.unboundedPreceding, -step)
    after = W.partitionBy(key).orderBy(micros).rangeBetween(step, W.unboundedFollowing)
    return events.withColumn("rival", F.greatest(F.max("level").over(before), F.max("level").over(after)))


def verdicts(m: DataFrame, lufs: float, ceiling: float) -> DataFrame:
    """``fails`` and ``warnings`` from measures: integrated, true_peak, hero_lead, phone_lead, mono_loss, quiet, voice, and band shares."""
    pick = lambda rules: F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules)))
    fails = [
        ("loudness", (F.col("integrated") > lufs + 1) | (F.col("integrated") < lufs - 6)),
        ("true peak", F.col("true_peak") > ceiling + 0.3),
        ("hero", F.col("hero_lead") < 2),
        ("phone", F.col("phone_lead") < 6),
        ("quiet", (F.col("quiet") < 0.15) & ~F.coalesce(F.col("voice"), F.lit(False))),
        ("mono", F.col("mono_loss") > 1),
    ]
    warnings = [
        ("sub", F.col("sub") > BALANCE["sub"]),
        ("harsh", F.col("presence") > BALANCE["presence"]),
        ("dull", F.col("brilliance") + F.col("air") < BALANCE["dull"]),
        ("thin", F.col("sub") + F.col("bass") < BALANCE["thin"]),
        ("gap", F.col("gap") > BALANCE["gap"]),
    ]
    return m.withColumn("fails", pick(fails)).withColumn("warnings", pick(warnings))


def duck(on: Column, depth: float, attack: float, release: float, hop: float = 0.01, hold: int = 15) -> Column:
    """Gains in dB for an array of voice flags: down ahead of the voice, held through short gaps, eased both ways."""
    import math

    ahead = max(1, int(attack / hop))
    n = F.size(on)
    target = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.exists(F.slice(on, F.greatest(i + 1 - hold, F.lit(1)), F.least(i, F.lit(hold)) + 1 + ahead), lambda x: x), F.lit(float(depth))).otherwise(0.0))
    down, up = math.exp(-hop / (attack / 3)), math.exp(-hop / (release / 3))
    # blocks, so that a long array isn't copied at every step

    def step(a: Column, x: Column) -> Column:
        g = x + (a["g"] - x) * F.when(x < a["g"], down).otherwise(up)
        return F.struct(g.alias("g"), F.array_append(a["out"], g).alias("out"))

    def block(a: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(a["g"].alias("g"), F.array().cast("array<double>").alias("out")), step)
        return F.struct(done["g"].alias("g"), F.array_append(a["out"], done["out"]).alias("out"))

    size = 256
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / size).cast("int")), lambda b: F.slice(target, b * size + 1, F.lit(size)))
    nested = F.struct(F.lit(0.0).alias("g"), F.array().cast("array<array<double>>").alias("out"))
    return F.flatten(F.aggregate(parts, nested, block, lambda a: a["out"]))
