"""Voice timing: which frames carry voice, pauses, squeezed time lines, and heard words laid on voice onsets.

Times are seconds. Every operator is windows by key; pauses and words meet in one sorted stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.functions import packs
from quillmill.operators import series


def frame_energy(samples: DataFrame, key: str, size: int, i: str = "i", x: str = "x") -> DataFrame:
    """The mean energy in dB of whole frames of ``size`` samples (i counts from 0)."""
    frames = samples.groupBy(key, F.floor(F.col(i) / size).alias("frame")).agg(F.avg(F.col(x) * F.col(x)).alias("_e"), F.count(F.lit(1)).alias("_n"))
    return frames.where(F.col("_n") == size).select(key, "frame", (10 * F.log10(F.col("_e") + 1e-12)).alias("db"))


def voiced(frames: DataFrame, key: str, order: str = "frame", value: str = "db") -> DataFrame:
    """Adds ``voice``: frames over a threshold between the quiet and the loud percentile of their series, widened by two before and three after."""
    p = series.with_percentiles(frames, key, value, {"_quiet": 0.1, "_loud": 0.95})
    rows = p.withColumn("_on", F.coalesce(F.col(value) > F.greatest(F.col("_quiet") + 8, F.col("_loud") - 38), F.lit(False)))
    # an onset is seen two frames ahead, an end holds for three
    return series.dilate(rows, key, [order], "_on", before=3, after=2).withColumnRenamed("wide", "voice").drop("_on", "_quiet", "_loud")


def pauses(frames: DataFrame, key: str, hop: float, least: float = 0.12, order: str = "frame", voice: str = "voice") -> DataFrame:
    """Silent stretches between voice of at least ``least`` seconds: t0, t1."""
    r = series.runs(frames, key, order, voice)
    span = W.partitionBy(key)
    first, last = F.min(F.when(F.col(voice), F.col("first"))).over(span), F.max(F.when(F.col(voice), F.col("last"))).over(span)
    rows = r.withColumn("_a", first).withColumn("_b", last).where(~F.col(voice) & (F.col("first") > F.col("_a")) & (F.col("last") < F.col("_b")))
    rows = rows.select(key, (F.col("first") * hop).alias("t0"), ((F.col("last") + 1) * hop).alias("t1"))
    return rows.where(F.col("t1") - F.col("t0") >= least - 1e-9)


def squeezed(runs: DataFrame, key: str, rate: int = 48_000, v: dict = packs.VOICE) -> DataFrame:
    """Runs (t0, t1, voice) between the first and the last voice with the length that they keep and where they begin then.

    Inner pauses as long as a sentence's become a breath, others over ``gap`` become ``gap``; the run after
    the last voice is cut to a short tail. Lengths are whole samples.
    """
    span, w = W.partitionBy(key), W.partitionBy(key).orderBy("t0")
    begin, end = F.min(F.when(F.col("voice"), F.col("t0"))).over(span), F.max(F.when(F.col("voice"), F.col("t1"))).over(span) + v["tail"]
    rows = runs.withColumn("_i0", begin).withColumn("_i1", F.least(end, F.max("t1").over(span)))
    rows = rows.withColumn("t0", F.greatest("t0", "_i0")).withColumn("t1", F.least("t1", "_i1")).where("t1 > t0")
    length = F.col("t1") - F.col("t0")
    keep = F.when(~F.col("voice") & (F.col("t0") > F.col("_i0")) & (F.col("t1") < F.col("_i1")), F.when(length >= v["sentence"], v["breath"]).when(length > v["gap"], v["gap"]))
    whole = F.floor(keep * rate / 2) * 2 / rate
    # the limit in decimals: as doubles 0.28 and 0.02 make more than 0.3, which a pause of 0.3 s must exceed
    rows = rows.withColumn("kept", F.when(length > F.round(keep + 0.02, 9), whole).otherwise(length))
    return rows.withColumn("at", F.coalesce(F.sum("kept").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).drop("_i0", "_i1")


def sections(lengths: DataFrame, key: str, order: str, length: str, lead: float = 0.5, gap: float = 0.45, holds: dict[int, float] | None = None) -> DataFrame:
    """Where each section begins and ends on the film's line: a lead first, and ``gap`` or its own hold before each other one."""
    held = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in (holds or {0: gap}).items() for x in kv)), F.col(order).cast("int")), F.lit(gap))
    w = W.partitionBy(key).orderBy(order)
    wait = F.when(F.row_number().over(w) == 1, F.lit(lead)).otherwise(held)
    rows = lengths.withColumn("_wait", wait)
    rows = rows.withColumn("end", F.sum(F.col("_wait") + F.col(length)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("begin", F.col("end") - F.col(length)).drop("_wait")


def _nearest(rows: DataFrame, marks: DataFrame, key: str, t: Column) -> DataFrame:
    """Adds ``_near``: the mark (key, s) nearest to the time ``t``, the earlier one on ties. One sorted stream."""
    cols = rows.columns
    both = rows.withColumn("_t", t).withColumn("_side", F.lit(1)).unionByName(marks.select(key, F.col("s").alias("_t")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    mark = F.when(F.col("_side") == 0, F.col("_t"))
    back = F.last(mark, True).over(W.partitionBy(key).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first(mark, True).over(W.partitionBy(key).orderBy("_t", F.desc("_side")).rowsBetween(0, W.unboundedFollowing))
    out = both.withColumn("_b", back).withColumn("_a", ahead).where("_side = 1")
    return out.select(*cols, F.when(F.col("_a") - F.col("_t") < F.col("_t") - F.col("_b"), F.col("_a")).otherwise(F.coalesce("_b", "_a")).alias("_near"))


def bias(words: DataFrame, starts: DataFrame, key: str, windows: tuple[float, ...] = packs.VOICE["windows"]) -> DataFrame:
    """How late the recogniser is for each key: the median distance of clause beginnings to the nearest voice onset, in two passes.

    ``words`` is (key, ord, word, t), ``starts`` (key, s). Clauses begin the text or follow a mark; with fewer
    than two all words count. A pass takes the distances under its window, and adds nothing with fewer than two.
    """
    w = W.partitionBy(key).orderBy("ord")
    opens = F.lag("word").over(w).isNull() | F.lag("word").over(w).rlike("[.!?,;:…]$")
    rows = words.withColumn("_open", opens).withColumn("_some", F.count_if("_open").over(W.partitionBy(key)))
    rows = rows.where(F.col("_open") | (F.col("_some") < 2)).select(key, "t")
    found = rows.select(key).distinct().withColumn("bias", F.lit(0.0))
    for window in windows:
        near = _nearest(rows.join(found, key), starts, key, F.col("t") - F.col("bias"))
        miss = F.col("t") - F.col("bias") - F.col("_near")
        step = near.withColumn("_m", miss).where(F.abs("_m") < window).groupBy(key).agg(F.median("_m").alias("_step"), F.count(F.lit(1)).alias("_n"))
        found = found.join(step, key, "left").select(key, (F.col("bias") + F.when(F.col("_n") >= 2, F.col("_step")).otherwise(0.0)).alias("bias"))
    return found


def calibrated(words: DataFrame, gaps: DataFrame, bounds: DataFrame, key: str, v: dict = packs.VOICE) -> DataFrame:
    """Words (key, ord, word, t) with t0 and t1 on the voice: bias taken off, onsets met, pauses left, no time going back.

    ``gaps`` holds the pauses (key, t0, t1) and ``bounds`` the first and last voice of each key. The word
    nearest to an onset begins there if it is within 0.3 s, a word inside a pause begins after it, and a
    word ends with the next word or the next pause. Of two onsets for one word the later one counts.
    """
    starts = bounds.select(key, F.col("first").alias("s")).unionByName(gaps.select(key, F.col("t1").alias("s")))
    rows = words.join(bias(words, starts, key), key, "left").withColumn("_t", F.col("t") - F.coalesce("bias", F.lit(0.0)))
    # the word nearest to each onset
    near = _nearest(starts, rows.select(key, F.col("_t").alias("s")), key, F.col("s")).where(F.abs(F.col("_near") - F.col("s")) < v["windows"][-1])
    snaps = near.groupBy(key, "_near").agg(F.max("s").alias("_snap"))
    rows = rows.join(snaps.select(key, F.col("_near").alias("_t"), "_snap"), [key, "_t"], "left")
    first = F.row_number().over(W.partitionBy(key, "_t").orderBy("ord")) == 1  # one word of equal times
    rows = rows.withColumn("_t", F.coalesce(F.when(first, F.col("_snap")), F.col("_t"))).drop("_snap")
    # the pause that began last
    inside = series.as_of(rows, gaps.select(key, F.col("t0").alias("_t"), F.struct("t0", "t1").alias("_g")), key, "_t", "_g", "_gap")
    start = F.when((F.col("_t") > F.col("_gap.t0")) & (F.col("_t") < F.col("_gap.t1")), F.col("_gap.t1")).otherwise(F.col("_t"))
    rows = inside.withColumn("_t", start).join(bounds.select(key, F.col("first").alias("_lo"), F.col("last").alias("_hi")), key)
    rows = rows.withColumn("_t", F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.col("_t"))))
    w = W.partitionBy(key).orderBy("ord")
    rows = rows.withColumn("t0", F.max("_t").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_next", F.coalesce(F.lead("t0").over(w), F.col("_hi")))
    # the next pause that begins after the word does
    marks = gaps.select(key, F.col("t0"), F.lit(0).alias("_side"), F.col("t0").alias("_stop"))
    both = rows.withColumn("_side", F.lit(1)).withColumn("_stop", F.lit(None).cast("double")).unionByName(marks, allowMissingColumns=True)
    ahead = F.first("_stop", True).over(W.partitionBy(key).orderBy("t0", "_side").rowsBetween(1, W.unboundedFollowing))
    rows = both.withColumn("_stop", ahead).where("_side = 1")
    end = F.when(F.col("_stop") <= F.col("_next"), F.col("_stop")).otherwise(F.col("_next"))
    return rows.select(*words.columns, "t0", F.greatest(end, F.col("t0") + v["shortest"]).alias("t1"))
