"""Sliding windows, segment means and resampling on grid rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from signalmill.functions.ordered import attach, framed, known_bins, with_stats
from signalmill.functions.symbols import symbolize
from signalmill.functions.timeparts import as_us, from_us, floor_div

SIGNAL = ("signal_id",)


def segment_bounds(window: int, segments: int) -> list[tuple[int, int]]:
    """Integer segments of a window: floor boundaries, at least one sample each, end exclusive."""
    out = []
    for k in range(segments):
        a, z = k * window // segments, (k + 1) * window // segments
        out.append((a, max(z, a + 1)))
    return out


def window_means(
    grid: DataFrame, window: int, segments: int, threshold: float = 0.01, by: Sequence[str] = SIGNAL
) -> DataFrame:
    """Z-normalised segment means (``paa``) of every full window, one row per start.

    A window whose population deviation is below the threshold is only centred.
    Running sums restart in every block: only their differences are used.
    """
    by, bounds = list(by), segment_bounds(window, segments)
    edges = sorted({z - 1 for _, z in bounds} | {a - 1 for a, _ in bounds if a > 0} | {window - 1})
    whole = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    cols = {
        "_v": lambda w: F.col("value") - F.avg("value").over(whole(w)),
        "_s": lambda w: F.sum("_v").over(upto(w)),
        "_q": lambda w: F.sum(F.col("_v") * F.col("_v")).over(upto(w)),
        "_sums": lambda w: F.array(*[F.lead("_s", e).over(w) if e else F.col("_s") for e in edges]),
        "_last": lambda w: F.lead("_q", window - 1).over(w),
    }
    rows = framed(grid, by, cols, after=window - 1).filter(F.col("_last").isNotNull())
    before = F.col("_s") - F.col("_v")
    at = lambda e: before if e < 0 else F.col("_sums")[edges.index(e)]
    mean = (at(window - 1) - before) / window
    var = (F.col("_last") - (F.col("_q") - F.col("_v") * F.col("_v"))) / window - mean * mean
    rows = rows.withColumn("_mean", mean).withColumn("_sd", F.sqrt(F.abs(var)))
    scale = F.when(F.col("_sd") >= threshold, F.col("_sd")).otherwise(1.0)
    paa = F.array(*[((at(z - 1) - at(a - 1)) / (z - a) - F.col("_mean")) / scale for a, z in bounds])
    return rows.select(
        *by, F.col("bin_idx").alias("start_index"), (F.col("bin_idx") + (window - 1)).alias("end_index"), paa.alias("paa")
    )


def sax_windows(
    grid: DataFrame, window: int, segments: int, breakpoints: Sequence[float], threshold: float = 0.01, by: Sequence[str] = SIGNAL
) -> DataFrame:
    """Every sliding window with its segment means and word."""
    return window_means(grid, window, segments, threshold, by).withColumn("word", symbolize(F.col("paa"), breakpoints))


def znorm(grid: DataFrame, threshold: float = 0.01, by: Sequence[str] = SIGNAL, name: str = "z") -> DataFrame:
    """Whole-series z-scores (population); below the threshold only centred."""
    out = with_stats(grid, by, {"_m": F.avg("value"), "_sd": F.stddev_pop("value")})
    centred = F.col("value") - F.col("_m")
    return out.withColumn(name, F.when(F.col("_sd") >= threshold, centred / F.col("_sd")).otherwise(centred)).drop("_m", "_sd")


def znorm_zero(grid: DataFrame, threshold: float = 0.001, by: Sequence[str] = SIGNAL, name: str = "z") -> DataFrame:
    """Whole-series z-scores; a flat series becomes zeros."""
    out = with_stats(grid, by, {"_m": F.avg("value"), "_sd": F.stddev_pop("value")})
    z = F.when(F.col("_sd") < threshold, 0.0).otherwise((F.col("value") - F.col("_m")) / F.col("_sd"))
    return out.withColumn(name, z).drop("_m", "_sd")


def _length(grid: DataFrame, by: Sequence[str]) -> DataFrame:
    n = known_bins(grid)
    return grid.withColumn("_n", F.lit(n).cast("bigint")) if n is not None else with_stats(grid, by, {"_n": F.count(F.lit(1))})


def paa_fractional(grid: DataFrame, segments: int, value: str = "value", by: Sequence[str] = SIGNAL) -> DataFrame:
    """Segment means where a sample counts with the share of it inside the segment."""
    rows, p = _length(grid, by), segments
    i, n = F.col("bin_idx"), F.col("_n")
    first, last = floor_div(i * p, n), F.least(F.lit(p - 1), F.ceil((i + 1) * p / n).cast("bigint") - 1)
    rows = rows.withColumn("segment", F.explode(F.sequence(first, F.greatest(first, last))))
    lo, hi = F.col("segment") * n / p, (F.col("segment") + 1) * n / p
    share = F.greatest(F.lit(0.0), F.least(i + 1.0, hi) - F.greatest(i + 0.0, lo))
    rows = rows.withColumn("_w", share).filter(F.col("_w") > 0)
    return rows.groupBy(*by, "segment").agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias("paa"))


def paa_integer(grid: DataFrame, segments: int, value: str = "value", by: Sequence[str] = SIGNAL) -> DataFrame:
    """Segment means with floor boundaries; a series no longer than that is left as it is."""
    rows = _length(grid, by)
    i, n = F.col("bin_idx"), F.col("_n")
    segment = F.when(n <= segments, i).otherwise(floor_div((i + 1) * segments - 1, n))
    return rows.groupBy(*by, segment.alias("segment")).agg(F.avg(value).alias("paa"))


def paa_truncate(grid: DataFrame, segments: int, value: str = "value", by: Sequence[str] = SIGNAL) -> DataFrame:
    """Means of ``segments`` equal parts of floor(n/segments) samples; the tail is dropped."""
    rows = _length(grid, by).withColumn("_len", floor_div(F.col("_n"), segments))
    rows = rows.filter((F.col("_len") > 0) & (F.col("bin_idx") < F.col("_len") * segments))
    return rows.groupBy(*by, floor_div(F.col("bin_idx"), F.col("_len")).alias("segment")).agg(F.avg(value).alias("paa"))


def series_word(segments: DataFrame, breakpoints: Sequence[float], by: Sequence[str] = SIGNAL) -> DataFrame:
    """Word of a series from its segment rows."""
    packed = segments.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("segment", "paa"))).alias("_p"))
    means = F.transform("_p", lambda s: s["paa"])
    return packed.select(*by, means.alias("paa"), symbolize(means, breakpoints).alias("word"))


def resample(rows: DataFrame, n: int, by: Sequence[str], idx: str = "pos", value: str = "value") -> DataFrame:
    """Each group (consecutive ``idx`` from 0) linearly resampled to ``n`` points."""
    by = list(by)
    facts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    pos = F.col("point") * (F.col("_n") - 1) / F.lit(float(max(n - 1, 1)))
    want = facts.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_pos", pos)
    want = want.withColumn("_lo", F.floor("_pos")).withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_n") - 1))
    side = lambda name: rows.select(*by, F.col(idx).cast("bigint").alias(f"_{name}"), F.col(value).alias(f"_v{name}"))
    out = want.join(side("lo"), [*by, "_lo"]).join(side("hi"), [*by, "_hi"])
    frac = F.col("_pos") - F.col("_lo")
    return out.select(*by, "point", (F.col("_vlo") * (1 - frac) + F.col("_vhi") * frac).alias(value))


def index_to_time(
    df: DataFrame, start: datetime, end: datetime, samples: int, index: str = "start_index", length: Column | str = "length"
) -> DataFrame:
    """Wall-clock span of index spans in a window of ``samples``; the end stops at the window end."""
    length = F.col(length) if isinstance(length, str) else length
    step = (as_us(end) - as_us(start)) / samples if samples > 1 else 0.0
    at = lambda i: from_us(F.least(F.lit(as_us(end)), F.floor(i * F.lit(step) + 0.5) + as_us(start)))
    return df.withColumn("start_ts", at(F.col(index))).withColumn("end_ts", at(F.col(index) + F.greatest(F.lit(1), length)))
