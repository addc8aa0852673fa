"""Univariate outliers, deviation bands and change points."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from signalmill.functions.ordered import attach, running_sum, with_stats
from signalmill.functions.quantiles import quantiles
from signalmill.operators.sequences import breach_runs
from signalmill.operators.spectral import decompose

SIGNAL = ("signal_id",)
# Quantile pair of each outlier kind.
FENCES = {"tukey": (0.25, 0.75), "ctukey": (0.10, 0.90)}


def fence_score(x: Column, lo: Column, hi: Column) -> Column:
    """Signed distance beyond the quantile pair in units of its width; 0 inside."""
    width = hi - lo
    score = F.when(x > hi, (x - hi) / width).when(x < lo, (x - lo) / width).otherwise(0.0)
    return F.when(x.isNotNull(), F.when(width > 0, score).otherwise(0.0))


def tukey_outliers(
    grid: DataFrame, kind: str = "ctukey", column: str = "value", by: Sequence[str] = SIGNAL, name: str = "score"
) -> DataFrame:
    """Robust outlier score per row (beyond ±1.5 counts as an outlier)."""
    lo, hi = FENCES[kind]
    q = quantiles(grid, by, column, {"_lo": lo, "_hi": hi})
    out = attach(grid, q, by, how="left")
    return out.withColumn(name, fence_score(F.col(column), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def decompose_anomalies(
    grid: DataFrame, sensitivity: float = 1.5, period: int = -1, trend: str = "linefit", by: Sequence[str] = SIGNAL
) -> DataFrame:
    """Decomposition with outlier score and flag in {-1, 0, 1} of the residual."""
    out = tukey_outliers(decompose(grid, period, trend, by), "ctukey", "residual", by)
    s = F.col("score")
    return out.withColumn("flag", F.when(s > sensitivity, 1).when(s < -sensitivity, -1).otherwise(0))


def z_for(confidence: float) -> float:
    """Two-sided normal quantile of a confidence in percent or as a fraction."""
    c = confidence / 100 if confidence > 1 else confidence
    return NormalDist().inv_cdf(0.5 + c / 2)


def deviation_points(scored: DataFrame, confidence: float, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Band ``baseline ± z·sigma`` (sigma = population deviation of the residuals) per bin."""
    rows = scored.withColumn("_r", F.col("value") - F.col("baseline"))
    rows = with_stats(rows, by, {"sigma": F.stddev_pop("_r")})
    half = F.col("sigma") * z_for(confidence)
    return (
        rows.withColumn("expected", F.col("baseline"))
        .withColumn("lower", F.col("baseline") - half)
        .withColumn("upper", F.col("baseline") + half)
        .withColumn("is_out", F.coalesce(F.abs("_r") > half, F.lit(False)))
        .drop("_r")
    )


def deviation_summary(points: DataFrame, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Share of bins in the band and the largest deviation."""
    dev = F.col("value") - F.col("expected")
    n = F.count(dev)
    return points.groupBy(*by).agg(
        n.alias("evaluated"),
        F.when(n > 0, F.count_if(dev.isNotNull() & ~F.col("is_out")) / n).otherwise(1.0).alias("pct_in_band"),
        F.coalesce(F.max(F.abs(dev)), F.lit(0.0)).alias("max_abs_deviation"),
    )


def deviation_band(scored: DataFrame, confidence: float, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Breach runs of the deviation band."""
    return breach_runs(deviation_points(scored, confidence, by), by)


def robust_points(scored: DataFrame, threshold: float = 1.5, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Median as expectation and the envelope of unflagged extremes as band."""
    by = list(by)
    s, v = F.col("score"), F.col("value")
    high, low = F.coalesce(s > threshold, F.lit(False)), F.coalesce(s < -threshold, F.lit(False))
    med = quantiles(scored, by, "value", {"expected": 0.5})
    band = scored.groupBy(*by).agg(
        F.coalesce(F.min(F.when(~low, v)), F.min(v)).alias("lower"),
        F.coalesce(F.max(F.when(~high, v)), F.max(v)).alias("upper"),
    )
    rows = attach(scored, med.join(band, by), by)
    return rows.withColumn("is_out", v.isNotNull() & (high | low))


def robust_deviation(scored: DataFrame, threshold: float = 1.5, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Breach runs of the robust band."""
    return breach_runs(robust_points(scored, threshold, by), by)


def change_point_two_lines(grid: DataFrame, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Best split into two least-squares lines, with level shift, slope change and kind.

    ``split_idx`` is the first index of the right line; each side has two points or more.
    """
    by = list(by)
    y0 = with_stats(grid.filter(F.col("value").isNotNull()), by, {"_n": F.count(F.lit(1)), "_mx": F.avg("bin_idx"), "_my": F.avg("value")})
    x, y = F.col("bin_idx") - F.col("_mx"), F.col("value") - F.col("_my")
    rows = y0.withColumn("_x", x).withColumn("_y", y)
    parts = {
        "l_n": F.lit(1.0),
        "l_x": F.col("_x"),
        "l_y": F.col("_y"),
        "l_xx": F.col("_x") * F.col("_x"),
        "l_xy": F.col("_x") * F.col("_y"),
        "l_yy": F.col("_y") * F.col("_y"),
    }
    rows = with_stats(rows, by, {"t" + n[1:]: F.sum(e) for n, e in parts.items()})
    rows = with_stats(rows, by, {"_lo": F.min("value"), "_hi": F.max("value")})
    rows = running_sum(rows, by, parts)

    def line(n, sx, sy, sxx, sxy, syy):
        vx, vy, cov = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
        slope = F.when(vx > 0, cov / F.when(vx > 0, vx)).otherwise(0.0)
        return slope, (sy - slope * sx) / n, F.greatest(vy - slope * cov, F.lit(0.0))

    names = ("n", "x", "y", "xx", "xy", "yy")
    left = [F.col(f"l_{c}") for c in names]
    right = [F.col(f"t_{c}") - F.col(f"l_{c}") for c in names]
    ls, lc, lsse = line(*left)
    rs, rc, rsse = line(*right)
    rows = rows.filter((F.col("l_n") >= 2) & (F.col("t_n") - F.col("l_n") >= 2))
    split = F.col("bin_idx") + 1
    pick = F.struct(
        (lsse + rsse).alias("sse"),
        split.alias("split_idx"),
        ls.alias("left_slope"),
        (lc + F.col("_my") - ls * F.col("_mx")).alias("left_intercept"),
        rs.alias("right_slope"),
        (rc + F.col("_my") - rs * F.col("_mx")).alias("right_intercept"),
        F.col("t_yy").alias("sst"),
        F.col("_n").alias("n"),
        (F.col("_hi") - F.col("_lo")).alias("spread"),
    )
    best = rows.groupBy(*by).agg(F.min(pick).alias("b")).select(*by, "b.*")
    slope_delta = F.col("right_slope") - F.col("left_slope")
    shift = (F.col("right_slope") * F.col("split_idx") + F.col("right_intercept")) - (
        F.col("left_slope") * F.col("split_idx") + F.col("left_intercept")
    )
    share = lambda c: F.when(F.col("spread") > 0, c / F.col("spread")).otherwise(0.0)
    out = best.withColumn("slope_delta", slope_delta).withColumn("level_shift", shift)
    level, slope = share(F.abs("level_shift")), share(F.abs("slope_delta") * F.col("n"))
    kind = (
        F.when((level < 0.05) & (slope < 0.05), "none")
        .when(level >= 2 * slope, "level-shift")
        .when(slope >= 2 * level, "slope-break")
        .otherwise("mixed")
    )
    return out.select(
        *by,
        "split_idx",
        F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).otherwise(0.0).alias("r_square"),
        "left_slope",
        "right_slope",
        "left_intercept",
        "right_intercept",
        "slope_delta",
        "level_shift",
        kind.alias("kind"),
    )
