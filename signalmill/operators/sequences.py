"""Runs, episodes and ordered selection along a grid."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from signalmill.functions.ordered import BLOCK, attach, fits_block, framed, ordinal, runs
from signalmill.functions.quantiles import quantiles
from signalmill.functions.timeparts import to_us
from signalmill.plans.runtime import discard, written

SIGNAL = ("signal_id",)


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], bucket: Column, name: str = "rank") -> DataFrame:
    """One-based row number that restarts per group; ``bucket`` follows the order (see ``ordinal``)."""
    return ordinal(df, by, order, bucket, name=name).withColumn(name, F.col(name) + 1)


def dedup_runs(df: DataFrame, by: Sequence[str], col: str, idx: str = "bin_idx") -> DataFrame:
    """Keep the first row of every run of equal values."""
    out = framed(df, by, {"_before": lambda w: F.lag(col).over(w), "_has": lambda w: F.lag(F.lit(1)).over(w)}, before=1, idx=idx)
    return out.filter(F.col("_has").isNull() | ~F.col("_before").eqNullSafe(F.col(col))).drop("_before", "_has")


def longest_gap(grid: DataFrame, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Longest stretch of NULL bins per key (0 when none)."""
    by = list(by)
    islands = runs(grid, by, F.col("value").isNull(), "_run")
    sizes = islands.groupBy(*by, "_run").agg(F.count_if(F.col("value").isNull()).alias("_len"))
    return sizes.groupBy(*by).agg(F.max("_len").alias("max_missing_run"))


def band_column(value: Column, thresholds: Sequence[float], labels: Sequence[str]) -> Column:
    """State label; each threshold is the inclusive lower bound of the band above it."""
    if len(labels) != len(thresholds) + 1 or len(labels) < 2:
        raise ValueError("give one more label than thresholds, at least two")
    if any(b <= a for a, b in zip(thresholds, thresholds[1:])):
        raise ValueError("thresholds must ascend")
    state = F.lit(labels[0])
    for t, label in zip(thresholds, labels[1:]):
        state = F.when(value >= t, label).otherwise(state)
    return state


def state_episodes(
    grid: DataFrame, thresholds: Sequence[float], labels: Sequence[str], by: Sequence[str] = SIGNAL
) -> DataFrame:
    """Stretches of one state: ``seg_id, state, start_ts, end_ts, bins``."""
    by = list(by)
    tagged = grid.withColumn("state", band_column(F.col("value"), thresholds, labels))
    islands = runs(tagged, by, F.col("state"), "_run")
    out = islands.groupBy(*by, (F.col("_run") - 1).alias("seg_id"), "state").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("bins")
    )
    return out.select(*by, F.col("seg_id").cast("bigint").alias("seg_id"), "state", "start_ts", "end_ts", "bins")


def episode_duration(episodes: DataFrame, bin_us: int) -> DataFrame:
    """Span from first to last bin plus one bin, in seconds."""
    span = (to_us("end_ts") - to_us("start_ts")).cast("double") / 1e6
    return episodes.withColumn("duration_s", span + bin_us / 1e6)


def state_dwell(episodes: DataFrame, bin_us: int, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Episode count and total dwell time per state."""
    return episode_duration(episodes, bin_us).groupBy(*by, "state").agg(
        F.count(F.lit(1)).alias("episodes"), F.sum("duration_s").alias("total_s")
    )


def mine_sequences(episodes: DataFrame, n: int, bin_us: int, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Count and median total duration of every run of ``n`` consecutive states."""
    if n < 2:
        raise ValueError("a sequence has at least two states")
    by = list(by)
    timed = episode_duration(episodes, bin_us)
    ahead = lambda w: w.rowsBetween(0, n - 1)
    grams = framed(
        timed,
        by,
        {"_states": lambda w: F.collect_list("state").over(ahead(w)), "total_s": lambda w: F.sum("duration_s").over(ahead(w))},
        after=n - 1,
        idx="seg_id",
    ).filter(F.size("_states") == n)
    grams = grams.withColumn("sequence", F.array_join("_states", " > "))
    keys = [*by, "sequence"]
    counts = grams.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return counts.join(quantiles(grams, keys, "total_s", {"median_s": 0.5}), keys)


def breach_runs(scored: DataFrame, by: Sequence[str] = SIGNAL, extra: Sequence[str] = ()) -> DataFrame:
    """Contiguous ``is_out`` bins with their peak deviation from ``expected`` and its side."""
    by = list(by)
    flagged = scored.withColumn("_out", F.coalesce("is_out", F.lit(False))).withColumn("_dev", F.col("value") - F.col("expected"))
    islands = runs(flagged, by, F.col("_out"), "_run").filter("_out")
    peak = F.struct(F.abs("_dev").alias("a"), (-F.col("bin_idx")).alias("i"))
    out = islands.groupBy(*by, "_run").agg(
        F.min("bin_idx").alias("start_idx"),
        F.max("bin_idx").alias("end_idx"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.max_by("_dev", peak).alias("peak_deviation"),
        F.max_by("value", peak).alias("peak_value"),
    )
    return out.withColumn("direction", F.when(F.col("peak_deviation") >= 0, "high").otherwise("low")).drop("_run")


def _greedy(pdf: pd.DataFrame, k: int, radius: int, idx: str) -> pd.DataFrame:
    taken: list[int] = []
    rows = []
    for row in pdf.sort_values("_order").itertuples(index=False):
        at = getattr(row, idx)
        if all(abs(at - other) > radius for other in taken):
            taken.append(at)
            rows.append(row)
            if len(rows) == k:
                break
    out = pd.DataFrame(rows, columns=pdf.columns)
    out["pick"] = range(1, len(out) + 1)
    return out


CUTS = (0.0003, 0.001, 0.003, 0.01, 0.03, 0.1, 0.3)


def _near_best(rows: DataFrame, by: Sequence[str], score: Column, bound: int, descending: bool) -> DataFrame:
    """Drop rows that a sketch proves to lie behind the best ``bound`` rows of their key."""
    rows = rows.withColumn("_key", -score if descending else score)
    facts = rows.groupBy(*by).agg(F.percentile_approx("_key", list(CUTS), 10_000).alias("_e"), F.count("_key").alias("_n"))
    # the sketch ranks within 1/10,000 of the rows; allow twice that
    safe = lambda p: (F.lit(p) - 0.0002) * F.col("_n") > bound
    limit = F.lit(float("inf"))
    for i, p in reversed(list(enumerate(CUTS))):
        limit = F.when(safe(p), F.col("_e")[i].cast("double")).otherwise(limit)
    kept = attach(rows, facts.select(*by, limit.alias("_limit")), by, salt="_key")
    return kept.filter(F.col("_key") <= F.col("_limit")).drop("_key", "_limit")


def pick_nonoverlap(
    scored: DataFrame,
    k: int,
    radius: int,
    score: str,
    by: Sequence[str] = SIGNAL,
    idx: str = "bin_idx",
    descending: bool = True,
) -> DataFrame:
    """Best-first picks per key whose indices lie more than ``radius`` apart.

    A pick rules out at most ``2*radius + 1`` indices, so the first ``k`` picks are
    always among the best ``k*(2*radius+1)`` rows (one row per index): only those
    reach a task, and the cut loses nothing.
    """
    by = list(by)
    bound = k * (2 * radius + 1)
    if not fits_block(scored, idx):
        scored = _near_best(scored, by, F.col(score), bound, descending)
    best = F.col(score).desc() if descending else F.col(score).asc()
    w = Window.partitionBy(*by).orderBy(best, F.col(idx).asc())
    head = (
        scored.filter(F.col(score).isNotNull()).withColumn("_order", F.row_number().over(w)).filter(F.col("_order") <= bound)
    )
    schema = T.StructType([*head.schema.fields, T.StructField("pick", T.LongType())])
    picks = head.groupBy(*by).applyInPandas(lambda pdf: _greedy(pdf, k, radius, idx), schema)
    return picks.drop("_order")


def pick_all(scored: DataFrame, radius: int, score: str, by: Sequence[str] = SIGNAL, idx: str = "bin_idx", block: int = BLOCK) -> DataFrame:
    """All best-first picks per key (lowest score, then lowest index) more than ``radius`` apart.

    In each round every row that is the best within ``radius`` is picked and its neighbours go:
    the picks that taking one row at a time would make. Rows are compared within index blocks.
    """
    by = list(by)
    left, path = written(scored.filter(F.col(score).isNotNull()).withMetadata(idx, {}))
    spark, out = left.sparkSession, None
    near = lambda w: w.rangeBetween(-radius, radius)
    while True:
        rows = framed(left, by, {"_best": lambda w: F.min(F.struct(score, idx)).over(near(w))}, radius, radius, idx, block)
        rows = framed(rows.withColumn("_top", F.col("_best")[idx] == F.col(idx)), by, {"_gone": lambda w: F.max("_top").over(near(w))}, radius, radius, idx, block)
        rows, _ = written(rows.drop("_best"))
        if path:
            discard(spark, path)
        picks = rows.filter("_top").drop("_top", "_gone")
        out = picks if out is None else out.unionByName(picks)
        left, path = rows.filter("not _gone").drop("_top", "_gone"), None
        if left.isEmpty():
            return out
