"""Multivariate detectors over the tracks of an entity, with one result schema."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from signalmill.functions.frames import cells, empty_frame
from signalmill.functions.ordered import BLOCK, attach, framed, with_stats
from signalmill.functions.timeparts import as_us, floor_div, from_us, ntz
from signalmill.operators.anomaly import tukey_outliers
from signalmill.operators.grid import bin_count, fill_linear, make_series
from signalmill.operators.joins import top_k_per_group
from signalmill.operators.sequences import longest_gap
from signalmill.plans.runtime import checkpointed

TRACK = ["entity_id", "track_id"]
EVENT = ["entity_id", "bin_idx"]


@dataclass(frozen=True)
class Prepared:
    """Filled grid rows plus one quality row per track."""

    grid: DataFrame
    tracks: DataFrame
    start_us: int
    bin_us: int
    n: int


def prepare(
    src: DataFrame, start: datetime, end: datetime, bin_us: int, min_coverage: float = 0.95, max_gap: int = 3
) -> Prepared:
    """Regular tracks of ``entity_id, track_id, ts, value`` readings in ``[start, end)``.

    Coverage counts bins with a finite reading. A track is invalid for the first
    reason that holds: empty_series, no_finite_observations, insufficient_coverage,
    max_gap_exceeded.
    """
    n = bin_count(start, end, bin_us)
    if not (as_us(start) < as_us(end) and bin_us > 0 and 0 <= min_coverage <= 1 and max_gap >= 0):
        raise ValueError("need start < end, a positive bin, coverage in [0, 1] and a gap >= 0")
    # the only pass over the readings; all later work starts from the binned tracks
    raw = checkpointed(make_series(src.filter(F.col("ts") < ntz(end)), start, end, bin_us, "avg", TRACK))
    facts = raw.groupBy(*TRACK).agg(
        F.count(F.lit(1)).alias("point_count"), F.count("value").alias("observed_bins")
    )
    facts = facts.join(longest_gap(raw, TRACK), TRACK)
    coverage = F.when(F.col("point_count") > 0, F.col("observed_bins") / F.col("point_count")).otherwise(0.0)
    error = (
        F.when(F.col("point_count") <= 0, "empty_series")
        .when(F.col("observed_bins") <= 0, "no_finite_observations")
        .when(F.col("coverage") < min_coverage, "insufficient_coverage")
        .when(F.col("max_missing_run") > max_gap, "max_gap_exceeded")
        .otherwise("")
    )
    tracks = facts.withColumn("coverage", coverage).withColumn("validation_error", error).select(
        *TRACK,
        ntz(as_us(start)).alias("series_start"),
        ntz(as_us(start) + n * bin_us).alias("series_end"),
        F.lit(int(bin_us)).cast("bigint").alias("bin_us"),
        "point_count",
        "observed_bins",
        "coverage",
        "max_missing_run",
        (F.col("validation_error") == "").alias("is_valid"),
        "validation_error",
    )
    # one small row per track, read by every detector several times
    return Prepared(fill_linear(raw, TRACK), checkpointed(tracks), as_us(start), int(bin_us), n)


def coverage_report(prep: Prepared) -> DataFrame:
    """Quality columns per track."""
    return prep.tracks.select(*TRACK, "point_count", "observed_bins", "coverage", "max_missing_run", "is_valid", "validation_error")


def coverage_rollup(report: DataFrame) -> DataFrame:
    """Track count, lowest coverage, worst gap and invalid tracks per entity."""
    return report.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("track_count"),
        F.min("coverage").alias("min_coverage"),
        F.max("max_missing_run").alias("worst_max_gap"),
        F.count_if(~F.col("is_valid")).alias("invalid_tracks"),
    )


def profile(tracks: DataFrame, window_us: int, min_history: int) -> DataFrame:
    """Whether each entity can be scored: misaligned, too few tracks, coverage, validity, history, ok."""
    if window_us <= 0 or min_history < 1:
        raise ValueError("the detection window must be positive and the history at least 1")
    facts = tracks.groupBy("entity_id").agg(
        F.count_distinct("track_id").alias("track_count"),
        F.count_distinct(F.when(F.col("is_valid"), F.col("track_id"))).alias("valid_track_count"),
        F.count_distinct(F.when(~F.col("is_valid"), F.col("track_id"))).alias("invalid_track_count"),
        F.count_distinct("series_start", "series_end", "bin_us", "point_count").alias("_clocks"),
        F.min("series_start").alias("series_start"),
        F.max("series_end").alias("series_end"),
        F.min("bin_us").alias("bin_us"),
        F.max("point_count").alias("point_count"),
        F.array_sort(F.collect_set(F.when(F.col("validation_error") != "", F.col("validation_error")))).alias("_errors"),
    )
    window = F.lit(int(window_us))
    thin = F.arrays_overlap("_errors", F.array(F.lit("insufficient_coverage"), F.lit("max_gap_exceeded")))
    bins = F.floor(window / F.col("bin_us")).cast("bigint")
    aligned = (F.col("_clocks") == 1) & (bins >= 1) & (F.pmod(window, F.col("bin_us")) == 0)
    bad = F.col("invalid_track_count") > 0
    status = (
        F.when(~aligned, "misaligned_series")
        .when(F.col("track_count") < 2, "invalid_input")
        .when(bad & thin, "insufficient_coverage")
        .when(bad, "invalid_input")
        .when(F.col("point_count") - bins < min_history, "insufficient_history")
        .otherwise("ok")
    )
    return facts.select(
        "entity_id",
        "series_start",
        "series_end",
        "bin_us",
        "point_count",
        bins.alias("detection_bins"),
        "track_count",
        "valid_track_count",
        "invalid_track_count",
        status.alias("status"),
        F.array_join("_errors", ",").alias("detail"),
    )


# ---------------------------------------------------------------- causal filters


def fir(grid: DataFrame, coefs: Sequence[float], by: Sequence[str] = TRACK, name: str = "filtered") -> DataFrame:
    """Causal filter: sum of ``coefs[k]`` times the value ``k`` bins earlier, zero before the start."""

    def build(w):
        out = F.lit(0.0)
        for k, c in enumerate(coefs):
            if c:
                past = F.col("value") if k == 0 else F.lag("value", k).over(w)
                out = out + F.lit(float(c)) * F.coalesce(past, F.lit(0.0))
        return out

    return framed(grid, by, {name: build}, before=len(coefs) - 1)


def causal_deseason(grid: DataFrame, season: int, by: Sequence[str] = TRACK, name: str = "deseasoned") -> DataFrame:
    """Subtract the value one season earlier (zero before the first season ends)."""
    if season <= 0:
        return grid.withColumn(name, F.col("value"))
    return framed(grid, by, {name: _deseason(season)}, before=season)


def _deseason(season: int):
    return lambda w: F.col("value") - F.coalesce(F.lag("value", season).over(w), F.lit(0.0))


def trend_window(season: int) -> int:
    return max(4, min(64, season if season > 1 else 8))


def causal_residual(grid: DataFrame, season: int, trend: str = "linefit", by: Sequence[str] = TRACK) -> DataFrame:
    """Deseasoned value minus a trend guess from earlier bins only, as ``residual``.

    ``avg`` guesses the mean of the last window, ``linefit`` twice that mean minus the
    mean of the window before it; bins before the start count as zero.
    """
    if trend not in ("avg", "linefit", "none"):
        raise ValueError("trend is avg, linefit or none")
    width = trend_window(season)
    mean = lambda w, a, z: F.coalesce(F.sum("_d").over(w.rowsBetween(a, z)), F.lit(0.0)) / width
    guess = {
        "none": lambda w: F.lit(0.0),
        "avg": lambda w: mean(w, -width, -1),
        "linefit": lambda w: 2 * mean(w, -width, -1) - mean(w, -2 * width, -width - 1),
    }[trend]
    cols = {
        "_d": _deseason(season) if season > 0 else (lambda w: F.col("value")),
        "residual": lambda w: F.col("_d") - guess(w),
    }
    return framed(grid, by, cols, before=max(season, 0) + 2 * width).drop("_d")


def standardize_history(
    rows: DataFrame, column: str, history_end: Column | int, floor: float = 1e-6, by: Sequence[str] = TRACK, name: str = "standardized"
) -> DataFrame:
    """Scale by mean and population deviation of the bins before ``history_end``.

    A deviation below the floor only centres.
    """
    end = F.lit(history_end) if isinstance(history_end, int) else history_end
    past = F.when(F.col("bin_idx") < end, F.col(column))
    out = with_stats(rows, by, {"_m": F.avg(past), "_sd": F.stddev_pop(past)})
    centred = F.col(column) - F.col("_m")
    return out.withColumn(name, F.when(F.col("_sd") >= floor, centred / F.col("_sd")).otherwise(centred)).drop("_m", "_sd")


def hann(i: Column, n: int) -> Column:
    """Hann weight of sample ``i`` in a window of ``n``."""
    return 0.5 - 0.5 * F.cos(F.lit(2.0 * np.pi) * i / F.lit(float(n - 1)))


# ---------------------------------------------------------------- shared result shape


def _explain(**pairs) -> Column:
    items = []
    for k, v in pairs.items():
        items += [F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string")]
    return F.create_map(*items)


def diagnostics(profiles: DataFrame, algorithm: str) -> DataFrame:
    """One row per entity that could not be scored (``event_index`` -1)."""
    bins = F.col("detection_bins")
    begin = F.col("series_start") + _span((F.col("point_count") - bins) * F.col("bin_us"))
    return profiles.filter(F.col("status") != "ok").select(
        "entity_id",
        F.lit(algorithm).alias("algorithm"),
        F.lit(-1).cast("bigint").alias("event_index"),
        F.col("series_end").alias("event_time"),
        F.when((bins >= 1) & (bins <= F.col("point_count")), begin).otherwise(F.col("series_start")).alias("window_start"),
        F.col("series_end").alias("window_end"),
        *[F.lit(None).cast("double").alias(c) for c in ("score", "threshold", "severity")],
        F.lit(False).alias("is_anomaly"),
        F.lit(0).cast("bigint").alias("vote_count"),
        F.lit(0.0).alias("vote_fraction"),
        "track_count",
        F.array().cast(CONTRIBUTORS).alias("contributors"),
        "status",
        _explain(
            detail=F.col("detail"),
            point_count=F.col("point_count"),
            detection_bins=bins,
            valid_track_count=F.col("valid_track_count"),
            invalid_track_count=F.col("invalid_track_count"),
        ).alias("explain"),
    )


CONTRIBUTORS = "array<struct<track_id:string,score:double,voted:boolean,detail:map<string,string>>>"


def _span(us: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us.cast("decimal(24,0)") / 1_000_000).cast("decimal(18,6)"))


def _vote(
    evidence: DataFrame,
    feature: str,
    threshold: float,
    rms: float,
    extreme: float,
    required: Column,
    voters: Column,
    emit_all: bool,
    detail: Column | None = None,
    k: int = 5,
) -> DataFrame:
    """Root mean square, votes, extreme value and leading tracks of the evidence per event.

    ``voters`` is the number of voices (tracks or projections). With ``detail`` the
    ``k`` best tracks come along in the same pass.
    """
    f = F.col(feature)
    aggs = [F.sum(f * f).alias("_ss"), F.max(f).alias("_max"), F.count_if(f >= threshold).alias("vote_count")]
    if detail is not None:
        w = Window.partitionBy(*EVENT).orderBy(f.desc(), "track_id")
        evidence = evidence.withColumn("rank", F.row_number().over(w))
        item = F.struct("rank", "track_id", f.alias("score"), (f >= threshold).alias("voted"), detail.alias("detail"))
        aggs.append(_ordered(F.collect_list(F.when(F.col("rank") <= k, item))).alias("contributors"))
    facts = evidence.groupBy(*EVENT, "track_count").agg(*aggs)
    facts = facts.withColumn("score", F.sqrt(F.col("_ss") / voters)).withColumn("_required", required)
    facts = facts.withColumn("vote_fraction", F.col("vote_count") / voters)
    hit = (F.col("score") >= rms) | (F.col("vote_count") >= F.col("_required")) | (F.col("_max") >= extreme)
    worst = F.greatest(F.col("score") / rms, F.col("vote_count") / F.col("_required"), F.col("_max") / extreme)
    facts = facts.withColumn("is_anomaly", hit).withColumn("severity", worst).withColumn("threshold", F.lit(float(rms)))
    return facts.drop("_ss") if emit_all else facts.filter("is_anomaly").drop("_ss")


def _required(min_votes: int, fraction: float) -> Column:
    return F.greatest(F.lit(int(min_votes)).cast("bigint"), F.ceil(F.lit(float(fraction)) * F.col("track_count")))


def _ordered(items: Column) -> Column:
    """Ranked structs as the contributor array, best first."""
    ranked = F.array_sort(items, lambda a, b: a["rank"] - b["rank"])
    fields = ("track_id", "score", "voted", "detail")
    return F.transform(ranked, lambda e: F.struct(*[e[n].alias(n) for n in fields])).cast(CONTRIBUTORS)


def _pack(rows: DataFrame, k: int, by: Sequence[str], score: str, voted: Column, detail: Column, tie: Sequence[str] = ("track_id",)) -> DataFrame:
    head = top_k_per_group(rows, k, by, [F.col(score).desc(), *[F.col(c) for c in tie]])
    item = F.struct("rank", "track_id", F.col(score).alias("score"), voted.alias("voted"), detail.alias("detail"))
    return head.groupBy(*by).agg(_ordered(F.collect_list(item)).alias("contributors"))


def _results(
    scores: DataFrame, prep: Prepared, algorithm: str, first: Column, last: Column, explain: Column, at: Column | None = None
) -> DataFrame:
    """Common result rows; ``first``/``last`` are bin offsets of the event window."""
    moment = lambda b: from_us(b * prep.bin_us + prep.start_us)
    return scores.select(
        "entity_id",
        F.lit(algorithm).alias("algorithm"),
        F.col("bin_idx").cast("bigint").alias("event_index"),
        moment(F.col("bin_idx") if at is None else at).alias("event_time"),
        moment(first).alias("window_start"),
        moment(last).alias("window_end"),
        "score",
        "threshold",
        "severity",
        "is_anomaly",
        "vote_count",
        "vote_fraction",
        "track_count",
        F.coalesce("contributors", F.array().cast(CONTRIBUTORS)).alias("contributors"),
        F.lit("ok").alias("status"),
        explain.alias("explain"),
    )


def _scored_grid(prep: Prepared, profiles: DataFrame) -> DataFrame:
    ok = profiles.filter(F.col("status") == "ok").select("entity_id", "track_count", "detection_bins")
    return attach(prep.grid, ok, "entity_id")


def _check(**conditions: bool) -> None:
    bad = [name for name, fine in conditions.items() if not fine]
    if bad:
        raise ValueError(f"invalid parameter: {', '.join(bad)}")


# ---------------------------------------------------------------- detectors


def residual_voting(
    prep: Prepared,
    window_us: int,
    season: int = 0,
    trend: str = "linefit",
    outlier_kind: str = "ctukey",
    feature_threshold: float = 1.5,
    rms_threshold: float = 1.2,
    min_votes: int = 2,
    min_fraction: float = 0.5,
    extreme_threshold: float = 3.0,
    emit_all: bool = False,
) -> DataFrame:
    """Outlier score of each track's causal residual, pooled per event bin."""
    _check(
        season=season >= -1, outlier_kind=outlier_kind in ("ctukey", "tukey"), thresholds=min(feature_threshold, rms_threshold, extreme_threshold) > 0,
        min_votes=min_votes >= 1, min_fraction=0 < min_fraction <= 1,
    )
    profiles = profile(prep.tracks, window_us, max(16, 2 * season if season > 0 else 16))
    rows = causal_residual(_scored_grid(prep, profiles), season, trend)
    tail = F.col("bin_idx") >= prep.n - F.col("detection_bins")
    rows = standardize_history(rows, "residual", prep.n - F.col("detection_bins"))
    rows = tukey_outliers(rows, outlier_kind, "standardized", TRACK).filter(tail)
    evidence = rows.withColumn("feature_score", F.abs("score")).filter(F.col("feature_score").isNotNull())
    scores = _vote(
        evidence, "feature_score", feature_threshold, rms_threshold, extreme_threshold, _required(min_votes, min_fraction),
        F.col("track_count"), emit_all, _explain(feature_score=F.col("feature_score")),
    )
    explain = _explain(
        feature_score_threshold=feature_threshold, required_votes=F.col("_required"), maximum_feature_score=F.col("_max"),
        outlier_kind=outlier_kind, seasonality=season, trend=trend,
    )
    i = F.col("bin_idx")
    return _results(scores, prep, "residual_voting", i, i + 1, explain).unionByName(diagnostics(profiles, "residual_voting"))


def change_point(
    prep: Prepared,
    window_us: int,
    season: int = 0,
    contrast: int = 8,
    track_threshold: float = 1.5,
    rms_threshold: float = 1.2,
    min_votes: int = 2,
    min_fraction: float = 0.5,
    extreme_threshold: float = 3.0,
    slopes: bool = True,
    emit_all: bool = False,
) -> DataFrame:
    """Contrast of two adjacent windows in level and slope, scored per track and pooled."""
    _check(
        season=season >= -1, contrast=2 <= contrast <= 4096, thresholds=min(track_threshold, rms_threshold, extreme_threshold) > 0,
        min_votes=min_votes >= 1, min_fraction=0 < min_fraction <= 1,
    )
    warm = 2 * contrast
    profiles = profile(prep.tracks, window_us, max(16, warm + 8))
    i = F.col("bin_idx")
    half = lambda c, w, a, z: F.coalesce(F.sum(c).over(w.rowsBetween(a, z)), F.lit(0.0)) / contrast
    gap = lambda c: lambda w: half(c, w, -(contrast - 1), 0) - half(c, w, -(warm - 1), -contrast)
    cols = {
        "_d": _deseason(season) if season > 0 else (lambda w: F.col("value")),
        "_step": lambda w: F.col("_d") - F.coalesce(F.lag("_d").over(w), F.lit(0.0)),
        "level_contrast": gap("_d"),
        "slope_contrast": gap("_step"),
    }
    rows = framed(_scored_grid(prep, profiles), TRACK, cols, before=max(season, 0) + warm + 1)
    # the filters' warm-up must not shape the fences
    rows = rows.withColumn("_lv", F.when(i >= warm - 1, F.col("level_contrast"))).withColumn("_sv", F.when(i >= warm, F.col("slope_contrast")))
    rows = tukey_outliers(rows, "ctukey", "_lv", TRACK, name="_ls")
    rows = tukey_outliers(rows, "ctukey", "_sv", TRACK, name="_ss") if slopes else rows.withColumn("_ss", F.lit(0.0))
    rows = rows.filter(i >= prep.n - F.col("detection_bins"))
    rows = rows.withColumn("level_score", F.abs("_ls")).withColumn("slope_score", F.abs("_ss"))
    if not slopes:
        rows = rows.withColumn("slope_contrast", F.lit(0.0))
    both = F.sqrt((F.col("level_score") * F.col("level_score") + F.col("slope_score") * F.col("slope_score")) / 2.0)
    evidence = rows.withColumn("track_score", both if slopes else F.col("level_score")).filter(F.col("track_score").isNotNull())
    kind = (
        F.when((F.col("level_score") >= track_threshold) & (F.col("slope_score") >= track_threshold), "mixed")
        .when(F.col("slope_score") >= F.col("level_score"), "slope_break")
        .otherwise("level_shift")
    )
    steeper = F.abs("slope_contrast") > F.abs("level_contrast")
    side = F.signum(F.when(steeper, F.col("slope_contrast")).otherwise(F.col("level_contrast"))).cast("int")
    detail = _explain(
        change_type=kind, direction=side, level_score=F.col("level_score"), slope_score=F.col("slope_score"),
        level_contrast=F.col("level_contrast"), slope_contrast=F.col("slope_contrast"),
    )
    scores = _vote(
        evidence, "track_score", track_threshold, rms_threshold, extreme_threshold, _required(min_votes, min_fraction),
        F.col("track_count"), emit_all, detail,
    )
    explain = _explain(
        contrast_window_bins=contrast, track_score_threshold=track_threshold, required_votes=F.col("_required"),
        maximum_track_score=F.col("_max"), detect_slope_changes=slopes, seasonality=season,
    )
    return _results(scores, prep, "change_point", i - warm + 1, i + 1, explain).unionByName(diagnostics(profiles, "change_point"))


def projection_weights(tracks: DataFrame, count: int, density: float, seed: str) -> DataFrame:
    """Sparse random signs per entity, projection and track, from SHA-256 digests.

    Byte 0 below ``density`` includes a track, nibble 2 gives the sign; the track with
    the smallest second digest is always included. Weights are ±1/sqrt(included).
    """
    rows = tracks.select(*TRACK).distinct().withColumn("projection_id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    text = lambda mark: F.sha2(F.concat(F.lit(f"{seed}|{mark}"), F.col("projection_id").cast("string"), F.lit("|"), F.col("track_id")), 256)
    rows = rows.withColumn("_h", text("")).withColumn("_force", text("force|"))
    digit = lambda at, n: F.conv(F.substring("_h", at, n), 16, 10).cast("int")
    rows = rows.withColumn("_in", digit(1, 2) / 256.0 < density).withColumn("_sign", F.when(digit(3, 1) % 2 == 0, 1.0).otherwise(-1.0))
    forced = rows.groupBy("entity_id", "projection_id").agg(F.min_by("track_id", "_force").alias("_forced"))
    rows = rows.join(forced, ["entity_id", "projection_id"]).filter(F.col("_in") | (F.col("track_id") == F.col("_forced")))
    size = rows.groupBy("entity_id", "projection_id").agg(F.count(F.lit(1)).alias("_k"))
    rows = rows.join(size, ["entity_id", "projection_id"])
    return rows.select(*TRACK, "projection_id", (F.col("_sign") / F.sqrt("_k")).alias("weight"))


def random_projection(
    prep: Prepared,
    window_us: int,
    season: int = 0,
    trend: str = "linefit",
    count: int = 16,
    density: float = 0.25,
    seed: str = "signalmill",
    projection_threshold: float = 1.5,
    rms_threshold: float = 1.2,
    min_votes: int = 2,
    extreme_threshold: float = 3.0,
    floor: float = 1e-6,
    max_work_rows: int | None = None,
    emit_all: bool = False,
    block: int = 2048,
) -> DataFrame:
    """Outlier score of sparse random mixtures of the standardized residuals.

    All entities are scored. Only a caller that gives ``max_work_rows`` has entities whose
    included weights times points exceed it set aside with ``work_limit_exceeded``.
    """
    _check(
        season=season >= -1, count=2 <= count <= 512, density=0 < density <= 1, seed=bool(seed), min_votes=1 <= min_votes <= count,
        thresholds=min(projection_threshold, rms_threshold, extreme_threshold, floor) > 0, max_work_rows=max_work_rows is None or max_work_rows >= 1,
    )
    profiles = profile(prep.tracks, window_us, max(16, 2 * season if season > 0 else 16))
    ok = profiles.filter(F.col("status") == "ok").select("entity_id")
    weights = checkpointed(projection_weights(prep.tracks.join(ok, "entity_id", "left_semi"), count, density, seed))
    work = weights.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_w"))
    guarded = profiles.join(work, "entity_id", "left").withColumn("_work", F.coalesce("_w", F.lit(0)) * F.col("point_count"))
    over = F.lit(False) if max_work_rows is None else (F.col("status") == "ok") & (F.col("_work") > max_work_rows)
    guarded = (
        guarded.withColumn("detail", F.when(over, F.concat(F.lit("estimated rows "), F.col("_work").cast("string"))).otherwise(F.col("detail")))
        .withColumn("status", F.when(over, "work_limit_exceeded").otherwise(F.col("status")))
        .drop("_w", "_work")
    )
    rows = causal_residual(_scored_grid(prep, guarded), season, trend)
    rows = standardize_history(rows, "residual", prep.n - F.col("detection_bins"), floor)
    live = weights.join(guarded.filter(F.col("status") == "ok").select("entity_id"), "entity_id", "left_semi")
    values = rows.select(*TRACK, "bin_idx", "standardized").withColumn("_blk", floor_div(F.col("bin_idx"), block))
    blocks = F.sequence(F.lit(0).cast("bigint"), F.lit(max(0, (prep.n - 1) // block)).cast("bigint"))
    spread = live.select(
        F.col("entity_id").alias("_e"), F.col("track_id").alias("_t"), F.col("projection_id").alias("_p"), F.col("weight").alias("_w"), F.explode(blocks).alias("_b")
    )
    mixed = cells(values, ["entity_id", "_blk"], spread, ["_e", "_b"])

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return empty_frame(["entity_id"], ["projection_id", "bin_idx"], ["projected"])
        names = {n: k for k, n in enumerate(sorted(left["track_id"].unique()))}
        lo = int(left["bin_idx"].min())
        size = int(left["bin_idx"].max()) - lo + 1
        x = np.zeros((len(names), size))
        x[left["track_id"].map(names).to_numpy(), left["bin_idx"].to_numpy() - lo] = left["standardized"].to_numpy()
        m = np.zeros((count, len(names)))
        m[right["_p"].to_numpy(), right["_t"].map(names).to_numpy()] = right["_w"].to_numpy()
        y = m @ x
        return pd.DataFrame(
            {
                "entity_id": left["entity_id"].iloc[0],
                "projection_id": np.repeat(np.arange(count), size),
                "bin_idx": np.tile(np.arange(lo, lo + size), count),
                "projected": y.ravel(),
            }
        )

    projected = mixed.applyInPandas(kernel, "entity_id string, projection_id int, bin_idx long, projected double")
    projected = projected.withMetadata("bin_idx", {"bins": prep.n})
    scored = tukey_outliers(projected, "ctukey", "projected", ["entity_id", "projection_id"])
    facts = guarded.select("entity_id", "track_count", "detection_bins")
    evidence = attach(scored, facts, "entity_id").filter(F.col("bin_idx") >= prep.n - F.col("detection_bins"))
    evidence = evidence.withColumn("projection_score", F.abs("score"))
    scores = _vote(
        evidence, "projection_score", projection_threshold, rms_threshold, extreme_threshold,
        F.lit(min_votes).cast("bigint"), F.lit(float(count)), emit_all,
    )
    hits = rows.join(scores.filter("is_anomaly").select(*EVENT), EVENT, "left_semi").select(*TRACK, "bin_idx", "standardized")
    shares = hits.join(live, TRACK).withColumn("_share", F.abs(F.col("weight") * F.col("standardized")))
    detail = _explain(projection_id=F.col("projection_id"), weight=F.col("weight"), standardized_residual=F.col("standardized"))
    packed = _pack(shares, 8, EVENT, "_share", F.lit(True), detail, ("track_id", "projection_id"))
    explain = _explain(
        projection_count=count, projection_density=density, projection_score_threshold=projection_threshold,
        minimum_projection_votes=min_votes, maximum_projection_score=F.col("_max"), seed=seed,
    )
    i = F.col("bin_idx")
    return _results(scores.join(packed, EVENT, "left"), prep, "random_projection", i, i + 1, explain).unionByName(diagnostics(guarded, "random_projection"))


def frame_spectra(prep: Prepared, rows: DataFrame, width: int, windows: int, use_hann: bool) -> DataFrame:
    """Half spectra of the latest frame (ordinal 0) and the frames before it, per track."""
    ordinal = floor_div(prep.n - 1 - F.col("bin_idx"), width)
    per_task = max(1, BLOCK // width)
    rows = rows.withColumn("_ordinal", ordinal).filter(F.col("_ordinal") <= windows)
    rows = rows.withColumn("_chunk", floor_div(F.col("_ordinal"), per_task))
    n = prep.n

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        ordinals, row = np.unique(pdf["_ordinal"].to_numpy(), return_inverse=True)
        frames = np.zeros((len(ordinals), width))
        frames[row, pdf["bin_idx"].to_numpy() - (n - (pdf["_ordinal"].to_numpy() + 1) * width)] = pdf["value"].to_numpy(dtype=float)
        centred = frames - frames.mean(axis=1, keepdims=True)
        sd = frames.std(axis=1, keepdims=True)
        z = np.where(sd >= 1e-9, centred / np.where(sd >= 1e-9, sd, 1.0), centred)
        if use_hann:
            z = z * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / (width - 1)))
        mags = np.abs(np.fft.rfft(z, axis=1))[:, 1 : width // 2 + 1]
        return pd.DataFrame(
            {
                "entity_id": pdf["entity_id"].iloc[0],
                "track_id": pdf["track_id"].iloc[0],
                "ordinal": np.repeat(ordinals, mags.shape[1]),
                "frequency_bin": np.tile(np.arange(1, mags.shape[1] + 1), len(ordinals)),
                "magnitude": mags.ravel(),
            }
        )

    schema = "entity_id string, track_id string, ordinal long, frequency_bin long, magnitude double"
    return rows.select(*TRACK, "bin_idx", "value", "_ordinal", "_chunk").groupBy(*TRACK, "_chunk").applyInPandas(kernel, schema)


def spectral(
    prep: Prepared,
    window_us: int,
    baseline_windows: int = 8,
    min_baseline: int = 3,
    use_hann: bool = True,
    track_threshold: float = 2.0,
    rms_threshold: float = 1.5,
    min_votes: int = 2,
    min_fraction: float = 0.5,
    extreme_threshold: float = 4.0,
    emit_all: bool = False,
) -> DataFrame:
    """Cosine distance of the latest spectrum to the mean of earlier ones, per track and pooled."""
    _check(
        baseline_windows=2 <= baseline_windows <= 128, min_baseline=2 <= min_baseline <= baseline_windows,
        thresholds=min(track_threshold, rms_threshold, extreme_threshold) > 0, min_votes=min_votes >= 1, min_fraction=0 < min_fraction <= 1,
    )
    width = max(1, window_us // prep.bin_us)
    available = max(0, (prep.n - width) // width)
    windows = min(baseline_windows, available)
    base = profile(prep.tracks, window_us, 1)
    ok = F.col("status") == "ok"
    status = (
        F.when(~ok, F.col("status"))
        .when(F.lit(width < 32 or available < min_baseline), "insufficient_history")
        .otherwise("ok")
    )
    profiles = base.withColumn("status", status)
    spectra = frame_spectra(prep, _scored_grid(prep, profiles), width, windows, use_hann)
    centroids = spectra.filter(F.col("ordinal") > 0).groupBy(*TRACK, "frequency_bin").agg(F.avg("magnitude").alias("centroid"))
    joined = spectra.join(centroids, [*TRACK, "frequency_bin"])
    m, c = F.col("magnitude"), F.col("centroid")
    parts = joined.groupBy(*TRACK, "ordinal").agg(F.sum(m * c).alias("_dot"), F.sqrt(F.sum(m * m)).alias("_a"), F.sqrt(F.sum(c * c)).alias("_b"))
    tiny_a, tiny_b = F.col("_a") <= 1e-12, F.col("_b") <= 1e-12
    distance = F.when(tiny_a & tiny_b, 0.0).when(tiny_a | tiny_b, 1.0).otherwise(1 - F.col("_dot") / (F.col("_a") * F.col("_b")))
    parts = parts.withColumn("distance", distance)
    # at most 128 distances per track
    past = parts.filter(F.col("ordinal") > 0).groupBy(*TRACK).agg(
        *[F.percentile("distance", p).alias(n) for n, p in (("_p25", 0.25), ("_p50", 0.5), ("_p75", 0.75))]
    )
    spread = F.greatest((F.col("_p75") - F.col("_p25")) / 1.349, F.lit(1e-6))
    now = parts.filter(F.col("ordinal") == 0).join(past, TRACK)
    evidence = now.withColumn("track_score", F.greatest(F.lit(0.0), (F.col("distance") - F.col("_p50")) / spread))
    evidence = evidence.join(profiles.select("entity_id", "track_count"), "entity_id").withColumn("bin_idx", F.lit(prep.n - 1).cast("bigint"))
    change = F.abs(m - c) / F.greatest(F.abs(c), F.lit(1e-9))
    moved = joined.filter(F.col("ordinal") == 0).withColumn("_change", change)
    top = top_k_per_group(moved, 3, TRACK, [F.col("_change").desc(), F.col("frequency_bin")])
    top = top.groupBy(*TRACK).agg(F.sort_array(F.collect_list(F.struct("rank", "frequency_bin"))).alias("_t"))
    top = top.select(*TRACK, F.array_join(F.transform("_t", lambda e: e["frequency_bin"].cast("string")), ",").alias("_top"))
    evidence = evidence.join(top, TRACK, "left")
    detail = _explain(
        latest_cosine_distance=F.col("distance"), historical_distance_median=F.col("_p50"), historical_distance_p25=F.col("_p25"),
        historical_distance_p75=F.col("_p75"), changed_frequencies=F.col("_top"),
    )
    scores = _vote(
        evidence, "track_score", track_threshold, rms_threshold, extreme_threshold, _required(min_votes, min_fraction),
        F.col("track_count"), emit_all, detail,
    )
    explain = _explain(
        fft_window_bins=width, baseline_windows=windows, hann_window=use_hann, track_score_threshold=track_threshold,
        required_votes=F.col("_required"), maximum_track_score=F.col("_max"),
    )
    end = F.lit(prep.n).cast("bigint")
    out = _results(scores, prep, "spectral_aggregation", end - width, end, explain, at=end)
    return out.unionByName(diagnostics(profiles, "spectral_aggregation"))


DETECTORS = {
    "residual_voting": residual_voting,
    "change_point": change_point,
    "random_projection": random_projection,
    "spectral_aggregation": spectral,
}


def contributor_shares(results: DataFrame, limit: int = 5) -> DataFrame:
    """Voting contributors (else the best one) of each event and their share of the shown score."""
    rows = results.filter(F.size("contributors") > 0).select(
        "entity_id", "algorithm", "event_index", F.posexplode("contributors").alias("_p", "c")
    )
    rows = rows.select("entity_id", "algorithm", "event_index", "_p", "c.*").withColumn("score", F.coalesce("score", F.lit(0.0)))
    keys = ["entity_id", "algorithm", "event_index"]
    whole = Window.partitionBy(*keys)
    order = whole.orderBy(F.col("voted").desc(), F.col("score").desc(), "_p")
    rows = rows.withColumn("_any", F.max(F.col("voted").cast("int")).over(whole)).withColumn("rank", F.row_number().over(order))
    shown = rows.filter(F.when(F.col("_any") == 1, F.col("voted") & (F.col("rank") <= limit)).otherwise(F.col("rank") == 1))
    plus = F.greatest(F.lit(0.0), F.col("score"))
    shown = shown.withColumn("_sum", F.sum(plus).over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))
    share = F.when(F.col("_sum") > 0, plus / F.col("_sum")).otherwise(1 / F.col("_n"))
    return shown.select(*keys, "rank", "track_id", "score", "voted", share.alias("share"))
