"""Pattern search, symbolic discords, word-bag classification and cycles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from signalmill.functions.frames import cells, empty_frame
from signalmill.functions.ordered import SALTS, attach, framed, known_bins, mark_bins, with_row
from signalmill.functions.quantiles import quantiles
from signalmill.functions.symbols import (
    EDGE, ROUNDED_BREAKPOINTS, fitted_breakpoints, gaussian_breakpoints, literal_array, mindist, similarity, symbol_index, symbolize,
)
from signalmill.functions.timeparts import as_us, floor_div, from_us, to_us
from signalmill.operators.catalog import best_row
from signalmill.operators.grid import fill_linear, make_series, search_space
from signalmill.operators.joins import at_classes, join_dim, map_tracks, top_k_per_group
from signalmill.operators.sequences import pick_nonoverlap
from signalmill.operators.spectral import series_length
from signalmill.operators.windows import SIGNAL, sax_windows, segment_bounds, window_means
from signalmill.plans.runtime import checkpointed, discard, written

TRACK = ("entity_id", "track_id")


class Query:
    """A short search pattern: z-normalised segment means, breakpoints and word."""

    def __init__(self, values: Sequence[float], segments: int, alpha: int, threshold: float):
        x = np.asarray(values, dtype=float)
        sd = x.std()
        z = (x - x.mean()) / sd if sd >= threshold else x - x.mean()
        self.length = len(x)
        self.breakpoints = fitted_breakpoints(z.tolist(), alpha)
        self.paa = [float(z[a:b].mean()) for a, b in segment_bounds(len(z), segments)]
        self.symbols = [sum(v + EDGE >= b for b in self.breakpoints) - 1 for v in self.paa]
        self.word = "".join("abcdefghijklmnopqrst"[s] for s in self.symbols)


def scale_windows(length: int, low: float, high: float, steps: int) -> list[tuple[int, float, int]]:
    """(index, scale, window) of the scale sweep; one step when both ends agree."""
    steps = 1 if low == high else max(1, steps)
    out = []
    for i in range(steps):
        scale = low if steps == 1 else low + (high - low) * i / (steps - 1)
        out.append((i, scale, max(1, int(math.floor(length * scale + 0.5)))))
    return out


def scored_windows(
    grid: DataFrame, query: Query, segments: int, low: float, high: float, steps: int, threshold: float, by: Sequence[str]
) -> DataFrame:
    """Distance and letter gap of every window at every scale."""
    target = literal_array(query.paa)
    wanted = F.array(*[F.lit(s) for s in query.symbols])
    out = None
    for index, scale, window in scale_windows(query.length, low, high, steps):
        if window < segments:
            continue
        rows = window_means(grid, window, segments, threshold, by)
        dist = F.sqrt(F.aggregate(F.zip_with("paa", target, lambda a, q: (a - q) * (a - q)), F.lit(0.0), lambda s, v: s + v))
        gaps = F.zip_with(F.transform("paa", lambda v: symbol_index(v, query.breakpoints)), wanted, lambda a, q: F.abs(a - q))
        rows = rows.withColumn("scale_index", F.lit(index)).withColumn("scale", F.lit(float(scale)))
        rows = rows.withColumn("matched_length", F.lit(window)).withColumn("distance", dist)
        rows = rows.withColumn("symbolic_distance", F.array_max(gaps).cast("double"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("every scaled window is shorter than the word")
    return out.withColumn("similarity", similarity(F.col("distance")))


def similarity_1d(
    query: Sequence[float],
    grid: DataFrame,
    segments: int = 8,
    alpha: int = 4,
    low: float = 1.0,
    high: float = 1.0,
    steps: int = 1,
    tolerance: int = 0,
    k: int = 5,
    threshold: float = 0.01,
) -> DataFrame:
    """Best windows of all signals for one pattern; overlapping hits are allowed.

    ``tolerance`` at or below 0 means no letter filter, else the largest letter gap.
    """
    q = Query(query, segments, alpha, threshold)
    rows = scored_windows(grid, q, segments, low, high, steps, threshold, SIGNAL)
    if tolerance > 0:
        rows = rows.filter(F.col("symbolic_distance") <= tolerance)
    order = [F.col("similarity").desc(), F.col("distance"), F.col("signal_id"), F.col("start_index"), F.col("scale_index")]
    top = rows.orderBy(*order).limit(k)
    # words of the survivors only; the rank runs over k rows
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return top.withColumn("query_word", F.lit(q.word)).withColumn("candidate_word", symbolize(F.col("paa"), q.breakpoints))


def similarity_multidim(
    queries: dict[str, Sequence[float]],
    tracks: DataFrame,
    segments: int = 8,
    alpha: int = 4,
    low: float = 1.0,
    high: float = 1.0,
    steps: int = 1,
    tolerance: int = -1,
    max_delay: int = 2,
    per_track_k: int = 5,
    k: int = 5,
    threshold: float = 0.01,
) -> DataFrame:
    """Entities where every query track has a similar window at about the same time.

    ``tracks`` is a grid by entity and track. A negative ``tolerance`` means no letter
    filter, 0 the exact word.
    """
    hits = None
    for name, values in sorted(queries.items()):
        q = Query(values, segments, alpha, threshold)
        rows = scored_windows(tracks.filter(F.col("track_id") == name), q, segments, low, high, steps, threshold, TRACK)
        if tolerance >= 0:
            rows = rows.filter(F.col("symbolic_distance") <= tolerance)
        rows = rows.withColumn("query_word", F.lit(q.word)).withColumn("candidate_word", symbolize(F.col("paa"), q.breakpoints)).drop("paa")
        hits = rows if hits is None else hits.unionByName(rows)
    best = [F.col("similarity").desc(), F.col("distance"), F.col("start_index"), F.col("scale_index")]
    hits = top_k_per_group(hits, per_track_k, TRACK, best).drop("rank")
    # from here on at most per_track_k rows per entity and track
    size = max(1, max_delay + 1)
    base = floor_div(F.col("start_index"), size) * size
    hits = hits.withColumn("anchor", F.explode(F.array(base - size, base, base + size)))
    hits = best_row(hits, ["entity_id", "anchor", "track_id"], best)
    item = F.struct("track_id", "start_index", "end_index", "scale", "query_word", "candidate_word", "symbolic_distance", "distance", "similarity")
    groups = hits.groupBy("entity_id", "anchor").agg(
        F.count_distinct("track_id").alias("matched_track_count"),
        F.min("start_index").alias("start_index"),
        F.max("end_index").alias("end_index"),
        (F.max("start_index") - F.min("start_index")).alias("_spread"),
        F.avg("similarity").alias("exact_score"),
        F.avg("distance").alias("mean_distance"),
        (1.0 / (1.0 + F.avg("symbolic_distance"))).alias("symbolic_score"),
        F.sort_array(F.collect_list(item)).alias("track_matches"),
    )
    groups = groups.filter((F.col("matched_track_count") == len(queries)) & (F.col("_spread") <= max_delay)).drop("_spread")
    groups = groups.withColumn("rank_score", F.col("exact_score") * F.col("symbolic_score"))
    groups = best_row(groups, ["entity_id", "start_index", "end_index"], [F.col("rank_score").desc(), F.col("anchor")]).drop("anchor")
    order = [F.col("rank_score").desc(), F.col("mean_distance"), F.col("entity_id"), F.col("start_index")]
    return groups.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def entity_tracks(
    df: DataFrame, hierarchy: DataFrame, metadata: DataFrame, level: str, start: datetime, end: datetime, bin_us: int, agg: str = "avg"
) -> DataFrame:
    """Filled tracks of the entities at a hierarchy level, one track per metric."""
    dim = hierarchy.select("signal_id", F.col(level).alias("entity_id")).join(metadata.select("signal_id", F.col("metric").alias("track_id")), "signal_id")
    rows = join_dim(df, dim).select(*TRACK, "ts", "value")
    return search_space(rows, start, end, bin_us, agg, TRACK)


def similarity_mapped(queries: dict[str, Sequence[float]], tracks: DataFrame, mapping: DataFrame, **params) -> DataFrame:
    """Multivariate search where search tracks carry other names than the query tracks."""
    renamed = map_tracks(tracks, mapping)
    bins = known_bins(tracks)
    return similarity_multidim(queries, renamed if bins is None else mark_bins(renamed, bins), **params)


def similarity_recurrence(queries: dict[str, Sequence[float]], grid: DataFrame, entity: str = "selection", **params) -> DataFrame:
    """Recurrences of one multi-signal episode among the same signals."""
    rows = grid.filter(F.col("signal_id").isin(list(queries))).withColumn("entity_id", F.lit(entity)).withColumnRenamed("signal_id", "track_id")
    return similarity_multidim(queries, rows, **params)


def suggest_params(queries: DataFrame, min_scale: float = 1.0, multi: bool = False) -> DataFrame:
    """Search settings from each pattern's length and spread (``query_id, value`` rows)."""
    scale = min_scale if min_scale > 0 else 1.0
    facts = queries.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("_sd"),
        F.coalesce(F.max("value") - F.min("value"), F.lit(0.0)).alias("_range"),
    )
    n, sd = F.col("n"), F.col("_sd")
    upper = F.least(F.lit(32), F.greatest(F.lit(1), F.floor(n * F.lit(scale))))
    lower = F.least(F.lit(4), upper)
    flat = (sd <= 1e-9) | (F.col("_range") <= 1e-9)
    cv = F.when(F.col("_range") > 1e-9, sd / F.col("_range")).otherwise(0.0)
    bump = F.when((n >= 48) & (cv >= 0.3), F.when(cv >= 0.4, 2).otherwise(1)).when((n <= 12) | flat, -1).otherwise(0)
    return facts.select(
        "query_id",
        F.least(upper, F.greatest(lower, F.floor(n / 4 + 0.5))).cast("int").alias("segments"),
        F.least(F.lit(8), F.greatest(F.lit(3), 4 + bump)).cast("int").alias("alphabet_size"),
        F.least(F.lit(1e6), F.greatest(F.lit(1e-6), sd * 0.03)).alias("znorm_threshold"),
        F.lit(1 if multi else 0).alias("symbol_tolerance"),
    )


def consolidate_matches(matches: DataFrame, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Best hit of each cluster of touching or overlapping windows.

    For the short lists a top-k search returns.
    """
    w = Window.partitionBy(*by).orderBy("start_index", "end_index")
    reach = F.max("end_index").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = matches.withColumn("_new", F.when(reach.isNull() | (F.col("start_index") > reach + 1), 1).otherwise(0))
    rows = rows.withColumn("_cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    order = [F.col("similarity").desc(), F.col("distance"), F.col("start_index")]
    return best_row(rows, [*by, "_cluster"], order).drop("_new", "_cluster")


# ---------------------------------------------------------------- symbolic discords


def word_counts(windows: DataFrame, by: Sequence[str] = SIGNAL) -> DataFrame:
    return windows.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("word_frequency"))


TIME_CHUNK = 4096  # starts of the windows on one side of a cell
PACK = 512  # candidates on the other


def _window_chunks(windows: DataFrame) -> DataFrame:
    """The windows of each signal and time chunk as one row: their starts and, one after another, their segment means."""
    rows = windows.groupBy("signal_id", floor_div(F.col("start_index"), TIME_CHUNK).alias("_chunk")).agg(F.array_sort(F.collect_list(F.struct("start_index", "paa"))).alias("_w"))
    return rows.select("signal_id", "_chunk", F.transform("_w", lambda w: w["start_index"]).alias("starts"), F.flatten(F.transform("_w", lambda w: w["paa"])).alias("means"))


def _score(cands: DataFrame, packed: DataFrame, window: int) -> DataFrame:
    w = Window.partitionBy("signal_id", "_c").orderBy("start_index")
    cands = cands.withColumn("_c", floor_div(F.col("start_index"), TIME_CHUNK))
    cands = cands.withColumn("_pack", F.concat_ws("-", "_c", floor_div(F.row_number().over(w) - 1, PACK)))
    met = packed.select("signal_id", "_chunk")
    left = cands.join(met, "signal_id").select("signal_id", "_chunk", "_pack", "start_index", "paa")
    right = packed.join(cands.select("signal_id", "_pack").distinct(), "signal_id")
    right = right.select(F.col("signal_id").alias("_sid"), F.col("_chunk").alias("_k"), F.col("_pack").alias("_p"), "starts", "means")

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return empty_frame(["signal_id"], ["start_index", "j"], ["d"])
        x, i, j = np.stack(a["paa"].to_numpy()).astype(float), a["start_index"].to_numpy(), np.asarray(b["starts"].iloc[0])
        y = np.asarray(b["means"].iloc[0], dtype=float).reshape(len(j), -1)
        d = np.zeros((len(i), len(j)))
        for own, other in zip(x.T, y.T):  # one segment at a time: no array of windows by windows by segments
            gap = own[:, None] - other
            d += gap * gap
        d = np.sqrt(d)
        d[np.abs(i[:, None] - j[None, :]) < window] = np.inf
        d[~np.isfinite(d)] = np.inf
        best = np.argmin(d, axis=1)
        out = pd.DataFrame({"signal_id": a["signal_id"], "start_index": i, "d": d[np.arange(len(i)), best], "j": j[best]})
        return out[np.isfinite(out["d"])]

    pairs = cells(left, ["signal_id", "_chunk", "_pack"], right, ["_sid", "_k", "_p"])
    scored = pairs.applyInPandas(kernel, "signal_id string, start_index long, d double, j long")
    best = scored.groupBy("signal_id", "start_index").agg(F.min(F.struct("d", "j")).alias("b"))
    return best.select("signal_id", "start_index", F.col("b.d").alias("nn_distance"), F.col("b.j").alias("nearest_neighbor_start"))


def score_candidates(cands: DataFrame, others: DataFrame, window: int) -> DataFrame:
    """Nearest non-overlapping window of each candidate by distance of segment means.

    Windows go into time chunks, one row each, and candidates into packs; every (chunk, pack) cell
    is a few array products that return one row per candidate.
    """
    return _score(cands, checkpointed(_window_chunks(others)), window)


def _word_bound(pool: DataFrame, others: DataFrame, window: int) -> DataFrame:
    """``pool`` with ``value``: the distance to the first or last window of its own word, which its nearest one cannot exceed."""
    ends = others.groupBy("signal_id", "word").agg(F.min(F.struct("start_index", "paa")).alias("_first"), F.max(F.struct("start_index", "paa")).alias("_last"))
    rows = attach(pool, ends, ["signal_id", "word"], how="left", salt="start_index")

    def apart(end: str) -> Column:
        squares = F.zip_with("paa", F.col(f"{end}.paa"), lambda x, y: (x - y) * (x - y))
        far = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda t, x: t + x))
        return F.when(F.abs(F.col("start_index") - F.col(f"{end}.start_index")) >= window, far)

    return rows.withColumn("value", F.coalesce(F.least(apart("_first"), apart("_last")), F.lit(float("inf")))).drop("_first", "_last")


def discord_search(pool: DataFrame, others: DataFrame, window: int, k: int, width: int = 256) -> tuple[DataFrame, int]:
    """The ``k`` candidates of all signals with the farthest nearest neighbour, non-overlapping within a signal, and how many were scored.

    A candidate's bound is the distance to a window of its own word: common words are close to
    something and come last. Best-first picks are made of the bounds as if they were distances. As long
    as a pick is only a bound, the highest bounds are scored, twice as many each round. When all picks
    are scored, no other candidate can take their place, since its distance is at most its bound.
    """
    keys = ["signal_id", "start_index"]
    packed = checkpointed(_window_chunks(others))
    state = _word_bound(pool, others, window).withColumn("exact", F.lit(False)).withColumn("nearest_neighbor_start", F.lit(None).cast("bigint"))
    state, path = written(state)
    order = [F.col("value").desc(), *keys]
    scored, width = 0, max(width, k)
    while True:
        picks = pick_nonoverlap(state.drop("paa"), k, window - 1, "value", idx="start_index").drop("pick")
        picks, place = written(picks.orderBy(*order).limit(k))
        if picks.filter(~F.col("exact")).isEmpty():
            return picks.drop("exact"), scored
        discard(state.sparkSession, place)
        ask = checkpointed(state.filter(~F.col("exact")).orderBy(*order).limit(width).select(*keys, "paa"))
        scored, width, old = scored + ask.count(), min(2 * width, 1 << 20), path
        near = _score(ask, packed, window).withColumnRenamed("nearest_neighbor_start", "_near")
        asked = ask.select(*keys, F.lit(True).alias("_asked")).join(near, keys, "left")
        rows = state.join(asked, keys, "left")
        rows = rows.withColumn("value", F.when(F.col("_asked"), F.col("nn_distance")).otherwise(F.col("value")))
        rows = rows.withColumn("nearest_neighbor_start", F.when(F.col("_asked"), F.col("_near")).otherwise(F.col("nearest_neighbor_start")))
        state, path = written(rows.withColumn("exact", F.col("exact") | F.col("_asked").isNotNull()).drop("_asked", "_near", "nn_distance"))
        discard(state.sparkSession, old)


def sax_discords(
    grid: DataFrame,
    window: int,
    k: int = 5,
    segments: int = 4,
    alpha: int = 4,
    threshold: float = 0.01,
    candidates: int = 100,
    detection_bins: int = 0,
) -> DataFrame:
    """Windows whose nearest non-overlapping neighbour is far.

    ``candidates`` > 0 considers the rarest words' windows of each signal, 0 every window
    no commoner than its signal's mean word count; ``discord_search`` scores only those that
    may be among the ``k``. With ``detection_bins`` only windows in the last bins are candidates
    and only earlier ones are neighbours.
    """
    windows = sax_windows(grid, window, segments, gaussian_breakpoints(alpha), threshold)
    counts = word_counts(windows)
    rows = windows.join(counts, ["signal_id", "word"])
    edge = series_length(grid) - detection_bins
    pool = rows.filter(F.col("start_index") >= edge) if detection_bins > 0 else rows
    others = windows.filter(F.col("start_index") < edge) if detection_bins > 0 else windows
    if candidates > 0:
        pool = top_k_per_group(pool, candidates, SIGNAL, [F.col("word_frequency"), F.col("start_index")]).drop("rank")
    else:
        common = rows.groupBy("signal_id").agg(F.avg("word_frequency").alias("_cut"))
        pool = attach(pool, common, "signal_id", salt="start_index").filter(F.col("word_frequency") <= F.col("_cut")).drop("_cut")
    picks, _ = discord_search(pool, others, window, k)
    picks = picks.withColumnRenamed("value", "nn_distance")
    order = [F.col("nn_distance").desc(), F.col("signal_id"), F.col("start_index")]
    return picks.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def discord_thresholds(discords: DataFrame) -> DataFrame:
    """Percentiles of the neighbour distance of a few sampled discords."""
    return discords.agg(
        *[F.percentile("nn_distance", p).alias(n) for n, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95))],
        F.max("nn_distance").alias("max"),
        F.count(F.lit(1)).alias("samples"),
    )


# ---------------------------------------------------------------- word-bag classification

LABELLED = ("class_label", "series_id")


def _bag(grid: DataFrame, by: Sequence[str], window: int, segments: int, alpha: int, threshold: float, reduction: str) -> DataFrame:
    words = sax_windows(grid, window, segments, gaussian_breakpoints(alpha), threshold, by).drop("paa")
    if reduction == "exact":
        prev = {"_w": lambda w: F.lag("word").over(w)}
        words = framed(words, by, prev, before=1, idx="start_index").filter(F.col("_w").isNull() | (F.col("_w") != F.col("word")))
    return words


def vsm_wordbag(
    training: DataFrame, window: int, segments: int, alpha: int, threshold: float = 0.01, reduction: str = "exact"
) -> DataFrame:
    """Word counts per class; ``exact`` counts a run of equal words once."""
    words = _bag(training, LABELLED, window, segments, alpha, threshold, reduction)
    return words.groupBy("class_label", "word").agg(F.count(F.lit(1)).alias("term_frequency"))


def vsm_train(bags: DataFrame, drop_common: bool = False) -> DataFrame:
    """Class weights ln(1 + tf) · ln(N / df); optionally without words of every class."""
    df = bags.groupBy("word").agg(F.count_distinct("class_label").alias("document_frequency"))
    rows = with_row(bags.join(df, "word"), bags.agg(F.count_distinct("class_label").alias("class_count")))
    if drop_common:
        rows = rows.filter(F.col("document_frequency") < F.col("class_count"))
    rows = rows.withColumn("tf", F.log1p("term_frequency")).withColumn("idf", F.log(F.col("class_count") / F.col("document_frequency")))
    return rows.withColumn("weight", F.col("tf") * F.col("idf"))


def vsm_scores(
    model: DataFrame, grid: DataFrame, window: int, segments: int, alpha: int, threshold: float = 0.01, reduction: str = "exact"
) -> DataFrame:
    """Cosine similarity of every input series to every class of the model."""
    bag = _bag(grid, ("series_id",), window, segments, alpha, threshold, reduction)
    bag = bag.groupBy("series_id", "word").agg(F.count(F.lit(1)).alias("input_tf"))
    norms = bag.groupBy("series_id").agg(F.sqrt(F.sum(F.col("input_tf") * F.col("input_tf").cast("double"))).alias("_in"))
    classes = model.groupBy("class_label").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_mn"))
    hit = bag.join(model.select("class_label", "word", "weight"), "word")
    dot = hit.groupBy("series_id", "class_label").agg(F.sum(F.col("weight") * F.col("input_tf")).alias("_dot"))
    labels = classes.agg(F.collect_list(F.struct("class_label", "_mn")).alias("_all"))  # one entry per class
    ids = with_row(grid.select("series_id").distinct(), labels)
    pairs = ids.select("series_id", F.explode("_all").alias("_c")).select("series_id", "_c.class_label", "_c._mn")
    out = pairs.join(norms, "series_id", "left").join(dot, ["series_id", "class_label"], "left")
    length = F.col("_mn") * F.coalesce("_in", F.lit(0.0))
    cosine = F.when(length > 0, F.coalesce("_dot", F.lit(0.0)) / length).otherwise(0.0)
    return out.select("series_id", "class_label", cosine.alias("cosine_similarity"), (1 - cosine).alias("cosine_distance"))


def vsm_top_words(
    model: DataFrame, grid: DataFrame, window: int, segments: int, alpha: int, top: int = 5, threshold: float = 0.01, reduction: str = "exact"
) -> DataFrame:
    """Words that contribute most to each class score."""
    bag = _bag(grid, ("series_id",), window, segments, alpha, threshold, reduction)
    bag = bag.groupBy("series_id", "word").agg(F.count(F.lit(1)).alias("input_tf"))
    rows = bag.join(model.select("class_label", "word", "weight"), "word").withColumn("contribution", F.col("weight") * F.col("input_tf"))
    return top_k_per_group(rows, top, ["series_id", "class_label"], [F.col("contribution").desc(), F.col("word")])


def vsm_classify(scores: DataFrame) -> DataFrame:
    """Predicted class, empty when the best score is shared or all scores agree."""
    w = Window.partitionBy("series_id")
    rows = scores.withColumn("_best", F.max("cosine_similarity").over(w))
    facts = rows.groupBy("series_id").agg(
        F.max("_best").alias("confidence"),
        F.count_distinct("cosine_similarity").alias("_scores"),
        F.count_if(F.col("cosine_similarity") == F.col("_best")).alias("_ties"),
        F.min(F.when(F.col("cosine_similarity") == F.col("_best"), F.col("class_label"))).alias("_label"),
    )
    vague = (F.col("_scores") <= 1) | (F.col("_ties") > 1)
    return facts.select(
        "series_id", F.when(vague, "").otherwise(F.col("_label")).alias("predicted_class"), "confidence", vague.alias("is_ambiguous")
    )


def _span_bins(spans: DataFrame, bin_us: int) -> DataFrame:
    """The bins in which spans look for readings: ``_lo`` up to and without ``_hi``, in microseconds.

    Equal ``class_label, series_id`` share their bins, so a reading at the very end of a span on whole bins, one
    past its own, counts only if a longer span of that name has such a bin.
    """
    named = spans.filter("_a <= _z").dropna(subset=["class_label", "series_id", "signal_id"])
    most = F.max(floor_div(F.col("_z") - F.col("_a") + (bin_us - 1), bin_us)).over(Window.partitionBy("class_label", "series_id"))
    last = F.least(floor_div(F.col("_z") - F.col("_a"), bin_us), most - 1)
    named = named.withColumn("_last", last).filter("_last >= 0")
    rows = named.withColumn("bin_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))))
    rows = rows.withColumn("_lo", F.col("_a") + F.col("bin_idx") * bin_us)
    return rows.withColumn("_hi", F.least(F.col("_z") + 1, F.col("_lo") + bin_us))


def _span_sums(spans: DataFrame, df: DataFrame, bin_us: int, unit: int) -> DataFrame:
    """``class_label, series_id, bin_idx`` with the mean of the readings in each bin that has any.

    Readings lie in pieces of ``unit``, halved until a piece is no longer than a bin, so a bin is the end of one
    piece, whole pieces, and the beginning of another. Running totals in both directions along a piece give these
    at the bin's edges: a reading is summed once or twice for each width in use, however many spans hold it, and
    nothing is ever subtracted. Bins in a row share their edges.
    """
    widths = [unit >> j for j in range(unit.bit_length())]
    class_of = lambda length: F.size(F.filter(F.array(*[F.lit(w).cast("bigint") for w in widths]), lambda w: w > length))
    width = F.expr(f"shiftright({unit}L, _cls)")
    whole = sum(w > bin_us for w in widths)
    length = F.col("_hi") - F.col("_lo")
    bins = _span_bins(spans, bin_us).withColumn("_cls", F.when(length == bin_us, F.lit(whole)).otherwise(class_of(length)))
    bins = bins.withColumn("_p", floor_div(F.col("_lo"), width)).withColumn("_q", floor_div(F.col("_hi"), width))

    def edge(us: Column, slot: Column, until: Column, since: Column) -> Column:
        return F.struct(us.alias("_us"), slot.alias("_slot"), until.cast("bigint").alias("_until"), since.cast("bigint").alias("_since"))

    none, own = F.lit(None), F.col("bin_idx")
    full_next = (own < F.col("_last")) & (F.col("_hi") + bin_us <= F.col("_z") + 1)
    ends = F.array(edge(F.col("_hi"), F.col("_q"), own, F.when(full_next & (F.col("_cls") == whole), own + 1)))
    starts = F.array(edge(F.col("_lo"), F.col("_p"), none, own))
    between = F.transform(F.sequence(F.col("_p") + 1, F.col("_q") - 1), lambda s: edge(s * width, s, none, own))
    edges = F.when((own == 0) | (length < bin_us), F.concat(ends, starts)).otherwise(ends)
    edges = F.when(F.col("_q") > F.col("_p") + 1, F.concat(edges, between)).otherwise(edges)
    ask = bins.select("signal_id", "_cls", "class_label", "series_id", F.inline(edges))

    rows = df.select("signal_id", to_us("ts").alias("_us"), F.col("value").cast("double").alias("value"))
    rows = rows.filter("signal_id is not null and _us is not null and value is not null")
    rows = at_classes(rows, bins).withColumn("_slot", floor_div(F.col("_us"), width))
    both = rows.withColumn("_kind", F.lit(1)).unionByName(ask.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    piece = Window.partitionBy("signal_id", "_cls", "_slot")
    # an edge comes before the readings of its own microsecond
    before = piece.orderBy("_us", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    after = piece.orderBy(F.desc("_us"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda w, bin_idx: F.struct(F.col(bin_idx).alias("bin_idx"), F.sum("value").over(w).alias("s"), F.count("value").over(w).alias("n"))
    known = both.withColumn("_pre", total(before, "_until")).withColumn("_post", total(after, "_since")).filter("_kind = 0")
    parts = known.select("class_label", "series_id", F.inline(F.array("_pre", "_post"))).filter("bin_idx is not null and n > 0")
    return parts.groupBy("class_label", "series_id", "bin_idx").agg((F.sum("s") / F.sum("n")).alias("value"))


def vsm_training(spans: DataFrame, df: DataFrame, bin_us: int, slot_us: int | None = None) -> DataFrame:
    """Filled grid of every labelled span (``class_label, series_id, signal_id, start_ts, end_ts``).

    Readings meet the bins' edges on signal and a piece of time, ``slot_us`` (a bin) at most, so one busy signal is
    spread and the work grows with readings and bins, not with the readings that each span holds.
    """
    spans = spans.withColumn("_a", to_us("start_ts")).withColumn("_z", to_us("end_ts"))
    means = _span_sums(spans, df, bin_us, slot_us or bin_us)
    bins = floor_div(F.col("_z") - F.col("_a") + (bin_us - 1), bin_us)
    frame = spans.filter(bins > 0).select(
        "class_label", "series_id", F.explode(F.sequence(F.lit(0).cast("bigint"), bins - 1)).alias("bin_idx")
    )
    return fill_linear(frame.join(means, ["class_label", "series_id", "bin_idx"], "left"), LABELLED)


# ---------------------------------------------------------------- cycles

CYCLE = ("signal_id", "cycle")


def extract_cycles(df: DataFrame, start: datetime, end: datetime, length_us: int, bin_us: int, agg: str = "avg") -> DataFrame:
    """Fixed-length cycles from ``start`` on one common offset grid, gap-filled."""
    from signalmill.sources.telemetry import BIN_AGGS, between

    origin, n = as_us(start), -(-length_us // bin_us)
    rows = df.filter(between(start, end)).withColumn("_off", to_us("ts") - origin)
    rows = rows.withColumn("cycle", floor_div(F.col("_off"), length_us))
    rows = rows.withColumn("bin_idx", floor_div(F.pmod("_off", F.lit(length_us)), bin_us))
    means = rows.groupBy(*CYCLE, "bin_idx").agg(BIN_AGGS[agg]("value").alias("value"))
    frame = means.select(*CYCLE).distinct().withColumn("bin_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    return fill_linear(mark_bins(frame.join(means, [*CYCLE, "bin_idx"], "left"), n), CYCLE)


def cycle_words(cycles: DataFrame, segments: int, alpha: int, threshold: float = 0.001) -> DataFrame:
    """Word of every cycle, with the two-decimal normal breakpoints."""
    from signalmill.operators.windows import paa_integer, series_word, znorm_zero

    z = znorm_zero(cycles, threshold, CYCLE)
    return series_word(paa_integer(z, segments, "z", CYCLE), [-1e308, *ROUNDED_BREAKPOINTS[alpha]], CYCLE)


def cycle_distances(words: DataFrame, alpha: int, length: int) -> DataFrame:
    """Word distance of every pair of cycles of a signal: the full matrix, for few cycles.

    ``nearest_cycles`` gives a bounded answer for many.
    """
    a = words.select("signal_id", F.col("cycle").alias("cycle_a"), F.col("word").alias("_wa"))
    b = words.select("signal_id", F.col("cycle").alias("cycle_b"), F.col("word").alias("_wb"))
    pairs = a.join(b, "signal_id").filter(F.col("cycle_a") < F.col("cycle_b"))
    return pairs.select("signal_id", "cycle_a", "cycle_b", mindist(F.col("_wa"), F.col("_wb"), alpha, length).alias("distance"))


def _distinct_words(words: DataFrame) -> DataFrame:
    """Each signal's words with their first cycle and number of cycles; the alphabet bounds their number."""
    return words.groupBy("signal_id", "word").agg(F.min("cycle").alias("first"), F.count(F.lit(1)).alias("n"))


def _word_pairs(bag: DataFrame, alpha: int, length: int) -> DataFrame:
    """Distances of all ordered pairs of a signal's distinct words; a signal is spread over its words."""
    a = bag.select("signal_id", F.col("first").alias("a"), F.col("n").alias("na"), F.col("word").alias("_wa"))
    b = bag.select("signal_id", F.col("first").alias("b"), F.col("n").alias("nb"), F.col("word").alias("_wb"))
    pairs = _with_all(a, b)
    return pairs.select("signal_id", "a", "b", "na", "nb", mindist(F.col("_wa"), F.col("_wb"), alpha, length).alias("distance"))


def _with_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of two tables that share a signal, one signal spread over salted copies of ``right``."""
    spread = left.withColumn("_salt", F.pmod(F.hash("a"), F.lit(SALTS)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(copies, ["signal_id", "_salt"]).drop("_salt")


def nearest_cycles(words: DataFrame, alpha: int, length: int, k: int = 5) -> DataFrame:
    """The ``k`` other cycles of the same signal with the nearest words; ties to the earlier cycle.

    Distances are taken between distinct words. Of each word only its first ``k + 1`` cycles can be
    among a cycle's nearest, so the work grows with the cycles, not with their pairs.
    """
    bag = checkpointed(_distinct_words(words))
    pairs = _word_pairs(bag, alpha, length)
    heads = top_k_per_group(words.select("signal_id", "word", "cycle"), k + 1, ["signal_id", "word"], [F.col("cycle")])
    heads = heads.join(bag.select("signal_id", "word", F.col("first").alias("b")), ["signal_id", "word"]).select("signal_id", "b", F.col("cycle").alias("neighbour"))
    # the nearest words whose heads hold k + 1 cycles: one is the cycle itself
    w = Window.partitionBy("signal_id", "a").orderBy("distance", "b").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.least("nb", F.lit(k + 1))).over(w), F.lit(0))
    pairs = pairs.withColumn("_sum", before)
    pairs = pairs.withColumn("_least", F.min("_sum").over(Window.partitionBy("signal_id", "a", "distance"))).filter(F.col("_least") <= k)
    near = pairs.join(heads, ["signal_id", "b"])
    lists = top_k_per_group(near, k + 1, ["signal_id", "a"], [F.col("distance"), F.col("neighbour")])
    mine = words.join(bag.select("signal_id", "word", F.col("first").alias("a")), ["signal_id", "word"]).select("signal_id", "a", "cycle")
    packed = lists.groupBy("signal_id", "a").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))).alias("_l"))
    own = attach(mine, packed, ["signal_id", "a"], salt="cycle")
    picked = F.slice(F.filter("_l", lambda e: e["neighbour"] != F.col("cycle")), 1, k)
    return own.select("signal_id", "cycle", F.posexplode(picked).alias("_p", "_e")).select("signal_id", "cycle", (F.col("_p") + 1).alias("rank"), "_e.neighbour", "_e.distance")


def cluster_cycles(words: DataFrame, k: int, alpha: int, length: int, rounds: int = 20) -> DataFrame:
    """K-medoids of each signal's cycles by word distance, seeded farthest-first from the first cycle.

    Works on distinct words weighted by their cycles, so equal words share a cluster and a signal
    with at most ``k`` of them gets one cluster each. Assignment and the choice of medoids are
    joins and sums over word pairs; ties go to the earlier cycle.
    """
    bag = checkpointed(_distinct_words(words))
    pairs = checkpointed(_word_pairs(bag, alpha, length))
    seats = bag.groupBy("signal_id").agg(F.min("first").alias("medoid")).withColumn("cluster", F.lit(0))
    seats = checkpointed(seats)
    to_seats = lambda seats: pairs.join(seats.withColumnRenamed("medoid", "b"), ["signal_id", "b"])
    for c in range(1, k):
        spread = to_seats(seats).groupBy("signal_id", "a").agg(F.min("distance").alias("d"))
        spread = spread.join(seats.withColumnRenamed("medoid", "a"), ["signal_id", "a"], "left_anti")
        far = spread.groupBy("signal_id").agg(F.max_by("a", F.struct("d", -F.col("a"))).alias("medoid")).withColumn("cluster", F.lit(c))
        seats = checkpointed(seats.unionByName(far))
    owners = lambda seats: to_seats(seats).groupBy("signal_id", "a").agg(F.min_by("cluster", F.struct("distance", "cluster")).alias("cluster"))
    owner = checkpointed(owners(seats))
    for _ in range(rounds):
        mates = owner.select("signal_id", F.col("a").alias("b"), F.col("cluster").alias("_with"))
        cost = pairs.join(owner, ["signal_id", "a"]).join(mates, ["signal_id", "b"]).filter(F.col("cluster") == F.col("_with"))
        cost = cost.groupBy("signal_id", "cluster", "a").agg(F.sum(F.col("distance") * F.col("nb")).alias("d"))
        moved = cost.groupBy("signal_id", "cluster").agg(F.min_by("a", F.struct(F.round("d", 9), "a")).alias("_to"))
        fresh = seats.join(moved, ["signal_id", "cluster"], "left")
        seats = checkpointed(fresh.select("signal_id", F.coalesce("_to", "medoid").alias("medoid"), "cluster"))
        after = checkpointed(owners(seats))
        same = after.join(owner, ["signal_id", "a", "cluster"], "left_anti").isEmpty()
        owner = after
        if same:
            break
    named = owner.join(seats, ["signal_id", "cluster"]).join(bag.select("signal_id", "word", F.col("first").alias("a")), ["signal_id", "a"])
    return words.select("signal_id", "cycle", "word").join(named, ["signal_id", "word"]).select("signal_id", "cycle", "cluster", "medoid")


def linkage(words: DataFrame, alpha: int, length: int) -> DataFrame:
    """Average-linkage merges per signal over its distinct words, each weighted by its cycles.

    A cluster is named by its first cycle. In each round all pairs of clusters that are each
    other's nearest merge: with mean distances that gives the merges of the one-by-one method, in
    about log(words) rounds of joins and sums. ``step`` numbers a signal's merges by distance.
    """
    bag = _distinct_words(words)
    pairs = _word_pairs(bag, alpha, length).filter("a <> b")
    weight = F.col("na") * F.col("nb")
    pairs = checkpointed(pairs.select("signal_id", "a", "b", (F.col("distance") * weight).alias("s"), weight.alias("n")))
    merges = None
    while not pairs.isEmpty():
        mean = F.round(F.col("s") / F.col("n"), 9)
        # ties by the pair's names, the same seen from both sides, so some pair is always mutual
        order = F.struct(mean, F.least("a", "b"), F.greatest("a", "b"))
        near = pairs.groupBy("signal_id", "a").agg(F.min_by(F.struct("b", (F.col("s") / F.col("n")).alias("d")), order).alias("m"))
        near = near.select("signal_id", "a", "m.b", "m.d")
        back = near.select("signal_id", F.col("b").alias("a"), F.col("a").alias("b"))
        found = checkpointed(near.join(back, ["signal_id", "a", "b"]).filter("a < b").select("signal_id", F.col("a").alias("left"), F.col("b").alias("right"), F.col("d").alias("distance")))
        merges = found if merges is None else merges.unionByName(found)
        into = lambda side: found.select("signal_id", F.col("right").alias(side), F.col("left").alias(f"_{side}"))
        named = pairs.join(into("a"), ["signal_id", "a"], "left").join(into("b"), ["signal_id", "b"], "left")
        named = named.select("signal_id", F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "s", "n").filter("a <> b")
        pairs = checkpointed(named.groupBy("signal_id", "a", "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    if merges is None:
        merges = pairs.select("signal_id", F.col("a").alias("left"), F.col("b").alias("right"), F.col("s").alias("distance"))
    step = F.row_number().over(Window.partitionBy("signal_id").orderBy(F.round("distance", 9), "left", "right")) - 1
    return merges.withColumn("step", step.cast("bigint")).select("signal_id", "step", "left", "right", "distance")
