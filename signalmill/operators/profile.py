"""Matrix profiles by tiled similarity joins, and what is read from them.

Series are cut into overlapping chunks. Every pair of chunks is one cell, spread by
its own key, so a long series fans out over the cluster. Within a cell the covariance of
a pair of windows follows from that of the pair one step before on its diagonal, so a
pair costs a few operations at any window length; a cell returns only the best neighbour
of each of its windows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from signalmill.functions.frames import cells, empty_frame
from signalmill.functions.ordered import attach, framed, known_bins, mark_bins, running_sum
from signalmill.functions.quantiles import quantiles
from signalmill.functions.timeparts import floor_div
from signalmill.operators.catalog import best_row
from signalmill.operators.sequences import pick_all, pick_nonoverlap
from signalmill.operators.stats import overview
from signalmill.plans.runtime import checkpointed

SIGNAL = ("signal_id",)
CHUNK = 1024  # windows: small enough that a series of some thousand points fills all cores
CELL_BYTES = 64 << 20


def exclusion(m: int) -> int:
    """Windows this close to each other are trivial matches."""
    return math.ceil(m / 4)


def chunk_size(m: int, chunk: int = CHUNK) -> int:
    """Windows per chunk, so that the normalised windows of a chunk stay near 64 MB."""
    return max(256, min(chunk, CELL_BYTES // (8 * m)))


def chunks(grid: DataFrame, m: int, size: int, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Chunk rows ``by, c, lo, values`` whose windows start in ``[c*size, (c+1)*size)``.

    Series with a NULL left are rejected as a whole.
    """
    by, i = list(by), F.col("bin_idx")
    rows = grid.withColumn("c", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), floor_div(i - (m - 1), size)), floor_div(i, size))))
    packed = rows.groupBy(*by, "c").agg(F.sort_array(F.collect_list(F.struct("bin_idx", "value"))).alias("_p"))
    out = packed.select(
        *by, "c", (F.col("c") * size).alias("lo"), F.transform("_p", lambda p: p["value"]).alias("values"),
        F.exists("_p", lambda p: p["value"].isNull()).alias("_gap"),
    )
    # written once: the series is read for both sides of every cell and for the gap check
    out = checkpointed(out.filter(F.size("values") >= m))
    broken = out.filter("_gap").select(*by).distinct()
    return out.drop("_gap").join(broken, by, "left_anti")


def _unit(values, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Centred windows of length one (zero when constant) and the constant mask."""
    w = np.lib.stride_tricks.sliding_window_view(np.asarray(values, dtype=float), m)
    z = w - w.mean(axis=1, keepdims=True)
    norm = np.sqrt((z * z).sum(axis=1))
    flat = norm <= 1e-12 * np.maximum(1.0, np.abs(w).max(axis=1))
    return np.divide(z, norm[:, None], out=np.zeros_like(z), where=~flat[:, None]), flat


def _corr(za, fa, zb, fb, mass: bool) -> np.ndarray:
    """Correlation of all window pairs; two constants agree only under the query rule."""
    c = np.clip(za @ zb.T, -1.0, 1.0)
    if mass and fa.any() and fb.any():
        c[np.ix_(fa, fb)] = 1.0
    return c


RESTART = 256  # rows after which covariances are computed anew, so that rounding does not add up
STEADY = 1e4  # largest over smallest product of two windows' norms up to which the recurrence holds its digits


class _Windows:
    """The windows of one chunk, and what the step along a diagonal needs of each."""

    def __init__(self, values, m: int):
        given = np.asarray(values, dtype=float)
        self.values = given - given.mean()  # correlations stay the same
        self.all = np.lib.stride_tricks.sliding_window_view(self.values, m)
        self.mean = self.all.mean(axis=1)
        centred = self.all - self.mean[:, None]
        norm = np.sqrt((centred * centred).sum(axis=1))
        high = np.lib.stride_tricks.sliding_window_view(np.abs(given), m).max(axis=1)
        self.flat = norm <= 1e-12 * np.maximum(1.0, high)
        self.scale = np.divide(1.0, norm, out=np.zeros_like(norm), where=~self.flat)
        self.half = (self.values[m:] - self.values[:-m]) / 2
        self.mid = (self.values[m:] - self.mean[1:]) + (self.values[:-m] - self.mean[:-1])
        sound = norm[~self.flat]
        self.spread = float(sound.max() / sound.min()) if len(sound) else 1.0

    def __len__(self) -> int:
        return len(self.mean)

    def unit(self, rows) -> np.ndarray:
        return (self.all[rows] - self.mean[rows][:, None]) * self.scale[rows][:, None]


def _corr_rows(a: _Windows, b: _Windows, s: int, e: int, mass: bool) -> np.ndarray:
    """Correlations of the windows ``s`` to ``e`` of ``a`` with all of ``b``.

    cov(i+1, j+1) = cov(i, j) + half_a(i) mid_b(j) + mid_a(i) half_b(j), from the first row and column.
    Chunks whose windows differ too much in scale take the products themselves.
    """
    if a.spread * b.spread <= STEADY:
        c = np.empty((e - s, len(b)))
        c[:, 0] = np.correlate(a.values[s : e + a.all.shape[1] - 1], b.all[0] - b.mean[0], "valid")
        c[0] = np.correlate(b.values, a.all[s] - a.mean[s], "valid")
        step = np.outer(a.half[s : e - 1], b.mid)
        step += np.outer(a.mid[s : e - 1], b.half)
        for r in range(1, e - s):
            np.add(c[r - 1, :-1], step[r - 1], out=c[r, 1:])
        c *= a.scale[s:e, None]
        c *= b.scale
    else:
        c = a.unit(slice(s, e)) @ b.unit(slice(None)).T
    np.clip(c, -1.0, 1.0, out=c)
    if mass and a.flat[s:e].any() and b.flat.any():
        c[np.ix_(a.flat[s:e], b.flat)] = 1.0
    return c


def _diagonals(a: _Windows, b: _Windows, mass: bool):
    """Correlations of all windows of ``a`` with all of ``b``, some rows at a time: (first row, block)."""
    for s in range(0, len(a), RESTART):
        yield s, _corr_rows(a, b, s, min(s + RESTART, len(a)), mass)


def _pair_corr(a: _Windows, i: np.ndarray, b: _Windows, j: np.ndarray, mass: bool) -> np.ndarray:
    """Correlations of chosen pairs by their products, so that close ones have all digits; -inf where ``j`` is negative."""
    c = np.clip(np.einsum("nm,nm->n", a.unit(i), b.unit(j)), -1.0, 1.0)
    if mass:
        c[a.flat[i] & b.flat[j]] = 1.0
    return np.where(j < 0, -np.inf, c)


TIE = 1e-12  # correlations this close count as equal: the lowest index wins


def _first_best(c: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Index and value of the first entry that ties with the largest one."""
    top = c.max(axis=axis, keepdims=True)
    at = (c >= top - TIE).argmax(axis=axis)
    return at, np.take_along_axis(c, np.expand_dims(at, axis), axis).squeeze(axis)


def _distance(corr: Column, m: int | Column) -> Column:
    m = F.lit(float(m)) if isinstance(m, int) else m
    return F.when(corr >= -1.0, F.sqrt(F.greatest(2.0 * m * (1.0 - corr), F.lit(0.0))))


def _self_cells(parts: DataFrame, by: Sequence[str]):
    """Chunk pairs (a <= b) of every series, each under its own key."""
    by = list(by)
    tops = parts.groupBy(*by).agg(F.max("c").alias("_top"))
    rows = attach(parts, tops, by, salt="c")
    zero = F.lit(0).cast("bigint")
    left = rows.select(*by, F.col("c").alias("a"), F.explode(F.sequence("c", "_top")).alias("b"), "lo", "values")
    right = rows.select(
        *[F.col(k).alias(f"_{k}") for k in by], F.explode(F.sequence(zero, F.col("c"))).alias("_a"), F.col("c").alias("_b"), F.col("lo").alias("_lo"), F.col("values").alias("_values")
    )
    return cells(left, [*by, "a", "b"], right, [*[f"_{k}" for k in by], "_a", "_b"])


def _neighbours(grid: DataFrame, m: int, minlag: int, mass: bool, by: Sequence[str], chunk: int) -> DataFrame:
    """Best neighbour of every window per side: ``by, idx, side, corr, nn`` (several rows per window)."""
    by, size = list(by), chunk_size(m, chunk)
    pairs = _self_cells(chunks(grid, m, size, by), by)

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return empty_frame([*by, "side"], ["idx", "nn"], ["corr"])
        a, b = int(left["lo"].iloc[0]), int(right["_lo"].iloc[0])
        wa = _Windows(left["values"].iloc[0], m)
        wb = wa if a == b else _Windows(right["_values"].iloc[0], m)
        i, j = np.arange(a, a + len(wa)), np.arange(b, b + len(wb))
        col_best, col_arg = np.full(len(j), -np.inf), np.full(len(j), -1)
        row_arg = np.full(len(i), -1)
        near = b - (a + len(wa) - 1) <= minlag  # else every pair is far enough apart
        for s, c in _diagonals(wa, wb, mass):
            if near:
                for r in range(len(c)):  # only later windows: each pair once
                    c[r, : max(0, a + s + r + minlag - b + 1)] = -np.inf
            at, top = _first_best(c, 1)
            row_arg[s : s + len(c)] = np.where(top < -1.0, -1, at)
            up, top = _first_best(c, 0)
            better = top > col_best + TIE
            col_best[better], col_arg[better] = top[better], s + up[better]
        row_best = _pair_corr(wa, np.arange(len(wa)), wb, row_arg, mass)
        col_best = _pair_corr(wb, np.arange(len(wb)), wa, col_arg, mass)
        row_arg, col_arg = np.where(row_arg < 0, -1, j[row_arg]), np.where(col_arg < 0, -1, i[col_arg])
        out = {k: left[k].iloc[0] for k in by}
        out["idx"] = np.concatenate([i, j])
        out["side"] = np.repeat(["right", "left"], [len(i), len(j)])
        out["corr"] = np.concatenate([row_best, col_best])
        out["nn"] = np.concatenate([row_arg, col_arg])
        return pd.DataFrame(out)

    schema = T.StructType(
        [grid.schema[k] for k in by]
        + [T.StructField("idx", T.LongType()), T.StructField("side", T.StringType()), T.StructField("corr", T.DoubleType()), T.StructField("nn", T.LongType())]
    )
    return pairs.applyInPandas(kernel, schema)


def _ranked() -> Column:
    """Order of candidate neighbours: correlation up to ties, then the lowest index."""
    return F.struct(F.round("corr", 12).alias("r"), (-F.col("nn")).alias("n"), F.col("corr"))


def _reduce(rows: DataFrame, keys: Sequence[str], m: int) -> DataFrame:
    best = rows.groupBy(*keys).agg(F.max(_ranked()).alias("_b"))
    none = F.col("_b.corr") < -1.0
    return best.select(
        *keys, _distance(F.col("_b.corr"), m).alias("dist"), F.when(~none, -F.col("_b.n")).alias("nn")
    )


def matrix_profile(
    grid: DataFrame, m: int, minlag: int | None = None, by: Sequence[str] = SIGNAL, mass: bool = False, chunk: int = CHUNK
) -> DataFrame:
    """Nearest-neighbour distance and index of every window of every series."""
    if m < 4:
        raise ValueError("windows have at least 4 samples")
    lag = exclusion(m) if minlag is None else int(minlag)
    return _marked(_reduce(_neighbours(grid, m, lag, mass, by, chunk), [*by, "idx"], m), grid)


def _marked(profile: DataFrame, grid: DataFrame) -> DataFrame:
    """Pass the proven length of the grid on to the window index."""
    bins = known_bins(grid)
    return profile if bins is None else mark_bins(profile, bins, "idx")


def lr_matrix_profile(
    grid: DataFrame, m: int, minlag: int | None = None, by: Sequence[str] = SIGNAL, chunk: int = CHUNK
) -> DataFrame:
    """Nearest earlier (left) and later (right) neighbour of every window."""
    lag = exclusion(m) if minlag is None else int(minlag)
    rows = _neighbours(grid, m, lag, False, by, chunk)
    pick = lambda side: F.max(F.when(F.col("side") == side, _ranked()))
    best = rows.groupBy(*by, "idx").agg(pick("left").alias("_l"), pick("right").alias("_r"))
    some = lambda s: F.col(f"{s}.corr") >= -1.0
    return best.select(
        *by,
        "idx",
        _distance(F.col("_l.corr"), m).alias("left_dist"),
        F.when(some("_l"), -F.col("_l.n")).alias("left_nn"),
        _distance(F.col("_r.corr"), m).alias("right_dist"),
        F.when(some("_r"), -F.col("_r.n")).alias("right_nn"),
    )


# ---------------------------------------------------------------- queries against series


def window_values(grid: DataFrame, seeds: DataFrame, m: int, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Values of chosen windows: ``seeds`` (``by, query_id, seed``) plus a ``query`` array."""
    at = seeds.withColumn("bin_idx", F.explode(F.sequence(F.col("seed"), F.col("seed") + (m - 1))))
    rows = at.join(grid.select(*by, "bin_idx", "value"), [*by, "bin_idx"])
    keys = [*by, "query_id", "seed"]
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin_idx", "value"))).alias("_p"))
    return packed.select(*keys, F.transform("_p", lambda p: p["value"]).alias("query")).filter(F.size("query") == m)


def query_profiles(
    queries: DataFrame, grid: DataFrame, m: int, by: Sequence[str] = SIGNAL, nearest_only: bool = False, minlag: int = -1, chunk: int = CHUNK
) -> DataFrame:
    """Distance of query windows to every window of their series (constants by the query rule).

    ``queries`` has ``by, query_id, seed, query`` and optionally ``limit``: farther
    windows are not returned. ``nearest_only`` keeps one window per query and chunk;
    windows within ``minlag`` of the seed are then skipped.
    """
    by, size = list(by), chunk_size(m, chunk)
    parts = chunks(grid, m, size, by)
    tops = parts.groupBy(*by).agg(F.max("c").alias("_top"))
    limit = F.col("limit") if "limit" in queries.columns else F.lit(None).cast("double")
    asked = queries.withColumn("limit", limit).withColumn("_pack", floor_div(F.col("seed"), size)).join(tops, by)
    packs = asked.select(*by, "_pack").distinct()
    asked = asked.select(*by, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_top"))).alias("c"), "_pack", "query_id", "seed", "query", "limit")
    right = parts.join(packs, by).select(*[F.col(k).alias(f"_{k}") for k in by], F.col("c").alias("_c"), F.col("_pack").alias("_p"), "lo", "values")
    pairs = cells(asked, [*by, "c", "_pack"], right, [*[f"_{k}" for k in by], "_c", "_p"])

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return empty_frame(by, ["query_id", "seed", "idx"], ["dist"])[[*by, "query_id", "seed", "idx", "dist"]]
        z, flat = _unit(right["values"].iloc[0], m)
        asked = [_unit(q, m) for q in left["query"]]
        q, fq = np.concatenate([u for u, _ in asked]), np.concatenate([f for _, f in asked])
        idx, seeds = np.arange(len(z)) + int(right["lo"].iloc[0]), left["seed"].to_numpy()
        c = _corr(q, fq, z, flat, True)
        d = np.sqrt(np.maximum(2.0 * m * (1.0 - c), 0.0))
        keep = ~(d > left["limit"].to_numpy(dtype=float)[:, None])  # no limit is NaN and cuts nothing
        if nearest_only:
            keep &= np.abs(idx[None, :] - seeds[:, None]) > minlag
            best, _ = _first_best(np.where(keep, c, -np.inf), 1)
            keep &= np.arange(len(idx))[None, :] == best[:, None]
        i, j = np.nonzero(keep)
        frame = {k: [left[k].iloc[0]] * len(i) for k in by}
        frame |= {"query_id": left["query_id"].to_numpy()[i], "seed": seeds[i], "idx": idx[j], "dist": d[i, j]}
        return pd.DataFrame(frame)

    schema = T.StructType(
        [grid.schema[k] for k in by]
        + [queries.schema["query_id"], T.StructField("seed", T.LongType()), T.StructField("idx", T.LongType()), T.StructField("dist", T.DoubleType())]
    )
    return pairs.applyInPandas(kernel, schema)


def distance_profile(query: Sequence[float], grid: DataFrame, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Distance of one pattern to every window of every series."""
    m = len(query)
    ids = grid.select(*by).distinct()
    asked = ids.withColumn("query_id", F.lit(0)).withColumn("seed", F.lit(-1).cast("bigint"))
    asked = asked.withColumn("query", F.array(*[F.lit(float(v)) for v in query]))
    return query_profiles(asked, grid, m, by).select(*by, "idx", "dist")


def nn_scan(grid: DataFrame, m: int, idxs: DataFrame, minlag: int | None = None, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Nearest neighbour of chosen windows (``by, idx``)."""
    lag = exclusion(m) if minlag is None else int(minlag)
    seeds = idxs.select(*by, F.col("idx").alias("query_id"), F.col("idx").alias("seed"))
    near = query_profiles(window_values(grid, seeds, m, by), grid, m, by, nearest_only=True, minlag=lag)
    best = near.groupBy(*by, "seed").agg(F.min(F.struct(F.round("dist", 9).alias("r"), F.col("idx").alias("nn"), "dist")).alias("b"))
    return best.select(*by, F.col("seed").alias("idx"), "b.dist", "b.nn")


# ---------------------------------------------------------------- motifs and discords


def greedy_pairs(pairs: DataFrame, k: int, gap: int, by: Sequence[str] = SIGNAL, one_axis: bool = True) -> DataFrame:
    """Closest pairs per key whose endpoints stay at least ``gap`` from accepted ones.

    Many pairs may share a neighbour, so no cut of the list is safe; each round takes the
    best remaining pair of every key at once. ``one_axis`` compares all endpoints with
    each other, else the two ends separately.
    """
    by = list(by)
    rows = checkpointed(pairs.filter(F.col("dist").isNotNull()).select(*by, "idx_a", "idx_b", "dist"))
    picks = None
    for rank in range(1, k + 1):
        left = rows
        if picks is not None:
            used = picks.groupBy(*by).agg(F.collect_list("idx_a").alias("_ua"), F.collect_list("idx_b").alias("_ub"))
            left = attach(rows, used, by, salt="idx_a")
            near = lambda end, taken: F.exists(taken, lambda u: F.abs(u - F.col(end)) < gap)
            if one_axis:
                both = F.concat("_ua", "_ub")
                clash = near("idx_a", both) | near("idx_b", both)
            else:
                clash = near("idx_a", F.col("_ua")) | near("idx_b", F.col("_ub"))
            left = left.filter(~clash)
        best = left.groupBy(*by).agg(F.min(F.struct("dist", "idx_a", "idx_b")).alias("b"))
        best = best.select(*by, F.lit(rank).alias("rank"), "b.idx_a", "b.idx_b", "b.dist")
        picks = checkpointed(best if picks is None else picks.unionByName(best))
    return picks


def _pairs(mp: DataFrame) -> DataFrame:
    some = mp.filter(F.col("nn").isNotNull())
    return some.withColumn("idx_a", F.least("idx", "nn")).withColumn("idx_b", F.greatest("idx", "nn"))


def motif_pairs(mp: DataFrame, k: int, minlag: int, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Top non-overlapping nearest-neighbour pairs of a profile."""
    return greedy_pairs(_pairs(mp), k, minlag, by)


def discords(mp: DataFrame, k: int, minlag: int, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Windows with the largest profile values, spaced beyond ``minlag``."""
    picks = pick_nonoverlap(mp.select(*by, "idx", "dist", "nn"), k, minlag, "dist", by, "idx")
    return picks.withColumnRenamed("pick", "rank")


def motif_pruned(grid: DataFrame, m: int, minlag: int | None = None, segments: int = 16, by: Sequence[str] = SIGNAL, chunk: int = CHUNK) -> DataFrame:
    """Exact best pair per series; cells drop windows whose segment-mean bound is too far.

    The diagonal cells give a first best distance. Elsewhere the distance of weighted
    segment means, a lower bound, decides which windows are compared in full.
    """
    by, size = list(by), chunk_size(m, chunk)
    lag = exclusion(m) if minlag is None else int(minlag)
    parts = chunks(grid, m, size, by)
    cuts = [k * m // min(segments, m) for k in range(min(segments, m) + 1)]

    def search(za, fa, zb, fb, a, b, bound):
        best = (np.inf, -1, -1)
        pa, pb = (np.stack([z[:, s:e].mean(axis=1) * math.sqrt(e - s) for s, e in zip(cuts, cuts[1:])], axis=1) for z in (za, zb))
        j = np.arange(b, b + len(zb))
        step = max(1, CELL_BYTES // (8 * len(zb)))
        for s in range(0, len(za), step):
            i = np.arange(a + s, a + min(s + step, len(za)))
            x = pa[s : s + step]
            low = (x * x).sum(1)[:, None] + (pb * pb).sum(1)[None, :] - 2 * x @ pb.T
            low[j[None, :] - i[:, None] <= lag] = np.inf
            limit = min(bound, best[0])
            # unit windows: full distance is sqrt(m) times the distance of the unit vectors
            rows = np.flatnonzero((low.min(axis=1) * m) <= limit * limit * (1 + 1e-9) + 1e-9)
            if not len(rows):
                continue
            c = _corr(za[s : s + step][rows], fa[s : s + step][rows], zb, fb, True)
            c[j[None, :] - i[rows][:, None] <= lag] = -np.inf
            at = int(np.argmax(c))
            r, col = divmod(at, c.shape[1])
            if c[r, col] >= -1.0:
                d = math.sqrt(max(2.0 * m * (1.0 - c[r, col]), 0.0))
                if d < best[0]:
                    best = (d, int(i[rows[r]]), int(j[col]))
        return best

    fields = [grid.schema[k] for k in by] + [T.StructField(n, t) for n, t in (("dist", T.DoubleType()), ("idx_a", T.LongType()), ("idx_b", T.LongType()))]
    schema = T.StructType(fields)
    empty = lambda: empty_frame(by, ["idx_a", "idx_b"], ["dist"])

    def row(pdf, best):
        if not np.isfinite(best[0]):
            return empty()
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "dist": [best[0]], "idx_a": [best[1]], "idx_b": [best[2]]})

    def near_kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        z, f = _unit(pdf["values"].iloc[0], m)
        lo = int(pdf["lo"].iloc[0])
        return row(pdf, search(z, f, z, f, lo, lo, np.inf))

    near = checkpointed(parts.groupBy(*by, "c").applyInPandas(near_kernel, schema))
    bound = near.groupBy(*by).agg(F.min("dist").alias("_bound"))
    bounded = parts.join(bound, by, "left").withColumn("_bound", F.coalesce("_bound", F.lit(float("inf"))))
    tops = bounded.groupBy(*by).agg(F.max("c").alias("_top"))
    rows = attach(bounded, tops, by, salt="c")
    left = rows.filter(F.col("c") < F.col("_top")).select(*by, F.col("c").alias("a"), F.explode(F.sequence(F.col("c") + 1, F.col("_top"))).alias("b"), "lo", "values", "_bound")
    right = rows.filter(F.col("c") > 0).select(
        *[F.col(k).alias(f"_{k}") for k in by], F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1)).alias("_a"), F.col("c").alias("_b"), F.col("lo").alias("_lo"), F.col("values").alias("_values")
    )

    def far_kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return empty()
        za, fa = _unit(x["values"].iloc[0], m)
        zb, fb = _unit(y["_values"].iloc[0], m)
        return row(x, search(za, fa, zb, fb, int(x["lo"].iloc[0]), int(y["_lo"].iloc[0]), float(x["_bound"].iloc[0])))

    far = cells(left, [*by, "a", "b"], right, [*[f"_{k}" for k in by], "_a", "_b"]).applyInPandas(far_kernel, schema)
    best = near.unionByName(far).groupBy(*by).agg(F.min(F.struct("dist", "idx_a", "idx_b")).alias("b"))
    return best.select(*by, "b.idx_a", "b.idx_b", "b.dist")


def _matches(profiles: DataFrame, motifs: DataFrame, keys: Sequence[str], m: int, factor: float, max_n: int | None) -> DataFrame:
    """Windows within the pair-relative threshold, spaced by half a window, the seed first."""
    keys = list(keys)
    pair = motifs.select(*keys, F.col("dist").alias("_pair"))
    rows = attach(profiles, pair, keys, salt="idx")
    # a pair at distance 0 sets no scale: use a low percentile of the profile instead
    flat = quantiles(rows.filter((F.col("_pair") <= 0) & (F.col("dist") > 0)), keys, "dist", {"_low": 0.01}, bounded=False)
    rows = rows.join(flat, keys, "left")
    limit = F.when(F.col("_pair") > 0, F.col("_pair") * factor).otherwise(F.coalesce(F.col("_low") * factor, F.lit(float("inf"))))
    seed = F.col("idx") == F.col("seed")
    rows = rows.filter(seed | (F.col("dist") <= limit)).withColumn("_score", F.when(seed, -1.0).otherwise(F.col("dist")))
    picks = _spaced(rows.select(*keys, "idx", "dist", "_score"), max_n, max(1, math.ceil(m / 2)) - 1, keys)
    return picks.drop("_score")


def _spaced(rows: DataFrame, max_n: int | None, radius: int, keys: Sequence[str]) -> DataFrame:
    """Best-first picks by ``_score``, more than ``radius`` apart: all of them, or the first ``max_n``."""
    if max_n is None:
        return pick_all(rows, radius, "_score", keys, "idx")
    return pick_nonoverlap(rows, max_n, radius, "_score", keys, "idx", descending=False).drop("pick")


def occurrences(
    grid: DataFrame, motifs: DataFrame, m: int, factor: float = 1.5, max_n: int | None = None, by: Sequence[str] = SIGNAL
) -> DataFrame:
    """All places that repeat each motif (``by, rank, idx_a, dist``)."""
    by = list(by)
    seeds = motifs.select(*by, F.col("rank").alias("query_id"), F.col("idx_a").alias("seed"))
    limits = motifs.select(*by, F.col("rank").alias("query_id"), F.when(F.col("dist") > 0, F.col("dist") * factor).alias("limit"))
    asked = window_values(grid, seeds, m, by).join(limits, [*by, "query_id"])
    found = query_profiles(asked, grid, m, by).withColumnRenamed("query_id", "rank")
    return _matches(found, motifs, [*by, "rank"], m, factor, max_n)


def pan_occurrences(grid: DataFrame, motifs: DataFrame, factor: float = 1.5, max_n: int | None = None, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Repeats of each motif of a scan over lengths, at the motif's own length (``m``)."""
    out = None
    for m in sorted(r["m"] for r in motifs.select("m").distinct().collect()):  # no more than the scanned lengths
        part = occurrences(grid, motifs.filter(F.col("m") == m).drop("m"), m, factor, max_n, by).withColumn("m", F.lit(m))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return motifs.select(*by, "rank", F.col("idx_a").alias("idx"), "dist", "m")
    return out


def pan_lengths(low: int, high: int, step: int | None = None) -> list[int]:
    """Window lengths of a scan: each one, or every ``step``-th."""
    low, high = max(4, int(low)), max(int(low) + 1, int(high))
    return list(range(low, high + 1, int(step or 1)))


def pan_motifs(grid: DataFrame, lengths: Sequence[int], k: int = 3, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Best motif of each window length, ranked by distance over sqrt(length)."""
    out = None
    for m in lengths:
        mp = matrix_profile(grid, m, by=by)
        best = _pairs(mp).groupBy(*by).agg(F.min(F.struct("dist", "idx_a", "idx_b")).alias("b"))
        part = best.select(*by, F.lit(int(m)).alias("m"), "b.idx_a", "b.idx_b", "b.dist")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy(*by).orderBy(F.col("dist") / F.sqrt(F.col("m").cast("double")), "m")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# ---------------------------------------------------------------- regimes and chains


def arc_curve(mp: DataFrame, edge: int, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Corrected arc curve: neighbour arcs over each index against the even spread."""
    by = list(by)
    ends = F.array(
        F.struct((F.least("idx", "nn") + 1).alias("idx"), F.lit(1).alias("d")),
        F.struct((F.greatest("idx", "nn") + 1).alias("idx"), F.lit(-1).alias("d")),
    )
    marks = mp.filter(F.col("nn").isNotNull()).select(*by, F.explode(ends).alias("e")).groupBy(*by, F.col("e.idx").alias("idx"))
    marks = marks.agg(F.sum("e.d").alias("_d"))
    rows = mp.select(*by, "idx").join(marks, [*by, "idx"], "left")
    rows = running_sum(rows, by, {"arcs": F.coalesce("_d", F.lit(0))}, idx="idx")
    size = mp.groupBy(*by).agg((F.max("idx") + 1).alias("_n"))
    rows = attach(rows, size, by, salt="idx")
    ideal = 2.0 * F.col("idx") * (F.col("_n") - F.col("idx")) / F.col("_n")
    cac = F.when(ideal > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("arcs") / F.when(ideal > 0, ideal)))).otherwise(1.0)
    edges = (F.col("idx") < edge) | (F.col("idx") >= F.col("_n") - edge)
    return rows.select(*by, "idx", F.col("arcs").cast("bigint").alias("arcs"), F.when(edges, 1.0).otherwise(cac).alias("cac"))


def regimes(mp: DataFrame, k: int, edge: int, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Boundaries: lowest dips of the arc curve below 1, spaced beyond ``edge``."""
    curve = arc_curve(mp, edge, by).filter(F.col("cac") < 1.0).drop("arcs")
    return pick_nonoverlap(curve, k, max(1, edge), "cac", by, "idx", descending=False).withColumnRenamed("pick", "rank")


def chains(lr: DataFrame, k: int = 1, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Longest chains of mutual left/right neighbours: ``by, rank, pos, idx, length``.

    Links form simple paths; every round doubles how far each window sees back along
    its path, so the number of rounds is the logarithm of the longest chain.
    """
    by = list(by)
    lr = checkpointed(lr.select(*by, "idx", "left_nn", "right_nn"))
    ahead = lr.filter(F.col("right_nn").isNotNull()).select(*by, F.col("right_nn").alias("idx"), F.col("idx").alias("head"))
    links = ahead.join(lr.select(*by, "idx", F.col("left_nn").alias("head")), [*by, "idx", "head"])
    state = lr.select(*by, "idx").join(links, [*by, "idx"], "left")
    state = state.select(*by, "idx", F.coalesce("head", "idx").alias("head"), F.when(F.col("head").isNotNull(), 1).otherwise(0).cast("bigint").alias("pos"))
    state = checkpointed(state)
    while True:
        up = state.select(*by, F.col("idx").alias("head"), F.col("head").alias("_h"), F.col("pos").alias("_p"))
        moved = state.join(up, [*by, "head"]).select(*by, "idx", F.col("_h").alias("head"), (F.col("pos") + F.col("_p")).alias("pos"), (F.col("_p") > 0).alias("_more"))
        moved = checkpointed(moved)
        state = moved.drop("_more")
        if not moved.filter("_more").limit(1).count():
            break
    size = state.groupBy(*by, "head").agg((F.max("pos") + 1).alias("length"), F.max("idx").alias("_end"))
    w = Window.partitionBy(*by).orderBy(F.col("length").desc(), F.col("_end"))
    best = size.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= k) & ((F.col("length") > 1) | (F.col("rank") == 1)))
    return state.join(best.drop("_end"), [*by, "head"]).select(*by, "rank", "pos", "idx", "length")


def chain_drift(links: DataFrame, grid: DataFrame, m: int, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Slopes and ends of window mean and swing along every chain."""
    by = list(by)
    cols = {
        "_mean": lambda w: F.avg("value").over(w.rowsBetween(0, m - 1)),
        "_swing": lambda w: F.max("value").over(w.rowsBetween(0, m - 1)) - F.min("value").over(w.rowsBetween(0, m - 1)),
    }
    windows = framed(grid, by, cols, after=m - 1).select(*by, F.col("bin_idx").alias("idx"), "_mean", "_swing")
    rows = links.join(windows, [*by, "idx"])
    return rows.groupBy(*by, "rank").agg(
        F.count(F.lit(1)).alias("links"),
        F.min_by("_mean", "pos").alias("mean_start"),
        F.max_by("_mean", "pos").alias("mean_end"),
        F.coalesce(F.regr_slope("_mean", "pos"), F.lit(0.0)).alias("mean_slope"),
        F.min_by("_swing", "pos").alias("amplitude_start"),
        F.max_by("_swing", "pos").alias("amplitude_end"),
        F.coalesce(F.regr_slope("_swing", "pos"), F.lit(0.0)).alias("amplitude_slope"),
    )


# ---------------------------------------------------------------- two series, many series


def _cross_neighbours(parts: DataFrame, pairs: DataFrame, m: int) -> DataFrame:
    """Best neighbours between the series of each pair: ``series, other, idx, corr, nn``.

    ``pairs`` (``s, t``) is joined by key; every chunk pair is one cell.
    """
    tops = parts.groupBy("signal_id").agg(F.max("c").alias("_top"))
    named = pairs.join(tops.select(F.col("signal_id").alias("s"), F.col("_top").alias("_ts")), "s")
    named = named.join(tops.select(F.col("signal_id").alias("t"), F.col("_top").alias("_tt")), "t")
    pack = lambda own, other, top: named.groupBy(F.col(own).alias("signal_id")).agg(F.collect_list(F.struct(F.col(other).alias("o"), F.col(top).alias("top"))).alias("_o"))
    zero = F.lit(0).cast("bigint")
    left = attach(parts, pack("s", "t", "_tt"), "signal_id", salt="c").withColumn("_o", F.explode("_o"))
    left = left.select(F.col("signal_id").alias("s"), F.col("_o.o").alias("t"), F.col("c").alias("a"), F.explode(F.sequence(zero, F.col("_o.top"))).alias("b"), "lo", "values")
    right = attach(parts, pack("t", "s", "_ts"), "signal_id", salt="c").withColumn("_o", F.explode("_o"))
    right = right.select(F.col("_o.o").alias("_s"), F.col("signal_id").alias("_t"), F.explode(F.sequence(zero, F.col("_o.top"))).alias("_a"), F.col("c").alias("_b"), F.col("lo").alias("_lo"), F.col("values").alias("_values"))

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return empty_frame(["series", "other"], ["idx", "nn"], ["corr"])
        wa, wb = _Windows(x["values"].iloc[0], m), _Windows(y["_values"].iloc[0], m)
        i, j = np.arange(len(wa)) + int(x["lo"].iloc[0]), np.arange(len(wb)) + int(y["_lo"].iloc[0])
        row_arg, col_best, col_arg = np.zeros(len(wa), int), np.full(len(wb), -np.inf), np.zeros(len(wb), int)
        for s, c in _diagonals(wa, wb, True):
            row_arg[s : s + len(c)] = _first_best(c, 1)[0]
            up, top = _first_best(c, 0)
            better = top > col_best + TIE
            col_best[better], col_arg[better] = top[better], s + up[better]
        row_best, col_best = _pair_corr(wa, np.arange(len(wa)), wb, row_arg, True), _pair_corr(wb, np.arange(len(wb)), wa, col_arg, True)
        row_arg, col_arg = j[row_arg], i[col_arg]
        s, t = x["s"].iloc[0], x["t"].iloc[0]
        return pd.DataFrame(
            {
                "series": np.repeat([s, t], [len(i), len(j)]),
                "other": np.repeat([t, s], [len(i), len(j)]),
                "idx": np.concatenate([i, j]),
                "corr": np.concatenate([row_best, col_best]),
                "nn": np.concatenate([row_arg, col_arg]),
            }
        )

    pairs = cells(left, ["s", "t", "a", "b"], right, ["_s", "_t", "_a", "_b"])
    return pairs.applyInPandas(kernel, "series string, other string, idx long, corr double, nn long")


def ab_profile(grid: DataFrame, a: str, b: str, m: int, chunk: int = CHUNK) -> DataFrame:
    """Nearest window of the other series, in both directions (``series`` a or b)."""
    rows = grid.filter(F.col("signal_id").isin([a, b]))
    parts = chunks(rows, m, chunk_size(m, chunk))
    pair = rows.sparkSession.createDataFrame([(a, b)], "s string, t string")
    best = _reduce(_cross_neighbours(parts, pair, m), ["series", "other", "idx"], m)
    side = F.when(F.col("series") == a, "a").otherwise("b")
    return best.select(side.alias("series"), "idx", "dist", "nn")


def ab_motifs(profile: DataFrame, k: int, gap: int) -> DataFrame:
    """Closest cross pairs, spaced within each series."""
    pairs = profile.filter(F.col("series") == "a").select(F.lit("ab").alias("pair"), F.col("idx").alias("idx_a"), F.col("nn").alias("idx_b"), "dist")
    return greedy_pairs(pairs, k, gap, ["pair"], one_axis=False).drop("pair")


def ab_occurrences(grid: DataFrame, a: str, b: str, motifs: DataFrame, m: int, factor: float = 1.5, max_n: int | None = None) -> DataFrame:
    """Repeats in both series of the shape that each cross pair has in ``a``: ``series`` (a or b), rank, idx, dist."""
    seeds = motifs.select(F.lit(a).alias("signal_id"), F.col("rank").alias("query_id"), F.col("idx_a").alias("seed"))
    shapes = window_values(grid, seeds, m).drop("signal_id", "seed")
    ends = F.array(*[F.struct(F.lit(s).alias("signal_id"), F.col(f"idx_{n}").alias("seed")) for s, n in ((a, "a"), (b, "b"))])
    limit = F.when(F.col("dist") > 0, F.col("dist") * factor)
    sides = motifs.select(F.col("rank").alias("query_id"), limit.alias("limit"), F.col("dist"), F.inline(ends))
    asked = sides.join(shapes, "query_id").select("signal_id", "query_id", "seed", "query", "limit")
    found = query_profiles(asked, grid.filter(F.col("signal_id").isin([a, b])), m).withColumnRenamed("query_id", "rank")
    pairs = sides.select("signal_id", F.col("query_id").alias("rank"), "dist")
    side = F.when(F.col("signal_id") == a, "a").otherwise("b")
    return _matches(found, pairs, ["signal_id", "rank"], m, factor, max_n).select(side.alias("series"), "rank", "idx", "dist")


def ab_discords(profile: DataFrame, k: int, gap: int, target: str = "b") -> DataFrame:
    """Windows of one series without a close analogue in the other."""
    return discords(profile.filter(F.col("series") == target), k, gap, ["series"])


SEGMENTS = 16
BLOCK_RUNS = 2048  # on either side of a cell of bounds
ROUND = 256  # runs of the first round of a consensus search; each further round takes four times as many
WIDEST = 4096
SEEDS = 3  # series whose windows are compared at once, for a first radius


def run_length(m: int) -> int:
    """Neighbouring windows that are bounded, compared or dropped together: few enough that they stay alike."""
    return 1 << min(5, int(math.log2(max(1, m // 12))))


def _boxes(parts: DataFrame, m: int) -> DataFrame:
    """Per run of windows the least and largest weighted segment means of its unit windows."""
    length = run_length(m)
    cuts = [k * m // min(SEGMENTS, m) for k in range(min(SEGMENTS, m) + 1)]

    def kernel(batches):
        for pdf in batches:
            for name, lo, values in zip(pdf["signal_id"], pdf["lo"], pdf["values"]):
                w = _Windows(values, m)
                z = w.unit(slice(None))
                means = np.stack([z[:, s:e].mean(axis=1) * math.sqrt(e - s) for s, e in zip(cuts, cuts[1:])], axis=1)
                starts = np.arange(0, len(w), length)
                low, high = np.minimum.reduceat(means, starts), np.maximum.reduceat(means, starts)
                yield pd.DataFrame({"signal_id": name, "run": starts + lo, "low": list(low), "high": list(high)})

    return parts.select("signal_id", "lo", "values").mapInPandas(kernel, "signal_id string, run long, low array<double>, high array<double>")


def _run_bounds(boxes: DataFrame, m: int, best: float, done: DataFrame) -> DataFrame:
    """(signal_id, run, other, bound): the series in which a run may have windows within ``best``.

    The distance of two boxes of segment means bounds that of their windows from below. Blocks of runs
    meet blocks of runs, and a cell returns only what lies within.
    """
    count = max(1, -(-boxes.count() // BLOCK_RUNS))
    placed = boxes.withColumn("_k", F.pmod(F.xxhash64("signal_id", floor_div(F.col("run"), run_length(m) * max(1, BLOCK_RUNS // 8))), F.lit(count)))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    left = placed.join(done, "signal_id", "left_anti").withColumn("_j", every)
    right = placed.select(F.col("signal_id").alias("other"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("_k").alias("_l"), every.alias("_i"))
    limit = (best * (1 + 1e-9) + 1e-9) ** 2 / m

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = [empty_frame(["signal_id", "other"], ["run"], ["bound"])[["signal_id", "run", "other", "bound"]]]
        if len(x) and len(y):
            y = y.sort_values("other", kind="stable")
            names = y["other"].to_numpy()
            starts = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            low, high = np.stack(y["_low"]).T, np.stack(y["_high"]).T
            for s in range(0, len(x), 128):
                part = x.iloc[s : s + 128]
                far = np.zeros((len(part), len(y)))
                for a, b, lo, hi in zip(np.stack(part["low"]).T, np.stack(part["high"]).T, low, high):
                    gap = np.maximum(a[:, None] - hi, lo - b[:, None])
                    np.maximum(gap, 0.0, out=gap)
                    far += gap * gap
                far = np.minimum.reduceat(far, starts, axis=1)
                i, j = np.nonzero((far <= limit) & (part["signal_id"].to_numpy()[:, None] != names[starts]))
                out.append(pd.DataFrame({"signal_id": part["signal_id"].to_numpy()[i], "run": part["run"].to_numpy()[i], "other": names[starts][j], "bound": np.sqrt(far[i, j] * m)}))
        return pd.concat(out)

    found = cells(left, ["_k", "_j"], right, ["_i", "_l"]).applyInPandas(kernel, "signal_id string, run long, other string, bound double")
    return found.groupBy("signal_id", "run", "other").agg(F.min("bound").alias("bound"))


def _compared(parts: DataFrame, pairs: DataFrame, m: int, best: float, length: int) -> DataFrame:
    """Nearest window of ``other`` to every window of a run, where it lies within ``best``: ``signal_id, idx, other, dist, nn``.

    ``pairs`` has ``signal_id, run, other``; a run has ``length`` windows. Every chunk of the other series is one cell.
    """
    tops = parts.groupBy("signal_id").agg(F.max("c").alias("_top"))
    size = parts.select("signal_id", "c", "lo", "values")
    runs = pairs.select("signal_id", "run").distinct().withColumn("_run", F.col("run"))
    starts = size.withColumn("run", F.explode(F.sequence(F.col("lo"), F.col("lo") + F.size("values") - m, F.lit(length).cast("bigint"))))
    shapes = starts.join(runs, ["signal_id", "run"]).select("signal_id", "run", F.slice("values", (F.col("run") - F.col("lo") + 1).cast("int"), length + m - 1).alias("shape"))
    asked = pairs.select("signal_id", "run", "other").join(shapes, ["signal_id", "run"]).join(tops.select(F.col("signal_id").alias("other"), "_top"), "other")
    asked = asked.select(F.col("signal_id").alias("_name"), F.col("run").alias("_run"), F.col("other").alias("_o"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_top"))).alias("_c"), "shape")

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = [empty_frame(["signal_id", "other"], ["idx", "nn"], ["dist"])[["signal_id", "idx", "other", "dist", "nn"]]]
        if len(x) and len(y):
            wb, lo, other = _Windows(x["values"].iloc[0], m), int(x["lo"].iloc[0]), x["signal_id"].iloc[0]
            for name, run, shape in zip(y["_name"], y["_run"], y["shape"]):
                wa = _Windows(shape, m)
                at = np.concatenate([_first_best(c, 1)[0] for _, c in _diagonals(wa, wb, True)])
                corr = _pair_corr(wa, np.arange(len(wa)), wb, at, True)
                dist = np.sqrt(np.maximum(2.0 * m * (1.0 - corr), 0.0))
                keep = np.flatnonzero(dist <= best * (1 + 1e-9) + 1e-9)
                out.append(pd.DataFrame({"signal_id": name, "idx": run + keep, "other": other, "dist": dist[keep], "nn": lo + at[keep]}))
        return pd.concat(out)

    found = cells(size, ["signal_id", "c"], asked, ["_o", "_c"]).applyInPandas(kernel, "signal_id string, idx long, other string, dist double, nn long")
    nearest = found.groupBy("signal_id", "idx", "other").agg(F.min(F.struct(F.round("dist", 9).alias("r"), F.col("nn"), F.col("dist"))).alias("b"))
    return nearest.select("signal_id", "idx", "other", "b.dist", "b.nn")


def _best_radius(near: DataFrame, need: int) -> tuple | None:
    """The smallest ``need - 1``-th distance of a window, with its series and place."""
    radius = near.groupBy("signal_id", "idx").agg(F.get(F.sort_array(F.collect_list("dist")), F.lit(need - 2)).alias("radius"))
    found = radius.filter("radius is not null").agg(F.min(F.struct("radius", "signal_id", "idx")).alias("b")).select("b.*").first()
    return tuple(found) if found["radius"] is not None else None


def consensus_search(grid: DataFrame, m: int, min_count: int | None = None, chunk: int = CHUNK) -> tuple[tuple | None, DataFrame, dict[str, int]]:
    """Best-first search for the window whose ``min_count``-th nearest series, itself at 0, is closest.

    Returns (radius, series, idx), the chunks, and how many pairs of a run of windows and a series there
    are, were bounded within the first radius, and were compared. All windows of a few series give the
    first radius: as many as hold the motif for certain, or ``SEEDS``. Runs of windows elsewhere come in
    the order of their bounds; a run goes as soon as fewer series than needed can lie within the best
    radius, and the search ends when the next run's bound is beyond it.
    """
    length = run_length(m)
    size = max(length, chunk_size(m, chunk) // length * length)
    parts = chunks(grid, m, size)
    ids = parts.select("signal_id").distinct()
    n = ids.count()
    if n < 2:
        return None, parts, {"all": 0, "bounded": 0, "compared": 0}
    need = n if min_count is None else max(2, min(int(min_count), n))
    boxes = checkpointed(_boxes(parts, m))
    first = [r[0] for r in ids.orderBy("signal_id").limit(min(SEEDS, n - need + 1)).collect()]
    seeds = ids.filter(F.col("signal_id").isin(first))
    asked = ids.select(F.col("signal_id").alias("other"), F.explode(F.array(*map(F.lit, first))).alias("signal_id")).filter("signal_id <> other")
    pairs = parts.select("signal_id", F.col("lo").alias("run")).join(asked, "signal_id")
    compared = boxes.join(seeds, "signal_id", "left_semi").count() * (n - 1)
    best = _best_radius(_compared(parts, pairs, m, float("inf"), size), need)
    near = F.array_sort(F.collect_list(F.struct("bound", "other")))
    runs = checkpointed(_run_bounds(boxes, m, best[0], seeds).groupBy("signal_id", "run").agg(near.alias("near")).withColumn("floor", F.get("near", F.lit(need - 2))["bound"]))
    work = {"all": boxes.count() * (n - 1), "bounded": runs.agg(F.coalesce(F.sum(F.size("near")), F.lit(0))).first()[0], "compared": compared}
    last, width = None, ROUND
    while True:
        reach = best[0] * (1 + 1e-9) + 1e-9
        left = runs.filter(F.col("floor") <= reach)
        if last:
            floor, name, run = last
            after = (F.col("signal_id") > name) | ((F.col("signal_id") == name) & (F.col("run") > run))
            left = left.filter((F.col("floor") > floor) | ((F.col("floor") == floor) & after))
        batch = left.select("floor", "signal_id", "run", F.size(F.filter("near", lambda x: x["bound"] <= reach)).alias("n")).orderBy("floor", "signal_id", "run").limit(width).collect()
        if not batch:
            return best, parts, work
        last, width = tuple(batch[-1])[:3], min(4 * width, WIDEST)
        work["compared"] += sum(r["n"] for r in batch)
        asked = grid.sparkSession.createDataFrame([(r["signal_id"], r["run"]) for r in batch], "signal_id string, run long")  # at most WIDEST rows
        pairs = runs.join(F.broadcast(asked), ["signal_id", "run"]).select("signal_id", "run", F.explode(F.filter("near", lambda x: x["bound"] <= reach)["other"]).alias("other"))
        found = _best_radius(_compared(parts, pairs, m, best[0], length), need)
        best = min(best, found) if found else best


def consensus_motif(grid: DataFrame, m: int, min_count: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """The window whose ``min_count``-th nearest series (itself at 0) is closest, and its nearest window in every series."""
    best, parts, _ = consensus_search(grid, m, min_count, chunk)
    if not best:
        return grid.sparkSession.createDataFrame([], "central_series string, central_idx long, radius double, signal_id string, idx long, dist double, is_central boolean")
    radius, name, idx = best
    central = [F.lit(name).alias("central_series"), F.lit(idx).cast("bigint").alias("central_idx"), F.lit(radius).alias("radius")]
    ids = parts.select("signal_id").distinct()
    own = ids.filter(F.col("signal_id") == name).select(*central, "signal_id", F.lit(idx).cast("bigint").alias("idx"), F.lit(0.0).alias("dist"), F.lit(True).alias("is_central"))
    pairs = ids.filter(F.col("signal_id") != name).select(F.lit(name).alias("signal_id"), F.lit(idx // run_length(m) * run_length(m)).cast("bigint").alias("run"), F.col("signal_id").alias("other"))
    near = _compared(parts, pairs, m, float("inf"), run_length(m)).filter(F.col("idx") == idx)
    return near.select(*central, F.col("other").alias("signal_id"), F.col("nn").alias("idx"), "dist", F.lit(False).alias("is_central")).unionByName(own)


# ---------------------------------------------------------------- several channels

TRACK = ("entity_id", "track_id")


CHANNELS = 16  # whose distances are held at a time


def mstamp(tracks: DataFrame, m: int, k_dims: Sequence[int] | None = None, minlag: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Profile over k of d channels: mean of the k smallest channel distances (``entity_id, k, idx``).

    Channels come in blocks. Of each pair of windows only the smallest distances so far are kept, as
    many as the largest k asked for, and the sum of all; so memory grows with k and not with d.
    """
    lag = exclusion(m) if minlag is None else int(minlag)
    d = tracks.select("track_id").distinct().count()
    size = max(64, min(chunk, CELL_BYTES // (64 * max(1, d))))
    parts = chunks(tracks, m, size, TRACK).groupBy("entity_id", "c", "lo").agg(
        F.sort_array(F.collect_list(F.struct("track_id", "values"))).alias("_t")
    )
    parts = parts.select("entity_id", "c", "lo", F.transform("_t", lambda t: t["values"]).alias("values"))
    wanted = sorted(k_dims) if k_dims else list(range(1, d + 1))

    def means(smallest: np.ndarray, total: np.ndarray, ks: list[int], count: int) -> dict[int, np.ndarray]:
        sums = np.cumsum(np.sort(smallest, axis=0), axis=0)
        return {k: (total if k == count else sums[k - 1]) / k for k in ks}

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return empty_frame(["entity_id"], ["k", "idx", "nn"], ["dist"])
        a, b = int(left["lo"].iloc[0]), int(right["_lo"].iloc[0])
        xs = [_Windows(v, m) for v in left["values"].iloc[0]]
        ys = xs if a == b else [_Windows(v, m) for v in right["_values"].iloc[0]]
        na, nb, count = len(xs[0]), len(ys[0]), len(xs)
        i, j = np.arange(a, a + na), np.arange(b, b + nb)
        ks = [k for k in wanted if k <= count]
        most = max([k for k in ks if k < count], default=0)
        to_distance = lambda c: np.sqrt(np.maximum(2.0 * m * (1.0 - c), 0.0))
        row_at = {k: np.full(na, -1) for k in ks}
        col_best, col_at = {k: np.full(nb, np.inf) for k in ks}, {k: np.full(nb, -1) for k in ks}
        step = max(1, min(RESTART, CELL_BYTES // (8 * nb * (most + CHANNELS + 2))))
        for s in range(0, na, step):
            e = min(s + step, na)
            total, smallest = np.zeros((e - s, nb)), np.empty((0, e - s, nb))
            for block in range(0, count, CHANNELS):
                dist = np.stack([to_distance(_corr_rows(x, y, s, e, True)) for x, y in zip(xs[block : block + CHANNELS], ys[block : block + CHANNELS])])
                total += dist.sum(axis=0)
                if most:
                    smallest = np.concatenate([smallest, dist])
                    if len(smallest) > most:
                        smallest = np.partition(smallest, most - 1, axis=0)[:most]
            near = j[None, :] - i[s:e, None] <= lag
            for k, kd in means(smallest, total, ks, count).items():
                kd = np.where(near, np.inf, kd)
                at = kd.argmin(axis=1)
                row_at[k][s:e] = np.where(near[np.arange(e - s), at], -1, at)
                up = kd.argmin(axis=0)
                top = kd[up, np.arange(nb)]
                better = top < col_best[k]
                col_best[k][better], col_at[k][better] = top[better], s + up[better]

        def exact(own, other, at, k):
            here = np.flatnonzero(at >= 0)
            dist = np.stack([to_distance(_pair_corr(x, here, y, at[here], True)) for x, y in zip(own, other)])
            return here, np.sort(dist, axis=0)[:k].sum(axis=0) / k

        out = [empty_frame([], ["k", "idx", "nn"], ["dist"])[["k", "idx", "dist", "nn"]]]
        for k in ks:
            for own, other, at, mine, theirs in ((xs, ys, row_at[k], i, j), (ys, xs, col_at[k], j, i)):
                here, dist = exact(own, other, at, k)
                out.append(pd.DataFrame({"k": k, "idx": mine[here], "dist": dist, "nn": theirs[at[here]]}))
        frame = pd.concat(out)
        frame.insert(0, "entity_id", left["entity_id"].iloc[0])
        return frame

    found = _self_cells(parts, ["entity_id"]).applyInPandas(kernel, "entity_id string, k int, idx long, dist double, nn long")
    best = found.groupBy("entity_id", "k", "idx").agg(F.min(F.struct("dist", "nn")).alias("b"))
    return best.select("entity_id", "k", "idx", "b.dist", "b.nn")


def participating_dims(tracks: DataFrame, pairs: DataFrame, m: int, k: int) -> DataFrame:
    """The ``k`` channels that agree best at each pair (``entity_id, rank, idx_a, idx_b``)."""
    keys = ["entity_id", "rank", "idx_a", "idx_b"]
    at = pairs.select(*keys).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    side = lambda name: tracks.select("entity_id", "track_id", F.col("bin_idx").alias(f"_{name}"), F.col("value").alias(f"_v{name}"))
    rows = at.withColumn("_a", F.col("idx_a") + F.col("_o")).withColumn("_b", F.col("idx_b") + F.col("_o"))
    rows = rows.join(side("a"), ["entity_id", "_a"]).join(side("b"), ["entity_id", "track_id", "_b"])
    facts = rows.groupBy(*keys, "track_id").agg(F.corr("_va", "_vb").alias("_r"), F.var_pop("_va").alias("_xa"), F.var_pop("_vb").alias("_xb"))
    fa, fb = F.col("_xa") <= 1e-18, F.col("_xb") <= 1e-18
    r = F.when(fa & fb, 1.0).when(fa | fb, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_r"))))
    facts = facts.withColumn("dim_dist", _distance(r, m))
    w = Window.partitionBy(*keys).orderBy("dim_dist", "track_id")
    head = facts.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    packed = head.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_n", "track_id", "dim_dist"))).alias("_p"))
    return packed.select(*keys, F.transform("_p", lambda p: p["track_id"]).alias("dims"), F.transform("_p", lambda p: p["dim_dist"]).alias("dim_dists"))


def mstamp_motifs(profile: DataFrame, tracks: DataFrame, m: int, k: int, n_dims: int, gap: int | None = None) -> DataFrame:
    """Top pairs at one dimensionality with the channels that take part."""
    gap = exclusion(m) if gap is None else gap
    pairs = motif_pairs(profile.filter(F.col("k") == n_dims), k, gap, ["entity_id"])
    return pairs.join(participating_dims(tracks, pairs, m, n_dims), ["entity_id", "rank", "idx_a", "idx_b"])


def mstamp_discords(profile: DataFrame, tracks: DataFrame, m: int, k: int, n_dims: int, gap: int | None = None) -> DataFrame:
    """Most novel windows at one dimensionality with the channels that stand out."""
    gap = exclusion(m) if gap is None else gap
    picks = checkpointed(discords(profile.filter(F.col("k") == n_dims), k, gap, ["entity_id"]))
    ends = picks.select("entity_id", "rank", F.col("idx").alias("idx_a"), F.col("nn").alias("idx_b"))
    dims = participating_dims(tracks, ends, m, n_dims).withColumnsRenamed({"idx_a": "idx", "idx_b": "nn"})
    return picks.join(dims, ["entity_id", "rank", "idx", "nn"])


def multidim_occurrences(
    tracks: DataFrame, motifs: DataFrame, m: int, factor: float = 1.5, max_n: int | None = None
) -> DataFrame:
    """Repeats of a multi-channel motif by mean distance over its channels (``dims``)."""
    seeds = motifs.select("entity_id", F.explode("dims").alias("track_id"), F.col("rank").alias("query_id"), F.col("idx_a").alias("seed"))
    found = query_profiles(window_values(tracks, seeds, m, TRACK), tracks, m, TRACK)
    mean = found.groupBy("entity_id", F.col("query_id").alias("rank"), "seed", "idx").agg(F.avg("dist").alias("dist"))
    return _matches(mean, motifs, ["entity_id", "rank"], m, factor, max_n)


def multidim_regimes(profile: DataFrame, m: int, k: int, n_dims: int) -> DataFrame:
    """Boundaries shared by the channels."""
    return regimes(profile.filter(F.col("k") == n_dims), k, m, ["entity_id"])


# ---------------------------------------------------------------- results


def result_rows(df: DataFrame, job_id: str, by: Sequence[str] = SIGNAL, dist: str = "dist") -> DataFrame:
    """Job-tagged rows with severity = distance over the job's largest one; non-finite becomes NULL."""
    finite = F.when(F.abs(F.col(dist)) < float("inf"), F.col(dist))
    rows = df.withColumn(dist, finite)
    top = rows.groupBy(*by).agg(F.max(dist).alias("_top"))
    rows = attach(rows, top, by, salt=dist)
    severity = F.when(F.col("_top") > 0, F.col(dist) / F.col("_top"))
    return rows.withColumn("job_id", F.lit(job_id)).withColumn("severity", severity).drop("_top")


def motif_strength(dist: Column, m: Column | int, second: Column | None = None) -> Column:
    m = F.lit(m) if isinstance(m, int) else m
    per = dist / F.sqrt(m.cast("double"))
    level = F.when(per < 0.15, "strong").when(per < 0.35, "moderate").otherwise("weak")
    if second is None:
        return level
    ratio = F.when(second > 0, dist / second)
    return F.when((ratio < 0.6) & (level == "moderate"), "strong").when((ratio > 0.95) & (level == "strong"), "moderate").otherwise(level)


def consistency_pct(dist: Column, m: Column | int) -> Column:
    m = F.lit(m) if isinstance(m, int) else m
    per = dist / F.sqrt(m.cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor((1 - per / 0.5) * 100 + 0.5).cast("double")))


def discord_severity(dist: Column, reference: Column) -> Column:
    """0 at or below the reference distance, 1 from three times it."""
    ratio = F.when(reference > 0, dist / reference).otherwise(dist)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ratio - 1) / 2))


def strength_of_severity(severity: Column) -> Column:
    return F.when(severity > 0.66, "strong").when(severity > 0.33, "moderate").otherwise("weak")


def drift_strength(drift: DataFrame) -> DataFrame:
    """Strength and direction of the change along chains (see ``chain_drift``)."""
    rel = lambda a, b: F.coalesce(F.abs(F.col(b) - F.col(a)) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9)), F.lit(0.0))
    change = F.greatest(rel("mean_start", "mean_end"), rel("amplitude_start", "amplitude_end"))
    level = F.when(F.col("links") < 3, "weak").when((change > 0.4) & (F.col("links") >= 4), "strong").when(change > 0.15, "moderate").otherwise("weak")
    slope = F.when(F.abs("amplitude_slope") > F.abs("mean_slope"), F.col("amplitude_slope")).otherwise(F.col("mean_slope"))
    return drift.withColumn("strength", level).withColumn(
        "drift_direction", F.when(slope > 0, "rising").when(slope < 0, "falling").otherwise("flat")
    )


def suggest_threshold(mp: DataFrame, seeds: DataFrame, factor: float = 1.5, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Distance that still counts as similar: ``factor`` times the seed's own, else the median."""
    by = list(by)
    some = mp.filter(F.col("dist") > 0)
    middle = quantiles(some.withColumnRenamed("idx", "_idx"), by, "dist", {"_mid": 0.5}, bounded=False)
    own = seeds.join(mp.select(*by, F.col("idx").alias("seed"), F.col("dist").alias("_own")), [*by, "seed"], "left").join(middle, by, "left")
    limit = F.when(F.col("_own") > 0, F.col("_own") * factor).otherwise(F.coalesce("_mid", F.lit(float("inf"))))
    return own.select(*by, "seed", limit.alias("threshold"))


def propagate_label(mp: DataFrame, seeds: DataFrame, length: int, gap: int, max_n: int | None = None, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Windows reached from a seed over neighbour links (both ways) within its threshold.

    ``seeds`` has ``by, seed, threshold``. Overlapping windows give way to closer ones.
    """
    by = list(by)
    nodes = checkpointed(attach(mp.select(*by, "idx", "dist", "nn"), seeds.select(*by, "seed", "threshold"), by, salt="idx"))
    fits = nodes.filter(F.col("dist") <= F.col("threshold")).select(*by, F.col("idx").alias("to"))
    ends = nodes.filter(F.col("nn").isNotNull())
    edges = ends.select(*by, "idx", F.col("nn").alias("to")).unionByName(ends.select(*by, F.col("nn").alias("idx"), F.col("idx").alias("to")))
    edges = checkpointed(edges.distinct().join(fits, [*by, "to"], "left_semi"))
    found = checkpointed(seeds.select(*by, F.col("seed").alias("idx")).distinct())
    front = found
    while True:
        fresh = front.join(edges, [*by, "idx"]).select(*by, F.col("to").alias("idx")).distinct().join(found, [*by, "idx"], "left_anti")
        front = checkpointed(fresh)
        if not front.limit(1).count():
            break
        found = checkpointed(found.unionByName(front))
    score = F.when(F.col("idx") == F.col("seed"), -1.0).otherwise(F.coalesce("dist", F.lit(float("inf"))))
    rows = found.join(nodes, [*by, "idx"]).select(*by, "idx", "dist", score.alias("_score"))
    picks = _spaced(rows, max_n, length + gap - 1, by)
    return picks.select(*by, F.col("idx").alias("start_index"), F.lit(length).alias("length"), "dist")


KINDS = (
    "full_mp", "motif", "discord", "pan", "segmentation", "chain",
    "ab_motif", "ab_discord", "multidim_motif", "multidim_discord", "multidim_segmentation", "consensus",
)


HEADLINE = ("motif_pairs", "discords", "segments", "chain_links", "consensus_members", "mp_result")


def summary(kind: str, m: int | None, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per analysis: its kind, window length, and rows and best distance of its leading table."""
    name = next(n for n in HEADLINE if n in tables)
    best = (F.max if name == "discords" else F.min)("dist") if "dist" in tables[name].columns else F.lit(None)
    facts = tables[name].agg(F.count(F.lit(1)).alias("rows"), best.cast("double").alias("best"))
    return facts.select(F.lit(kind).alias("type"), F.lit(m).cast("int").alias("m"), F.lit(name).alias("leading"), "rows", "best")


def analyze(kind: str, df: DataFrame, job_id: str, m: int | None = None, k: int = 3, **params) -> dict[str, DataFrame]:
    """Result tables of one analysis, each tagged with the job.

    ``df`` is a filled grid by ``signal_id``, or by ``entity_id, track_id`` for the
    multidim kinds. Further parameters: ``a``/``b`` (ab kinds), ``n_dims``, ``min_count``,
    ``lengths``.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    if m is None and kind != "pan":
        raise ValueError("m is required")
    multi = kind.startswith("multidim")
    by = ("entity_id",) if multi else SIGNAL
    out: dict[str, DataFrame] = {}
    if kind == "pan":
        pairs = checkpointed(pan_motifs(df, params["lengths"], k))
        out["motif_pairs"], out["motif_occurrences"] = pairs, pan_occurrences(df, pairs)
    elif kind.startswith("ab"):
        profile = checkpointed(ab_profile(df, params["a"], params["b"], m))
        out["mp_result"] = profile
        if kind == "ab_motif":
            pairs = checkpointed(ab_motifs(profile, k, exclusion(m)))
            out["motif_pairs"], out["motif_occurrences"] = pairs, ab_occurrences(df, params["a"], params["b"], pairs, m)
        else:
            out["discords"] = result_rows(ab_discords(profile, k, exclusion(m)), job_id, ["series"])
    elif kind == "consensus":
        out["consensus_members"] = consensus_motif(df, m, params.get("min_count"))
    elif multi:
        dims = params.get("n_dims") or df.select("track_id").distinct().count()
        profile = checkpointed(mstamp(df, m, [dims]))
        out["mp_result"] = profile
        if kind == "multidim_motif":
            pairs = checkpointed(mstamp_motifs(profile, df, m, k, dims))
            out["motif_pairs"], out["motif_occurrences"] = pairs, multidim_occurrences(df, pairs, m)
        elif kind == "multidim_discord":
            out["discords"] = result_rows(mstamp_discords(profile, df, m, k, dims), job_id, by)
        else:
            out["segments"] = multidim_regimes(profile, m, k, dims)
            out["arc_curve"] = arc_curve(profile.filter(F.col("k") == dims), m, by)
    elif kind == "chain":
        links = checkpointed(chains(lr_matrix_profile(df, m), k))
        out["chain_links"], out["chain_drift"] = links, drift_strength(chain_drift(links, df, m))
    else:
        profile = checkpointed(matrix_profile(df, m))
        out["mp_result"] = profile
        if kind in ("full_mp", "motif"):
            pairs = motif_pairs(profile, k, exclusion(m))
            out["motif_pairs"], out["motif_occurrences"] = pairs, occurrences(df, pairs, m)
        if kind in ("full_mp", "discord"):
            out["discords"] = result_rows(discords(profile, k, exclusion(m)), job_id)
        if kind == "segmentation":
            out["segments"], out["arc_curve"] = regimes(profile, k, m), arc_curve(profile, m)
    out["overview"] = overview(df, by=("entity_id", "track_id") if multi else SIGNAL)
    out["summary"] = summary(kind, m, out)
    return {name: t if "job_id" in t.columns else t.withColumn("job_id", F.lit(job_id)) for name, t in out.items()}
