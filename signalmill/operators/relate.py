"""Correlation, regression, lead/lag and Granger relations between signals."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import combinations
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from signalmill.functions.frames import by_cell
from signalmill.functions.ordered import BLOCK, fits_block, known_bins, ordinal, with_row, with_stats
from signalmill.functions.timeparts import floor_div
from signalmill.operators.grid import pivot_signals
from signalmill.operators.spectral import series_length
from signalmill.plans.runtime import checkpointed, discard, written

GROUP = 128  # signals per side of one pair cell
SIDE = 512  # of a cell that meets packed series
PAIR_BLOCK = 1 << 14  # bins that such a cell takes
SPREAD = 32  # groups into which many signals go, for cells enough; each more is one more copy of every series
FEW = 8  # of large cells
SORTED = 3 << 22  # pairs of a cell that brings its rows in an order
STRIP, RUN = 512, 256  # signals of a cell's sides that come out together: each of a strip beside the same run
REACH = 1024  # of a cell that returns only what reaches a threshold


def _pair_cells(grid: DataFrame, lags: int, groups: int, block: int) -> DataFrame:
    """Rows copied to every (signal group, signal group, time block) cell that needs them."""
    i = F.col("bin_idx")
    rows = grid.select("signal_id", "bin_idx", "value").withColumn("_g", F.pmod(F.hash("signal_id"), F.lit(groups)))
    rows = rows.withColumn("_blk", F.explode(F.sequence(floor_div(i, block), floor_div(i + lags, block))))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return rows.select(
        "signal_id", "bin_idx", "value", "_blk", F.least("_g", "_o").alias("_ga"), F.greatest("_g", "_o").alias("_gb"), "_g"
    )


def _groups(ids: DataFrame) -> int:
    return max(1, -(-ids.select("signal_id").distinct().count() // GROUP))


def _cell_matrix(pdf: pd.DataFrame, block: int, lags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signal names, their groups and the value matrix of one pair cell."""
    lo = int(pdf["_blk"].iloc[0]) * block
    row, names = pd.factorize(pdf["signal_id"], sort=True)
    group = np.zeros(len(names), dtype=int)
    group[row] = pdf["_g"].to_numpy()
    width = int(pdf["bin_idx"].max()) - lo + 1
    x = np.full((len(names), width + lags), np.nan)
    x[row, pdf["bin_idx"].to_numpy() - lo + lags] = pdf["value"].to_numpy(dtype=float)
    return np.asarray(names, dtype=object), group, x


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """The rows of a cell's two groups in the order of their signals, and whether it is one group."""
    ga, gb = pdf["_ga"].iloc[0], pdf["_gb"].iloc[0]
    left = pdf[pdf["_g"] == ga].sort_values("signal_id")
    return left, left if ga == gb else pdf[pdf["_g"] == gb].sort_values("signal_id"), ga == gb


def _dense(side: pd.DataFrame, first: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A side's signals, which have a row for each time block, and their values by place, NaN where there is none."""
    row, names = pd.factorize(side["signal_id"])
    x = np.full((len(names), width), np.nan)
    for i, at, v in zip(row, side["at"], side["v"]):
        x[i, np.asarray(at, dtype=np.int64) - first] = v
    return np.asarray(names, dtype=object), x


def _centred_series(grid: DataFrame, blk: Column) -> DataFrame:
    """A row for each signal and time block: the places of its values and the values less the signal's mean."""
    centred = with_stats(grid.select("signal_id", "bin_idx", "value"), "signal_id", {"_mean": F.avg("value")}).filter(F.col("bin_idx").isNotNull())
    filled = F.when(F.col("value").isNotNull(), F.struct("bin_idx", (F.col("value") - F.col("_mean")).alias("v")))
    rows = centred.groupBy("signal_id", blk.alias("_blk")).agg(F.collect_list(filled).alias("_p"))
    return rows.select("signal_id", "_blk", F.transform("_p", lambda p: p["bin_idx"]).alias("at"), F.transform("_p", lambda p: p["v"]).alias("v"))


def pair_moments(grid: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """Moment sums over the shared bins of every unordered signal pair, one row per pair.

    Values are centred first and packed, a row for each signal and time block. Cells of two signal groups and
    one time block do the sums as matrix products, so no row per pair and bin is ever produced.
    """
    packed = checkpointed(_centred_series(grid, floor_div(F.col("bin_idx"), block)))
    groups = max(1, -(-packed.select("signal_id").distinct().count() // SIDE))
    cells = _both_sides(packed.withColumn("_g", F.pmod(F.hash("signal_id"), F.lit(groups))), groups)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(pdf)
        filled = [at for at in pdf["at"] if len(at)]
        first = min((int(min(at)) for at in filled), default=0)
        width = max((int(max(at)) for at in filled), default=0) - first + 1
        (own, x), (other, y) = _dense(left, first, width), _dense(right, first, width)
        m, k = np.isfinite(x).astype(float), np.isfinite(y).astype(float)
        x, y = np.nan_to_num(x), np.nan_to_num(y)
        i, j = np.triu_indices(len(x), 1) if same else (g.ravel() for g in np.indices((len(x), len(y))))
        sums = {"n": m @ k.T, "sx": x @ k.T, "sy": m @ y.T, "sxx": (x * x) @ k.T, "sxy": x @ y.T, "syy": m @ (y * y).T}
        out = {c: v[i, j] for c, v in sums.items()}
        a, b = own[i], other[j]
        swap = (a > b).astype(bool)
        for u, w in (("sx", "sy"), ("sxx", "syy")):
            out[u], out[w] = np.where(swap, out[w], out[u]), np.where(swap, out[u], out[w])
        return pd.DataFrame({"signal_a": np.where(swap, b, a), "signal_b": np.where(swap, a, b)} | out)

    sums = ("n", "sx", "sy", "sxx", "sxy", "syy")
    schema = "signal_a string, signal_b string, " + ", ".join(f"{c} double" for c in sums)
    parts = by_cell(cells, "_ga", "_gb", "_blk").applyInPandas(kernel, schema)
    return parts.groupBy("signal_a", "signal_b").agg(*[F.sum(c).alias(c) for c in sums])


def _side(rows: pa.Table, group: int, first: int, width: int) -> tuple[pa.Array, np.ndarray]:
    """Names of a group's signals, sorted, and their values by place, NaN where there is none."""
    rows = rows.filter(pc.equal(rows["_g"], group)).sort_by("signal_id")
    x = np.full((len(rows), width), np.nan)
    row = np.repeat(np.arange(len(rows)), pc.list_value_length(rows["at"]).to_numpy())
    x[row, pc.list_flatten(rows["at"]).to_numpy() - first] = pc.list_flatten(rows["v"]).to_numpy()
    return pa.concat_arrays(rows["signal_id"].cast(pa.string()).chunks or [pa.array([], pa.string())]), x


def _paired(grid: DataFrame, corr: bool, by_r: bool = False) -> DataFrame:
    """``signal_a, signal_b, n`` and, if asked for, ``r`` of every unordered pair, for a grid known to fit one block.

    A cell of two groups has both whole series of its pairs, so what it returns is final. It returns its rows in batches
    of bounded size and so that files stay small. As a rule groups hold signals with about as many values, so that a
    cell has few different ``n``, and each signal comes beside the same run of others. With ``by_r`` groups are ranges of
    names and rows come in the order of ``r``, whose equal values are many if it is rounded afterwards.
    """
    spark, bins = grid.sparkSession, max(1, known_bins(grid))
    packed, path = written(_centred_series(grid, F.lit(0)).drop("_blk"))
    count, first, last = packed.agg(F.count(F.lit(1)), F.min(F.array_min("at")), F.max(F.array_max("at"))).first()
    first, width = first or 0, (last or 0) - (first or 0) + 1
    side = min(max(1, CELL_VALUES // bins), isqrt(SORTED) if by_r else count + 1)
    groups = max(1, -(-count // side), min(FEW if by_r else SPREAD, -(-count // SIDE)))
    placed = checkpointed(packed.repartitionByRange(groups, *[] if by_r else [F.size("at")], "signal_id").withColumn("_g", F.spark_partition_id()))
    discard(spark, path)
    fields = [("signal_a", pa.string()), ("signal_b", pa.string()), ("n", pa.int64())] + [("r", pa.float64())] * corr

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        ga, gb = rows["_ga"][0].as_py(), rows["_gb"][0].as_py()
        own, x = _side(rows, ga, first, width)
        other, y = (own, x) if ga == gb else _side(rows, gb, first, width)
        m, k = np.isfinite(x).astype(float), np.isfinite(y).astype(float)
        x, y = np.nan_to_num(x), np.nan_to_num(y)
        names = pa.concat_arrays([own, other])
        others = other.to_pylist()
        before = np.array([bisect_left(others, v) for v in own.to_pylist()], dtype=np.int64)

        def met(i: slice, j: slice) -> tuple[np.ndarray, np.ndarray | None]:
            """Shared bins and correlations (NaN if constant) of some of one side with some of the other."""
            n = m[i] @ k[j].T
            if not corr:
                return n, None
            sx, sy, sxx, syy = x[i] @ k[j].T, m[i] @ y[j].T, (x[i] * x[i]) @ k[j].T, m[i] @ (y[j] * y[j]).T
            vx, vy = n * sxx - sx * sx, n * syy - sy * sy
            # a constant side leaves rounding dust only
            ok = (n >= 2) & (vx > 1e-12 * n * sxx) & (vy > 1e-12 * n * syy)
            with np.errstate(invalid="ignore", divide="ignore"):
                return n, np.where(ok, (n * (x[i] @ y[j].T) - sx * sy) / (np.sqrt(vx) * np.sqrt(vy)), np.nan)

        def batch(i: np.ndarray, j: np.ndarray, n: np.ndarray, r: np.ndarray | None) -> pa.RecordBatch:
            swap, j = j < before[i], j + len(own)
            cols = [names.take(pa.array(np.where(swap, j, i))), names.take(pa.array(np.where(swap, i, j))), pa.array(n.astype(np.int64))] + ([pa.array(r, mask=np.isnan(r))] if corr else [])
            return pa.RecordBatch.from_arrays(cols, schema=pa.schema(fields))

        if by_r:
            n, r = np.empty((len(own), len(other)), np.uint16), np.empty((len(own), len(other)))
            for i in range(0, len(own), RUN):
                n[i : i + RUN], r[i : i + RUN] = met(slice(i, i + RUN), slice(None))
            # r + 3 has one exponent, so its bits are in its order; the lowest make room for the place
            low = (1 << max(0, r.size - 1).bit_length()) - 1
            at = (r + 3).view(np.int64)
            at &= ~low
            for i in range(len(own)):
                at[i] |= np.arange(i * len(other), (i + 1) * len(other))
            at = at[np.triu(np.ones(at.shape, bool), 1)] if ga == gb else at.ravel()
            at.sort()
            for lo in range(0, len(at), STRIP * RUN):
                place = at[lo : lo + STRIP * RUN] & low
                yield batch(*divmod(place, len(other)), n.ravel()[place], r.ravel()[place])
            return
        for hi in range(0, len(other), RUN):
            for lo in range(0, len(own), STRIP):
                n, r = met(slice(lo, lo + STRIP), slice(hi, hi + RUN))
                i, j = (at.ravel() for at in np.indices(n.shape))
                keep = i + lo < j + hi if ga == gb else slice(None)
                if n.size and (ga != gb or keep.any()):
                    yield batch(i[keep] + lo, j[keep] + hi, n.ravel()[keep], r.ravel()[keep] if corr else None)

    schema = "signal_a string, signal_b string, n long" + ", r double" * corr
    return by_cell(_both_sides(placed, groups), "_ga", "_gb", cells=groups * (groups + 1)).applyInArrow(kernel, schema)


def pair_products(grid: DataFrame, lags: int, block: int = 1 << 14) -> DataFrame:
    """Product sums over complete bins for every ordered signal pair, one row per pair.

    Features are [1, a(t), a(t-1) … a(t-p), b(t-1) … b(t-p)]; cells as in ``pair_moments``.
    """
    centred = with_stats(grid, "signal_id", {"_mean": F.avg("value")})
    centred = centred.withColumn("value", F.col("value") - F.col("_mean"))
    cells = _pair_cells(centred, lags, _groups(grid), block)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        names, group, x = _cell_matrix(pdf, block, lags)
        x = x[:, : block + lags]
        same = pdf["_ga"].iloc[0] == pdf["_gb"].iloc[0]
        stack = np.stack([x[:, lags - k : x.shape[1] - k] for k in range(lags + 1)])  # lag, signal, time
        out = []
        for a in range(len(names)):
            for b in range(len(names)):
                if a != b and (same or group[a] != group[b]):
                    f = np.vstack([np.ones(stack.shape[2]), stack[:, a], stack[1:, b]])
                    f = f[:, np.isfinite(f).all(axis=0)]
                    out.append((names[a], names[b], (f @ f.T).ravel().tolist()))
        return pd.DataFrame(out, columns=["signal_a", "signal_b", "sums"])

    parts = by_cell(cells, "_ga", "_gb", "_blk").applyInPandas(kernel, "signal_a string, signal_b string, sums array<double>")
    size = (2 * lags + 2) ** 2
    totals = F.array(*[F.sum(F.col("sums")[i]) for i in range(size)])
    return parts.groupBy("signal_a", "signal_b").agg(totals.alias("sums"))


def signal_pairs(grid: DataFrame) -> DataFrame:
    """Unordered signal pairs with the number of bins both have a value in."""
    pairs = _paired(grid, False) if fits_block(grid, block=PAIR_BLOCK) else pair_moments(grid)
    return pairs.select("signal_a", "signal_b", F.col("n").cast("bigint").alias("shared_bins"))


def correlation_matrix(grid: DataFrame, symmetric: bool = False, by_r: bool = False) -> DataFrame:
    """Pairwise-complete Pearson correlation of every signal pair (NULL if constant).

    ``by_r``: rows of a cell come in the order of their correlation, for a caller that rounds it.
    """
    n, sx, sy, sxx, sxy, syy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy"))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    # a constant side leaves rounding dust only
    some = lambda v, s: v > 1e-12 * n * s
    ok = (n >= 2) & some(vx, sxx) & some(vy, syy)
    r = F.when(ok, (n * sxy - sx * sy) / (F.sqrt(vx) * F.sqrt(vy)))
    upper = _paired(grid, True, by_r) if fits_block(grid, block=PAIR_BLOCK) else pair_moments(grid).select("signal_a", "signal_b", n.cast("bigint").alias("n"), r.alias("r"))
    if not symmetric:
        return upper
    flipped = upper.select(F.col("signal_b").alias("signal_a"), F.col("signal_a").alias("signal_b"), "n", "r")
    own = grid.groupBy("signal_id").agg(F.count("value").alias("n"))
    own = own.select(F.col("signal_id").alias("signal_a"), F.col("signal_id").alias("signal_b"), "n", F.lit(1.0).alias("r"))
    return upper.unionByName(flipped).unionByName(own)


SKETCH = 64  # segment means by which a correlation is bounded
CELL_VALUES = 1 << 21  # of the signals on one side of a cell


def _packed(grid: DataFrame, block: int) -> DataFrame:
    """Places and centred values of each signal and time block, gaps left out; written once."""
    centred = with_stats(grid.select("signal_id", "bin_idx", "value"), "signal_id", {"_mean": F.avg("value")}).filter(F.col("value").isNotNull())
    pair = F.struct("bin_idx", (F.col("value") - F.col("_mean")).alias("v"))
    rows = centred.groupBy("signal_id", floor_div(F.col("bin_idx"), block).alias("_blk")).agg(F.array_sort(F.collect_list(pair)).alias("_p"))
    return checkpointed(rows.select("signal_id", "_blk", F.transform("_p", lambda p: p["bin_idx"]).alias("at"), F.transform("_p", lambda p: p["v"]).alias("v")))


def _sketches(packed: DataFrame, first: int, bins: int, groups: int) -> DataFrame:
    """Per signal its group, whether it has a value in every bin, and its unit vector's parts along equal segments."""
    width = -(-bins // SKETCH)
    sums = packed.select("signal_id", F.explode(F.arrays_zip("at", "v")).alias("p")).groupBy("signal_id", floor_div(F.col("p.at") - first, width).alias("seg"))
    sums = sums.agg(F.sum("p.v").alias("s"), F.count("*").alias("n"), F.sum(F.col("p.v") * F.col("p.v")).alias("q"))
    share = F.col("s") / F.sqrt(F.least(F.lit(width), F.lit(bins) - F.col("seg") * width))
    sums = sums.withColumn("c", share)
    found = sums.groupBy("signal_id").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.array_sort(F.collect_list(F.struct("seg", "c"))).alias("_c"))
    parts = F.transform("_c", lambda c: c["c"] / F.sqrt("q"))
    return found.filter("q > 0").select("signal_id", F.pmod(F.hash("signal_id"), F.lit(groups)).alias("_g"), (F.col("n") == bins).alias("whole"), parts.alias("parts"))


def _both_sides(rows: DataFrame, groups: int) -> DataFrame:
    """Every row in the cells of its group with each group."""
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return rows.withColumn("_ga", F.least("_g", "_o")).withColumn("_gb", F.greatest("_g", "_o")).drop("_o")


def _may_reach(threshold: float, absolute: bool):
    """The signals of a cell with a partner whose correlation may reach the threshold.

    For unit vectors x, y with parts p, q along orthogonal directions, x y <= p q + |x - p| |y - q|. A
    signal with gaps is not bounded.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(pdf)
        size = max(map(len, pdf["parts"]))

        def unit(side):
            whole, parts = side["whole"].to_numpy(bool), np.zeros((len(side), size))
            for i in np.flatnonzero(whole):
                parts[i] = side["parts"].iloc[i]
            return whole, parts, np.sqrt(np.maximum(0.0, 1.0 - (parts * parts).sum(axis=1)))

        (own, p, rest), (other, q, more) = unit(left), unit(right)
        high = p @ q.T
        if absolute:
            np.abs(high, out=high)
        high += np.outer(rest, more)
        pair = high >= threshold - 1e-9
        pair |= ~own[:, None]
        pair |= ~other[None, :]
        if same:
            np.fill_diagonal(pair, False)
        found = [left[pair.any(axis=1)]] + ([] if same else [right[pair.any(axis=0)]])
        return pd.concat(found)[["signal_id", "_g", "_ga", "_gb"]]

    return kernel


def _reaching(threshold: float, absolute: bool, first: int, bins: int):
    """Correlation of the pairs of one cell, over shared bins, where it reaches the threshold."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(pdf)
        (own, x), (other, y) = _dense(left, first, bins), _dense(right, first, bins)
        m, k = np.isfinite(x).astype(float), np.isfinite(y).astype(float)
        x, y = np.nan_to_num(x), np.nan_to_num(y)
        n, sx, sy, sxx, syy = m @ k.T, x @ k.T, m @ y.T, (x * x) @ k.T, m @ (y * y).T
        vx, vy = n * sxx - sx * sx, n * syy - sy * sy
        sound = (n >= 2) & (vx > 1e-12 * n * sxx) & (vy > 1e-12 * n * syy)
        with np.errstate(invalid="ignore", divide="ignore"):
            r = (n * (x @ y.T) - sx * sy) / (np.sqrt(vx) * np.sqrt(vy))
            hit = sound & ((np.abs(r) if absolute else r) >= threshold)
        i, j = np.nonzero(np.triu(hit, 1) if same else hit)
        a, b = own[i], other[j]
        swap = (a > b).astype(bool)
        return pd.DataFrame({"signal_a": np.where(swap, b, a), "signal_b": np.where(swap, a, b), "n": n[i, j].astype(np.int64), "r": r[i, j]})

    return kernel


def correlated_pairs(grid: DataFrame, threshold: float = 0.9, absolute: bool = False, block: int = 1 << 14) -> DataFrame:
    """Pairs of signals whose correlation over shared bins is at least ``threshold``: signal_a, signal_b, n, r.

    Equal to the full matrix, filtered, which is never made. Segment means bound every correlation from
    above: groups of signals meet by these short vectors first, and of each cell only signals with a
    partner in reach go on. Their whole series meet in cells of bounded size, and a cell returns what
    reaches the threshold. Signals with gaps have no bound and always go on; constant ones have no
    correlation. With ``absolute`` also strongly negative pairs count.
    """
    packed = _packed(grid, block)
    first, last, count = packed.agg(F.min(F.get("at", F.lit(0))), F.max(F.element_at("at", -1)), F.count_distinct("signal_id")).first()
    if first is None:
        return grid.sparkSession.createDataFrame([], "signal_a string, signal_b string, n long, r double")
    bins = last - first + 1
    groups = max(1, -(-count // max(1, min(REACH, CELL_VALUES // bins))))
    sketched = by_cell(_both_sides(_sketches(packed, first, bins, groups), groups), "_ga", "_gb")
    tried = sketched.applyInPandas(_may_reach(threshold, absolute), "signal_id string, _g int, _ga int, _gb int")
    rows = by_cell(tried.join(packed, "signal_id"), "_ga", "_gb")
    return rows.applyInPandas(_reaching(threshold, absolute, first, bins), "signal_a string, signal_b string, n long, r double")


def pearson(grid: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of two signals (NULL below two pairs or when constant)."""
    wide = pivot_signals(grid, {"_a": a, "_b": b}).filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    n = F.count(F.lit(1))
    ok = (n >= 2) & (F.var_pop("_a") > 0) & (F.var_pop("_b") > 0)
    return wide.agg(n.alias("n"), F.when(ok, F.corr("_a", "_b")).alias("r"))


def lag_sums(target: DataFrame, candidates: DataFrame, max_lag: int, block: int = 1 << 14) -> DataFrame:
    """Moment sums of target(t) against each candidate(t - lag) over lags ±max_lag.

    Time blocks carry ``max_lag`` extra candidate bins on both sides, so the lags
    never multiply the shuffled rows.
    """
    groups = _groups(candidates)
    i = F.col("bin_idx")
    t = target.select(F.lit(None).cast("string").alias("signal_id"), "bin_idx", "value", floor_div(i, block).alias("_blk"))
    t = t.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    c = candidates.select("signal_id", "bin_idx", "value").withColumn("_g", F.pmod(F.hash("signal_id"), F.lit(groups)))
    c = c.withColumn("_blk", F.explode(F.sequence(floor_div(i - max_lag, block), floor_div(i + max_lag, block))))
    rows = t.unionByName(c)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        lo = int(pdf["_blk"].iloc[0]) * block
        own = pdf["signal_id"].isna()
        x = np.full(block, np.nan)
        x[pdf.loc[own, "bin_idx"].to_numpy() - lo] = pdf.loc[own, "value"].to_numpy(dtype=float)
        out = []
        for name, part in pdf[~own].groupby("signal_id"):
            y = np.full(block + 2 * max_lag, np.nan)
            y[part["bin_idx"].to_numpy() - lo + max_lag] = part["value"].to_numpy(dtype=float)
            for lag in range(-max_lag, max_lag + 1):
                z = y[max_lag - lag : max_lag - lag + block]
                ok = np.isfinite(x) & np.isfinite(z)
                if ok.any():
                    a, b = x[ok], z[ok]
                    out.append((name, lag, len(a), a.sum(), b.sum(), a @ a, a @ b, b @ b))
        return pd.DataFrame(out, columns=["signal_id", "lag", "n", "sx", "sy", "sxx", "sxy", "syy"])

    schema = "signal_id string, lag int, n long, sx double, sy double, sxx double, sxy double, syy double"
    parts = by_cell(rows, "_g", "_blk").applyInPandas(kernel, schema)
    return parts.groupBy("signal_id", "lag").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy")])


def cross_correlation(grid: DataFrame, a: str, b: str, max_lag: int) -> DataFrame:
    """Pearson of a(t) with b(t + lag) for every lag; a positive peak lag means a leads."""
    side = lambda sid: _centred(grid.filter(F.col("signal_id") == sid))
    limit = max(0, min(int(max_lag), series_length(grid) - 1))
    sums = lag_sums(side(b), side(a), limit)
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy = n * F.col("sxx") - sx * sx, n * F.col("syy") - sy * sy
    r = F.when((n >= 2) & (vx > 0) & (vy > 0), (n * F.col("sxy") - sx * sy) / (F.sqrt(vx) * F.sqrt(vy)))
    return sums.select("lag", "n", r.alias("r"))


def best_lag(cc: DataFrame) -> DataFrame:
    """The lag with the largest absolute correlation (the lowest lag on ties)."""
    top = cc.filter(F.col("r").isNotNull()).agg(F.max_by(F.struct("lag", "r"), F.struct(F.abs("r"), -F.col("lag"))).alias("b"))
    return top.select("b.*")


def _centred(rows: DataFrame) -> DataFrame:
    out = with_stats(rows, "signal_id", {"_mean": F.avg("value")})
    return out.withColumn("value", F.col("value") - F.col("_mean")).drop("_mean")


def standardized(grid: DataFrame) -> DataFrame:
    """Whole-series z-scores (population); a flat or empty series becomes zero."""
    out = with_stats(grid, "signal_id", {"_m": F.avg("value"), "_sd": F.stddev_pop("value")})
    z = F.when(F.coalesce("_sd", F.lit(0.0)) == 0, 0.0).otherwise((F.col("value") - F.col("_m")) / F.col("_sd"))
    return out.withColumn("value", z).drop("_m", "_sd")


def rank_causes(grid: DataFrame, target: str, max_lag: int, bin_us: int) -> DataFrame:
    """Candidate drivers of the target by lagged correlation; positive lag leads it."""
    z = standardized(grid)
    n = series_length(grid)
    need = max(8, n // 4)
    own, rest = z.filter(F.col("signal_id") == target), z.filter(F.col("signal_id") != target)
    sums = lag_sums(own, rest, max_lag)
    corr = F.when(F.col("n") >= need, F.col("sxy") / F.col("n")).otherwise(0.0)
    scored = sums.withColumn("c", corr)
    best = scored.groupBy("signal_id").agg(
        F.max_by(F.struct("c", "lag"), F.struct(F.abs("c"), -F.col("lag"))).alias("b")
    )
    zero = F.col("b.c") == 0
    return best.select(
        "signal_id",
        F.col("b.c").alias("correlation"),
        F.when(zero, 0).otherwise(F.col("b.lag")).alias("lag_bins"),
        (F.when(zero, 0).otherwise(F.col("b.lag")) * (bin_us / 1e6)).alias("lag_s"),
        (~zero & (F.col("b.lag") > 0)).alias("leads"),
        F.abs("b.c").alias("strength"),
    )


def cause_edges(ranks: DataFrame, target: str, threshold: float = 0.3) -> DataFrame:
    """Directed edges from strong candidates to the target."""
    return ranks.filter(F.col("strength") >= threshold).select(
        F.col("signal_id").alias("source"), F.lit(target).alias("target"), "correlation", "lag_s"
    )


def propagation_order(ranks: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Leading candidates, longest lead first."""
    return ranks.filter(F.col("leads") & (F.col("strength") >= threshold)).orderBy(F.col("lag_s").desc(), "signal_id")


def _target_rows(grid: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Feature rows next to the target value of the same bin."""
    y = grid.filter(F.col("signal_id") == target).select("bin_idx", F.col("value").alias("_y"))
    x = grid.filter(F.col("signal_id").isin(list(features)))
    return x.select(F.col("signal_id").alias("feature"), "bin_idx", "ts", F.col("value").alias("_x")).join(y, "bin_idx")


def regression(grid: DataFrame, target: str, features: Sequence[str], compat: bool = False) -> DataFrame:
    """One-variable least squares per feature.

    ``compat`` divides the population covariance by the sample variance, the slope
    some dashboards show; it is (n-1)/n of the least-squares one.
    """
    rows = _target_rows(grid, target, features)
    facts = rows.groupBy("feature").agg(
        F.covar_pop("_x", "_y").alias("_cov"),
        (F.var_samp("_x") if compat else F.var_pop("_x")).alias("_vx"),
        F.avg("_x").alias("_mx"),
        F.avg("_y").alias("_my"),
        F.var_samp("_y").alias("variance"),
        F.pow(F.corr("_x", "_y"), 2).alias("r2"),
    )
    slope = F.when(F.col("_vx") > 0, F.col("_cov") / F.col("_vx")).otherwise(0.0)
    return facts.select(
        "feature",
        slope.alias("slope"),
        (F.col("_my") - slope * F.col("_mx")).alias("intercept"),
        F.when(~F.isnan("r2"), F.col("r2")).alias("r2"),
        "variance",
        (F.col("variance") * (1 - F.col("r2"))).alias("residual_variance"),
    )


def regression_fitted(grid: DataFrame, target: str, features: Sequence[str], compat: bool = False) -> DataFrame:
    """Target and fitted value per bin and feature."""
    fits = regression(grid, target, features, compat).select("feature", "slope", "intercept")
    rows = _target_rows(grid, target, features).join(fits, "feature")
    return rows.select(
        "feature", "bin_idx", "ts", F.col("_y").alias("value"), (F.col("intercept") + F.col("slope") * F.col("_x")).alias("fitted")
    )


def sensitivity(grid: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Features ranked by R², then name."""
    w = Window.orderBy(F.col("r2").desc_nulls_last(), "feature")  # one row per named feature
    fits = regression(grid, target, features).select("feature", "r2", "slope", "intercept")
    return fits.withColumn("rank", F.row_number().over(w))


def what_if(fits: DataFrame, scenario: DataFrame) -> DataFrame:
    """Prediction per scenario: mean intercept plus the sum of slope times value.

    ``scenario`` has ``scenario_id, feature, x``; a feature without a value counts as 0.
    """
    total = fits.agg(F.avg("intercept").alias("_c"))
    sums = scenario.join(fits, "feature").groupBy("scenario_id").agg(F.sum(F.col("slope") * F.col("x")).alias("_s"))
    ids = scenario.select("scenario_id").distinct().join(sums, "scenario_id", "left")
    out = with_row(ids, total)
    return out.select("scenario_id", (F.col("_c") + F.coalesce("_s", F.lit(0.0))).alias("predicted"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(xtx: pd.Series, xty: pd.Series) -> pd.Series:
    """Solve one small normal system per row; NULL when singular."""

    def one(a, b):
        dim = len(b)
        m = np.asarray(a, dtype=float).reshape(dim, dim)
        if not np.isfinite(m).all() or np.linalg.matrix_rank(m) < dim:
            return None
        return np.linalg.solve(m, np.asarray(b, dtype=float)).tolist()

    return pd.Series([one(a, b) if a is not None else None for a, b in zip(xtx, xty)])


def validate_points(grid: DataFrame, target: str, refs: Sequence[str], fraction: float = 0.7) -> DataFrame:
    """Virtual-sensor estimate, residual and z per bin, with the fit on the first part."""
    n, p = series_length(grid), len(refs)
    train_end = max(1, int(n * min(0.95, max(0.1, fraction))))
    names = [f"_x{i}" for i in range(p)]
    wide = pivot_signals(grid, {"value": target, **dict(zip(names, refs))})
    terms = [F.lit(1.0), *[F.col(x) for x in names]]
    have = F.lit(True)
    for x in names:
        have = have & F.col(x).isNotNull()
    train = wide.filter((F.col("bin_idx") < train_end) & have & F.col("value").isNotNull())
    aggs = [F.sum(terms[a] * terms[b]) for a in range(p + 1) for b in range(p + 1)]
    fit = train.agg(
        F.array(*aggs).alias("_xtx"),
        F.array(*[F.sum(t * F.col("value")) for t in terms]).alias("_xty"),
        F.count(F.lit(1)).alias("_m"),
        F.avg("value").alias("_my"),
    ).filter(F.col("_m") >= p + 2)
    fit = fit.withColumn("beta", _solve("_xtx", "_xty")).filter(F.col("beta").isNotNull())
    est = F.col("beta")[0]
    for i, x in enumerate(names):
        est = est + F.col("beta")[i + 1] * F.col(x)
    rows = with_row(wide, fit.select("beta", "_m", "_my"))
    rows = rows.withColumn("estimate", est).withColumn("residual", F.col("value") - F.col("estimate"))
    rows = rows.withColumn("is_train", F.col("bin_idx") < train_end)
    used = F.col("is_train") & F.col("residual").isNotNull()
    noise = rows.filter(used).agg(
        F.sqrt(F.sum(F.col("residual") * F.col("residual")) / F.greatest(F.lit(1), F.max("_m") - (p + 1))).alias("sigma"),
        (1 - F.sum(F.col("residual") * F.col("residual")) / F.sum(F.pow(F.col("value") - F.col("_my"), 2))).alias("r2"),
    )
    rows = with_row(rows, noise).drop("_m", "_my", *names)
    sd = F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(1.0)
    return rows.withColumn("residual_z", F.col("residual") / sd).withColumn("r2", F.greatest(F.coalesce("r2", F.lit(0.0)), F.lit(0.0)))


def validate_signal(grid: DataFrame, target: str, refs: Sequence[str], fraction: float = 0.7) -> DataFrame:
    """Bias, share beyond 3 sigma, largest z after the training part, and the verdict."""
    points = validate_points(grid, target, refs, fraction)
    z = F.abs("residual_z")
    late = ~F.col("is_train") & F.col("residual").isNotNull()
    facts = points.agg(
        F.max("sigma").alias("sigma"),
        F.max("r2").alias("r2"),
        F.coalesce(F.avg(F.when(late, F.col("residual"))), F.lit(0.0)).alias("bias"),
        F.coalesce(F.avg(F.when(late, (z > 3).cast("double"))), F.lit(0.0)).alias("out_of_bounds"),
        F.coalesce(F.max(F.when(late, z)), F.lit(0.0)).alias("max_abs_z"),
        F.count_if(F.lit(True)).alias("_rows"),
    ).filter(F.col("_rows") > 0)
    shift = F.abs("bias") / F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(1.0)
    worst, share = F.col("max_abs_z"), F.col("out_of_bounds")
    verdict = (
        F.when((worst > 6) | (share > 0.1) | (shift > 2), "faulty")
        .when((worst > 3) | (share > 0.02) | (shift > 1), "suspect")
        .otherwise("valid")
    )
    return facts.drop("_rows").withColumn("verdict", verdict)


@F.pandas_udf(T.DoubleType())
def _granger_score(sums: pd.Series, lags: pd.Series) -> pd.Series:
    """Relative drop in residual squares from the second signal's lags."""

    def rss(m: np.ndarray, cols: list[int]) -> float | None:
        a, b, yy = m[np.ix_(cols, cols)], m[cols, 1], m[1, 1]
        if m[0, 0] < len(cols) + 1 or np.linalg.matrix_rank(a) < len(cols):
            return None
        return float(yy - b @ np.linalg.solve(a, b))

    def one(flat, p):
        dim = 2 * p + 2
        m = np.asarray(flat, dtype=float).reshape(dim, dim)
        if m[0, 0] < 2 * p + 3:
            return 0.0
        own = [0, *range(2, p + 2)]
        small, full = rss(m, own), rss(m, [*own, *range(p + 2, dim)])
        if small is None or full is None or small <= 0:
            return 0.0
        return max(0.0, min(0.999, (small - full) / small))

    return pd.Series([one(s, int(p)) for s, p in zip(sums, lags)])


def causality_matrix(grid: DataFrame, p: int = 1) -> DataFrame:
    """Granger score of every ordered pair ``source -> target`` with ``p`` lags."""
    p = max(1, int(p))
    sums = pair_products(grid, p)
    return sums.select(
        F.col("signal_b").alias("source"), F.col("signal_a").alias("target"), _granger_score("sums", F.lit(p)).alias("score")
    )


def granger(grid: DataFrame, target: str, source: str, p: int = 1) -> DataFrame:
    """Granger score of one ordered pair."""
    pair = causality_matrix(grid.filter(F.col("signal_id").isin([target, source])), p)
    return pair.filter((F.col("source") == source) & (F.col("target") == target))


def causal_edges(matrix: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Directed edges at or above the threshold."""
    return matrix.filter(F.col("score") >= threshold)


def diagnose_anomalies(
    scored: DataFrame, target: str, candidates: Sequence[str], max_terms: int | None = None, top: int | None = None
) -> DataFrame:
    """Candidate regimes over-represented in the target's anomalous bins.

    ``scored`` is a grid with a ``flag`` column for the target rows. Candidates are
    low / normal / high around mean ± half a sample deviation. ``max_terms`` limits the
    candidates of a combination, ``top`` the rows.
    """
    cands = list(candidates)
    names = [f"cand{i}" for i in range(len(cands))]
    stats = with_stats(scored.filter(F.col("signal_id").isin([target, *cands])), "signal_id", {"_m": F.avg("value"), "_sd": F.stddev_samp("value")})
    state = (
        F.when(F.col("value") > F.col("_m") + 0.5 * F.col("_sd"), "high")
        .when(F.col("value") < F.col("_m") - 0.5 * F.col("_sd"), "low")
        .otherwise("normal")
    )
    wide = stats.withColumn("_state", state).groupBy("bin_idx").agg(
        F.max(F.when(F.col("signal_id") == target, (F.col("flag") != 0).cast("int"))).alias("_a"),
        *[F.max(F.when(F.col("signal_id") == c, F.col("_state"))).alias(n) for c, n in zip(cands, names)],
    )
    total = wide.agg(F.sum("_a").alias("_ta"), F.sum(1 - F.col("_a")).alias("_tn"))
    sets = [[F.col(n) for n in s] for size in range(1, min(max_terms or len(names), len(names)) + 1) for s in combinations(names, size)]
    counts = wide.groupingSets(sets, *names).agg(F.sum("_a").alias("count_anomalous"), F.sum(1 - F.col("_a")).alias("count_normal"))
    rows = with_row(counts, total)
    pct = lambda c, t: F.when(F.col(t) > 0, F.col(c) * 100.0 / F.col(t)).otherwise(0.0)
    rows = rows.withColumn("pct_anomalous", pct("count_anomalous", "_ta")).withColumn("pct_normal", pct("count_normal", "_tn"))
    rows = rows.withColumn("contribution", F.col("pct_anomalous") - F.col("pct_normal")).drop("_ta", "_tn")
    rows = rows.orderBy(F.col("contribution").desc(), *[F.col(n).asc_nulls_first() for n in names])
    return rows if top is None else rows.limit(top)


def scatter_pairs(grid: DataFrame, x: str, y: str, max_points: int | None = None) -> DataFrame:
    """Shared bins of two signals; with ``max_points`` every step-th one when there are more."""
    wide = pivot_signals(grid, {"x": x, "y": y}).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    if max_points is None:
        return wide.select("bin_idx", "ts", "x", "y")
    wide = wide.withColumn("_all", F.lit(1))
    rows = ordinal(wide, "_all", ["bin_idx"], floor_div(F.col("bin_idx"), BLOCK), name="_at")
    total = wide.agg(F.count(F.lit(1)).alias("_n"))
    step = F.when(F.col("_n") > max_points, F.ceil(F.col("_n") / max_points)).otherwise(1)
    return with_row(rows, total).filter(F.pmod(F.col("_at"), step) == 0).select("bin_idx", "ts", "x", "y")
