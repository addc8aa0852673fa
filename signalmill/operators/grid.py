"""Dense regular grids: ``signal_id, bin_idx, ts, value`` with NULL for empty bins."""

from __future__ import annotations

import ast
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from signalmill.functions.ordered import BLOCK, framed, known_bins, mark_bins, neighbours, with_stats
from signalmill.functions.timeparts import as_us, floor_div, from_us, ntz, to_us
from signalmill.sources.telemetry import BIN_AGGS, between, finite

BIN_US_AGGS = ("avg", "min", "max", "sum", "count")


def bin_count(start: datetime, end: datetime, bin_us: int) -> int:
    """Grid points of ``[start, end)`` stepped by the bin."""
    return max(0, -(-(as_us(end) - as_us(start)) // bin_us))


def make_series(
    df: DataFrame,
    start: datetime,
    end: datetime,
    bin_us: int,
    agg: str = "avg",
    by: Sequence[str] = ("signal_id",),
    block: int = BLOCK,
) -> DataFrame:
    """Aggregate readings on a dense grid anchored at ``start``.

    Readings select inclusively, the grid is ``[start, end)``; empty bins are NULL
    (0 for count).
    """
    if agg not in BIN_US_AGGS:
        raise ValueError(f"aggregation must be one of {BIN_US_AGGS}")
    by, n, origin = list(by), bin_count(start, end, bin_us), as_us(start)
    keyed = df.filter(between(start, end)).withColumn("bin_idx", floor_div(to_us("ts") - origin, bin_us))
    # the join below would add these filters to one branch only and so split the scan
    for name in (*by, "bin_idx"):
        keyed = keyed.filter(F.col(name).isNotNull())
    filled = keyed.groupBy(*by, "bin_idx").agg(BIN_AGGS[agg]("value").alias("value"))
    # counting the binned values keeps this branch on the same exchange: one scan of the readings
    ids = filled.groupBy(*by).agg(F.count("value").alias("_seen")).filter(F.col("_seen") >= 0).select(*by)
    frame = skeleton(ids, n, by, block)
    out = frame.join(filled, [*by, "bin_idx"], "left")
    if agg == "count":
        out = out.withColumn("value", F.coalesce("value", F.lit(0)).cast("double"))
    out = out.select(*by, "bin_idx", from_us(F.col("bin_idx") * bin_us + origin).alias("ts"), "value")
    return mark_bins(out, n)


def skeleton(ids: DataFrame, n: int, by: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Every index ``0..n-1`` for every key; long grids are spread before they grow."""
    if n <= 0:
        return ids.withColumn("bin_idx", F.lit(0).cast("bigint")).filter(F.lit(False))
    if n <= block:
        return ids.withColumn("bin_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    last = F.lit(n - 1).cast("bigint")
    blocks = ids.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((n - 1) // block).cast("bigint"))))
    blocks = blocks.repartition(*by, "_b")
    low = F.col("_b") * block
    return blocks.withColumn("bin_idx", F.explode(F.sequence(low, F.least(low + (block - 1), last)))).drop("_b")


def fill_linear(grid: DataFrame, by: Sequence[str] = ("signal_id",), value: str = "value", block: int = BLOCK) -> DataFrame:
    """Interpolate inner gaps, hold the nearest value at the edges; all-NULL stays NULL."""
    i, v = F.col("bin_idx"), F.col(value)
    near = neighbours(grid, by, v.isNotNull(), F.struct(i.alias("i"), v.alias("v")), block=block)
    p, q = F.col("_prev"), F.col("_next")
    span = (q["i"] - p["i"]).cast("double")
    inner = p["v"] + (q["v"] - p["v"]) * (i - p["i"]) / span
    return near.withColumn(
        value,
        F.when(v.isNotNull(), v).when(p.isNull(), q["v"]).when(q.isNull(), p["v"]).otherwise(inner),
    ).drop("_prev", "_next")


def search_space(
    df: DataFrame, start: datetime, end: datetime, bin_us: int, agg: str = "avg", by: Sequence[str] = ("signal_id",)
) -> DataFrame:
    """Gap-filled grid of every signal: the common input of the analyses."""
    return fill_linear(make_series(df, start, end, bin_us, agg, by), by)


def aligned(
    df: DataFrame, ids: Sequence[str], start: datetime, end: datetime, bin_us: int, agg: str = "avg"
) -> DataFrame:
    """One row per bin with one column per signal."""
    grid = search_space(df.filter(F.col("signal_id").isin(list(ids))), start, end, bin_us, agg)
    return pivot_signals(grid, {i: i for i in ids})


def pivot_signals(grid: DataFrame, columns: dict[str, str], value: str = "value") -> DataFrame:
    """Wide view of named signals: ``bin_idx, ts, <columns>`` by one conditional aggregate."""
    picks = [F.max(F.when(F.col("signal_id") == sid, F.col(value))).alias(name) for name, sid in columns.items()]
    out = grid.filter(F.col("signal_id").isin(list(columns.values()))).groupBy("bin_idx", "ts").agg(*picks)
    bins = known_bins(grid)
    return out if bins is None else mark_bins(out, bins)


def analysis_grid(df: DataFrame, signal: str, start: datetime, end: datetime, bin_us: int) -> DataFrame:
    """Chart read of one signal on epoch-floored bins, the grid a matrix-profile run uses."""
    floor = as_us(start) // bin_us * bin_us
    stop = -(-as_us(end) // bin_us) * bin_us
    rows = df.filter((F.col("signal_id") == signal) & between(start, end) & (F.col("ts") < ntz(end)))
    grid = make_series(rows, start, end, bin_us) if floor == as_us(start) else _from_floor(rows, floor, stop, bin_us)
    return fill_linear(grid)


def _from_floor(rows: DataFrame, floor: int, stop: int, bin_us: int) -> DataFrame:
    return make_series(rows, floor, stop, bin_us)


_CALLS = {
    "abs": F.abs,
    "sqrt": F.sqrt,
    "exp": F.exp,
    "ln": F.log,
    "log10": F.log10,
    "floor": F.floor,
    "ceil": F.ceil,
    "round": lambda x: F.floor(x + F.lit(0.5)),
    "sign": F.signum,
    "min": F.least,
    "max": F.greatest,
    "pow": F.pow,
}
_CONSTS = {"pi": 3.141592653589793, "e": 2.718281828459045}


def formula_column(formula: str, names: Sequence[str]) -> Column:
    """Column of an arithmetic formula over the named columns.

    Allowed: ``+ - * / % ^``, unary minus, numbers, ``pi``, ``e`` and the listed
    functions. NULL inputs and non-finite results give NULL.
    """
    tree = ast.parse(formula.replace("^", "**"), mode="eval").body

    def build(node) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            if node.id in names:
                return F.col(node.id).cast("double")
            if node.id in _CONSTS:
                return F.lit(_CONSTS[node.id])
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.UAdd):
            return build(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = build(node.left), build(node.right)
            if isinstance(node.op, ast.Add):
                return a + b
            if isinstance(node.op, ast.Sub):
                return a - b
            if isinstance(node.op, ast.Mult):
                return a * b
            if isinstance(node.op, ast.Div):
                return F.when(b != 0, a / b)
            if isinstance(node.op, ast.Mod):
                return F.when(b != 0, a % F.when(b != 0, b))
            if isinstance(node.op, ast.Pow):
                return F.pow(a, b)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
            args = [build(a) for a in node.args]
            result = _CALLS[node.func.id](*args).cast("double")
            for a in args:  # least/greatest skip NULLs, a formula must not
                result = F.when(a.isNotNull(), result)
            return result
        raise ValueError(f"not allowed in a formula: {ast.dump(node)[:60]}")

    return finite(build(tree))


def derive(grid: DataFrame, formula: str, variables: dict[str, str], name: str = "value") -> DataFrame:
    """Derived metric over aligned signals; ``variables`` maps formula names to signals."""
    wide = pivot_signals(grid, variables)
    return wide.withColumn(name, formula_column(formula, list(variables)))


def rate_of_change(grid: DataFrame, by: Sequence[str] = ("signal_id",), name: str = "rate") -> DataFrame:
    """First difference; NULL when either side is missing."""
    return lag_value(grid, 1, by, "_lag1").withColumn(name, F.col("value") - F.col("_lag1")).drop("_lag1")


def lag_value(grid: DataFrame, n: int, by: Sequence[str] = ("signal_id",), name: str = "lagged") -> DataFrame:
    """Value ``n`` bins earlier."""
    return framed(grid, by, {name: lambda w: F.lag("value", n).over(w)}, before=n)


def rolling_mean(grid: DataFrame, n: int, by: Sequence[str] = ("signal_id",), name: str = "rolling_mean") -> DataFrame:
    """Trailing mean over at most ``n`` bins, ignoring NULLs."""
    return framed(grid, by, {name: lambda w: F.avg("value").over(w.rowsBetween(-(n - 1), 0))}, before=n - 1)


def moving_mean_std(grid: DataFrame, m: int, by: Sequence[str] = ("signal_id",)) -> DataFrame:
    """Mean and population deviation of every full window of ``m`` bins, by window start."""
    cols = {
        "mean": lambda w: F.avg("value").over(w.rowsBetween(0, m - 1)),
        "std": lambda w: F.stddev_pop("value").over(w.rowsBetween(0, m - 1)),
        "_len": lambda w: F.count(F.lit(1)).over(w.rowsBetween(0, m - 1)),
    }
    return framed(grid, by, cols, after=m - 1).filter(F.col("_len") == m).drop("_len")


def apply_adjustments(grid: DataFrame, adjustments: Sequence[dict], by: Sequence[str] = ("signal_id",)) -> DataFrame:
    """Scenario edits in order: scale, offset, ramp, clamp; disabled ones are skipped."""
    out = grid.withColumn("scenario", F.col("value"))
    active = [a for a in adjustments if a.get("enabled", True)]
    if any(a["kind"] == "ramp" for a in active):
        n = known_bins(grid)
        out = out.withColumn("_n", F.lit(n)) if n is not None else with_stats(out, by, {"_n": F.count(F.lit(1))})
    for a in active:
        v = F.col("scenario")
        if a["kind"] == "scale":
            v = v * F.lit(float(a.get("value", 1.0)))
        elif a["kind"] == "offset":
            v = v + F.lit(float(a.get("value", 0.0)))
        elif a["kind"] == "ramp":
            total = float(a.get("ramp_to", 0.0))
            v = v + F.when(F.col("_n") > 1, F.lit(total) * F.col("bin_idx") / (F.col("_n") - 1)).otherwise(F.lit(total))
        elif a["kind"] == "clamp":
            if a.get("min") is not None:
                v = F.when(v.isNotNull(), F.greatest(v, F.lit(float(a["min"]))))
            if a.get("max") is not None:
                v = F.when(v.isNotNull(), F.least(v, F.lit(float(a["max"]))))
        else:
            raise ValueError(f"unknown adjustment {a['kind']!r}")
        out = out.withColumn("scenario", v)
    return out.drop("_n")
