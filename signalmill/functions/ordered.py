"""Order-dependent building blocks that never put a whole series in one task.

A series is cut into blocks of ``block`` consecutive indices. Frames that look a
fixed distance back or ahead copy only the rows near a block edge into the
neighbouring block; running totals add a small per-block carry. A grid whose
length is known to fit one block (see ``mark_bins``) takes the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from signalmill.functions.timeparts import floor_div

BLOCK = 1 << 17
SALTS = 16
IDX = "bin_idx"


def mark_bins(df: DataFrame, bins: int, idx: str = IDX) -> DataFrame:
    """Record the proven number of grid points per series on the index column."""
    return df.withMetadata(idx, {"bins": int(bins)})


def known_bins(df: DataFrame, idx: str = IDX) -> int | None:
    return df.schema[idx].metadata.get("bins") if idx in df.columns else None


def fits_block(df: DataFrame, idx: str = IDX, block: int = BLOCK) -> bool:
    bins = known_bins(df, idx)
    return bins is not None and bins <= block


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def framed(
    df: DataFrame,
    keys: str | Sequence[str],
    cols: dict[str, Callable[[WindowSpec], Column]],
    before: int = 0,
    after: int = 0,
    idx: str = IDX,
    block: int = BLOCK,
) -> DataFrame:
    """Window columns whose frames reach at most ``before`` rows back and ``after`` ahead.

    The rows of one key must have consecutive indices. Columns are added one
    after another, so a later one may use an earlier one only when the reach
    covers both.
    """
    keys = _keys(keys)
    if fits_block(df, idx, block):
        w = Window.partitionBy(*keys).orderBy(idx)
        for name, build in cols.items():
            df = df.withColumn(name, build(w))
        return df
    block = max(block, 4 * (before + after), 4)
    i = F.col(idx)
    out = df.withColumn("_own", floor_div(i, block)).withColumn(
        "_blk", F.explode(F.sequence(floor_div(i - after, block), floor_div(i + before, block)))
    )
    w = Window.partitionBy(*keys, "_blk").orderBy(idx)
    for name, build in cols.items():
        out = out.withColumn(name, build(w))
    return out.filter(F.col("_blk") == F.col("_own")).drop("_blk", "_own")


def running_sum(
    df: DataFrame,
    keys: str | Sequence[str],
    sums: dict[str, Column],
    idx: str = IDX,
    block: int = BLOCK,
) -> DataFrame:
    """Inclusive running totals along ``idx`` for each key; 0 before the first value."""
    keys = _keys(keys)
    full = (Window.unboundedPreceding, Window.currentRow)
    if fits_block(df, idx, block):
        w = Window.partitionBy(*keys).orderBy(idx).rowsBetween(*full)
        for name, expr in sums.items():
            df = df.withColumn(name, F.coalesce(F.sum(expr).over(w), F.lit(0)))
        return df
    tagged = df.withColumn("_blk", floor_div(F.col(idx), block))
    w = Window.partitionBy(*keys, "_blk").orderBy(idx).rowsBetween(*full)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = tagged.groupBy(*keys, "_blk").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    carry = carry.select(
        *keys, "_blk", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums]
    )
    out = tagged
    for name, expr in sums.items():
        out = out.withColumn(f"_i_{name}", F.coalesce(F.sum(expr).over(w), F.lit(0)))
    out = out.join(carry, [*keys, "_blk"])
    for name in sums:
        out = out.withColumn(name, F.col(f"_i_{name}") + F.col(f"_c_{name}"))
    return out.drop("_blk", *[f"_i_{n}" for n in sums], *[f"_c_{n}" for n in sums])


def neighbours(
    df: DataFrame,
    keys: str | Sequence[str],
    present: Column,
    payload: Column,
    prev: str = "_prev",
    nxt: str = "_next",
    idx: str = IDX,
    block: int = BLOCK,
) -> DataFrame:
    """Payload of the nearest row at or before / at or after each row where ``present`` holds."""
    keys = _keys(keys)
    mark = F.when(present, payload)
    back = lambda w: F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = lambda w: F.first(mark, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    if fits_block(df, idx, block):
        w = Window.partitionBy(*keys).orderBy(idx)
        return df.withColumn(prev, back(w)).withColumn(nxt, ahead(w))
    tagged = df.withColumn("_blk", floor_div(F.col(idx), block))
    edge = tagged.groupBy(*keys, "_blk").agg(
        F.max_by(mark, F.when(present, F.col(idx))).alias("_last"),
        F.min_by(mark, F.when(present, F.col(idx))).alias("_first"),
    )
    by_block = Window.partitionBy(*keys).orderBy("_blk")
    edge = edge.select(
        *keys,
        "_blk",
        F.last("_last", ignorenulls=True)
        .over(by_block.rowsBetween(Window.unboundedPreceding, -1))
        .alias("_before"),
        F.first("_first", ignorenulls=True)
        .over(by_block.rowsBetween(1, Window.unboundedFollowing))
        .alias("_after"),
    )
    w = Window.partitionBy(*keys, "_blk").orderBy(idx)
    out = tagged.withColumn("_p", back(w)).withColumn("_n", ahead(w)).join(edge, [*keys, "_blk"])
    return (
        out.withColumn(prev, F.coalesce("_p", "_before"))
        .withColumn(nxt, F.coalesce("_n", "_after"))
        .drop("_p", "_n", "_before", "_after", "_blk")
    )


def attach(df: DataFrame, stats: DataFrame, keys: str | Sequence[str], how: str = "inner", salt: Column | str = IDX) -> DataFrame:
    """Join one stats row per key onto many rows per key, spreading hot keys over salts.

    Salts come from a join, which the planner counts; of an exploded array it sees one row, so that it
    would send a table of many keys whole through the driver. Small ones it still finds out at run time.
    """
    keys = _keys(keys)
    salt = F.col(salt) if isinstance(salt, str) else salt
    many = df.withColumn("_salt", F.pmod(F.hash(salt), F.lit(SALTS)))
    salts = df.sparkSession.range(SALTS).select(F.col("id").cast("int").alias("_salt"))
    few = stats.crossJoin(F.broadcast(salts))
    return many.join(few, [*keys, "_salt"], how).drop("_salt")


def with_row(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (a total without grouping) to every row.

    One row is a proven bound, so it is broadcast and the rows stay where they are.
    """
    one = F.lit(1)
    return df.withColumn("_one", one).join(F.broadcast(facts.withColumn("_one", one)), "_one").drop("_one")


def with_stats(
    df: DataFrame,
    keys: str | Sequence[str],
    aggs: dict[str, Column],
    idx: str = IDX,
    block: int = BLOCK,
) -> DataFrame:
    """Per-key aggregates as extra columns of every row."""
    keys = _keys(keys)
    if fits_block(df, idx, block):
        w = Window.partitionBy(*keys)
        for name, agg in aggs.items():
            df = df.withColumn(name, agg.over(w))
        return df
    stats = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return attach(df, stats, keys, salt=idx)


def ordinal(
    df: DataFrame,
    keys: str | Sequence[str],
    order: Sequence[Column | str],
    bucket: Column,
    name: str = "ordinal",
    weight: Column | None = None,
) -> DataFrame:
    """Zero-based position of each row within its key.

    ``bucket`` must be non-decreasing along ``order`` (a time slot, say): rows are
    numbered inside each bucket and shifted by the rows in earlier buckets. With
    ``weight`` a row stands for that many positions and gets its first one.
    """
    keys = _keys(keys)
    tagged = df.withColumn("_bkt", bucket)
    size = F.lit(1).cast("bigint") if weight is None else weight
    before = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = tagged.groupBy(*keys, "_bkt").agg(F.sum(size).alias("_size"))
    sizes = sizes.select(*keys, "_bkt", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_skip"))
    w = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    within = F.row_number().over(w) - 1 if weight is None else F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - size
    return (
        tagged.withColumn("_rn", within)
        .join(sizes, [*keys, "_bkt"])
        .withColumn(name, (F.col("_rn") + F.col("_skip")).cast("bigint"))
        .drop("_rn", "_skip", "_bkt")
    )


def runs(
    df: DataFrame,
    keys: str | Sequence[str],
    label: Column,
    name: str = "run_id",
    idx: str = IDX,
    block: int = BLOCK,
) -> DataFrame:
    """Number consecutive rows with an equal ``label`` (gaps and islands)."""
    keys = _keys(keys)
    out = df.withColumn("_label", label)
    out = framed(
        out,
        keys,
        {"_new": lambda w: F.when(F.col("_label").eqNullSafe(F.lag("_label").over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)},
        before=1,
        idx=idx,
        block=block,
    )
    return running_sum(out, keys, {name: F.col("_new")}, idx=idx, block=block).drop("_label", "_new")
