"""Exact quantiles (linear interpolation) without holding a group in one task.

A bounded sketch brackets each wanted rank; only the rows inside the bracket are
counted and ordered. Groups known to be short use the built-in aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from signalmill.functions.ordered import IDX, attach, fits_block

ACCURACY = 10_000


def quantiles(
    df: DataFrame,
    keys: str | Sequence[str],
    value: str,
    probs: dict[str, float],
    idx: str = IDX,
    accuracy: int = ACCURACY,
    bounded: bool | None = None,
) -> DataFrame:
    """One row per key with a column for each wanted probability (type 7)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if bounded is None:
        bounded = fits_block(df, idx)
    if bounded:
        return df.groupBy(*keys).agg(*[F.percentile(value, float(p)).alias(n) for n, p in probs.items()])

    names, wanted = list(probs), [float(p) for p in probs.values()]
    slack = 2.0 / accuracy
    edges = []
    for p in wanted:
        edges += [max(0.0, p - slack), min(1.0, p + slack)]
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", edges, accuracy).alias("_edges"),
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    # two spare ranks on either side keep short groups inside the bracket
    spare = F.col("_n") * F.lit(slack) < 4
    brackets = F.array(
        *[
            F.struct(
                F.lit(i).alias("q"),
                F.when(spare | F.lit(p - slack <= 0), F.col("_min")).otherwise(F.col("_edges")[2 * i]).alias("lo"),
                F.when(spare | F.lit(p + slack >= 1), F.col("_max")).otherwise(F.col("_edges")[2 * i + 1]).alias("hi"),
                (F.lit(p) * (F.col("_n") - 1)).alias("pos"),
            )
            for i, p in enumerate(wanted)
        ]
    )
    sketch = sketch.select(*keys, brackets.alias("_br"))
    tally = attach(rows, sketch, keys, salt="_v").withColumn("_b", F.explode("_br")).filter(F.col("_v") <= F.col("_b.hi"))
    # below the bracket every value folds into one count; inside it each value is kept
    tally = tally.groupBy(
        *keys, F.col("_b").alias("_b"), F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v")).alias("_v")
    ).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*keys, "_b").orderBy(F.col("_v").asc_nulls_first())
    ranked = tally.withColumn("_hi_rank", F.sum("_c").over(upto) - 1).withColumn(
        "_lo_rank", F.col("_hi_rank") - F.col("_c") + 1
    )
    floor, ceil = F.floor("_b.pos"), F.ceil("_b.pos")
    hit = lambda rank: F.max(F.when((F.col("_lo_rank") <= rank) & (rank <= F.col("_hi_rank")), F.col("_v")))
    picked = ranked.groupBy(*keys, "_b").agg(hit(floor).alias("_a"), hit(ceil).alias("_z"))
    frac = F.col("_b.pos") - F.floor("_b.pos")
    picked = picked.select(*keys, F.col("_b.q").alias("_q"), (F.col("_a") + (F.col("_z") - F.col("_a")) * frac).alias("_val"))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_q") == i, F.col("_val"))).alias(n) for i, n in enumerate(names)]
    )
