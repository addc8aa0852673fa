"""Small helpers for kernels that exchange pandas frames with Spark."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame

WAVES = 4  # partitions of cells a core, so that uneven cells even out


def _count(df: DataFrame) -> int:
    """Partitions for cells: their input is some KB and their work is seconds, so the sizes by which adaptive execution
    merges shuffle partitions would put all of them in one task; a number that is asked for stays."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), WAVES * spark.sparkContext.defaultParallelism)


def by_cell(df: DataFrame, *keys: str, cells: int = 0):
    """Rows grouped for a kernel, the cells of ``keys`` spread over all cores, or over ``cells`` tasks if these are more."""
    return df.repartition(max(_count(df), cells), *keys).groupBy(*keys)


def cells(left: DataFrame, left_keys: Sequence[str], right: DataFrame, right_keys: Sequence[str]):
    """Both sides grouped for a cogrouped kernel, the cells spread over all cores."""
    return by_cell(left, *left_keys).cogroup(by_cell(right, *right_keys))


def empty_frame(text: list[str] = (), ints: list[str] = (), floats: list[str] = ()) -> pd.DataFrame:
    """Frame without rows whose columns have the right types for Arrow."""
    cols = {n: pd.Series(dtype=object) for n in text}
    cols |= {n: pd.Series(dtype="int64") for n in ints}
    cols |= {n: pd.Series(dtype="float64") for n in floats}
    return pd.DataFrame(cols)
