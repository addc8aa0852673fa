"""Column names that a table does not have yet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, stem: str) -> str:
    """``stem`` with as many underscores in front as it takes to clash with no column, in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem
