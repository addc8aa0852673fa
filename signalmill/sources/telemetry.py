"""Reading telemetry tables, in long or wide layout, and storing result tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from signalmill.functions.timeparts import as_us, floor_div, from_us, ntz, shift, to_us

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def finite(value: Column | str) -> Column:
    """The value, or NULL when it is NaN or infinite."""
    value = F.col(value) if isinstance(value, str) else value
    value = value.cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def canonicalize(df: DataFrame, signal: Column | str, ts: Column | str, value: Column | str) -> DataFrame:
    """Project any table to ``signal_id, ts, value``."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(
        col(signal).cast("string").alias("signal_id"),
        col(ts).cast("timestamp_ntz").alias("ts"),
        finite(value).alias("value"),
    )


def between(start: datetime | None, end: datetime | None, ts: str = "ts") -> Column:
    """Inclusive time range on the raw column, so that it reaches the scan."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(ts) >= ntz(start))
    if end is not None:
        cond = cond & (F.col(ts) <= ntz(end))
    return cond


def slice_signal(
    df: DataFrame, ids: Sequence[str] | None = None, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Readings of some signals (or all) in a window, in time order."""
    out = df.filter(between(start, end))
    if ids is not None:
        out = out.filter(F.col("signal_id").isin(list(ids)))
    return out.orderBy("signal_id", "ts")


def shift_tz(df: DataFrame, minutes: int, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Select rows by raw time, then move ``ts`` into the query time zone."""
    return df.filter(between(start, end)).withColumn("ts", shift("ts", minutes))


def unpivot_wide(
    df: DataFrame,
    prefix: str,
    ts: str,
    measures: Sequence[str],
    delim: str = ":",
    ids: Sequence[str] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    pre_agg: tuple[str, int] | None = None,
) -> DataFrame:
    """Wide table to long ``signal_id = prefix + delim + measure``.

    Ids are split on the first delimiter; prefix, time and measure selection all
    happen before the unpivot. ``pre_agg=(how, bin_us)`` aggregates avg/min/max/sum
    per bin (anchored at ``start``, else at the epoch) first, which gives the same
    binned result from fewer rows.
    """
    kept, prefixes = list(measures), None
    if ids is not None:
        split = [i.split(delim, 1) for i in ids if delim in i]
        prefixes = sorted({p for p, _ in split})
        kept = [m for m in measures if m in {m2 for _, m2 in split}]
    wide = df.filter(between(start, end, ts))
    if prefixes is not None:
        wide = wide.filter(F.col(prefix).isin(prefixes))
    wide = wide.select(F.col(prefix).alias("_prefix"), F.col(ts).alias("ts"), *[finite(m).alias(m) for m in kept])
    if pre_agg is not None:
        how, bin_us = pre_agg
        if how not in ("avg", "min", "max", "sum"):
            raise ValueError("pre-aggregation takes avg, min, max or sum")
        origin = 0 if start is None else as_us(start)
        binned = from_us(floor_div(to_us("ts") - origin, bin_us) * bin_us + origin)
        wide = wide.groupBy("_prefix", binned.alias("ts")).agg(*[getattr(F, how)(m).alias(m) for m in kept])
    long = wide.unpivot(["_prefix", "ts"], kept, "_measure", "value")
    long = long.select(F.concat("_prefix", F.lit(delim), "_measure").alias("signal_id"), "ts", "value")
    return long if ids is None else long.filter(F.col("signal_id").isin(list(ids)))


BIN_AGGS = {
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "count": F.count,
    "stdev": F.stddev_samp,
    "any": F.min,
}


def binned_window(
    df: DataFrame,
    bin_us: int,
    agg: str = "avg",
    ids: Sequence[str] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Epoch-aligned bins that hold readings, one aggregate per bin.

    ``any`` takes the smallest reading so that reruns agree.
    """
    rows = df.filter(between(start, end))
    if ids is not None:
        rows = rows.filter(F.col("signal_id").isin(list(ids)))
    keyed = rows.withColumn("bin_us", floor_div(to_us("ts"), bin_us) * bin_us)
    if agg == "median":
        from signalmill.functions.quantiles import quantiles

        out = quantiles(keyed, ["signal_id", "bin_us"], "value", {"value": 0.5})
    else:
        out = keyed.groupBy("signal_id", "bin_us").agg(BIN_AGGS[agg]("value").alias("value"))
    return out.select("signal_id", from_us("bin_us").alias("ts"), "value")


def read_dimension(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """External dimension (annotations, governed metadata) in any format the session has."""
    return spark.read.format(fmt).options(**options).load(path)


def write_results(tables: dict[str, DataFrame], path: str, job_id: str) -> None:
    """Append result tables under ``path/<table>``, partitioned by job."""
    for name, df in tables.items():
        tagged = df if "job_id" in df.columns else df.withColumn("job_id", F.lit(job_id))
        tagged.write.mode("append").partitionBy("job_id").parquet(f"{path}/{name}")


def read_result(
    table: DataFrame,
    job_id: str,
    start_idx: int | None = None,
    end_idx: int | None = None,
    idx: str = "idx",
    order: Sequence[Column | str] | None = None,
    limit: int | None = None,
    **equal,
) -> DataFrame:
    """One job's rows: an index range, a ranked head, or one overview level."""
    out = table.filter(F.col("job_id") == job_id)
    for name, val in equal.items():
        out = out.filter(F.col(name) == val)
    if start_idx is not None:
        out = out.filter(F.col(idx) >= start_idx)
    if end_idx is not None:
        out = out.filter(F.col(idx) <= end_idx)
    out = out.orderBy(*(order or [idx]))
    return out if limit is None else out.limit(limit)


def validate_source(
    df: DataFrame,
    kind: str = "narrow",
    signal: str = "signal_id",
    ts: str = "ts",
    value: str = "value",
    measures: Sequence[str] = (),
    delim: str = ":",
) -> DataFrame:
    """Check report: one row per check with ``ok`` and a message."""
    if kind not in ("narrow", "wide"):
        raise ValueError("kind is narrow or wide")
    types = {f.name: f.dataType for f in df.schema.fields}
    checks: list[tuple[str, bool, str]] = []
    required = [signal, ts] + ([value] if kind == "narrow" else [])
    for name in required:
        checks.append((f"column:{name}", name in types, "present" if name in types else "missing"))
    if ts in types:
        timed = isinstance(types[ts], (T.TimestampNTZType, T.TimestampType, T.DateType))
        checks.append((f"time:{ts}", timed, types[ts].simpleString()))
    numeric = [value] if kind == "narrow" else list(measures)
    for name in numeric:
        found = types.get(name)
        checks.append((f"numeric:{name}", isinstance(found, NUMERIC), found.simpleString() if found else "missing"))
    if kind == "wide":
        checks.append(("measures", len(measures) >= 2, f"{len(measures)} measures"))
        for name in measures:
            checks.append((f"delimiter:{name}", delim not in name, "delimiter in name" if delim in name else "clear"))
    report = df.sparkSession.createDataFrame(checks, "check string, ok boolean, message string")
    probe = [name for name in required if name in types]
    if probe:
        blank = df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in probe], F.count(F.lit(1)).alias("rows"))
        facts = blank.unpivot([], [*probe, "rows"], "check", "n").select(
            F.when(F.col("check") == "rows", F.lit("rows")).otherwise(F.concat(F.lit("nulls:"), "check")).alias("check"),
            F.when(F.col("check") == "rows", F.col("n") > 0).otherwise(F.col("n") == 0).alias("ok"),
            F.col("n").cast("string").alias("message"),
        )
        report = report.unionByName(facts)
    return report
