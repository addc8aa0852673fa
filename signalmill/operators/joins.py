"""Joins of readings with dimensions, events, other signals and shifted copies."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from signalmill.functions.ordered import attach, with_row
from signalmill.functions.timeparts import floor_div, ntz, to_us

PARTS = 4  # slots to the width of a length class
TILE = 256  # points that meet an interval together
DEAL = 1 << 14  # points and intervals to a task, as far as these are more than the shuffle partitions


def join_dim(df: DataFrame, dim: DataFrame, on: str = "signal_id", how: str = "inner") -> DataFrame:
    """Readings with their dimension row; a hot signal spreads over salted copies of it."""
    return attach(df, dim, on, how, salt="ts")


def lag_join(target: DataFrame, candidate: DataFrame, lags: Sequence[int]) -> DataFrame:
    """Target bins next to the candidate value ``lag`` bins earlier."""
    moved = candidate.select(
        F.col("signal_id").alias("candidate_id"),
        F.col("bin_idx").alias("_at"),
        F.col("value").alias("candidate_value"),
    )
    moved = moved.withColumn("lag", F.explode(F.array(*[F.lit(int(l)) for l in lags])))
    moved = moved.withColumn("bin_idx", F.col("_at") + F.col("lag")).drop("_at")
    return target.join(moved, "bin_idx")


def align_bins(grid: DataFrame, target: str, candidates: Sequence[str]) -> DataFrame:
    """Target value next to each candidate's value on the shared bins."""
    value = lambda sid: F.max(F.when(F.col("signal_id") == sid, F.col("value")))
    rows = grid.filter(F.col("signal_id").isin([target, *candidates])).groupBy("bin_idx", "ts")
    wide = rows.agg(value(target).alias("target"), *[value(c).alias(c) for c in candidates])
    return wide.filter(F.col("target").isNotNull())


def map_tracks(space: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rename search tracks to the query track they answer (``search_track -> query_track``)."""
    named = mapping.select(F.col("search_track").alias("track_id"), F.col("query_track").alias("_to"))
    return attach(space, named, "track_id").withColumn("track_id", F.col("_to")).drop("_to")


def escape_segment(col: Column | str) -> Column:
    """Percent-escape ``%`` and ``/`` in one path segment."""
    col = F.col(col) if isinstance(col, str) else col
    return F.replace(F.replace(col, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))


def scope_keys(catalog: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Every scope a signal belongs to: itself and each hierarchy path above it."""
    keys = [F.struct(F.lit("TagId").alias("scope_type"), F.col("signal_id").alias("scope_id"))]
    for i, level in enumerate(levels, start=1):
        path = F.concat_ws("/", *[escape_segment(l) for l in levels[:i]])
        whole = F.lit(True)
        for l in levels[:i]:
            whole = whole & F.col(l).isNotNull()
        keys.append(F.struct(F.lit(f"Level{i}").alias("scope_type"), F.when(whole, path).alias("scope_id")))
    rows = catalog.select("signal_id", F.explode(F.array(*keys)).alias("k")).select("signal_id", "k.*")
    return rows.filter(F.col("scope_id").isNotNull())


def resolve_scope(events: DataFrame, catalog: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Each event with every signal its scope covers."""
    return events.join(scope_keys(catalog, levels), ["scope_type", "scope_id"])


def scope_totals(events: DataFrame, catalog: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Per signal the number of events whose scope covers it and their smallest and largest ``event_id``.

    Events are added up by scope before scopes meet signals, so no event is repeated for every signal.
    """
    scopes = events.groupBy("scope_type", "scope_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))
    hits = resolve_scope(scopes, catalog, levels)
    return hits.groupBy("signal_id").agg(F.sum("n").alias("n"), F.min("first_event").alias("first_event"), F.max("last_event").alias("last_event"))


def events_overlapping(
    events: DataFrame, start: datetime, end: datetime, scopes: DataFrame | None = None
) -> DataFrame:
    """Events and annotations whose interval meets the window, limited to some scopes."""
    out = events.filter((F.col("start_ts") <= ntz(end)) & (F.coalesce("end_ts", "start_ts") >= ntz(start)))
    if scopes is not None:
        out = out.join(scopes.select("scope_type", "scope_id").distinct(), ["scope_type", "scope_id"], "left_semi")
    return out


def with_class(df: DataFrame, lo: Column, hi: Column, unit: int) -> DataFrame:
    """``_lo``, ``_hi`` (microseconds) and ``_cls``: the interval is at most ``unit * 2^_cls`` long, so it lies in two slots of that width."""
    df = df.withColumn("_lo", lo).withColumn("_hi", hi)
    return df.withColumn("_cls", F.ceil(F.log2(F.greatest((F.col("_hi") - F.col("_lo")) / unit, F.lit(1.0)))).cast("int"))


def class_width(unit: int, parts: int = 1) -> Column:
    return F.expr(f"greatest(shiftleft({unit}L, _cls) div {parts}, 1L)")


def in_slots(df: DataFrame, unit: int, parts: int = 1) -> DataFrame:
    """A row for each slot of its own class's width that an interval meets: one or two; of a part of that width, as many more."""
    width = class_width(unit, parts)
    return df.withColumn("_slot", F.explode(F.sequence(floor_div(F.col("_lo"), width), floor_div(F.col("_hi"), width))))


def at_classes(df: DataFrame, intervals: DataFrame) -> DataFrame:
    """``df`` once for each class among ``intervals`` (fewer than 64)."""
    rows = with_row(df, intervals.agg(F.collect_set("_cls").alias("_classes")))
    return rows.withColumn("_cls", F.explode("_classes")).drop("_classes")


def meeting(points: DataFrame, intervals: DataFrame, on: Sequence[str], unit: int, order: Sequence[str] = ("_at",)) -> DataFrame:
    """Points (``_at``) beside the intervals (``with_class``) in whose slots they lie, as far as their tile does.

    An interval lies in the few slots of a ``PARTS``-th of its class's width, so that little more meets than matches; a
    point looks into one slot of each class. Far more rows come out than go in, so the planner's measures of the
    input do not fit: neither side is broadcast, and slots are dealt over all shuffle partitions or more.

    The points of a slot meet an interval a tile at a time: rows come out as runs of one interval beside the same few points
    in the same ``order``, which a columnar file stores in a fraction of what pairs in any order take, as long
    as a task's ids fit its dictionaries.
    """
    keys = [*on, "_cls", "_slot"]
    rows = points.count() + intervals.count()
    n = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // DEAL))
    spans = in_slots(intervals.filter(F.col("_lo") <= F.col("_hi")), unit, PARTS)
    spots = at_classes(points, intervals).withColumn("_slot", floor_div(F.col("_at"), class_width(unit, PARTS))).repartition(n, *keys)
    within = Window.partitionBy(*keys).orderBy("_at")
    spots = spots.withColumn("_tile", floor_div(F.row_number().over(within) - 1, TILE))
    own = [c for c in points.columns if c not in on]
    listed = F.collect_list(F.struct(*order, *[c for c in own if c not in order]))
    if "map<" not in points.select(*own).schema.simpleString():  # maps have no order
        listed = F.sort_array(listed)
    tiles = spots.groupBy(*keys, "_tile").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), listed.alias("_spots"))
    pairs = tiles.hint("merge").join(spans.repartition(n, *keys), keys).filter((F.col("_first") <= F.col("_hi")) & (F.col("_last") >= F.col("_lo")))
    pairs = pairs.withColumn("_spot", F.explode("_spots"))
    return pairs.select(*keys, *[c for c in spans.columns if c not in keys], *[F.col("_spot")[c].alias(c) for c in own])


def interval_overlap(left: DataFrame, right: DataFrame, on: Sequence[str], slot_us: int) -> DataFrame:
    """Pairs of overlapping intervals (``start_ts, end_ts`` / ``r_start_ts, r_end_ts``).

    Of two that overlap, the later start lies within the other interval; equal starts count as the right one's.
    Length classes double from ``slot_us``: an interval lies in a few slots of its class, however long, and a
    start looks into one slot of each class. Busy keys spread over their slots. Starts that come out together are in order
    of their own columns, so a filter on these keeps runs of them.
    """
    a = with_class(left, to_us("start_ts"), to_us(F.coalesce("end_ts", "start_ts")), slot_us)
    b = with_class(right, to_us("r_start_ts"), to_us(F.coalesce("r_end_ts", "r_start_ts")), slot_us)

    def started(x: DataFrame, y: DataFrame) -> DataFrame:
        """Rows of ``y`` that start within ``x``."""
        starts = y.drop("_cls").withColumnsRenamed({"_lo": "_at", "_hi": "_end"})
        return meeting(starts, x, on, slot_us, [c for c in y.columns if c not in (*on, "_cls", "_lo", "_hi")]).filter((F.col("_at") <= F.col("_hi")) & (F.col("_lo") <= F.col("_end")))

    pairs = started(a, b).filter(F.col("_at") >= F.col("_lo")).unionByName(started(b, a).filter(F.col("_at") > F.col("_lo")))
    return pairs.drop("_slot", "_cls", "_lo", "_hi", "_at", "_end")


def markers_near(markers: DataFrame, times: DataFrame, threshold_us: int, slot_us: int | None = None) -> DataFrame:
    """Markers whose span, widened by the threshold, contains a given ``at_ts``.

    A marker lies in a few slots of its length class; a time looks into one slot of each class.
    """
    unit = slot_us or max(2 * threshold_us, 1_000_000)
    wide = with_class(markers, to_us("start_ts") - threshold_us, to_us(F.coalesce("end_ts", "start_ts")) + threshold_us, unit)
    pairs = meeting(times.withColumn("_at", to_us("at_ts")), wide, [], unit)
    return pairs.filter(F.col("_at").between(F.col("_lo"), F.col("_hi"))).drop("_slot", "_cls", "_lo", "_hi", "_at")


def missing_signals(ids: DataFrame, df: DataFrame) -> DataFrame:
    """Signals without any reading."""
    return ids.join(df.select("signal_id").distinct(), "signal_id", "left_anti")


def missing_bins(grid: DataFrame) -> DataFrame:
    """Grid points without a reading."""
    return grid.filter(F.col("value").isNull()).drop("value")


def union_all(*tables: DataFrame) -> DataFrame:
    """Rows of all tables, columns matched by name, absent ones NULL."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def top_k(df: DataFrame, k: int, order: Sequence[Column | str]) -> DataFrame:
    """The first ``k`` rows of the whole table under a full ordering."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, k: int, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first ``k`` rows of each group, with their rank."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def contributors(df: DataFrame, k: int, by: Sequence[str], order: Sequence[Column], fields: Sequence[str]) -> DataFrame:
    """The ``k`` leading rows of each group as one ordered array of structs."""
    head = top_k_per_group(df, k, by, order)
    packed = head.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("contributors"))
    return packed


def distinct_ids(df: DataFrame) -> DataFrame:
    return df.select("signal_id").distinct()


def overlap(a: Column, b: Column) -> Column:
    """Common elements of two arrays."""
    return F.array_intersect(a, b)
