"""Structured Streaming: binned tails, episodes, rules, alert collapse and watches.

Streams have ``signal_id, ts, value`` with ``ts`` as TIMESTAMP (event-time watermarks
need it). Batch twins use the same columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from signalmill.functions.normal import normal_quantile
from signalmill.functions.ordered import attach, ordinal
from signalmill.functions.timeparts import DAY, as_us, floor_div, from_us, to_us
from signalmill.operators import multivariate, similarity
from signalmill.operators.grid import search_space
from signalmill.operators.joins import join_dim

# Smallest history of a discord watch, as multiple and floor.
DISCORD_HISTORY = (4, 200)
SAFETY_BINS = 4


def stream_bins(sdf: DataFrame, bin_width: str, watermark: str, agg: str = "avg") -> DataFrame:
    """Tumbling aggregate per signal; a bin is final once the watermark passes it."""
    how = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}[agg]
    rows = sdf.withWatermark("ts", watermark) if sdf.isStreaming else sdf
    out = rows.groupBy("signal_id", F.window("ts", bin_width).alias("w")).agg(how("value").alias("value"), F.count(F.lit(1)).alias("count"))
    return out.select("signal_id", F.col("w.start").alias("ts"), "value", "count")


def live_tail(sdf: DataFrame, width: str, step: str, watermark: str) -> DataFrame:
    """Latest statistics over the last ``width``, refreshed every ``step``."""
    rows = sdf.withWatermark("ts", watermark) if sdf.isStreaming else sdf
    out = rows.groupBy("signal_id", F.window("ts", width, step).alias("w")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("avg"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.max_by("value", "ts").alias("last"),
    )
    return out.select("signal_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "count", "avg", "min", "max", "last")


def sessions(sdf: DataFrame, gap: str, watermark: str) -> DataFrame:
    """Stretches of readings without a pause longer than ``gap``."""
    rows = sdf.withWatermark("ts", watermark) if sdf.isStreaming else sdf
    out = rows.groupBy("signal_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("count"))
    return out.select("signal_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "count")


EPISODE = "signal_id string, seg_id long, state string, start_ts timestamp, end_ts timestamp, bins long"


def _timed(rows: DataFrame, idle: timedelta | None, delay: timedelta) -> tuple[DataFrame, str, int | None]:
    """The stream with its watermark, the kind of timeout, and the idle time in milliseconds."""
    if idle is None:
        return rows, "NoTimeout", None
    return rows.withWatermark("ts", f"{int(delay.total_seconds() * 1000)} milliseconds"), "EventTimeTimeout", int(idle.total_seconds() * 1000)


def _expire(state, last_us: int, idle_ms: int | None) -> None:
    """Let the key go ``idle_ms`` after its last row, once the watermark passes that time."""
    if idle_ms is not None:
        state.setTimeoutTimestamp(max(last_us // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))


def stream_episodes(
    bins: DataFrame, thresholds: Sequence[float], labels: Sequence[str], idle: timedelta | None = None, delay: timedelta = timedelta(0)
) -> DataFrame:
    """Closed state episodes of a stream of final bins (see ``stream_bins``).

    One row per bin reaches the state, so even a busy signal is a short input. An episode is
    emitted when the next state begins. Bins of one micro-batch may come in any order; a bin
    older than the last one seen of its signal is left to ``split_late_stream``. With ``idle`` the
    last episode of a signal without bins for so long, by the watermark (``delay`` behind the
    newest time), is emitted as well and its state is dropped.
    """
    if len(labels) != len(thresholds) + 1:
        raise ValueError("give one more label than thresholds")
    cuts, names = list(thresholds), list(labels)
    rows, timeout, idle_ms = _timed(bins.select("signal_id", "ts", "value"), idle, delay)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seg, label, first, last, bins_seen = state.get
            state.remove()
            yield pd.DataFrame([(key[0], seg, label, pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us"), bins_seen)], columns=["signal_id", "seg_id", "state", "start_ts", "end_ts", "bins"])
            return
        rows = pd.concat(list(batches)).dropna(subset=["value"]).sort_values("ts")
        seg, label, first, last, bins_seen = state.get if state.exists else (0, None, None, None, 0)
        closed = []
        for at, value in zip(rows["ts"], rows["value"]):
            if last is not None and at.value // 1000 < last:
                continue
            now = names[sum(value >= c for c in cuts)]
            if label is not None and now != label:
                closed.append((key[0], seg, label, pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us"), bins_seen))
                seg, first, bins_seen = seg + 1, None, 0
            label, last = now, at.value // 1000
            first, bins_seen = last if first is None else first, bins_seen + 1
        if label is not None:
            state.update((seg, label, first, last, bins_seen))
            _expire(state, last, idle_ms)
        yield pd.DataFrame(closed, columns=["signal_id", "seg_id", "state", "start_ts", "end_ts", "bins"])

    return rows.groupBy("signal_id").applyInPandasWithState(
        step, EPISODE, "seg long, label string, first long, last long, bins long", "append", timeout
    )


# ---------------------------------------------------------------- rules and alerts

CONDITIONS = ("threshold_above", "threshold_below", "deviation_band", "rate_of_change")


def evaluate_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Readings or bins that meet a rule of their signal (stream or batch).

    ``rules``: ``rule_id, signal_id, condition_type, threshold, confidence,
    rate_per_minute, severity``. ``deviation_band`` reads ``baseline`` and ``sigma``
    columns, ``rate_of_change`` a ``rate_per_minute_now`` column, where present. A
    confidence is a fraction or, above 1, in percent; without one nothing fires.
    """
    have = set(rows.columns)
    named = rules.withColumnRenamed("rate_per_minute", "_limit")
    hit = rows.join(named, "signal_id") if rows.isStreaming else join_dim(rows, named)
    kind, v = F.col("condition_type"), F.col("value")
    fired = F.when(kind == "threshold_above", v > F.col("threshold")).when(kind == "threshold_below", v < F.col("threshold"))
    if {"baseline", "sigma"} <= have:
        share = F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
        z = normal_quantile(0.5 + share / 2)
        fired = fired.when(kind == "deviation_band", F.abs(v - F.col("baseline")) > z * F.col("sigma"))
    if "rate_per_minute_now" in have:
        fired = fired.when(kind == "rate_of_change", F.abs("rate_per_minute_now") > F.col("_limit"))
    out = hit.filter(F.coalesce(fired, F.lit(False)))
    return out.select(
        "rule_id", "signal_id", "ts", "value", "condition_type", "severity",
        F.concat_ws(":", F.coalesce(F.col("rule_id").cast("string"), F.col("signal_id")), "severity").alias("dedup_key"),
    )


ALERT = "dedup_key string, opened_at timestamp, last_at timestamp, occurrence_count long, status string, last_value double"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Firings of one input partition folded per key and minute."""
    for part in batches:
        if part.empty:
            continue
        part = part.assign(minute=part["ts"].dt.floor("min")).sort_values("ts")
        folded = part.groupby(["dedup_key", "minute"], sort=False).agg(
            first_ts=("ts", "min"), last_ts=("ts", "max"), n=("ts", "size"), value=("value", "last")
        )
        yield folded.reset_index()[["dedup_key", "first_ts", "last_ts", "n", "value"]]


def collapse_alerts(fired: DataFrame, quiet: timedelta, delay: timedelta | None = None) -> DataFrame:
    """One alert per dedup key: firings count into the open one until ``quiet`` time passes.

    Update-mode stream of ``dedup_key, ts, value``. Firings are folded per key and minute
    where they are read, so a storm on one key reaches its state as a few rows. A late firing
    counts into the open alert if it lies within ``quiet`` of it and may move its opening back;
    one before that is left to ``split_late_stream``. With ``delay`` an alert whose quiet time the
    watermark (``delay`` behind the newest time) has passed is closed and its state is dropped.
    """
    gap = int(quiet.total_seconds() * 1_000_000)
    if gap < 60_000_000:
        raise ValueError("quiet time is at least a minute")
    rows = fired.select("dedup_key", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    rows = rows.mapInPandas(_fold, "dedup_key string, first_ts timestamp, last_ts timestamp, n long, value double")
    timed, timeout, idle_ms = _timed(rows.withColumnRenamed("first_ts", "ts"), None if delay is None else quiet, delay or timedelta(0))
    rows = timed.withColumnRenamed("ts", "first_ts")

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            opened, last, count, value = state.get
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(opened, unit="us"), pd.Timestamp(last, unit="us"), count, "CLOSED", value)], columns=["dedup_key", "opened_at", "last_at", "occurrence_count", "status", "last_value"])
            return
        part = pd.concat(list(batches)).sort_values("first_ts")
        opened, last, count, value = state.get if state.exists else (None, None, 0, None)
        out = []
        at = lambda us: pd.Timestamp(us, unit="us")
        for first, end, n, v in zip(part["first_ts"], part["last_ts"], part["n"], part["value"]):
            first_us, end_us = first.value // 1000, end.value // 1000
            if last is not None and first_us - last > gap:
                out.append((key[0], at(opened), at(last), count, "CLOSED", value))
                opened, count = None, 0
            if opened is not None and end_us < opened - gap:
                continue
            opened = first_us if opened is None else min(opened, first_us)
            if last is None or end_us >= last:
                last, value = end_us, float(v)
            count += int(n)
        state.update((opened, last, count, value))
        _expire(state, last, idle_ms)
        out.append((key[0], at(opened), at(last), count, "OPEN", value))
        yield pd.DataFrame(out, columns=["dedup_key", "opened_at", "last_at", "occurrence_count", "status", "last_value"])

    return rows.groupBy("dedup_key").applyInPandasWithState(
        step, ALERT, "opened long, last long, count long, value double", "update", timeout
    )


def collapse_alerts_batch(fired: DataFrame, quiet: timedelta) -> DataFrame:
    """The same alerts from a table of firings: a pause longer than ``quiet`` starts a new one."""
    gap = int(quiet.total_seconds() * 1_000_000)
    us = to_us(F.col("ts").cast("timestamp_ntz"))
    rows = fired.select("dedup_key", "ts", "value").withColumn("_us", us).withColumn("_day", floor_div(F.col("_us"), DAY))
    by_slot = Window.partitionBy("dedup_key", "_day").orderBy("_us")
    before = Window.partitionBy("dedup_key").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    # the last firing before each slot, so that slots can be read apart
    edges = rows.groupBy("dedup_key", "_day").agg(F.max("_us").alias("_end"))
    edges = edges.select("dedup_key", "_day", F.max("_end").over(before).alias("_prior"))
    rows = rows.join(edges, ["dedup_key", "_day"])
    last = F.coalesce(F.lag("_us").over(by_slot), F.col("_prior"))
    rows = rows.withColumn("_new", F.when(last.isNull() | (F.col("_us") - last > gap), 1).otherwise(0))
    starts = rows.groupBy("dedup_key", "_day").agg(F.sum("_new").alias("_n"))
    starts = starts.select("dedup_key", "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    running = F.sum("_new").over(by_slot.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(starts, ["dedup_key", "_day"]).withColumn("alert", running + F.col("_base"))
    out = rows.groupBy("dedup_key", "alert").agg(
        F.min("ts").alias("opened_at"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("occurrence_count"),
        F.max_by("value", "_us").alias("last_value"),
    )
    newest = F.max("alert").over(Window.partitionBy("dedup_key"))
    return out.withColumn("status", F.when(F.col("alert") == newest, "OPEN").otherwise("CLOSED")).drop("alert")


LIFECYCLE = (
    "dedup_key string, alert int, status string, opened_at timestamp_ntz, last_at timestamp_ntz, occurrence_count long, last_value double, "
    "assignee string, suppressed_until timestamp_ntz, closed_at timestamp_ntz, audit array<struct<action:string,at:timestamp_ntz,by:string,note:string>>"
)
ACTIONS = ("ACK", "ASSIGN", "SUPPRESS", "CLOSE", "REOPEN")


def alert_lifecycle(fired: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts of ``fired`` (dedup_key, ts, value) under the operators' ``actions``.

    ``actions``: dedup_key, ts, action (see ``ACTIONS``), and where they apply assignee, until, by,
    note. A firing counts into the key's open or acknowledged alert, or into a suppressed one
    until its suppression ends; else it opens a new alert. An action applies to the key's newest
    alert and comes before a firing of the same time; without an alert it does nothing. The audit
    trail starts with OPENED. Firings are summed between a key's actions first, so however many a
    key has, only as many rows as it has actions are folded in order.
    """
    have = set(actions.columns)
    col = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
    acts = actions.select("dedup_key", F.col("ts").cast("timestamp_ntz").alias("ts"), "action", col("assignee", "string"), col("until", "timestamp_ntz"), col("by", "string"), col("note", "string"))
    acts = acts.filter(F.col("action").isin(*ACTIONS))
    edges = acts.select("dedup_key", F.explode(F.array("ts", F.when(F.col("action") == "SUPPRESS", F.col("until")))).alias("at")).filter("at is not null")
    edges = edges.groupBy("dedup_key").agg(F.array_sort(F.collect_set("at")).alias("_edges"))
    rows = fired.select("dedup_key", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").cast("double").alias("value"))
    rows = attach(rows, edges, "dedup_key", "left", salt="ts").withColumn("_part", F.coalesce(F.size(F.filter("_edges", lambda e: e <= F.col("ts"))), F.lit(0)))
    sums = rows.groupBy("dedup_key", "_part").agg(F.min("ts").alias("ts"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("n"), F.max_by("value", F.struct("ts", "value")).alias("value"))
    both = sums.select("dedup_key", "ts", F.lit(1).alias("kind"), "last_at", "n", "value", *[F.lit(None).cast(k).alias(c) for c, k in (("action", "string"), ("assignee", "string"), ("until", "timestamp_ntz"), ("by", "string"), ("note", "string"))])
    done = acts.select("dedup_key", "ts", F.lit(0).alias("kind"), *[F.lit(None).cast(k).alias(c) for c, k in (("last_at", "timestamp_ntz"), ("n", "long"), ("value", "double"))], "action", "assignee", "until", "by", "note")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        plain = lambda v: None if pd.isna(v) else v
        alerts: list[dict] = []
        for row in pdf.sort_values(["ts", "kind", "action"], kind="stable").itertuples():
            now = alerts[-1] if alerts else None
            if row.kind:
                muted = now and now["status"] == "SUPPRESSED" and now["suppressed_until"] is not None and now["suppressed_until"] > row.ts
                if not now or now["status"] not in ("OPEN", "ACK") and not muted:
                    opened = {"action": "OPENED", "at": row.ts, "by": None, "note": None}
                    now = {"dedup_key": row.dedup_key, "alert": len(alerts) + 1, "status": "OPEN", "opened_at": row.ts, "occurrence_count": 0, "assignee": None, "suppressed_until": None, "closed_at": None, "audit": [opened]}
                    alerts.append(now)
                now |= {"last_at": row.last_at, "last_value": row.value, "occurrence_count": now["occurrence_count"] + int(row.n)}
            elif now:
                change = {
                    "ACK": {"status": "ACK"}, "ASSIGN": {"assignee": plain(row.assignee)}, "SUPPRESS": {"status": "SUPPRESSED", "suppressed_until": plain(row.until)},
                    "CLOSE": {"status": "CLOSED", "closed_at": row.ts}, "REOPEN": {"status": "OPEN", "suppressed_until": None, "closed_at": None},
                }
                now |= change[row.action]
                now["audit"].append({"action": row.action, "at": row.ts, "by": plain(row.by), "note": plain(row.note)})
        names = [f.split()[0] for f in LIFECYCLE.split(", ")]
        out = pd.DataFrame(alerts, columns=names)
        for name in ("suppressed_until", "closed_at"):
            out[name] = pd.to_datetime(out[name])
        return out

    return both.unionByName(done).groupBy("dedup_key").applyInPandas(fold, LIFECYCLE)


def active_alerts(alerts: DataFrame, now: datetime) -> DataFrame:
    """Alerts in the queue: not closed, and not within a suppression."""
    until = F.col("suppressed_until") if "suppressed_until" in alerts.columns else F.lit(None).cast("timestamp_ntz")
    muted = (F.col("status") == "SUPPRESSED") & (until > F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz"))
    return alerts.filter((F.col("status") != "CLOSED") & ~F.coalesce(muted, F.lit(False)))


# ---------------------------------------------------------------- scheduled watches


def lookback_us(frequency_us: int, query_bins: int, bin_us: int) -> int:
    """Tail a run must read so that no match between two runs is lost."""
    return frequency_us + (max(1, query_bins) - 1) * bin_us


def watch_similarity(
    readings: DataFrame, query: Sequence[float], now: datetime, frequency_us: int, bin_us: int, min_similarity: float = 0.0, **params
) -> DataFrame:
    """One run of a pattern watch over the tail of a readings table."""
    start = now - timedelta(microseconds=lookback_us(frequency_us, len(query), bin_us))
    hits = similarity.similarity_1d(query, search_space(readings, start, now, bin_us), **params)
    at = lambda i: from_us(i * bin_us + as_us(start))
    hits = hits.filter(F.col("similarity") >= min_similarity)
    return hits.withColumn("match_start", at(F.col("start_index"))).withColumn("match_end", at(F.col("end_index") + 1)).drop("paa")


def watch_multidim(
    readings: DataFrame, queries: dict[str, Sequence[float]], now: datetime, frequency_us: int, bin_us: int, min_similarity: float = 0.0, **params
) -> DataFrame:
    """One run of a multi-signal pattern watch (``entity_id, track_id, ts, value``)."""
    longest = max(len(q) for q in queries.values())
    start = now - timedelta(microseconds=lookback_us(frequency_us, longest, bin_us))
    tracks = search_space(readings, start, now, bin_us, by=similarity.TRACK)
    hits = similarity.similarity_multidim(queries, tracks, **params).filter(F.col("exact_score") >= min_similarity)
    at = lambda i: from_us(i * bin_us + as_us(start))
    return hits.withColumn("match_start", at(F.col("start_index"))).withColumn("match_end", at(F.col("end_index") + 1))


def history_bins(detector: str, detection: int, season: int = 0, contrast: int = 8, baseline_windows: int = 8) -> int:
    """Bins a scheduled detector run has to read."""
    if detector == "spectral_aggregation":
        return detection * (baseline_windows + 1) + SAFETY_BINS
    if detector == "change_point":
        return detection + max(16, 2 * contrast + 8) + SAFETY_BINS
    return detection + max(16, 2 * season if season > 0 else 16) + SAFETY_BINS


def watch_mvad(
    readings: DataFrame,
    detector: str,
    now: datetime,
    frequency_us: int,
    bin_us: int,
    detection: int,
    min_coverage: float = 0.95,
    max_gap: int = 3,
    min_severity: float = 0.0,
    **params,
) -> DataFrame:
    """One run of a multivariate watch; emits only events of the newest slice."""
    shape = {"contrast": params.get("contrast", 8), "season": params.get("season", 0), "baseline_windows": params.get("baseline_windows", 8)}
    bins = history_bins(detector, detection, **shape)
    end_us = as_us(now) // bin_us * bin_us
    end = datetime(1970, 1, 1) + timedelta(microseconds=end_us)
    start = end - timedelta(microseconds=bins * bin_us)
    prep = multivariate.prepare(readings.filter(F.col("ts") >= F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz")), start, end, bin_us, min_coverage, max_gap)
    found = multivariate.DETECTORS[detector](prep, detection * bin_us, emit_all=False, **params)
    fresh = to_us("event_time") > end_us - (frequency_us + bin_us)
    return found.filter((F.col("status") == "ok") & F.col("is_anomaly") & fresh & (F.col("severity") >= min_severity))


def watch_discords(
    readings: DataFrame, now: datetime, frequency_us: int, bin_us: int, detection: int, min_distance: float, window: int, **params
) -> DataFrame:
    """One run of a discord watch: recent windows unlike anything in enough earlier history."""
    bins = detection + max(DISCORD_HISTORY[0] * detection, DISCORD_HISTORY[1])
    start = now - timedelta(microseconds=bins * bin_us)
    found = similarity.sax_discords(search_space(readings, start, now, bin_us), window, detection_bins=detection, **params)
    at = lambda i: from_us(i * bin_us + as_us(start))
    found = found.filter((F.col("nn_distance") >= min_distance) & (to_us(at(F.col("end_index"))) > as_us(now) - (frequency_us + bin_us)))
    return found.withColumn("match_end", at(F.col("end_index") + 1))


def run_watch(
    trigger: DataFrame, run: Callable[[datetime], DataFrame], sink: Callable[[DataFrame, int], None], every: str | None = None, **options
):
    """Streaming query that runs a watch on every micro-batch, at the newest event time seen.

    The batch re-reads the look-back from the readings table, so late rows that have
    reached the table by then are counted.
    """

    def on_batch(batch: DataFrame, epoch: int) -> None:
        newest = batch.agg(F.max("ts").cast("timestamp_ntz").cast("string").alias("t")).first()["t"]
        if newest is not None:
            sink(run(datetime.fromisoformat(newest)), epoch)

    writer = trigger.writeStream.foreachBatch(on_batch).options(**options)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


def split_late(batch: DataFrame, newest: Column, delay: timedelta) -> tuple[DataFrame, DataFrame]:
    """Rows inside the allowed delay behind ``newest``, and the late rest for a side table."""
    limit = int(delay.total_seconds() * 1_000_000)
    us = to_us(F.col("ts").cast("timestamp_ntz"))
    late = us < to_us(newest.cast("timestamp_ntz")) - limit
    return batch.filter(~late), batch.filter(late)


def split_late_stream(sdf: DataFrame, delay: timedelta, folder: str, fresh: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None], **options):
    """Streaming query that hands each micro-batch's rows on, and the late ones to a side table.

    A row is late if it lies more than ``delay`` behind the newest time of the batches before: the
    watermark that stateful steps drop it by. The newest time of each batch is kept in ``folder``,
    which executors and driver share, so a restarted query splits as before.
    """
    limit = int(delay.total_seconds() * 1_000_000)
    spark = sdf.sparkSession
    schema = "epoch long, newest long"

    def on_batch(batch: DataFrame, epoch: int) -> None:
        batch = batch.withColumn("_us", to_us(F.col("ts").cast("timestamp_ntz")))
        spark.createDataFrame([], schema).write.mode("append").parquet(folder)
        seen = spark.read.schema(schema).parquet(folder).filter(F.col("epoch") < epoch).agg(F.max("newest").alias("m")).first()["m"]
        batch.agg(F.max("_us").alias("newest")).select(F.lit(epoch).cast("long").alias("epoch"), "newest").write.mode("append").parquet(folder)
        old = F.lit(False) if seen is None else F.coalesce(F.col("_us") < seen - limit, F.lit(False))
        fresh(batch.filter(~old).drop("_us"), epoch)
        late(batch.filter(old).drop("_us"), epoch)

    return sdf.writeStream.foreachBatch(on_batch).options(**options).trigger(availableNow=True).start()


def progress_rows(df: DataFrame, job_id: str, stage: str, done: int, steps: int, best: Column | None = None) -> DataFrame:
    """One progress row of a job stage, aggregated from its output table."""
    best = F.lit(None).cast("double") if best is None else best
    facts = df.agg(F.count(F.lit(1)).alias("rows"), F.min(best).alias("best"))
    return facts.select(
        F.lit(job_id).alias("job_id"), F.lit(stage).alias("stage"), F.lit(100.0 * done / steps).alias("pct"), "rows", "best"
    )
