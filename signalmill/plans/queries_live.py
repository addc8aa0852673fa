"""Streams, rules, alerts and watches over the test tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from signalmill.functions.timeparts import DAY, HOUR, to_us
from signalmill.operators.catalog import best_row
from signalmill.operators.grid import rate_of_change
from signalmill.operators.spectral import decompose
from signalmill.functions.ordered import with_row, with_stats
from signalmill.plans.queries_core import EPISODES
from signalmill.plans.registry import query
from signalmill.plans.runtime import shared_folder
from signalmill.plans.samples import END, FILLED, START, hourly, rounded, signals, sql_round, tracks
from signalmill.streaming import live as L

NOW = datetime(2024, 1, 31)


def stream(t):
    """events as a file stream with a TIMESTAMP event time."""
    source = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")
    return source.select(F.col("event_type").alias("signal_id"), F.col("ts").cast("timestamp").alias("ts"), "value")


def drained(t, sdf, mode: str = "append"):
    """Run a stream over all available data into a table and read that."""
    base = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"

    def store(batch, epoch):
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{base}/out")

    run = sdf.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(store).start()
    run.awaitTermination()
    return t.spark.read.schema(sdf.schema.add("epoch", "long")).parquet(f"{base}/out")


def newest(out, *keys):
    """The last update of every key."""
    return best_row(out, keys, [F.col("epoch").desc()]).drop("epoch")


def ntz(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("l01_stream_bins", sql_round("SELECT event_type AS signal_id, date_trunc('day', ts)::TIMESTAMP AS ts, avg(value) AS value, count(*) AS count FROM events GROUP BY ALL", "value"))
def _(t):
    out = drained(t, L.stream_bins(stream(t), "1 day", "1 hour"), "update")
    return rounded(ntz(newest(out, "signal_id", "ts"), "ts"))


@query("l02_live_tail", sql_round("""SELECT event_type AS signal_id, date_trunc('day', ts)::TIMESTAMP - to_days(k.k::INT) AS start_ts, date_trunc('day', ts)::TIMESTAMP - to_days(k.k::INT) + INTERVAL 3 DAY AS end_ts, count(*) AS count, avg(value) AS avg, min(value) AS min, max(value) AS max, arg_max(value, ts) AS last
 FROM events CROSS JOIN range(3) k(k) GROUP BY ALL""", "avg"))
def _(t):
    out = drained(t, L.live_tail(stream(t), "3 days", "1 day", "1 hour"), "update")
    return rounded(ntz(newest(out, "signal_id", "start_ts"), "start_ts", "end_ts"))


@query("l03_stream_episodes", FILLED + EPISODES + " SELECT * FROM ep QUALIFY seg_id < max(seg_id) OVER (PARTITION BY signal_id)")
def _(t):
    bins = hourly(t).select("signal_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    base = f"{shared_folder(t.spark)}/bins-{uuid.uuid4().hex}"
    bins.write.parquet(base)
    live = t.spark.readStream.schema(bins.schema).parquet(base)
    out = drained(t, L.stream_episodes(live, [30.0, 80.0], ["low", "normal", "high"]))
    return ntz(out, "start_ts", "end_ts").drop("epoch")


@query("l03_sessions", """WITH g AS (SELECT event_type AS signal_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY signal_id ORDER BY ts) AS k FROM g) SELECT signal_id, min(ts) AS start_ts, max(ts) + INTERVAL 30 MINUTE AS end_ts, count(*) AS count FROM s GROUP BY signal_id, k""")
def _(t):
    return ntz(L.sessions(signals(t).withColumn("ts", F.col("ts").cast("timestamp")), "30 minutes", "1 hour"), "start_ts", "end_ts")


def rules(t):
    """Order priorities as rule kinds, one rule per order of the first event types."""
    kinds = F.element_at(F.array(*[F.lit(c) for c in L.CONDITIONS]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    names = F.element_at(F.array(*[F.lit(s) for s in ("click", "error", "purchase", "signup", "view")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return t.nation.select(
        F.col("n_name").alias("rule_id"), names.alias("signal_id"), kinds.alias("condition_type"),
        (F.when(kinds == "threshold_above", 150.0).otherwise(5.0)).alias("threshold"), F.lit(0.99).alias("confidence"),
        F.lit(2.0).alias("rate_per_minute"), F.when(F.col("n_regionkey") > 2, "critical").otherwise("warning").alias("severity"),
    )


RULES = """ru AS (SELECT n_name AS rule_id, ['click', 'error', 'purchase', 'signup', 'view'][n_nationkey % 5 + 1] AS signal_id, ['threshold_above', 'threshold_below', 'deviation_band', 'rate_of_change'][n_nationkey % 4 + 1] AS kind, CASE WHEN n_regionkey > 2 THEN 'critical' ELSE 'warning' END AS severity FROM nation)"""
FIRED = FILLED + f""", {RULES}, st AS (SELECT *, avg(value) OVER s AS baseline, stddev_pop(value) OVER s AS sigma, (value - lag(value) OVER o) / 60 AS rate FROM filled WINDOW s AS (PARTITION BY signal_id), o AS (PARTITION BY signal_id ORDER BY bin_idx)),
fi AS (SELECT rule_id, st.signal_id, ts, value, kind AS condition_type, severity, rule_id || ':' || severity AS dedup_key FROM st JOIN ru USING (signal_id)
 WHERE CASE kind WHEN 'threshold_above' THEN value > 150 WHEN 'threshold_below' THEN value < 5 WHEN 'deviation_band' THEN abs(value - baseline) > 2.5758293035489 * sigma ELSE abs(rate) > 2.0 END)"""


def fired(t):
    rows = with_stats(hourly(t), "signal_id", {"baseline": F.avg("value"), "sigma": F.stddev_pop("value")})
    rows = rate_of_change(rows).withColumn("rate_per_minute_now", F.col("rate") / 60)
    return L.evaluate_rules(rows, rules(t))


@query("l04_evaluate_rules", sql_round(FIRED + " SELECT * FROM fi", "value"))
def _(t):
    return rounded(fired(t))


ALERTS = FIRED + """, fa AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY dedup_key ORDER BY ts) <= 43200000000 THEN 0 ELSE 1 END AS n FROM fi),
fb AS (SELECT *, sum(n) OVER (PARTITION BY dedup_key ORDER BY ts) AS a FROM fa),
al AS (SELECT dedup_key, a, min(ts) AS opened_at, max(ts) AS last_at, count(*) AS occurrence_count, arg_max(value, ts) AS last_value, CASE WHEN a = max(a) OVER (PARTITION BY dedup_key) THEN 'OPEN' ELSE 'CLOSED' END AS status FROM fb GROUP BY dedup_key, a)"""


@query("l05_collapse_alerts", sql_round(ALERTS + " SELECT * EXCLUDE (a) FROM al", "last_value"))
def _(t):
    return rounded(L.collapse_alerts_batch(fired(t), timedelta(hours=12)))


@query("l05_collapse_stream", sql_round(ALERTS + " SELECT * EXCLUDE (a) FROM al", "last_value"))
def _(t):
    base = f"{shared_folder(t.spark)}/fired-{uuid.uuid4().hex}"
    fired(t).select("dedup_key", F.col("ts").cast("timestamp").alias("ts"), "value").write.parquet(base)
    live = t.spark.readStream.schema("dedup_key string, ts timestamp, value double").parquet(base)
    out = drained(t, L.collapse_alerts(live, timedelta(hours=12)), "update")
    return rounded(ntz(newest(out, "dedup_key", "opened_at"), "opened_at", "last_at"))


def actions(t):
    """Every alert of the test: acknowledged, assigned, suppressed for three days, later closed."""
    at = lambda day, hour=0: datetime(2024, 1, day, hour)
    what = [("ACK", at(5), None, None), ("ASSIGN", at(6), "shift-2", None), ("SUPPRESS", at(10), None, at(13)), ("CLOSE", at(20, 12), None, None), ("REOPEN", at(29), None, None)]
    keys = fired(t).select("dedup_key").distinct()
    return keys.withColumn("_a", F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.lit(str(x)).cast("timestamp_ntz").alias("ts"), F.lit(u).cast("string").alias("assignee"), F.lit(None if v is None else str(v)).cast("timestamp_ntz").alias("until")) for a, x, u, v in what]))).select("dedup_key", "_a.*")


LIFE = FIRED + """, o AS (SELECT *, min(ts) OVER (PARTITION BY dedup_key) AS first_ts FROM fi),
s0 AS (SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-20 12:00:00' THEN 3 WHEN first_ts < TIMESTAMP '2024-01-10' AND ts >= TIMESTAMP '2024-01-13' THEN 2 ELSE 1 END AS part FROM o),
s1 AS (SELECT *, bool_or(part = 3 AND ts < TIMESTAMP '2024-01-29') OVER k AS fresh, max(part) FILTER (part < 3) OVER k AS before FROM s0 WINDOW k AS (PARTITION BY dedup_key)),
sg AS (SELECT *, CASE WHEN part = 3 AND NOT fresh THEN coalesce(before, 3) ELSE part END AS seg FROM s1),
ag AS (SELECT dedup_key, seg, min(ts) AS opened_at, max(ts) AS last_at, count(*) AS occurrence_count, arg_max(value, (ts, value)) AS last_value, bool_or(first_ts < TIMESTAMP '2024-01-10') AS was FROM sg GROUP BY ALL),
nm AS (SELECT *, row_number() OVER w AS alert, lead(seg) OVER w AS later FROM ag WINDOW w AS (PARTITION BY dedup_key ORDER BY seg)),
li AS (SELECT dedup_key, alert::INT AS alert,
  CASE WHEN later IS NULL AND opened_at < TIMESTAMP '2024-01-29' THEN 'OPEN' WHEN seg = 3 THEN 'OPEN' WHEN seg = 2 OR NOT was OR later IS NULL OR later = 3 THEN 'CLOSED' ELSE 'SUPPRESSED' END AS status,
  opened_at, last_at, occurrence_count, last_value,
  CASE WHEN opened_at < TIMESTAMP '2024-01-06' THEN 'shift-2' END AS assignee,
  CASE WHEN seg = 1 AND was AND later IS NOT NULL THEN TIMESTAMP '2024-01-13' END AS suppressed_until,
  CASE WHEN later IS NOT NULL AND (seg = 2 OR NOT was OR later = 3) THEN TIMESTAMP '2024-01-20 12:00:00' END AS closed_at,
  1 + (opened_at < TIMESTAMP '2024-01-05')::INT + (opened_at < TIMESTAMP '2024-01-06')::INT + (seg = 1 AND was)::INT
   + ((later IS NULL OR later = 3) AND opened_at < TIMESTAMP '2024-01-20 12:00:00')::INT + (later IS NULL AND opened_at < TIMESTAMP '2024-01-29')::INT AS steps FROM nm)"""


def lifecycle(t):
    out = L.alert_lifecycle(fired(t), actions(t))
    return rounded(out.withColumn("steps", F.size("audit")).drop("audit"))


@query("l05_alert_lifecycle", sql_round(LIFE + " SELECT * FROM li", "last_value"))
def _(t):
    return lifecycle(t)


@query("l06_alert_queue", sql_round(LIFE + " SELECT * FROM li WHERE status <> 'CLOSED' AND NOT (status = 'SUPPRESSED' AND coalesce(suppressed_until > TIMESTAMP '2024-01-12', false))", "last_value"))
def _(t):
    return L.active_alerts(lifecycle(t), datetime(2024, 1, 12))


@query("l06_active_alerts", sql_round(ALERTS + " SELECT * EXCLUDE (a) FROM al WHERE status <> 'CLOSED'", "last_value"))
def _(t):
    return rounded(L.active_alerts(L.collapse_alerts_batch(fired(t), timedelta(hours=12)), NOW))


@query("l07_watch_similarity")
def _(t):
    from signalmill.plans.queries_patterns import pattern

    hits = L.watch_similarity(signals(t), pattern(hourly(t), "click", 0, 24), NOW, 5 * DAY, HOUR, 0.2, segments=4, k=5)
    return rounded(hits)


@query("l08_watch_multidim")
def _(t):
    from signalmill.plans.queries_patterns import track_grid, track_patterns

    queries = track_patterns(track_grid(t), "e0", ["click", "view"], 8)
    hits = L.watch_multidim(tracks(t), queries, NOW, 10 * DAY, 3 * HOUR, segments=4, per_track_k=10, max_delay=3)
    return rounded(hits.drop("track_matches"))


@query("l09_watch_mvad")
def _(t):
    out = L.watch_mvad(tracks(t), "residual_voting", NOW, DAY, 3 * HOUR, 8, 0.05, 200, feature_threshold=0.3, rms_threshold=0.2, extreme_threshold=0.8)
    return rounded(out.drop("contributors", "explain"))


@query("l10_watch_discords")
def _(t):
    return rounded(L.watch_discords(signals(t), NOW, 2 * DAY, HOUR, 48, 0.5, 24, candidates=60))


@query("l11_split_late", "SELECT 'late' AS part, count(*) AS n FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 3 DAY UNION ALL SELECT 'fresh', count(*) FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def _(t):
    rows = signals(t)
    tagged = with_row(rows, rows.agg(F.max("ts").alias("newest")))
    fresh, late = L.split_late(tagged, F.col("newest"), timedelta(days=3))
    count = lambda df, part: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return count(late, "late").unionByName(count(fresh, "fresh"))


@query("l12_progress_rows", sql_round("SELECT 'job-1' AS job_id, 'binning' AS stage, 50.0::DOUBLE AS pct, count(*) AS \"rows\", min(value) AS best FROM events", "best"))
def _(t):
    return rounded(L.progress_rows(signals(t), "job-1", "binning", 1, 2, F.col("value")))
