"""Per-key facts that come from a file meet the rows without going whole through the driver."""

from pyspark.sql import functions as F

from signalmill.functions.ordered import attach


def test_salted_facts_are_not_broadcast_by_their_file_size(spark, tmp_path):
    spark.range(300_000).select(F.col("id").alias("key"), (F.col("id") % 5).alias("fact")).write.parquet(f"{tmp_path}/facts")
    rows = spark.range(2_000_000).filter("id < 1000").select((F.col("id") * 400).alias("key"), F.col("id").alias("bin_idx"))
    out = attach(rows, spark.read.parquet(f"{tmp_path}/facts"), "key")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(i * 400, i, i * 400 % 5) for i in range(750)]


def test_null_and_repeated_keys(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1), (2, 2), (None, 3)], "key bigint, bin_idx bigint")
    facts = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "key bigint, fact string")
    assert sorted(map(tuple, attach(rows, facts, "key").collect())) == [(1, 0, "a"), (1, 0, "b"), (1, 1, "a"), (1, 1, "b")]
    left = attach(rows, facts, "key", "left").collect()
    assert sorted((r["bin_idx"], r["fact"] or "") for r in left) == [(0, "a"), (0, "b"), (1, "a"), (1, "b"), (2, ""), (3, "")]


def test_events_are_added_up_before_they_meet_signals(spark):
    """As every event with every signal of its scope, but no row of the plan stands for both."""
    from signalmill.operators import joins as J

    catalog = spark.createDataFrame([(f"s{i}", "r", f"n{i % 3}") for i in range(30)] + [("lone", None, None)], "signal_id string, level1 string, level2 string")
    scopes = [("Level1", "r"), ("Level2", "r/n1"), ("TagId", "s4"), ("TagId", None), ("Level1", "none")]
    events = spark.createDataFrame([(i, *scopes[i % 5]) for i in range(200)] + [(7, "Level1", "r"), (None, "Level1", "r")], "event_id bigint, scope_type string, scope_id string")
    hits = J.resolve_scope(events, catalog, ["level1", "level2"]).groupBy("signal_id")
    want = hits.agg(F.count("*"), F.min("event_id"), F.max("event_id")).collect()
    got = J.scope_totals(events, catalog, ["level1", "level2"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) == 30
    assert "count" in got._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0].split("Join Inner")[-1]
