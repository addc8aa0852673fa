"""Streams over several micro-batches: expiry of state, late rows, order within a batch."""

from datetime import datetime, timedelta

from signalmill.streaming import live as L

AT = datetime(2024, 3, 1)
HOURS = lambda h: AT + timedelta(hours=h)


def staged(spark, tmp_path, batches, schema):
    """A file stream that reads one of ``batches`` at a time, each spread over partitions but written as one file."""
    folder = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(sdf, tmp_path, mode):
    out = []
    query = sdf.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    query.foreachBatch(lambda batch, epoch: out.extend((epoch, *map(str, r)) for r in batch.collect())).start().awaitTermination()
    return out


def test_idle_signals_close_their_last_episode(spark, tmp_path):
    first = [("a", HOURS(h), v) for h, v in ((2, 9.0), (0, 1.0), (1, 1.0))] + [("b", HOURS(0), 9.0)]
    second = [("b", HOURS(1), 9.0), ("a", HOURS(1.5), 1.0)]  # a's late bin is passed over
    third = [("b", HOURS(80), 1.0)]
    sdf = staged(spark, tmp_path, [first, second, third], "signal_id string, ts timestamp, value double")
    got = drain(L.stream_episodes(sdf, [5.0], ["low", "high"], idle=timedelta(hours=24)), tmp_path, "append")
    rows = [r[1:] for r in got]
    assert ("a", "0", "low", str(HOURS(0)), str(HOURS(1)), "2") in rows
    assert ("a", "1", "high", str(HOURS(2)), str(HOURS(2)), "1") in rows  # closed by the watermark
    assert ("b", "0", "high", str(HOURS(0)), str(HOURS(1)), "2") in rows and len(rows) == 3


def test_quiet_alerts_close(spark, tmp_path):
    first = [("k", HOURS(1), 1.0), ("k", HOURS(2), 2.0)]
    second = [("k", HOURS(0.5), 0.5), ("other", HOURS(2), 1.0)]  # late, within the quiet time: it counts
    third = [("other", HOURS(90), 1.0)]
    sdf = staged(spark, tmp_path, [first, second, third], "dedup_key string, ts timestamp, value double")
    got = drain(L.collapse_alerts(sdf, timedelta(hours=6), delay=timedelta(hours=12)), tmp_path, "update")
    last = [r[1:] for r in got if r[1] == "k"][-1]
    assert last == ("k", str(HOURS(0.5)), str(HOURS(2)), "3", "CLOSED", "2.0")


def test_late_rows_have_a_side_table(spark, tmp_path):
    batches = [[(1, HOURS(10)), (2, HOURS(0))], [(3, HOURS(9)), (4, HOURS(3)), (5, HOURS(30))], [(6, HOURS(10)), (7, HOURS(26)), (8, None)]]
    sdf = staged(spark, tmp_path, batches, "id int, ts timestamp")
    fresh, late = [], []
    keep = lambda to: lambda batch, epoch: to.extend(r["id"] for r in batch.collect())
    L.split_late_stream(sdf, timedelta(hours=5), str(tmp_path / "newest"), keep(fresh), keep(late), checkpointLocation=str(tmp_path / "state")).awaitTermination()
    assert sorted(late) == [4, 6] and sorted(fresh) == [1, 2, 3, 5, 7, 8]
