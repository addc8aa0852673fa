from datetime import datetime

from pyspark.sql import functions as F

from signalmill.functions import timeparts as T

MOMENTS = [datetime(2024, 3, 10, 2, 30, 15, 123456), datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(2024, 11, 3, 1, 30), datetime(1995, 1, 1)]


def test_epoch_conversion_ignores_the_session_zone(spark):
    df = spark.createDataFrame([(m,) for m in MOMENTS], "ts timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            rows = df.select("ts", T.to_us("ts").alias("us"), T.from_us(T.to_us("ts")).alias("back")).collect()
            assert [r["us"] for r in rows] == [T.as_us(m) for m in MOMENTS]
            assert [r["back"] for r in rows] == MOMENTS
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_floor_division_and_shift(spark):
    df = spark.createDataFrame([(-7,), (7,), (-8,)], "v long")
    assert [r[0] for r in df.select(T.floor_div(F.col("v"), 4)).collect()] == [-2, 1, -2]
    ts = spark.createDataFrame([(MOMENTS[0],)], "ts timestamp_ntz")
    row = ts.select(T.shift("ts", 90).alias("s"), *[T.time_attr("ts", a).alias(a) for a in ("minute", "hour", "dayOfWeek", "dayOfMonth", "month")]).first()
    assert row["s"] == datetime(2024, 3, 10, 4, 0, 15, 123456)
    assert (row["minute"], row["hour"], row["dayOfWeek"], row["dayOfMonth"], row["month"]) == (30, 2, 6, 9, 2)
