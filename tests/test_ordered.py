import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.functions.ordered import attach, framed, neighbours, ordinal, runs, running_sum, with_stats
from signalmill.functions.quantiles import quantiles
from signalmill.operators.grid import fill_linear, make_series, skeleton


def table(df, *cols):
    rows = df.select(*cols).collect()
    return sorted(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=157), rng.normal(size=157)
    a[:4] = np.nan
    a[60:75] = np.nan
    b[-9:] = np.nan
    b[::7] = np.nan
    return {"a": a, "b": b}


@pytest.mark.parametrize("block", [8, 16, 1000])
def test_blocks_give_the_plain_window(grid_of, series, block):
    plain, cut = grid_of(series), grid_of(series, known=False)
    cols = {"lag": lambda w: F.lag("value", 2).over(w), "mean": lambda w: F.avg("value").over(w.rowsBetween(-3, 1))}
    want = table(framed(plain, "signal_id", cols, 3, 1), "signal_id", "bin_idx", "lag", "mean")
    got = table(framed(cut, "signal_id", cols, 3, 1, block=block), "signal_id", "bin_idx", "lag", "mean")
    assert want == got
    one = F.when(F.col("value").isNotNull(), 1).otherwise(0)
    want = table(running_sum(plain, "signal_id", {"s": one}), "signal_id", "bin_idx", "s")
    assert want == table(running_sum(cut, "signal_id", {"s": one}, block=block), "signal_id", "bin_idx", "s")
    label = F.col("value").isNull()
    want = table(runs(plain, "signal_id", label), "signal_id", "bin_idx", "run_id")
    assert want == table(runs(cut, "signal_id", label, block=block), "signal_id", "bin_idx", "run_id")
    args = (F.col("value").isNotNull(), F.col("bin_idx"))
    want = table(neighbours(plain, "signal_id", *args), "signal_id", "bin_idx", "_prev", "_next")
    assert want == table(neighbours(cut, "signal_id", *args, block=block), "signal_id", "bin_idx", "_prev", "_next")


@pytest.mark.parametrize("block", [8, 1000])
def test_fill_linear_matches_pandas(grid_of, series, block):
    import pandas as pd

    got = {(r["signal_id"], r["bin_idx"]): r["value"] for r in fill_linear(grid_of(series, known=False), block=block).collect()}
    for name, values in series.items():
        want = pd.Series(values).interpolate(limit_direction="both")
        for i, v in enumerate(want):
            assert got[name, i] == pytest.approx(v, abs=1e-12)


def test_all_null_series_stays_null(grid_of):
    out = fill_linear(grid_of({"a": [np.nan] * 5}))
    assert [r["value"] for r in out.collect()] == [None] * 5


def test_long_skeleton_is_complete(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "signal_id string")
    got = table(skeleton(ids, 25, ["signal_id"], block=7), "signal_id", "bin_idx")
    assert got == [(s, i) for s in "ab" for i in range(25)]


def test_reading_at_window_end_is_not_on_the_grid(spark):
    from datetime import datetime

    rows = [("a", datetime(2024, 1, 1, 0, 0), 1.0), ("a", datetime(2024, 1, 1, 0, 0, 30), 3.0), ("a", datetime(2024, 1, 1, 0, 3), 9.0)]
    df = spark.createDataFrame(rows, "signal_id string, ts timestamp_ntz, value double")
    out = make_series(df, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 3), 60_000_000)
    assert table(out, "bin_idx", "value") == [(0, 2.0), (1, None), (2, None)]


@pytest.mark.parametrize("n", [1, 2, 5, 400, 3000])
def test_sketch_bracketed_quantiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    hot = np.where(rng.random(n) < 0.4, 7.0, rng.lognormal(size=n))  # one value holds many rows
    data = [("h", float(v)) for v in hot] + [("u", float(v)) for v in rng.normal(size=n)]
    df = spark.createDataFrame(data, "k string, v double").repartition(4)
    probs = {"p0": 0.0, "p1": 0.013, "q1": 0.25, "med": 0.5, "p95": 0.95, "p100": 1.0}
    for accuracy in (50, 10_000):
        got = {r["k"]: r for r in quantiles(df, "k", "v", probs, accuracy=accuracy, bounded=False).collect()}
        for key, values in (("h", hot), ("u", [v for k, v in data if k == "u"])):
            for name, p in probs.items():
                assert got[key][name] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_ordinal_with_ties_and_weights(spark):
    df = spark.createDataFrame([("a", i // 3, i) for i in range(20)], "k string, slot int, v int")
    got = table(ordinal(df, "k", ["v"], F.col("slot")), "v", "ordinal")
    assert got == [(i, i) for i in range(20)]
    got = table(ordinal(df, "k", ["v"], F.col("slot"), weight=F.col("v")), "v", "ordinal")
    assert got == [(i, sum(range(i))) for i in range(20)]


def test_attach_and_stats_agree(grid_of, series):
    a = with_stats(grid_of(series), "signal_id", {"m": F.avg("value")})
    b = with_stats(grid_of(series, known=False), "signal_id", {"m": F.avg("value")})
    assert [x[:2] for x in table(a, "signal_id", "bin_idx")] == [x[:2] for x in table(b, "signal_id", "bin_idx")]
    for x, y in zip(table(a, "signal_id", "bin_idx", "m"), table(b, "signal_id", "bin_idx", "m")):
        assert x[2] == pytest.approx(y[2])
