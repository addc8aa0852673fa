import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import walk
from signalmill.functions.timeparts import HOUR
from signalmill.operators import relate as R, spectral as S

START = __import__("datetime").datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    a = rng.normal(size=300)
    b = np.concatenate([np.zeros(3), a[:-3]]) * 0.9 + rng.normal(0, 0.1, 300)
    c = 2 * a - b + rng.normal(0, 0.2, 300)
    gaps = a.copy()
    gaps[::9] = np.nan
    return {"a": a, "b": b, "c": c, "g": gaps, "k": np.full(300, 2.0)}


def test_correlation_is_pairwise_complete(grid_of, data, monkeypatch):
    grid = grid_of(data)
    for group in (32, 2):
        monkeypatch.setattr(R, "GROUP", group)
        got = {(r["signal_a"], r["signal_b"]): r for r in R.correlation_matrix(grid).collect()}
        assert len(got) == 10
        for (p, q), r in got.items():
            ok = np.isfinite(data[p]) & np.isfinite(data[q])
            assert r["n"] == ok.sum()
            if "k" in (p, q):
                assert r["r"] is None
            else:
                assert r["r"] == pytest.approx(np.corrcoef(data[p][ok], data[q][ok])[0, 1], abs=1e-9)


def _granger(y, s, p):
    rows = [t for t in range(p, len(y)) if np.isfinite([y[t], *y[t - p : t], *s[t - p : t]]).all()]
    own = np.array([[1, *(y[t - k] for k in range(1, p + 1))] for t in rows])
    full = np.array([[1, *(y[t - k] for k in range(1, p + 1)), *(s[t - k] for k in range(1, p + 1))] for t in rows])
    out = np.array([y[t] for t in rows])
    rss = lambda x: ((out - x @ np.linalg.lstsq(x, out, rcond=None)[0]) ** 2).sum()
    return max(0.0, min(0.999, (rss(own) - rss(full)) / rss(own)))


def test_granger_matches_least_squares(grid_of, data, monkeypatch):
    parts = {k: data[k] for k in ("a", "b", "g")}
    base = R.pair_products
    monkeypatch.setattr(R, "pair_products", lambda g, lags: base(g, lags, block=64))
    for r in R.causality_matrix(grid_of(parts), 2).collect():
        assert r["score"] == pytest.approx(_granger(parts[r["target"]], parts[r["source"]], 2), abs=1e-9)
    one = R.granger(grid_of(parts), "b", "a", 3).collect()[0]
    assert one["score"] == pytest.approx(_granger(data["b"], data["a"], 3), abs=1e-9) and one["score"] > 0.9


def test_lags_across_blocks(grid_of, data, monkeypatch):
    base = R.lag_sums
    monkeypatch.setattr(R, "lag_sums", lambda t, c, m: base(t, c, m, block=40))
    grid = grid_of({k: data[k] for k in ("a", "b")})
    got = {r["lag"]: r["r"] for r in R.cross_correlation(grid, "a", "b", 6).collect()}
    for lag, r in got.items():
        x, y = (data["a"][: 300 - lag], data["b"][lag:]) if lag >= 0 else (data["a"][-lag:], data["b"][: 300 + lag])
        assert r == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
    best = R.rank_causes(grid, "b", 6, HOUR).collect()[0]
    assert best["signal_id"] == "a" and best["lag_bins"] == 3 and best["leads"]


def test_virtual_sensor(grid_of, data):
    grid = grid_of({k: data[k] for k in ("a", "b", "c")})
    points = {r["bin_idx"]: r for r in R.validate_points(grid, "c", ["a", "b"], 0.7).collect()}
    x = np.column_stack([np.ones(210), data["a"][:210], data["b"][:210]])
    beta = np.linalg.lstsq(x, data["c"][:210], rcond=None)[0]
    sigma = np.sqrt(((data["c"][:210] - x @ beta) ** 2).sum() / (210 - 3))
    for i, r in points.items():
        assert r["estimate"] == pytest.approx(beta[0] + beta[1] * data["a"][i] + beta[2] * data["b"][i], abs=1e-8)
    assert points[0]["sigma"] == pytest.approx(sigma, abs=1e-8)
    report = R.validate_signal(grid, "c", ["a", "b"], 0.7).collect()[0]
    z = np.array([points[i]["residual"] for i in range(210, 300)]) / sigma
    assert report["max_abs_z"] == pytest.approx(np.abs(z).max(), abs=1e-8)
    assert report["verdict"] in ("valid", "suspect")


@pytest.mark.parametrize("block", [40, 1000])
def test_four_step_transform(grid_of, block):
    x = walk(360, 9)
    got = {r["k"]: r["magnitude"] for r in S.spectrum(grid_of({"x": x}), HOUR, block=block).collect()}
    want = np.abs(np.fft.fft(x))
    assert len(got) == 180
    for k, v in got.items():
        assert v == pytest.approx(want[k], rel=1e-9, abs=1e-7)


@pytest.mark.parametrize("n, block", [(101, 40), (2 * 151, 60), (257, 100)])
def test_transform_of_lengths_without_two_factors(grid_of, n, block):
    assert S._split(n, block) is None
    x = walk(n, n)
    got = {r["k"]: r["magnitude"] for r in S.spectrum(grid_of({"x": x, "y": x[::-1]}), HOUR, block=block).filter("signal_id = 'x'").collect()}
    want = np.abs(np.fft.fft(x))
    assert got and all(v == pytest.approx(want[k], rel=1e-9, abs=1e-7) for k, v in got.items())


def test_periods_and_spectrogram(grid_of):
    t = np.arange(240)
    x = np.sin(2 * np.pi * t / 24) + 0.01 * t + np.random.default_rng(1).normal(0, 0.1, 240)
    for block in (32, 1 << 17):
        top = S.detect_periods(grid_of({"x": x}), 1, block=block).collect()[0]
        assert abs(top["period_bins"] - 24) <= 1 and 0 < top["score"] <= 1
    frames = S.spectrogram(grid_of({"x": x}), 32, 8, HOUR, START, frames_per_task=5).collect()
    assert len({r["frame"] for r in frames}) == (240 - 32) // 8 + 1
    for r in frames:
        want = np.abs(np.fft.rfft(x[r["start_idx"] : r["start_idx"] + 32]))[r["k"]]
        assert r["magnitude"] == pytest.approx(want, abs=1e-8)


def test_decompose_auto_period(grid_of):
    t = np.arange(240)
    x = 5 + 0.02 * t + np.tile(np.sin(2 * np.pi * np.arange(24) / 24), 10)
    rows = S.decompose(grid_of({"x": x})).collect()
    assert max(abs(r["residual"]) for r in rows) < 0.2


@pytest.mark.parametrize("threshold, absolute", [(0.9, False), (0.6, True), (-1.0, False), (0.99, True)])
def test_correlated_pairs_are_the_matrix_filtered(grid_of, monkeypatch, threshold, absolute):
    monkeypatch.setattr(R, "GROUP", 5)
    monkeypatch.setattr(R, "SKETCH", 16)
    rng = np.random.default_rng(7)
    data = {f"w{i:02d}": walk(200, i) for i in range(16)}
    data |= {f"x{i:02d}": data[f"w{i:02d}"] * (1 - 2 * (i % 2)) + rng.normal(0, 0.5, 200) for i in range(8)}
    data |= {f"n{i}": rng.normal(size=200) for i in range(4)} | {"k": np.full(200, 2.0), "none": np.full(200, np.nan)}
    for i in (1, 3):
        data[f"w{i:02d}"][i * 7 :: 11] = np.nan
    grid = grid_of(data)
    want = {}
    for r in R.correlation_matrix(grid).collect():
        if r["r"] is not None and (abs(r["r"]) if absolute else r["r"]) >= threshold:
            want[r["signal_a"], r["signal_b"]] = (r["n"], pytest.approx(r["r"], abs=1e-9))
    got = {(r["signal_a"], r["signal_b"]): (r["n"], r["r"]) for r in R.correlated_pairs(grid, threshold, absolute, block=64).collect()}
    assert got == want and want
    assert R.correlated_pairs(grid.limit(0)).collect() == []


def test_few_signals_go_on_from_their_sketches(grid_of):
    """Of 300 walks only those with a partner within reach have their series compared."""
    data = {f"w{i:03d}": walk(256, 1000 + i) for i in range(300)}
    data["twin"] = data["w007"] + 0.01
    packed = R._packed(grid_of(data), 64)
    cells = R._both_sides(R._sketches(packed, 0, 256, 6), 6).groupBy("_ga", "_gb")
    tried = cells.applyInPandas(R._may_reach(0.99, False), "signal_id string, _g int, _ga int, _gb int")
    assert tried.count() < 0.3 * 301 * 6
    assert {"twin", "w007"} <= {r["signal_id"] for r in tried.collect()}


def test_intervals_of_any_length_make_two_rows(spark):
    """Seconds and months side by side: every overlap once, and no interval in more than two slots."""
    from datetime import timedelta

    from signalmill.operators import joins as J

    rng = np.random.default_rng(5)
    length = [timedelta(seconds=float(s)) for s in (0, 1, 2, 4, 60, 3600, 90 * 86400)]
    rows = [(i, START + timedelta(seconds=int(rng.integers(0, 7 * 86400))), length[int(rng.integers(7))]) for i in range(400)]
    rows = [(i, f"k{i % 3}", a, None if not d else a + d) for i, a, d in rows]
    left = spark.createDataFrame(rows, "i long, k string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    right = left.select(F.col("i").alias("j"), "k", F.col("start_ts").alias("r_start_ts"), F.col("end_ts").alias("r_end_ts"))
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] <= (b[3] or b[2]) and b[2] <= (a[3] or a[2]))
    got = J.interval_overlap(left, right, ["k"], 1_000_000)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want
    assert set(got.columns) == {"i", "k", "start_ts", "end_ts", "j", "r_start_ts", "r_end_ts"}
    classed = J.with_class(left, F.unix_micros(F.col("start_ts").cast("timestamp")), F.unix_micros(F.coalesce("end_ts", "start_ts").cast("timestamp")), 1_000_000)
    assert J.in_slots(classed, 1_000_000).groupBy("i").count().agg(F.max("count")).first()[0] <= 2
    times = spark.createDataFrame([(n, START + timedelta(seconds=1777 * n)) for n in range(300)], "n long, at_ts timestamp_ntz")
    near = J.markers_near(left, times, 1_000_000)
    second = timedelta(seconds=1)
    want = sorted((r[0], n) for r in rows for n in range(300) if r[2] - second <= START + timedelta(seconds=1777 * n) <= (r[3] or r[2]) + second)
    assert sorted((r["i"], r["n"]) for r in near.collect()) == want


def test_little_more_meets_than_matches_and_all_tasks_take_part(spark, tmp_path):
    """Small files with large results: slots are dealt over all partitions, and most pairs that meet are results."""
    from signalmill.operators import joins as J

    rng = np.random.default_rng(8)
    minutes = lambda c: F.expr(f"timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, {c}, 0)")
    rows = [(i, int(rng.integers(20000)), int(rng.integers(60, 960))) for i in range(1200)]
    spark.createDataFrame(rows, "i long, s int, n int").coalesce(1).write.parquet(f"{tmp_path}/spans")
    spans = spark.read.parquet(f"{tmp_path}/spans").select("i", minutes("s").alias("start_ts"), minutes("s + n").alias("end_ts"))
    times = spans.select(F.col("i").alias("j"), F.col("start_ts").alias("at_ts"))
    right = spans.select(F.col("i").alias("j"), F.col("start_ts").alias("r_start_ts"), F.col("end_ts").alias("r_end_ts"))
    near = sorted((a[0], b[0]) for a in rows for b in rows if a[1] <= b[1] <= a[1] + a[2])
    both = sorted((a[0], b[0]) for a in rows for b in rows if a[1] <= b[1] + b[2] and b[1] <= a[1] + a[2])
    hour = 3_600_000_000
    for got, want in ((J.markers_near(spans, times, 0, hour), near), (J.interval_overlap(spans, right, [], hour), both)):
        assert sorted((r["i"], r["j"]) for r in got.collect()) == want
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert "BroadcastHashJoin [_cls" not in got._jdf.queryExecution().executedPlan().toString()
    wide = J.with_class(spans, F.unix_micros(F.col("start_ts").cast("timestamp")), F.unix_micros(F.col("end_ts").cast("timestamp")), hour)
    spots = times.withColumn("_at", F.unix_micros(F.col("at_ts").cast("timestamp")))
    assert J.meeting(spots, wide, [], hour).count() < 1.6 * len(near)


def test_intervals_that_end_before_they_start(spark):
    """Such an interval meets those that hold both its ends, as the two comparisons say."""
    from signalmill.operators import joins as J

    rng = np.random.default_rng(9)
    rows = [(i, int(a), int(a + rng.integers(-50, 120))) for i, a in enumerate(rng.integers(0, 400, 150))] + [(900, None, 5), (901, 7, None), (902, 30, 30), (902, 30, 30)]
    at = lambda c: F.expr(f"timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, {c})")
    df = spark.createDataFrame(rows, "i long, s int, e int")
    left = df.select("i", at("s").alias("start_ts"), at("e").alias("end_ts"))
    right = df.select(F.col("i").alias("j"), at("s").alias("r_start_ts"), at("e").alias("r_end_ts"))
    full = [(i, s, s if e is None else e) for i, s, e in rows if s is not None]
    want = sorted((a[0], b[0]) for a in full for b in full if a[1] <= b[2] and b[1] <= a[2])
    assert sorted((r["i"], r["j"]) for r in J.interval_overlap(left, right, [], 10_000_000).collect()) == want
