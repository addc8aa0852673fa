"""Results with far more rows than their input: every row is there, and the rows lie so that files stay small."""

import functools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.operators import joins as J, relate as R
from signalmill.plans.samples import rounded

MINUTE = 60_000_000


def minutes(c):
    return F.expr(f"timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, {c}, 0)")


def bytes_a_row(df, folder):
    df.write.parquet(folder)
    return sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.endswith(".parquet")) / df.sparkSession.read.parquet(folder).count()


@pytest.fixture(scope="module")
def spans(spark):
    """Ids in no order of time."""
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(1000)), int(rng.integers(60, 300))) for i in rng.permutation(4000) * 1_000_003]
    return spark.createDataFrame(rows, "i long, s int, n int").select("i", minutes("s").alias("start_ts"), minutes("s + n").alias("end_ts"))


def test_markers_lie_in_runs(spark, spans, tmp_path):
    rng = np.random.default_rng(4)
    times = spark.createDataFrame([(int(j), int(rng.integers(1000))) for j in rng.permutation(8000) * 1_000_003], "j long, s int")
    times = times.select("j", minutes("s").alias("at_ts"))
    near = J.markers_near(spans, times, 2 * MINUTE, 30 * MINUTE).select("j", "i")
    assert bytes_a_row(near, f"{tmp_path}/near") < 0.5


def test_overlaps_lie_in_runs(spark, spans, tmp_path):
    right = spans.select(F.col("i").alias("j"), F.col("start_ts").alias("r_start_ts"), F.col("end_ts").alias("r_end_ts"))
    both = J.interval_overlap(spans, right, [], 60 * MINUTE).filter("i < j").select("i", "j")
    assert bytes_a_row(both, f"{tmp_path}/both") < 0.75


@pytest.mark.parametrize("tile", (1, 3, 256))
def test_tiles_of_any_size(spark, monkeypatch, tile):
    """Equal rows, ties, missing keys and times, and columns that have no order."""
    monkeypatch.setattr(J, "TILE", tile)
    monkeypatch.setattr(J, "DEAL", 40)
    rng = np.random.default_rng(6)
    some = lambda v: None if rng.random() < 0.05 else v
    rows = [(int(rng.integers(60)), some(f"k{rng.integers(2)}"), some(int(rng.integers(200))), int(rng.integers(0, 90))) for _ in range(150)]
    df = spark.createDataFrame(rows + rows[:10], "i long, k string, s int, n int")
    df = df.withColumn("i", F.when(F.col("i") > 3, F.col("i")))
    left = df.select("i", "k", minutes("s").alias("start_ts"), F.when(F.col("n") > 9, minutes("s + n")).alias("end_ts"), F.create_map(F.lit("i"), "i").alias("m"))
    right = left.select(F.col("i").alias("j"), "k", F.col("start_ts").alias("r_start_ts"), F.col("end_ts").alias("r_end_ts"))
    full = [(i if i > 3 else None, k, s, s + n if n > 9 else s) for i, k, s, n in rows + rows[:10] if s is not None]
    plain = lambda pairs: sorted(map(str, pairs))
    want = [(a[0], b[0]) for a in full for b in full if a[1] is not None and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]]
    for one in (left, left.drop("m")):
        got = J.interval_overlap(one, right, ["k"], 10 * MINUTE)
        assert plain((r["i"], r["j"]) for r in got.collect()) == plain(want)
        assert all(r["m"] == {"i": r["i"]} for r in got.collect()) if "m" in got.columns else True
    times = left.select(F.col("i").alias("j"), F.col("start_ts").alias("at_ts"), "m")
    got = J.markers_near(left.drop("m"), times, 2 * MINUTE, 10 * MINUTE).collect()
    assert plain((r["i"], r["j"]) for r in got) == plain((a[0], b[0]) for a in full for b in full if a[2] - 2 <= b[2] <= a[3] + 2)


def gappy(count, seed=7):
    """Signals of 30 bins, about a tenth of them empty."""
    rng = np.random.default_rng(seed)
    return {f"u{i}": np.where(rng.random(30) < 0.1, np.nan, rng.normal(size=30)) for i in rng.permutation(count)}


def test_shared_bins_lie_in_runs(spark, grid_of, tmp_path):
    assert bytes_a_row(R.signal_pairs(grid_of(gappy(1200))), f"{tmp_path}/pairs") < 0.7


def test_rounded_correlations_lie_in_order(spark, grid_of, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "FEW", 1, raising=False)
    matrix = functools.partial(R.correlation_matrix, **{"by_r": True} if "by_r" in R.correlation_matrix.__code__.co_varnames else {})
    assert bytes_a_row(rounded(matrix(grid_of(gappy(3000)))), f"{tmp_path}/matrix") < 7.5


def test_every_series_is_copied_a_bounded_number_of_times(spark, grid_of, monkeypatch):
    found, both = [], R._both_sides
    monkeypatch.setattr(R, "SIDE", 2)
    monkeypatch.setattr(R, "_both_sides", lambda rows, groups: found.append(groups) or both(rows, groups))
    assert R.signal_pairs(grid_of(gappy(100))).count() == 100 * 99 // 2
    assert found == [32]


@pytest.mark.parametrize("by_r", (False, True))
def test_cells_of_any_shape(spark, grid_of, monkeypatch, by_r):
    """Groups, strips and runs that do not divide each other, names whose order is not that of their numbers of values."""
    data = gappy(23) | {"flat": np.full(30, 2.0), "empty": np.full(30, np.nan), "one": np.where(np.arange(30) == 4, 1.0, np.nan), "Ü": np.arange(30.0), "": -np.arange(30.0)}
    names, want = sorted(data), {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = (data[c][np.isfinite(data[a]) & np.isfinite(data[b])] for c in (a, b))
            want[a, b] = (len(x), np.corrcoef(x, y)[0, 1] if len(x) > 1 and x.std() > 1e-9 and y.std() > 1e-9 else None)
    for name, size in {"SIDE": 4, "SORTED": 30, "FEW": 3, "STRIP": 3, "RUN": 2}.items():
        monkeypatch.setattr(R, name, size)
    for matrix in (R.correlation_matrix(grid_of(data), by_r=by_r), R.correlation_matrix(grid_of(data, known=False), by_r=by_r)):
        rows = matrix.collect()
        got = {(r["signal_a"], r["signal_b"]): (r["n"], r["r"]) for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys()
        assert all(got[k][0] == n and (got[k][1] is None if r is None else abs(got[k][1] - r) < 1e-9) for k, (n, r) in want.items())
    rows = R.signal_pairs(grid_of(data)).collect()
    assert {(r["signal_a"], r["signal_b"]): r["shared_bins"] for r in rows} == {k: n for k, (n, _) in want.items()} and len(rows) == len(want)
    assert R.signal_pairs(grid_of({"a": np.full(30, np.nan)})).collect() == R.correlation_matrix(grid_of({"a": np.arange(30.0)}), by_r=by_r).collect() == []
