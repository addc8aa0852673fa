"""Selections, rules and sums over NULLs and block edges: the same in every block size."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.functions.ordered import mark_bins, running_sum
from signalmill.operators import catalog, forecast as P, multivariate as M, sequences as W, spc as S, stats
from signalmill.plans.runtime import shared_folder
from signalmill.streaming import live as L

LIMITS = "signal_id string, subgroup long, ts timestamp_ntz, value double, center double, sigma double, ucl double, lcl double"


@pytest.mark.parametrize("block", [2, 5, 1 << 17])
def test_running_sum_starts_at_zero(spark, block):
    values = [None, 2.0, None, None, 3.0, None, -1.0]
    df = mark_bins(spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, bin_idx long, v double"), len(values))
    got = running_sum(df, "k", {"s": F.col("v")}, block=block).orderBy("bin_idx").collect()
    assert [r["s"] for r in got] == [0.0, 2.0, 2.0, 2.0, 5.0, 5.0, 4.0]


def test_rules_pass_over_missing_points(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0.3, 1.0, 500)
    missing = rng.random(500) < 0.2
    at = lambda i: datetime(2024, 1, 1) + timedelta(hours=int(i))
    rows = [("s", i, at(i), None if missing[i] else float(v[i]), 0.0, 1.0, 3.0, -3.0) for i in range(500)]
    kept = [("s", n, at(i), float(v[i]), 0.0, 1.0, 3.0, -3.0) for n, i in enumerate(np.flatnonzero(~missing))]
    hits = lambda data, **how: sorted((r["ts"], r["rule_id"], r["side"]) for r in S.run_rules(spark.createDataFrame(data, LIMITS), **how).collect())
    want = hits(kept)
    assert want and hits(rows) == want and hits(rows, block=7) == want and hits(kept, block=64) == want


@pytest.mark.parametrize("radius, block", [(0, 8), (3, 4), (7, 1 << 17), (50, 16)])
def test_pick_all_is_the_greedy_choice(spark, radius, block):
    rng = np.random.default_rng(radius)
    rows = [(k, int(i), float(rng.integers(0, 9))) for k in "ab" for i in np.flatnonzero(rng.random(300) < 0.6)]
    want = []
    for k in "ab":
        taken = []
        for _, i in sorted((s, i) for key, i, s in rows if key == k):
            if all(abs(i - j) > radius for j in taken):
                taken.append(i)
        want += [(k, i) for i in sorted(taken)]
    got = W.pick_all(spark.createDataFrame(rows, "signal_id string, bin_idx long, s double"), radius, "s", block=block)
    assert sorted((r["signal_id"], r["bin_idx"]) for r in got.collect()) == want


@pytest.mark.parametrize("block", [6, 1 << 17])
def test_exceedance_paths_skip_missing_residuals(spark, block):
    rng = np.random.default_rng(2)
    past = [None if i % 5 == 3 else float(x) for i, x in enumerate(rng.normal(size=120))]
    steps = 4
    rows = [("a", i, None, None, r, 1.0) for i, r in enumerate(past)] + [("a", 120 + s, s + 1, 0.2 * s, None, 1.0) for s in range(steps)]
    fc = spark.createDataFrame(rows, "signal_id string, bin_idx long, step int, forecast double, residual double, sigma double")
    got = P.exceedance(fc, 1.5, block=block).collect()[0]
    kept = np.array([r for r in past if r is not None])
    paths = [np.cumsum(kept[i : i + steps]) + 0.2 * np.arange(steps) for i in range(len(kept) - steps + 1)]
    assert got["method"] == "trajectory"
    assert got["any_breach_probability"] == pytest.approx(np.mean([(p > 1.5).any() for p in paths]))


def test_exceedance_of_no_forecast(spark):
    empty = spark.createDataFrame([], "signal_id string, bin_idx long, step int, forecast double, residual double, sigma double")
    assert P.exceedance(empty, 1.0).collect() == []


def test_history_of_scheduled_detectors():
    assert [L.history_bins("residual_voting", 16), L.history_bins("random_projection", 10), L.history_bins("change_point", 10)] == [36, 30, 38]
    assert L.history_bins("spectral_aggregation", 32) == 292 and L.history_bins("spectral_aggregation", 32, baseline_windows=12) == 420
    assert L.history_bins("residual_voting", 8, season=96) == 204 and L.history_bins("change_point", 10, contrast=16) == 54


@pytest.mark.parametrize("confidence, fires", [(0.96, True), (96.0, True), (0.97, False), (0.9999, False), (None, False), (0.5, True)])
def test_any_confidence_of_a_deviation_rule(spark, confidence, fires):
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("s", at, 2.1, 0.0, 1.0)], "signal_id string, ts timestamp, value double, baseline double, sigma double")
    rules = spark.createDataFrame([("r", "s", "deviation_band", None, confidence, None, "high")], "rule_id string, signal_id string, condition_type string, threshold double, confidence double, rate_per_minute double, severity string")
    assert L.evaluate_rules(rows, rules).count() == fires


def test_nothing_is_cut_unless_asked(spark, grid_of):
    x = np.random.default_rng(0).normal(size=900)
    assert stats.duration_curve(grid_of({"x": x})).count() == 900
    assert stats.duration_curve(grid_of({"x": x}), 500).count() == 451
    ids = spark.range(1500).select(F.col("id").cast("string").alias("signal_id"), F.lit("n").alias("signal_name"))
    assert catalog.page(ids, 0, 1200).count() == 1201


def test_published_defaults():
    import inspect

    of = lambda f: {k: p.default for k, p in inspect.signature(f).parameters.items()}
    assert of(M.residual_voting) | {"rms_threshold": 1.2, "extreme_threshold": 3.0, "min_fraction": 0.5} == of(M.residual_voting)
    assert of(M.change_point) | {"contrast": 8, "rms_threshold": 1.2, "extreme_threshold": 3.0, "min_fraction": 0.5} == of(M.change_point)
    assert of(M.random_projection) | {"count": 16, "min_votes": 2, "rms_threshold": 1.2, "extreme_threshold": 3.0, "max_work_rows": None} == of(M.random_projection)
    assert of(M.spectral) | {"baseline_windows": 8, "min_baseline": 3, "track_threshold": 2.0, "rms_threshold": 1.5, "extreme_threshold": 4.0} == of(M.spectral)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {"spark.none": ""}

    with pytest.raises(ValueError):
        shared_folder(Session())
