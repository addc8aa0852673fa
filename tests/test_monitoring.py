from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brute import walk
from signalmill.functions.normal import normal_cdf, normal_quantile
from signalmill.functions.timeparts import DAY, HOUR
from signalmill.operators import forecast as P, multivariate as M, spc as S
from signalmill.operators.grid import formula_column
from signalmill.operators.sequences import _near_best, pick_nonoverlap
from signalmill.streaming import live as L


def test_rules_by_hand(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=400)
    v[50:62] += 1.5
    v[100:108] = np.linspace(-1, 1.5, 8)
    v[150:170] = np.tile([0.5, -0.5], 10)
    v[200:220] = rng.uniform(-0.5, 0.5, 20)
    v[300] = 4.0
    rows = [("s", i, datetime(2024, 1, 1) + timedelta(hours=i), float(x), 0.0, 1.0, 3.0, -3.0) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "signal_id string, subgroup long, ts timestamp_ntz, value double, center double, sigma double, ucl double, lcl double")
    step = np.sign(np.diff(v, prepend=np.nan))
    want = set()
    for k in range(len(v)):
        last = lambda n: v[k - n + 1 : k + 1] if k + 1 >= n else None
        if abs(v[k]) > 3:
            want.add((k, 1))
        if last(9) is not None and (all(last(9) > 0) or all(last(9) < 0)):
            want.add((k, 2))
        if k >= 5 and (all(step[k - 4 : k + 1] > 0) or all(step[k - 4 : k + 1] < 0)):
            want.add((k, 3))
        if k >= 13 and all(step[j] != 0 and step[j] == -step[j - 1] for j in range(k - 11, k + 1)):
            want.add((k, 4))
        for rule, (n, m, zone) in {5: (3, 2, 2), 6: (5, 4, 1)}.items():
            if last(n) is not None and any((s * last(n) >= zone).sum() >= m and s * v[k] >= zone for s in (1, -1)):
                want.add((k, rule))
        if last(15) is not None and all(abs(last(15)) < 1):
            want.add((k, 7))
        if last(8) is not None and all(abs(last(8)) > 1):
            want.add((k, 8))
    got = {(r["subgroup"], r["rule_id"]) for r in S.run_rules(df, "nelson").collect()}
    assert got == want and {r for _, r in want} >= {1, 2, 3, 4, 6, 7}


def test_normal_columns(spark):
    df = spark.createDataFrame([(p,) for p in (0.001, 0.02, 0.3, 0.5, 0.9, 0.999)], "p double")
    from statistics import NormalDist

    for r in df.select("p", normal_quantile(F.col("p")).alias("q")).withColumn("back", normal_cdf(F.col("q"))).collect():
        assert r["q"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-6)
        assert r["back"] == pytest.approx(r["p"], abs=1e-6)


def test_backtest_equals_refits(grid_of):
    t = np.arange(200)
    x = 3 + 0.05 * t + np.sin(2 * np.pi * t / 12) + np.random.default_rng(2).normal(0, 0.3, 200)
    H, L_, step, p, fit = 10, 100, 7, 12, 60
    got = {(r["origin"], r["h"]): r["error"] for r in P.backtest(grid_of({"x": x}), H, L_, step, p, fit).collect()}
    want = {}
    for o in range(L_, 200 - H + 1, step):
        i = np.arange(o - fit, o)
        s, c = np.polyfit(i, x[i], 1)
        res = x[i] - (c + s * i)
        raw = np.array([res[i % p == k].mean() for k in range(p)])
        raw -= raw.mean()
        for h in range(1, H + 1):
            j = o + h - 1
            want[o, h] = x[j] - (c + s * j + raw[j % p])
    assert got.keys() == want.keys()
    assert [got[k] for k in sorted(got)] == pytest.approx([want[k] for k in sorted(want)], abs=1e-8)


@pytest.mark.parametrize("direction", ["above", "below"])
def test_exceedance(grid_of, direction):
    x = 10 + walk(120, 3) * 0.5
    fc = P.forecast(grid_of({"x": x}), 8, HOUR, 0).cache()
    rows = fc.orderBy("bin_idx").collect()
    res = np.array([r["residual"] for r in rows if r["step"] is None])
    f = np.array([r["forecast"] for r in rows if r["step"] is not None])
    thr = float(np.median(f)) + (1.0 if direction == "above" else -1.0)
    over = (lambda v: v > thr) if direction == "above" else (lambda v: v < thr)
    want = [over(f[h] + res * np.sqrt(h + 1)).mean() for h in range(8)]
    got = P.exceedance_steps(fc, thr, direction).orderBy("step").collect()
    assert [r["probability"] for r in got] == pytest.approx(want)
    paths = [over(f + np.cumsum(res[s : s + 8])).any() for s in range(len(res) - 7)]
    out = P.exceedance(fc, thr, direction).collect()[0]
    assert out["any_breach_probability"] == pytest.approx(np.mean(paths)) and out["method"] == "trajectory"


def test_plan_backtest_limits():
    plan = P.plan_backtest(720, 48)
    assert plan.feasible and plan.folds >= 20 and plan.history >= 96
    assert not P.plan_backtest(60, 20).feasible


def test_greedy_cut_is_exact(spark):
    rng = np.random.default_rng(0)
    score = rng.normal(size=400).cumsum()
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(score)], "signal_id string, bin_idx long, score double")
    taken = []
    for i in np.argsort(-score, kind="stable"):
        if all(abs(i - t) > 15 for t in taken):
            taken.append(int(i))
    got = [r["bin_idx"] for r in pick_nonoverlap(df, 5, 15, "score").orderBy("pick").collect()]
    assert got == taken[:5]
    low = []
    for i in np.argsort(score, kind="stable"):
        if all(abs(i - t) > 2 for t in low):
            low.append(int(i))
    got = [r["bin_idx"] for r in pick_nonoverlap(df, 3, 2, "score", descending=False).orderBy("pick").collect()]
    assert got == low[:3]


def test_sketch_cut_keeps_every_needed_row(spark):
    rng = np.random.default_rng(1)
    score = np.round(rng.normal(size=20_000), 2)  # many ties
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(score)], "signal_id string, bin_idx long, score double")
    kept = _near_best(df, ["signal_id"], F.col("score"), 30, True)
    assert 30 <= kept.count() < 1_000
    top = np.sort(score)[::-1][:30]
    assert sorted((r["score"] for r in kept.collect()), reverse=True)[:30] == pytest.approx(top)


def test_formula_guard(spark):
    df = spark.createDataFrame([(1.0, 2.0), (4.0, 0.0), (None, 1.0)], "a double, b double")
    f = lambda text: [r[0] for r in df.select(formula_column(text, ["a", "b"])).collect()]
    assert f("a / b") == [0.5, None, None]
    assert f("max(a, b) ^ 2 - -1") == [5.0, 17.0, None]
    assert f("ln(a - 1)") == [None, pytest.approx(np.log(3)), None]
    for bad in ("__import__('os')", "a.b", "a if b else 1", "eval(a)", "[a]"):
        with pytest.raises(ValueError):
            formula_column(bad, ["a", "b"])


def _readings(spark, shift=False):
    rng = np.random.default_rng(5)
    rows = []
    for e in ("e1", "e2"):
        for k, t in enumerate(("t1", "t2", "t3")):
            v = np.sin(np.arange(400) / 6 + k) + rng.normal(0, 0.05, 400)
            if e == "e1":
                v[390 : 400 if shift else 391] += 12 if shift else 6  # a lasting level change, or one spike
            rows += [(e, t, datetime(2024, 1, 1) + timedelta(hours=i), float(x)) for i, x in enumerate(v)]
    rows.append(("lonely", "t1", datetime(2024, 1, 1), 1.0))
    return spark.createDataFrame(rows, "entity_id string, track_id string, ts timestamp_ntz, value double")


@pytest.mark.parametrize("name", ["residual_voting", "change_point", "random_projection"])
def test_detectors_flag_the_spike(spark, name):
    readings = _readings(spark, shift=name == "change_point")
    prep = M.prepare(readings, datetime(2024, 1, 1), datetime(2024, 1, 1) + timedelta(hours=400), HOUR)
    out = M.DETECTORS[name](prep, 20 * HOUR).collect()
    hits = [r for r in out if r["status"] == "ok"]
    at = 395 if name == "change_point" else 390
    assert {r["entity_id"] for r in hits} == {"e1"} and at in {r["event_index"] for r in hits}
    top = next(r for r in hits if r["event_index"] == at)
    assert len(top["contributors"]) >= 3 and top["severity"] >= 1
    odd = [r for r in out if r["status"] != "ok"]
    assert [(r["entity_id"], r["status"], r["event_index"]) for r in odd] == [("lonely", "invalid_input", -1)]


def test_spectral_detector(spark):
    rng = np.random.default_rng(5)
    rows = []
    for e in ("e1", "e2"):
        for k, t in enumerate(("t1", "t2")):
            v = np.sin(np.arange(384) / 4 + k) + rng.normal(0, 0.1, 384)
            if e == "e1":
                v[352:] = np.sin(np.arange(32) * 1.7 + k)
            rows += [(e, t, datetime(2024, 1, 1) + timedelta(hours=i), float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "entity_id string, track_id string, ts timestamp_ntz, value double")
    prep = M.prepare(df, datetime(2024, 1, 1), datetime(2024, 1, 17), HOUR)
    out = {r["entity_id"]: r for r in M.spectral(prep, 32 * HOUR, 10, 4, emit_all=True).collect()}
    assert out["e1"]["is_anomaly"] and out["e1"]["score"] > out["e2"]["score"]
    x = [r[3] for r in rows if r[0] == "e1" and r[1] == "t1"]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(32) / 31)
    spec = []
    for o in range(11):
        w = np.array(x[384 - (o + 1) * 32 : 384 - o * 32])
        spec.append(np.abs(np.fft.rfft((w - w.mean()) / w.std() * hann))[1:17])
    spec = np.array(spec)
    mid = spec[1:].mean(axis=0)
    d = 1 - spec @ mid / (np.linalg.norm(spec, axis=1) * np.linalg.norm(mid))
    q1, q2, q3 = np.percentile(d[1:], [25, 50, 75])
    want = max(0.0, (d[0] - q2) / max((q3 - q1) / 1.349, 1e-6))
    got = next(c for c in out["e1"]["contributors"] if c["track_id"] == "t1")["score"]
    assert got == pytest.approx(want, rel=1e-6)


def test_watch_emits_only_the_newest_slice(spark):
    now = datetime(2024, 1, 1) + timedelta(hours=400)
    found = L.watch_mvad(_readings(spark).filter("entity_id <> 'lonely'"), "residual_voting", now, 12 * HOUR, HOUR, 20)
    assert 390 in {int((r["event_time"] - datetime(2024, 1, 1)).total_seconds() // 3600) for r in found.collect()}
    late = L.watch_mvad(_readings(spark).filter("entity_id <> 'lonely'"), "residual_voting", now, 2 * HOUR, HOUR, 20)
    assert late.count() == 0


# ---------------------------------------------------------------- streams


def _drain(spark, tmp_path, sdf, mode):
    rows = []
    run = (
        sdf.writeStream.outputMode(mode)
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .foreachBatch(lambda b, e: rows.extend((e, r) for r in b.collect()))
        .start()
    )
    run.awaitTermination()
    return rows


def _files(spark, tmp_path, pdf, parts):
    """One parquet file per part, read one per micro-batch."""
    for k, part in enumerate(np.array_split(np.arange(len(pdf)), parts)):
        spark.createDataFrame(pdf.iloc[part]).coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
    schema = spark.read.parquet(str(tmp_path / "in/p0")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def test_stream_bins_equal_batch_over_micro_batches(spark, tmp_path):
    at = pd.date_range("2024-01-01", periods=300, freq="7min")
    pdf = pd.DataFrame({"signal_id": ["a", "b"] * 150, "ts": at, "value": np.arange(300.0)})
    live = _files(spark, tmp_path, pdf, 3)
    last = {}
    for _, r in _drain(spark, tmp_path, L.stream_bins(live, "1 hour", "2 days"), "update"):
        last[r["signal_id"], r["ts"]] = (r["value"], r["count"])
    want = {(r["signal_id"], r["ts"]): (r["value"], r["count"]) for r in L.stream_bins(spark.createDataFrame(pdf), "1 hour", "2 days").collect()}
    assert last == want


def test_stream_episodes_equal_batch(spark, tmp_path):
    v = np.repeat([1.0, 9.0, 5.0, 1.0, 9.0], [4, 3, 6, 2, 5])
    pdf = pd.DataFrame({"signal_id": "a", "ts": pd.date_range("2024-01-01", periods=20, freq="h"), "value": v})
    live = _files(spark, tmp_path, pdf, 4)
    out = [r for _, r in _drain(spark, tmp_path, L.stream_episodes(live, [4.0, 8.0], ["low", "mid", "high"]), "append")]
    assert [(r["seg_id"], r["state"], r["bins"]) for r in sorted(out, key=lambda r: r["seg_id"])] == [
        (0, "low", 4), (1, "high", 3), (2, "mid", 6), (3, "low", 2)
    ]


def test_alert_stream_equals_batch(spark, tmp_path):
    hours = [0, 1, 2, 20, 21, 50, 51, 52, 53]
    at = pd.to_datetime("2024-01-01") + pd.to_timedelta(np.repeat(hours, 3) * 3600 + np.tile([0, 5, 9], 9), unit="s")
    pdf = pd.DataFrame({"dedup_key": "k", "ts": at, "value": np.arange(27.0)})
    live = _files(spark, tmp_path, pdf, 4)
    last = {}
    for _, r in _drain(spark, tmp_path, L.collapse_alerts(live, timedelta(hours=12)), "update"):
        last[r["opened_at"]] = (r["last_at"], r["occurrence_count"], r["status"], r["last_value"])
    batch = L.collapse_alerts_batch(spark.createDataFrame(pdf), timedelta(hours=12)).collect()
    assert last == {r["opened_at"]: (r["last_at"], r["occurrence_count"], r["status"], r["last_value"]) for r in batch}
    assert len(last) == 3


def test_watch_runs_per_micro_batch(spark, tmp_path):
    pdf = pd.DataFrame({"signal_id": "a", "ts": pd.date_range("2024-01-01", periods=40, freq="h"), "value": np.arange(40.0)})
    live = _files(spark, tmp_path, pdf, 2)
    seen = []
    run = L.run_watch(live, lambda now: spark.range(1).withColumn("now", F.lit(now)), lambda df, e: seen.append(df.first()["now"]), checkpointLocation=str(tmp_path / "w"))
    run.awaitTermination()
    assert len(seen) == 2 and max(seen) == datetime(2024, 1, 2, 15)


@pytest.mark.parametrize("ahead", [1, 40, 700])
def test_crossings_by_brute_force(ahead):
    """Block bounds against every path step by step, also for horizons of several blocks."""
    rng = np.random.default_rng(ahead)
    residual = rng.normal(size=1500)
    run, level = np.cumsum(residual), rng.normal(size=ahead).cumsum() / 5
    for threshold in (-5.0, 3.0, 20.0, 60.0):
        want = [(level + run[t : t + ahead] - (run[t] - residual[t])).max() > threshold for t in range(len(run) - ahead + 1)]
        assert P._crossings(run, residual, level, threshold).tolist() == want


def test_the_plan_does_not_grow_with_the_folds(grid_of):
    grid = grid_of({"x": np.sin(np.arange(2600) / 5)})
    size = lambda step: len(P.backtest(grid, 10, 100, step, 12)._jdf.queryExecution().optimizedPlan().toString())
    few, many = size(125), size(1)
    assert abs(few - many) < 0.02 * few
    rows = P.backtest(grid, 10, 100, 1, 12, 50)
    assert rows.agg(F.count_distinct("origin"), F.count("*")).first()[:] == (2491, 24910)
