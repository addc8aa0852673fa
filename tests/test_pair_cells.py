"""Pairs of signals in cells: several groups against NumPy, and nothing per pair is shuffled again."""

import numpy as np

from signalmill.operators import relate as R


def series():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4, 30))
    out = {f"u{i}": base[i % 4] + rng.normal(size=30) * 0.3 for i in range(12)}
    for i in (2, 5):
        out[f"u{i}"][rng.integers(0, 30, 8)] = np.nan
    return out | {"flat": np.full(30, 2.0), "empty": np.full(30, np.nan)}


def brute(data):
    out, names = {}, sorted(data)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = np.isfinite(data[a]) & np.isfinite(data[b])
            x, y = data[a][both], data[b][both]
            out[a, b] = (int(both.sum()), np.corrcoef(x, y)[0, 1] if len(x) > 1 and x.std() > 1e-9 and y.std() > 1e-9 else None)
    return out


def same(rows, want):
    got = {(r["signal_a"], r["signal_b"]): (r["n"], r["r"]) for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(got[k][0] == n and (got[k][1] is None if r is None else abs(got[k][1] - r) < 1e-9) for k, (n, r) in want.items())


def test_cells_of_many_groups(spark, grid_of, monkeypatch):
    data = series()
    want = brute(data)
    monkeypatch.setattr(R, "SIDE", 3)
    monkeypatch.setattr(R, "REACH", 3)
    for known in (True, False):
        same(R.correlation_matrix(grid_of(data, known=known)).collect(), want)
    same(R.correlated_pairs(grid_of(data), 0.7).collect(), {k: x for k, x in want.items() if x[1] is not None and x[1] >= 0.7})
    same(R.correlated_pairs(grid_of(data), 0.7, block=8).collect(), {k: x for k, x in want.items() if x[1] is not None and x[1] >= 0.7})


def test_sums_of_one_block_are_final(spark, grid_of):
    plan = R.signal_pairs(grid_of(series()))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("FlatMapGroupsInPandas")[0]
