import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import distances, planted, profile, walk
from signalmill.operators import profile as P

M = 20
LAG = P.exclusion(M)


@pytest.fixture(scope="module")
def data():
    flat = walk(180, 5)
    flat[30:75] = flat[30]
    return {"a": planted(260, M, (60, 190), 1), "b": walk(200, 2), "c": flat}


@pytest.mark.parametrize("chunk", [300, 10_000])
def test_matrix_profile(grid_of, data, chunk, monkeypatch):
    monkeypatch.setattr(P, "chunk_size", lambda m, c=0: 64 if chunk == 300 else 10_000)
    got = {(r["signal_id"], r["idx"]): r for r in P.matrix_profile(grid_of(data), M).collect()}
    lr = {(r["signal_id"], r["idx"]): r for r in P.lr_matrix_profile(grid_of(data), M).collect()}
    for name, x in data.items():
        d = profile(x, M, LAG)
        for i in range(len(d)):
            row = got[name, i]
            assert row["dist"] == pytest.approx(d[i].min(), abs=1e-6)
            assert d[i, row["nn"]] == pytest.approx(d[i].min(), abs=1e-6)
            left, right = d[i, :i], d[i, i:]
            for side, part in (("left", left), ("right", right)):
                best = part.min() if len(part) else np.inf
                if np.isfinite(best):
                    assert lr[name, i][f"{side}_dist"] == pytest.approx(best, abs=1e-6)
                else:
                    assert lr[name, i][f"{side}_nn"] is None


def test_planted_motif_and_pruned_search(grid_of, data, monkeypatch):
    monkeypatch.setattr(P, "chunk_size", lambda m, c=0: 50)
    mp = P.matrix_profile(grid_of(data), M)
    pairs = {r["signal_id"]: r for r in P.motif_pairs(mp, 1, LAG).collect()}
    assert abs(pairs["a"]["idx_a"] - 60) <= 2 and abs(pairs["a"]["idx_b"] - 190) <= 2
    pruned = {r["signal_id"]: r for r in P.motif_pruned(grid_of(data), M, segments=5).collect()}
    for name, x in data.items():
        assert pruned[name]["dist"] == pytest.approx(profile(x, M, LAG, mass=True).min(), abs=1e-6)


def test_top_pairs_keep_their_distance(grid_of, data):
    mp = P.matrix_profile(grid_of(data), M).cache()
    rows = mp.filter("signal_id = 'b'").orderBy("dist", "idx").collect()
    used, want = [], []
    for r in sorted(rows, key=lambda r: (r["dist"], min(r["idx"], r["nn"]))):
        a, b = sorted((r["idx"], r["nn"]))
        if all(abs(a - u) >= LAG and abs(b - u) >= LAG for u in used):
            want.append((a, b))
            used += [a, b]
        if len(want) == 3:
            break
    got = P.motif_pairs(mp, 3, LAG).filter("signal_id = 'b'").orderBy("rank").collect()
    assert [(r["idx_a"], r["idx_b"]) for r in got] == want


def test_occurrences_and_nn_scan(grid_of, data):
    x = planted(400, M, (40, 160, 250, 330), 7)
    grid = grid_of({"x": x})
    pairs = P.motif_pairs(P.matrix_profile(grid, M), 1, LAG)
    found = [r["idx"] for r in P.occurrences(grid, pairs, M, factor=3.0).collect()]
    assert all(any(abs(f - p) <= 2 for f in found) for p in (40, 160, 250, 330))
    d = profile(x, M, LAG, mass=True)
    idxs = grid.filter("bin_idx in (5, 100, 300)").select("signal_id", F.col("bin_idx").alias("idx"))
    for r in P.nn_scan(grid, M, idxs).collect():
        assert r["dist"] == pytest.approx(d[r["idx"]].min(), abs=1e-6)


def test_identical_pair_uses_the_low_percentile(grid_of):
    x = walk(150, 3)
    x[100:130] = x[20:50]
    grid = grid_of({"x": x})
    pair = P.motif_pairs(P.matrix_profile(grid, M), 1, LAG)
    found = [r["idx"] for r in P.occurrences(grid, pair, M).collect()]
    assert len(found) >= 2


def test_regimes_find_the_boundary(grid_of):
    rng = np.random.default_rng(0)
    t = np.linspace(0, 1, 300)
    x = np.concatenate([np.sin(2 * np.pi * 6 * t), np.sin(2 * np.pi * 18 * t)]) + rng.normal(0, 0.05, 600)
    mp = P.matrix_profile(grid_of({"x": x}), 30)
    cut = P.regimes(mp, 1, 30).collect()[0]["idx"]
    assert abs(cut - 300) <= 40
    nn = {r["idx"]: r["nn"] for r in mp.collect()}
    n = len(nn)
    arcs = [sum(min(i, j) < p <= max(i, j) for i, j in nn.items()) for p in range(n)]
    got = {r["idx"]: r["arcs"] for r in P.arc_curve(mp, 30).collect()}
    assert [got[p] for p in range(n)] == arcs


def test_chains_follow_mutual_links(grid_of):
    x = planted(500, M, (20, 120, 220, 320, 420), 11)
    lr = P.lr_matrix_profile(grid_of({"x": x}), M).cache()
    rows = {r["idx"]: r for r in lr.collect()}
    length, prev = {i: 1 for i in rows}, {}
    for i in sorted(rows):
        j = rows[i]["right_nn"]
        if j is not None and rows[j]["left_nn"] == i:
            length[j], prev[j] = length[i] + 1, i
    best = min(length, key=lambda i: (-length[i], i))
    path = [best]
    while path[-1] in prev:
        path.append(prev[path[-1]])
    got = P.chains(lr, 1).orderBy("pos").collect()
    assert [r["idx"] for r in got] == path[::-1]
    drift = P.chain_drift(P.chains(lr, 1), grid_of({"x": x}), M).collect()[0]
    means = [x[i : i + M].mean() for i in path[::-1]]
    want = np.polyfit(range(len(means)), means, 1)[0] if len(means) > 1 else 0.0
    assert drift["mean_slope"] == pytest.approx(want, abs=1e-8)


def test_ab_and_consensus(grid_of, data, monkeypatch):
    monkeypatch.setattr(P, "chunk_size", lambda m, c=0: 70)
    grid = grid_of(data)
    d = distances(data["a"], data["b"], M)
    for r in P.ab_profile(grid, "a", "b", M).collect():
        want = d[r["idx"]].min() if r["series"] == "a" else d[:, r["idx"]].min()
        assert r["dist"] == pytest.approx(want, abs=1e-6)
    for need in (2, 3):
        best = np.inf
        for s, x in data.items():
            near = np.stack([distances(x, y, M).min(axis=1) for t, y in data.items() if t != s])
            best = min(best, np.sort(np.vstack([np.zeros(near.shape[1]), near]), axis=0)[need - 1].min())
        out = P.consensus_motif(grid, M, need).collect()
        assert out[0]["radius"] == pytest.approx(best, abs=1e-6)
        assert sum(r["is_central"] for r in out) == 1 and len(out) == 3


def test_mstamp_and_dims(grid_of, monkeypatch):
    d, n, m = 3, 150, 16
    xs = [walk(n, s) for s in (1, 2, 3)]
    for x in xs[:2]:
        x[100:116] = x[30:46]
    grid = grid_of({("e", f"t{i}"): x for i, x in enumerate(xs)}, keys=("entity_id", "track_id"))
    lag = P.exclusion(m)
    cube = np.stack([distances(x, x, m) for x in xs])
    i = np.arange(cube.shape[1])
    cube.sort(axis=0)
    kd = np.cumsum(cube, axis=0) / np.arange(1, d + 1)[:, None, None]
    kd[:, np.abs(i[:, None] - i[None, :]) <= lag] = np.inf
    full = P.mstamp(grid, m, chunk=64).cache()
    for r in full.collect():
        assert r["dist"] == pytest.approx(kd[r["k"] - 1, r["idx"]].min(), abs=1e-6)
    top = P.mstamp_motifs(full, grid, m, 1, 2).collect()[0]
    assert (top["idx_a"], top["idx_b"]) == (30, 100) and sorted(top["dims"]) == ["t0", "t1"]


def test_incomplete_series_is_rejected(grid_of):
    x = walk(100, 1)
    y = x.copy()
    y[50] = np.nan
    out = P.matrix_profile(grid_of({"x": x, "y": y}), M)
    assert {r["signal_id"] for r in out.select("signal_id").distinct().collect()} == {"x"}


def test_label_propagation_matches_breadth_first(grid_of):
    x = planted(500, M, (20, 120, 220, 320, 420), 13)
    mp = P.matrix_profile(grid_of({"x": x}), M).cache()
    rows = {r["idx"]: r for r in mp.collect()}
    seed = 120
    limit = rows[seed]["dist"] * 1.5
    seen, todo = {seed}, [seed]
    while todo:
        cur = todo.pop()
        for nb in [rows[cur]["nn"], *[i for i, r in rows.items() if r["nn"] == cur]]:
            if nb is not None and nb not in seen and rows[nb]["dist"] <= limit:
                seen.add(nb)
                todo.append(nb)
    kept = []
    for i in sorted(seen, key=lambda i: (i != seed, rows[i]["dist"], i)):
        if all(abs(i - k) >= M + LAG for k in kept):
            kept.append(i)
    seeds = mp.filter(f"idx = {seed}").select("signal_id", F.col("idx").alias("seed"), F.lit(limit).alias("threshold"))
    got = P.propagate_label(mp, seeds, M, LAG).collect()
    assert sorted(r["start_index"] for r in got) == sorted(kept)


def test_analyze_returns_tagged_tables(grid_of):
    out = P.analyze("full_mp", grid_of({"x": walk(150, 1)}), "j", M, 2)
    assert {"mp_result", "motif_pairs", "motif_occurrences", "discords", "overview", "summary"} == set(out)
    for t in out.values():
        assert {r["job_id"] for r in t.select("job_id").distinct().collect()} == {"j"}
    with pytest.raises(ValueError):
        P.analyze("nothing", grid_of({"x": [1.0]}), "j", M)


def test_ab_and_pan_occurrences(grid_of):
    a, b = planted(500, M, (40, 260), 11), planted(500, M, (120, 360), 12)
    grid = grid_of({"a": a, "b": b})
    out = P.analyze("ab_motif", grid, "j", M, 1, a="a", b="b")
    found = {(r["series"], r["idx"]) for r in out["motif_occurrences"].collect()}
    pair = out["motif_pairs"].collect()[0]
    assert {("a", pair["idx_a"]), ("b", pair["idx_b"])} <= found and {s for s, _ in found} == {"a", "b"}
    row = out["summary"].collect()[0]
    assert (row["type"], row["leading"], row["rows"], row["job_id"]) == ("ab_motif", "motif_pairs", 1, "j") and row["best"] == pytest.approx(pair["dist"])
    pan = P.analyze("pan", grid_of({"a": a}), "j", lengths=[M - 4, M], k=2)
    pairs = {r["rank"]: (r["m"], r["idx_a"]) for r in pan["motif_pairs"].collect()}
    hits = pan["motif_occurrences"].collect()
    assert {(r["rank"], r["m"]) for r in hits} == {(k, m) for k, (m, _) in pairs.items()}
    assert all(i in {r["idx"] for r in hits if r["rank"] == k} for k, (_, i) in pairs.items())


def brute_consensus(data, m, need):
    best = (np.inf, "", -1)
    for s, x in data.items():
        near = np.stack([distances(x, y, m).min(axis=1) for t, y in data.items() if t != s])
        radius = np.sort(near, axis=0)[need - 2]
        best = min(best, (radius.min(), s, int(radius.argmin())))
    return best


@pytest.mark.parametrize("need", [None, 2, 9])
def test_consensus_search_prunes_and_finds_the_same(grid_of, monkeypatch, need):
    """A shape planted in most of twelve series: the search compares few pairs of a run and a series."""
    monkeypatch.setattr(P, "chunk_size", lambda m, c=0: 200)
    monkeypatch.setattr(P, "BLOCK_RUNS", 40)
    rng = np.random.default_rng(4)
    shape = 8 * np.sin(np.linspace(0, 6 * np.pi, 48)) * np.linspace(0.2, 1, 48)
    data = {f"s{i:02d}": walk(500 + 30 * i, 50 + i) for i in range(12)}
    for i, x in enumerate(data.values()):
        if i not in (1, 5):
            at = 40 + 31 * i
            x[at : at + 48] = x[at] + shape + rng.normal(0, 0.05, 48)
    best, _, work = P.consensus_search(grid_of(data, known=False), 48, need)
    want = brute_consensus(data, 48, need or 12)
    assert best[0] == pytest.approx(want[0], abs=1e-7)
    assert need is None or best[1:] == want[1:]
    if need:
        # the windows of three of twelve series, and a few runs besides
        assert work["compared"] < work["all"] * 0.3 and work["bounded"] < work["all"] * 0.1


def test_consensus_of_flat_and_lone_series(grid_of):
    assert P.consensus_motif(grid_of({"a": walk(100, 1)}), 16).collect() == []
    data = {"a": np.r_[walk(60, 2), np.full(40, 3.0)], "b": np.r_[np.full(50, -1.0), walk(60, 3)], "c": walk(120, 4)}
    for need in (2, 3):
        got = P.consensus_search(grid_of(data, known=False), 16, need)[0]
        assert got[0] == pytest.approx(brute_consensus(data, 16, need)[0], abs=1e-7)


@pytest.mark.parametrize("m", [4, 16, 100])
def test_diagonals_agree_with_products(m):
    rng = np.random.default_rng(m)
    for x, y in (
        (walk(700, 1), walk(500, 2)),
        (1e6 + rng.standard_normal(600), rng.standard_normal(600) * 1e-3),
        (np.r_[rng.standard_normal(300), np.zeros(200), 1e7 * rng.standard_normal(100)], walk(400, 3)),
        (np.full(300, 2.0), walk(300, 4)),
    ):
        a, b = P._Windows(x, m), P._Windows(y, m)
        got = np.vstack([c for _, c in P._diagonals(a, b, True)])
        (za, fa), (zb, fb) = P._unit(x, m), P._unit(y, m)
        want = P._corr(za, fa, zb, fb, True)
        assert np.abs(got - want).max() < 1e-9
        i, j = np.arange(0, len(a), 7), np.arange(0, len(b), 7)
        k = min(len(i), len(j))
        assert np.allclose(P._pair_corr(a, i[:k], b, j[:k], True), want[i[:k], j[:k]], atol=1e-9)
