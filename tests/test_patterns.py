from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import walk
from signalmill.functions import symbols as Y
from signalmill.functions.timeparts import DAY, HOUR
from signalmill.operators import similarity as X, windows as W


def z(v, thr=0.01):
    sd = v.std()
    return (v - v.mean()) / sd if sd >= thr else v - v.mean()


def means(v, p):
    return np.array([v[a:b].mean() for a, b in W.segment_bounds(len(v), p)])


@pytest.fixture(scope="module")
def data():
    flat = walk(150, 6)
    flat[20:70] = 3.0
    return {"a": walk(170, 1) + 1e6, "b": walk(140, 2), "f": flat}


@pytest.mark.parametrize("block", [64, 1 << 17])
def test_window_means(grid_of, data, block, monkeypatch):
    base = W.framed
    monkeypatch.setattr(W, "framed", lambda *a, **k: base(*a, block=block, **k))
    for w, p in ((20, 6), (16, 4)):
        got = W.window_means(grid_of(data, known=False), w, p).collect()
        assert len(got) == sum(len(x) - w + 1 for x in data.values())
        for r in got:
            x = data[r["signal_id"]][r["start_index"] : r["start_index"] + w]
            assert np.allclose(r["paa"], means(z(x), p), atol=1e-5)


@pytest.mark.parametrize("tolerance", [0, 1])
def test_search_over_scales(grid_of, data, tolerance):
    query = data["b"][30:54]
    q = z(query)
    cuts = Y.fitted_breakpoints(q.tolist(), 4)
    letters = lambda v: np.array([sum(x >= b for b in cuts) - 1 for x in v])
    qp = means(q, 6)
    want = []
    for scale in (0.9, 1.0, 1.1):
        w = int(24 * scale + 0.5)
        for name, x in data.items():
            for i in range(len(x) - w + 1):
                p = means(z(x[i : i + w]), 6)
                if tolerance <= 0 or np.abs(letters(p) - letters(qp)).max() <= tolerance:
                    want.append((np.linalg.norm(p - qp), name, i, w))
    want.sort()
    got = X.similarity_1d(query.tolist(), grid_of(data), 6, 4, 0.9, 1.1, 3, tolerance, 8).orderBy("rank").collect()
    assert [r["distance"] for r in got] == pytest.approx([w[0] for w in want[:8]], abs=1e-5)
    assert (got[0]["signal_id"], got[0]["start_index"]) == ("b", 30) and got[0]["query_word"] == got[0]["candidate_word"]


def test_multidim_needs_every_track_in_time(grid_of):
    a, b = walk(120, 1), walk(120, 2)
    c, d = walk(120, 3), walk(120, 4)
    c[50:66], d[52:68] = a[10:26] * 2, b[10:26] + 7
    grid = grid_of({("e1", "x"): c, ("e1", "y"): d, ("e2", "x"): c, ("e2", "y"): walk(120, 9)}, keys=("entity_id", "track_id"))
    queries = {"x": a[10:26].tolist(), "y": b[10:26].tolist()}
    got = X.similarity_multidim(queries, grid, 4, 4, per_track_k=2, max_delay=2).orderBy("rank").collect()
    assert (got[0]["entity_id"], got[0]["start_index"], got[0]["end_index"]) == ("e1", 50, 67)
    assert got[0]["rank_score"] == pytest.approx(1.0, abs=1e-4)


@pytest.mark.parametrize("candidates,detection", [(15, 0), (0, 0), (15, 40)])
def test_discords_by_brute_force(grid_of, candidates, detection, monkeypatch):
    data = {"a": walk(150, 1), "b": walk(150, 2)}
    w, p = 16, 4
    cuts = Y.gaussian_breakpoints(4)
    found = []
    for name, x in data.items():
        paa = [means(z(x[i : i + w]), p) for i in range(len(x) - w + 1)]
        words = ["".join("abcd"[sum(v >= c for c in cuts) - 1] for v in q) for q in paa]
        freq = {u: words.count(u) for u in set(words)}
        edge = len(x) - detection
        pool = [i for i in range(len(paa)) if not detection or i >= edge]
        others = [j for j in range(len(paa)) if not detection or j < edge]
        if candidates:
            pool = sorted(pool, key=lambda i: (freq[words[i]], i))[:candidates]
        else:
            cut = np.mean([freq[u] for u in words])
            pool = [i for i in pool if freq[words[i]] <= cut]
        scored = []
        for i in pool:
            near = [np.linalg.norm(paa[i] - paa[j]) for j in others if abs(i - j) >= w]
            if near:
                scored.append((min(near), name, i))
        taken = []
        for s in sorted(scored, key=lambda s: (-s[0], s[2])):
            if all(abs(s[2] - t[2]) >= w for t in taken):
                taken.append(s)
        found += taken
    want = sorted(found, key=lambda s: (-s[0], s[1], s[2]))[:4]
    monkeypatch.setattr(X, "TIME_CHUNK", 50)
    monkeypatch.setattr(X, "PACK", 7)
    got = X.sax_discords(grid_of(data), w, 4, p, 4, candidates=candidates, detection_bins=detection).orderBy("rank").collect()
    assert [r["nn_distance"] for r in got] == pytest.approx([s[0] for s in want], abs=1e-6)
    assert [(r["signal_id"], r["start_index"]) for r in got] == [s[1:] for s in want]


def test_discord_search_scores_few_candidates(grid_of):
    """A repeating shape with two odd places: common words are bounded by their own kind and never scored."""
    from signalmill.operators.windows import sax_windows

    rng = np.random.default_rng(1)
    x = np.sin(np.arange(3000) * 2 * np.pi / 24) + rng.normal(0, 0.05, 3000)
    x[700:716] += 2.5
    x[2000:2016] = rng.normal(size=16)
    w, p = 24, 6
    windows = sax_windows(grid_of({"a": x}), w, p, Y.gaussian_breakpoints(4)).drop("end_index").cache()
    picks, scored = X.discord_search(windows, windows, w, 2, width=16)
    every = np.array([means(z(x[i : i + w]), p) for i in range(len(x) - w + 1)])
    gaps = np.sqrt(((every[:, None] - every[None]) ** 2).sum(axis=2))
    gaps[np.abs(np.subtract.outer(np.arange(len(every)), np.arange(len(every)))) < w] = np.inf
    near, taken = gaps.min(axis=1), []
    for i in np.argsort(-near, kind="stable"):
        if all(abs(i - t) >= w for t in taken):
            taken.append(i)
    got = picks.orderBy(F.desc("value")).collect()
    assert [r["start_index"] for r in got] == taken[:2]
    assert [r["value"] for r in got] == pytest.approx(near[taken[:2]].tolist(), abs=1e-9)
    assert scored < len(every) / 4


def test_word_functions(spark):
    df = spark.createDataFrame([("abca", "adcb"), ("dddd", "aaaa")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select(
        Y.word_distance(a, b).alias("m"), Y.word_distance(a, b, "max").alias("x"), Y.mindist(a, b, 4, 16).alias("d"),
        Y.tolerance_regex(a, 4, 1, 1, 2).alias("r"),
    ).collect()
    assert [r["m"] for r in rows] == [0.75, 3.0] and [r["x"] for r in rows] == [2.0, 3.0]
    assert rows[0]["d"] == pytest.approx(2 * 0.67) and rows[1]["d"] == pytest.approx(2 * np.sqrt(4 * 1.34**2))
    assert rows[0]["r"] == "[ab]{1,2}[abc]{1,2}[bcd]{1,2}[ab]{1,2}"
    assert len(Y.gaussian_breakpoints(20)) == 20 and Y.gaussian_breakpoints(3)[1] == pytest.approx(-0.430727299, abs=1e-8)


def word_matrix(words, alpha, length):
    """Lower-bound distance of every pair of words, from the rounded breakpoints."""
    cuts = np.asarray(Y.ROUNDED_BREAKPOINTS[alpha], dtype=float)
    gap = lambda p, q: 0.0 if abs(p - q) < 2 else cuts[max(p, q) - 1] - cuts[min(p, q)]
    each = [[np.sqrt(length / len(a)) * np.sqrt(sum(gap(ord(x) - 97, ord(y) - 97) ** 2 for x, y in zip(a, b))) for b in words] for a in words]
    return np.array(each)


def some_words(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcd"), 4)) for _ in range(n)]


def cycle_rows(spark, *lists):
    rows = [(f"s{k}", i, w) for k, words in enumerate(lists) for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "signal_id string, cycle long, word string").repartition(5)


def test_linkage_merges(spark):
    words = ["aaaa", "aaab", "dddd", "dddc", "adad", "aaaa", "cbda", "dddd", "bdac"]
    got = X.linkage(cycle_rows(spark, words, ["abab"], ["abab", "dcdc", "abab"]), 4, 8).orderBy("signal_id", "step").collect()
    d = word_matrix(words, 4, 8)
    groups, want = {}, []
    for i, w in enumerate(words):
        groups.setdefault(words.index(w), []).append(i)
    while len(groups) > 1:
        dist, i, j = min((round(np.mean([d[p, q] for p in groups[i] for q in groups[j]]), 9), i, j) for i in groups for j in groups if i < j)
        want.append((i, j, dist))
        groups[i] += groups.pop(j)
    mine = [r for r in got if r["signal_id"] == "s0"]
    assert [(r["left"], r["right"]) for r in mine] == [w[:2] for w in want]
    assert [r["distance"] for r in mine] == pytest.approx([w[2] for w in want])
    assert [(r["left"], r["right"]) for r in got if r["signal_id"] == "s2"] == [(0, 1)] and not [r for r in got if r["signal_id"] == "s1"]


@pytest.mark.parametrize("k", [1, 3, 6])
def test_clusters_of_cycles(spark, k):
    """Farthest-first seeds and weighted medoids, against the same rules in loops."""
    lists = [some_words(60, k), ["aaaa", "dddd", "aaaa"]]
    got = {(r["signal_id"], r["cycle"]): r["medoid"] for r in X.cluster_cycles(cycle_rows(spark, *lists), k, 4, 8).collect()}
    for name, words in zip(("s0", "s1"), lists):
        d = word_matrix(words, 4, 8)
        firsts = sorted({words.index(w) for w in words})
        count = {f: words.count(words[f]) for f in firsts}
        seats = [0]
        while len(seats) < min(k, len(firsts)):
            seats.append(max((f for f in firsts if f not in seats), key=lambda f: (min(d[f, s] for s in seats), -f)))
        owner = {f: min(range(len(seats)), key=lambda c: (d[f, seats[c]], c)) for f in firsts}
        for _ in range(20):
            for c in range(len(seats)):
                mine = [f for f in firsts if owner[f] == c]
                if mine:
                    seats[c] = min(mine, key=lambda f: (round(sum(d[f, g] * count[g] for g in mine), 9), f))
            after = {f: min(range(len(seats)), key=lambda c: (d[f, seats[c]], c)) for f in firsts}
            if after == owner:
                break
            owner = after
        assert {i: got[name, i] for i in range(len(words))} == {i: seats[owner[words.index(w)]] for i, w in enumerate(words)}


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_cycles(spark, k):
    lists = [some_words(40, 9), ["aaaa"] * 7, ["abcd"]]
    got = X.nearest_cycles(cycle_rows(spark, *lists), 4, 8, k).collect()
    for name, words in zip(("s0", "s1", "s2"), lists):
        d = word_matrix(words, 4, 8)
        want = {(i, n): j for i in range(len(words)) for n, j in enumerate(sorted((j for j in range(len(words)) if j != i), key=lambda j: (d[i, j], j))[:k], 1)}
        assert {(r["cycle"], r["rank"]): r["neighbour"] for r in got if r["signal_id"] == name} == want


def test_many_cycles_of_one_signal(spark):
    """No cap and no group of all cycles: 100,000 cycles with a few words."""
    words = spark.range(100_000).select(F.lit("s").alias("signal_id"), F.col("id").alias("cycle"), F.concat(F.when(F.col("id") % 2 == 0, "aa").otherwise("dd"), F.when(F.col("id") % 3 == 0, "ab").otherwise("dc")).alias("word"))
    assert X.cluster_cycles(words, 2, 4, 8).count() == 100_000
    assert X.nearest_cycles(words, 4, 8, 2).count() == 200_000
    assert X.linkage(words, 4, 8).count() == 3


def test_training_spans_fill_each_window(spark):
    rows = [("s", datetime(2024, 1, 1, h), float(h)) for h in (0, 1, 3, 6)]
    df = spark.createDataFrame(rows, "signal_id string, ts timestamp_ntz, value double")
    spans = spark.createDataFrame(
        [("c", "c#0", "s", datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 5))],
        "class_label string, series_id string, signal_id string, start_ts timestamp_ntz, end_ts timestamp_ntz",
    )
    got = X.vsm_training(spans, df, HOUR, slot_us=2 * HOUR).orderBy("bin_idx").collect()
    assert [(r["bin_idx"], r["value"]) for r in got] == [(0, 1.0), (1, 2.0), (2, 3.0), (3, 3.0)]


@pytest.mark.parametrize("slot", [None, 2 * HOUR, HOUR // 5])
def test_training_bins_of_any_span(spark, slot):
    """Spans of any length and beginning, shared names, nulls, readings on the edges and of very different sizes."""
    us = lambda t: int((t - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 + t.microsecond
    rng = np.random.default_rng(11)
    begin = datetime(2024, 1, 1)
    minute = lambda m: begin + timedelta(minutes=int(m))
    rows = [(f"s{i % 2}", minute(rng.integers(0, 1500)), float(rng.normal()) * 10.0 ** int(rng.integers(0, 3))) for i in range(700)]
    rows += [("s0", minute(400), 1e300), ("s0", minute(401), 1e300), ("s1", minute(700), None), (None, minute(3), 1.0), ("s1", None, 2.0), ("s1", minute(701), float("inf"))]
    spans = [(f"c{i % 2}", f"n{i}", f"s{i % 2}", minute(a := rng.integers(-60, 1400)), minute(a + rng.integers(-1, 400))) for i in range(60)]
    spans += [("c0", f"w{i}", "s0", minute(37 * i), minute(37 * i + 240)) for i in range(12)]  # whole bins, ends on readings
    spans += [("c0", f"p{i}", "s0", at, at + timedelta(microseconds=i)) for i, at in enumerate([rows[0][1], rows[2][1], rows[4][1]])]
    spans += [("c0", "w1", "s1", minute(5), minute(700)), spans[3], (None, "x", "s0", minute(0), minute(90)), ("c1", "y", None, minute(0), minute(90)), ("c1", "z", "s1", None, minute(90))]
    found = {}
    for c, n, s, a, z in spans:
        for r, t, v in rows:
            if None not in (c, n, s, a, z, r, t, v) and s == r and a <= t <= z:
                found.setdefault((c, n, (us(t) - us(a)) // HOUR), []).append(v)
    want = []
    for c, n, s, a, z in spans:
        if a is not None and z is not None:
            want += [(str(c), n, k, float(np.mean(found[c, n, k])) if (c, n, k) in found else None) for k in range(-(-(us(z) - us(a)) // HOUR))]
    df = spark.createDataFrame(rows, "signal_id string, ts timestamp_ntz, value double")
    named = spark.createDataFrame(spans, "class_label string, series_id string, signal_id string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    fill, X.fill_linear = X.fill_linear, lambda grid, by: grid
    try:
        got = X.vsm_training(named, df, HOUR, slot_us=slot).collect()
    finally:
        X.fill_linear = fill
    order = lambda r: (r[0], r[1], r[2])
    got = sorted(((str(r["class_label"]), r["series_id"], r["bin_idx"], r["value"]) for r in got), key=order)
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want, key=order)]
    for (*_, v), (*_, w) in zip(got, sorted(want, key=order)):
        assert v == pytest.approx(w, rel=1e-9) if w is not None else v is None


def test_training_sums_each_reading_by_edges(spark):
    """A thousand spans over the same readings: rows summed grow with both tables, not with their product."""
    begin, seen = datetime(2024, 1, 1), []
    df = spark.range(2000).select(F.lit("s").alias("signal_id"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,0,id * 10)").alias("ts"), F.col("id").cast("double").alias("value"))
    spans = spark.createDataFrame([("c", str(i), "s", begin + timedelta(seconds=i), begin + timedelta(seconds=i, hours=4)) for i in range(1000)], "class_label string, series_id string, signal_id string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    got = X.vsm_training(spans, df, HOUR)
    got.collect()

    def walk_plan(node):
        seen.append(node.metrics().get("numOutputRows").get().value() if node.metrics().contains("numOutputRows") else 0)
        inner = node.executedPlan() if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else node.plan() if "QueryStage" in node.getClass().getSimpleName() else None
        children = [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
        for child in children:
            walk_plan(child)

    walk_plan(got._jdf.queryExecution().executedPlan())
    assert max(seen) < 50_000  # 1,440,000 readings lie in the spans
