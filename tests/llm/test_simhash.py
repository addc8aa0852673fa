import random

import numpy as np
import pytest
import xxhash

from signalmill.llm import simhash as S


def brute_print(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    values = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_roots(prints, limit):
    """prints: list of (id, value) -> smallest id reachable within ``limit`` bits, per place."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= limit:
                root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            ids[find(i)] = min(doc, ids.get(find(i), doc))
    return [ids.get(find(i)) for i in range(len(prints))]


def check(df, rows):
    prints = [(r[0], brute_print(r[1])) for r in rows]
    want = sorted(((d, f"{p:016x}", c) for (d, p), c in zip(prints, brute_roots(prints, 4))), key=str)
    got = sorted((tuple(r) for r in S.op7(df).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == want


def test_odd_rows(odd, odd_rows, clashing):
    check(odd, odd_rows)
    check(clashing, odd_rows)


def test_empty(none):
    assert S.op7(none).collect() == []
    assert S.drop_near_duplicates(none).collect() == []


@pytest.mark.parametrize("limit, reach", [(4, 1), (4, 2), (2, 2), (6, 2)])
def test_every_near_pair_shares_a_chain(limit, reach):
    rng = random.Random(limit)
    masks = S.chain_masks(limit, reach)
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, limit)))
        assert any(not diff & m for _, m in masks)


@pytest.mark.parametrize("reach", [1, 2])
def test_dense_and_chained_prints(spark, reach):
    """A tight cluster, a loose one around it, a chain of four-bit steps and strangers."""
    rng = np.random.default_rng(reach)
    centre = int(rng.integers(0, 1 << 63))
    flip = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    values = {flip(centre, int(rng.integers(0, 8))) for _ in range(300)} | {int(v) for v in rng.integers(0, 1 << 63, 300)}
    x = int(rng.integers(0, 1 << 63))
    for i in range(12):
        x ^= 0xF << (5 * i)
        values.add(x)
    values = sorted(values)
    rows = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    roots = {r["fp"]: r["root"] for r in S.link(spark.createDataFrame(rows, "fp bigint").repartition(7), 4, reach).collect()}
    want = brute_roots(list(enumerate(values)), 4)
    got = [roots.get(r[0], r[0]) for r in rows]
    assert len({(a, b) for a, b in zip(got, want)}) == len(set(got)) == len(set(want))


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_similar_documents(spark):
    """Edited copies: none of a pair far above 0.8 stays double, nothing far below goes."""
    rng = random.Random(8)
    make = lambda n: [rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice("xyzuvw") * rng.randint(1, 4) + str(rng.randint(0, 40)) for _ in range(n)]
    rows = []
    for family in range(40):
        words = make(rng.randint(120, 500))
        rows.append((len(rows), " ".join(words)))
        for edits in (0, 1, 1, 2, 3, 5, 8, 40):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = make(1)[0]
            rows.append((len(rows), "  ".join(copy) if edits == 0 else " ".join(copy)))
    rows += [(10_000 + i, " ".join(make(80))) for i in range(60)] + [(20_000, None), (20_001, ""), (20_002, " \n"), (None, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    out = S.drop_similar(df).collect()
    kept = [r["doc_id"] for r in out if r["doc_id"] is not None]
    assert len(kept) == len(set(kept)) and sum(r["doc_id"] is None for r in out) == 1
    sets = {d: shingles(t) for d, t in rows if d is not None and d < 20_000}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    families = [range(9 * f, 9 * f + 9) for f in range(40)]
    high = [(a, b) for f in families for a in f for b in f if a < b and alike(a, b) >= 0.87]
    double = [alike(*p) for p in high if p[0] in kept and p[1] in kept]
    assert len(high) > 200 and len(double) <= len(high) // 100 and max(double, default=0) < 0.93
    for f in families:
        for d in f:
            if max(alike(d, e) for e in f if e != d) < 0.7:
                assert d in kept
    assert {10_000 + i for i in range(60)} <= set(kept) and [d for d in kept if d >= 20_000] == [20_000]


def planted(rng, make):
    """Texts with added, removed, moved and scattered edits, around and on a similarity of 0.8."""
    rows = []
    for family in range(60):
        words = make(rng.randint(60, 300))
        rows.append(words)
        n = len(words)
        for share in (0.05, 0.1, 0.15, 0.18, 0.2, 0.22, 0.25, 0.3):
            k, at = max(1, int(share * n)), rng.randrange(n // 2)
            rows.append(words[:at] + make(k) + words[at:])
            rows.append(words[:at] + words[at + k :])
            rows.append(words[k:] + words[:k])
        for edits in (1, 2, n // 60, n // 40, n // 25):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(n)] = make(1)[0]
            rows.append(copy)
    for n in (1, 3, 5, 6, 8, 9, 12, 14, 40):  # n + 4 words have n shingles; of 5k shingles 4k are exactly 0.8
        words = make(n + 4)
        rows += [words, words + make(1), words + make(2), words[: -max(1, n // 5)], words + make(max(1, n // 4))]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def brute_classes(rows, similarity=0.8):
    """doc_id -> smallest doc_id reachable over pairs of exactly compared shingle sets."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= round(10 * similarity) * len(sets[i] | sets[j]):
                hi, lo = max(find(i), find(j)), min(find(i), find(j))
                root[hi] = lo
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_blocks_and_threshold_as_brute_force(spark):
    """Every pair at 0.8 or more is linked, block inserts and deletions too, and no pair below."""
    rng = random.Random(21)
    make = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    rows = planted(rng, make)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = brute_classes(rows)
    kept = {r["doc_id"] for r in S.drop_similar(df).collect()}
    assert kept == {d for d, root in want.items() if d == root}


def test_the_very_threshold(spark):
    """Pairs of texts with so many common shingles of so many in all, at, just above and just below 0.8."""
    rows, linked = [], set()
    for k, (shared, total) in enumerate([(8, 10), (79, 100), (80, 100), (81, 100), (399, 500), (400, 500), (799, 1000), (801, 1000)]):
        own, words = total - shared, [f"w{k}_{i}" for i in range(shared + 4)]
        a, b = words + [f"a{k}_{i}" for i in range(own // 2)], words + [f"b{k}_{i}" for i in range(own - own // 2)]
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        assert (len(x & y), len(x | y)) == (shared, total)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        linked |= {2 * k + 1} if 5 * shared >= 4 * total else set()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in S.drop_similar(df).collect()} == {d for d, _ in rows} - linked


def test_a_passage_of_many_documents(spark, monkeypatch):
    """Common shingles change the order of the prefixes, not the result."""
    rng = random.Random(4)
    make = lambda n: [f"{rng.randrange(10**6)}" for _ in range(n)]
    passage, rows = make(60), []
    for i in range(120):
        words = make(rng.randint(5, 60))
        rows += [(3 * i, " ".join(words[:5] + passage + words[5:])), (3 * i + 1, " ".join(words[:5] + passage + words[5:] + make(rng.randint(1, 30)))), (3 * i + 2, " ".join(words))]
    monkeypatch.setattr(S, "SAMPLED", 2)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = brute_classes(rows)
    assert len(S.common_shingles(df, 5)[0]) >= 50
    assert {r["doc_id"] for r in S.drop_similar(df).collect()} == {d for d, root in want.items() if d == root}


def test_similar_odd_rows(odd, clashing, none):
    kept = sorted(r["doc_id"] for r in S.drop_similar(odd).collect() if r["doc_id"] is not None)
    assert kept == sorted(r["doc_id"] for r in S.drop_similar(clashing).collect() if r["doc_id"] is not None)
    assert 3 in kept and not {100, 105, 120, 123, 201, 212} & set(kept) and kept.count(210) == 1
    assert S.drop_similar(none).collect() == [] and set(S.drop_similar(clashing).columns) == set(clashing.columns)


def test_dropping_keeps_one_of_a_class(odd, odd_rows):
    kept = S.drop_near_duplicates(odd).collect()
    prints = [(r[0], brute_print(r[1])) for r in odd_rows if r[0] is not None]
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(brute_roots(prints, 4)))
    assert sum(r["doc_id"] is None for r in kept) == 2
    assert kept and set(kept[0].asDict()) == set(odd.columns)
