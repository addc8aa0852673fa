import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from signalmill.llm import packing as P
from signalmill.llm.vocab import byte_encoder, default_path


def plain_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(default_path()).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_ids_are_the_tokenizers(texts):
    texts = [*texts, "a<|endoftext|>b", " ".join(texts)]
    encode = byte_encoder(default_path())
    assert [encode(t).tolist() for t in texts] == plain_ids(texts)


def check(df, rows, capacity):
    from pyspark.sql import functions as F

    got = [r.asDict() for r in P.pack_documents(df, capacity).withColumn("crc", F.crc32("ids")).collect()]
    want = []
    for (doc, text, *_), ids in zip(rows, plain_ids([r[1] or "" for r in rows])):
        ids = np.array([*ids, 2], "<u4")
        first = len(ids) % capacity or min(capacity, len(ids))
        starts = [0, *range(first, len(ids), capacity)]
        for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.append((doc, n, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["crc"]) for r in got), key=str) == sorted(want, key=str)
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert not filled or max(filled.values()) <= capacity
    return len(filled), best_fit([w[3] for w in want], capacity)


def best_fit(lengths, capacity):
    """Sequences that plain best-fit decreasing needs."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        gap = min(fits) if fits else capacity
        if fits:
            gaps.remove(gap)
        gaps.append(gap - n)
    return len(gaps)


def test_places(odd, odd_rows, clashing):
    made, plain = check(odd, odd_rows, 64)
    assert made <= plain
    check(clashing, odd_rows, 1024)


def test_empty(none):
    assert P.pack_documents(none).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece(seed):
    rng = random.Random(seed)
    counts = {n: rng.randint(1, 400) for n in rng.sample(range(1, 256), rng.randint(1, 80))}
    plan = P.plan(counts, 256)
    assert all(sum(p) <= 256 and t > 0 for t, p in plan)
    used = {n: sum(t * p.count(n) for t, p in plan) for n in counts}
    assert used == counts
    assert sum(t for t, _ in plan) <= best_fit([n for n, c in counts.items() for _ in range(c)], 256)


def test_exact_complements_reach_the_bound():
    counts = {700: 50, 324: 50, 512: 40, 300: 30, 124: 60, 600: 30}  # one, two and three fillers
    assert sum(t for t, _ in P.plan(counts)) == -(-sum(n * c for n, c in counts.items()) // 1024)
