import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from signalmill.llm import lattice as L
from signalmill.llm.vocab import byte_pieces, default_path


def known():
    ranked = sorted(p for p in byte_pieces(default_path()) if len(p) <= L.LONGEST)
    return {p: i for i, p in enumerate(ranked)}


def brute_word(word, places, scores):
    text = b" " + word
    total = 0.0
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        at, parts = 0, []
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(text[at:i])
                at = i
        if all(p in places for p in parts):
            total += math.exp(sum(scores[places[p]] for p in parts))
    return math.log(total) + scores[-1]


def test_all_segmentations_count():
    places, pieces = known(), L.pieces_of(default_path())
    scores = pieces.start()
    words = [b"there", b"the", b"a", "é".encode(), b"token$$", b"\xff\x00x", b"internatio"]
    got = L.segment_scores(words, pieces, scores)
    assert np.allclose(got, [brute_word(w, places, scores) for w in words], rtol=1e-9)


def test_expected_uses_are_the_gradient():
    pieces = L.pieces_of(default_path())
    scores = pieces.start()
    (_, text), = L._by_length([b"thereon"])
    uses = L.expected(pieces.arcs(text), scores)
    for piece in np.flatnonzero(uses)[:12]:
        up = scores.copy()
        up[piece] += 1e-6
        rise = (L.segment_scores([b"thereon"], pieces, up) - L.segment_scores([b"thereon"], pieces, scores))[0] / 1e-6
        assert abs(rise - uses[piece]) < 1e-4


def brute(rows):
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
    bags = [(t or "").encode().lower().split() + [None] for _, t, *_ in rows]
    count = Counter()
    for (d, *_), bag in zip(rows, bags):
        if not held(d):
            count.update(bag)
    n, v = sum(count.values()), len(count)
    out = []
    for (d, *_), bag in zip(rows, bags):
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in bag)
        out.append((d, held(d), len(bag), sum(count[w] > 0 for w in bag), n, round(base, 6)))
    return sorted(out, key=str)


def check(df, rows, **how):
    got = L.score_documents(df, **how).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == brute(rows)
    return {r["doc_id"]: r["score"] for r in got}


def test_counts_and_base(odd, odd_rows, clashing):
    """The head that is sent to all tasks and the joined tail give the same scores."""
    first = check(odd, odd_rows)
    second = check(clashing, odd_rows, head=5)
    assert all(abs(first[d] - second[d]) < 1e-6 * abs(first[d]) for d in first)
    assert all(s < 0 and math.isfinite(s) for s in first.values())


def test_scores_are_probabilities_of_words(spark):
    """One language, one text: the score is the sum of the words' mixtures and the end."""
    text = "ab ab ab ba cd"
    rows = [(0, text, "en"), (2, "ab zz", "en")]
    assert not L.held_out(0)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    scores = {r["doc_id"]: r["score"] for r in L.score_documents(df).collect()}
    counted = Counter(w for d, t, _ in rows if not L.held_out(d) for w in t.split())
    docs = sum(not L.held_out(d) for d, *_ in rows)
    tokens, kinds = sum(counted.values()), len(counted)
    ones, twos = (sum(c == n for c in counted.values()) for n in (1, 2))
    d = ones / (ones + 2 * twos)
    words = spark.createDataFrame([(w.encode(), c) for w, c in counted.items()], "word binary, c bigint")
    learned = L.learn_pieces(words, default_path())
    part = lambda w: math.exp(L.segment_scores([w.encode()], L.pieces_of(default_path()), learned)[0])
    draw = lambda w, rest: max(counted[w] - d, 0) / tokens + d * kinds / tokens * rest
    for doc, t, _ in rows:
        want = math.log10((docs + 0.5) / (tokens + docs + 1)) + sum(math.log10(draw(w, draw(w, part(w))) * (tokens + 0.5) / (tokens + docs + 1)) for w in t.split())
        assert scores[doc] == pytest.approx(want, rel=1e-9)


def test_empty(none, spark, odd):
    assert L.score_documents(none).collect() == []
    only = odd.filter("doc_id is not null").filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")
    got = L.score_documents(only).collect()
    assert got and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)


def test_learning_helps_on_held_out_words(odd):
    """Re-estimated pieces beat the vocabulary's own order on words that training has not seen."""
    counts = L._counts(odd.select("doc_id", "text", "lang"), [])
    fresh = [bytes(r["word"]) for r in counts.filter("c = 0").collect()]
    pieces = L.pieces_of(default_path())
    before = L.segment_scores(fresh, pieces, pieces.start()).mean()
    after = L.segment_scores(fresh, pieces, L.learn_pieces(counts, default_path())).mean()
    assert len(fresh) > 10 and after > before
