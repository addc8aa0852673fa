import hashlib
import re

import pytest

from signalmill.llm import exact as X


def brute(rows):
    groups = {}
    for at, (doc, text, *_) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is None, doc or 0, at))
    out = []
    for body, members in groups.items():
        best = min(members)
        for m in sorted(members):
            doc, keep = (rows[i][0] for i in (m[3], best[3]))
            out.append((doc, keep, len(members), hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


def check(df, rows, **how):
    want, groups = brute(rows)
    got = X.exact_groups(df, **how).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    assert sum(r["kept"] for r in got) == groups
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("how", [{}, {"huge": 500}, {"primes": (3, 5)}, {"huge": 97, "primes": (7, 3)}])
def test_groups(odd, odd_rows, clashing, how):
    """Also with chunked hashing of longer texts, and with primes so small that fingerprints collide."""
    check(odd, odd_rows, **how)
    check(clashing, odd_rows, **how)


def test_empty(none):
    assert X.exact_groups(none).collect() == []


def test_chunks_combine():
    data = bytes(range(256)) * 2000
    tables = X.powers()
    whole, state = X.fold(data, tables), [0, 0]
    for at in range(0, len(data), 12345):
        part = data[at : at + 12345]
        for i, value in enumerate(X.fold(part, tables)):
            state[i] = (state[i] * pow(X.BASES[i], len(part), X.PRIMES[i]) + value) % X.PRIMES[i]
    assert tuple(state) == whole
    slow = 0
    for b in data[:3000]:
        slow = (slow * X.BASES[0] + b + 1) % X.PRIMES[0]
    assert X.fold(data[:3000], tables)[0] == slow
