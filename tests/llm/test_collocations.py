import random
import re
from collections import Counter, defaultdict

import pytest

from signalmill.llm import collocations as C


def brute(rows, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        above = Counter()
        for p, a in found.items():
            for q in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}:
                above[q] = max(above[q], a)
        scored = []
        for p, a in found.items():
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if not 100 * above[p] >= share * a:
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def texts(seed, docs=120):
    """A small vocabulary, so that phrases of all lengths repeat; some words come up only in late documents."""
    rng = random.Random(seed)
    vocabulary = ["The", "of", "a", "red", "fox", "ünï", "jumps", "日本", "over\x00", "dog", "x" * 70, "on", "To"]
    rows = []
    for i in range(docs):
        parts = [rng.choice(vocabulary[: 6 + i % 8]) for _ in range(rng.randint(0, 40))]
        if i % 3 == 0:
            parts += ["New", "York", "City", "hall"] * rng.randint(1, 2)
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "\x0b", "\r\n"]) for w in parts), rng.choice(["en", "en", "de", None, "und"]), "s", 1))
    return rows


@pytest.mark.parametrize("least, share, top, shards, chunk", [(4, 80, 2000, 4, 300), (10, 60, 7, 3, 1 << 20), (2, 100, 50, 1, 50), (30, 80, 2000, 5, 500)])
def test_against_brute_force(spark, monkeypatch, least, share, top, shards, chunk):
    monkeypatch.setattr(C, "CHUNK_BYTES", chunk)
    rows = texts(least) + [(900, None, "en", "s", 1), (901, "", "de", "s", 1), (902, " \t\n", None, "s", 1)] + [texts(1)[0]] * 5
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = C.collocations(df, least, share, top, shards)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, share, top)


def test_odd_rows(spark, odd, odd_rows, clashing, none):
    want = brute(odd_rows, 3, 80, 2000)
    assert sorted(map(tuple, C.collocations(odd, 3).collect())) == want and want
    assert sorted(map(tuple, C.collocations(clashing, 3).collect())) == want
    assert C.collocations(none).collect() == []


def test_words_of_one_name(spark, monkeypatch):
    """Under the first names two words are one: everything is counted again."""
    true = C._chunk

    def clashing_names(text, lang, seed):
        import numpy as np

        row = true(text, lang, seed)
        if seed == 0:
            names = np.frombuffer(row["names"], np.uint64).copy()
            names[1:] %= 3
            row["names"] = names.tobytes()
        return row

    monkeypatch.setattr(C, "_chunk", clashing_names)
    rows = texts(4, 40)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(map(tuple, C.collocations(df, 4, shards=2).collect())) == brute(rows, 4, 80, 2000)


def test_a_crowded_sketch_only_counts_more(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 8)
    monkeypatch.setattr(C, "SLOTS", 16)
    rows = texts(8)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(2)
    assert sorted(map(tuple, C.collocations(df, 8).collect())) == brute(rows, 8, 80, 2000)


@pytest.mark.parametrize("text", [b"", b" \t ", b"\xff", b"\xff\xff a", b"a", b"a b\xffa  c\ta\xff", "\x00 ünï\u00a0x\x1f \x85 日本 日本".encode() + b"\xff \xff", b"ab a b ab" * 9])
def test_codes_of_a_chunk(text):
    """Words are numbered without an object for each occurrence, with the numbers that a plain walk gives."""
    import numpy as np

    tokens = re.findall(rb"\xff|[^ \t\xff]+", text)
    codes = {b"\xff": 0}
    want = [codes.setdefault(w, len(codes)) for w in tokens]
    row = C._chunk(text, "en", 0)
    assert np.frombuffer(row["codes"], np.uint32).tolist() == want
    assert row["words"] == b"\xff".join([*codes][1:]) and row["n"] == sum(c > 0 for c in want)
    assert len(row["names"]) == 8 * len(codes)


def test_a_phrase_is_looked_up_once_a_chunk(monkeypatch):
    """However often a phrase comes in a chunk, its place in the sketch is sought once."""
    import numpy as np
    import pyarrow as pa
    from types import SimpleNamespace

    sought, true = [], C._reach
    monkeypatch.setattr(C, "_reach", lambda sketch, names: sought.append(len(names)) or true(sketch, names))
    row = C._chunk(b"a b c d e " * 1000, "en", 0)
    batch = pa.RecordBatch.from_pylist([{"names": row["names"], "codes": row["codes"]}])
    out = [r for b in C._counter(SimpleNamespace(value=np.ones(C.BLOCK, np.uint8)), 2, 3)([batch]) for r in b.to_pylist()]
    assert sorted((r["len"], r["c"]) for r in out) == sorted([(1, 1000)] * 5 + [(n, 1000 if i + n <= 5 else 999) for n in (2, 3, 4) for i in range(5)])
    assert sought == [6, 5, 5]
