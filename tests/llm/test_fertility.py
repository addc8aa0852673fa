import math
import random
import re
from collections import Counter

import pytest

from signalmill.llm import fertility as Q


def tokens(word, cutters):
    import base64

    import public_tokenizers
    import sentencepiece
    import tiktoken

    if not cutters:
        cutters.append(sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")))
        with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        cutters.append(tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    piece, byte = cutters
    a = piece.encode(word)
    b = byte.encode_ordinary(" " + word)
    return [(t, piece.is_byte(t) or t == 0) for t in a], [(t, "�" in byte.decode([t])) for t in b]


def brute(rows):
    """All counts of every row, word by word."""
    out, cutters, seen = [], [], {}
    for doc, text, lang, *_ in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
        row = [doc, len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]
        for w in words:
            if w not in seen:
                seen[w] = tokens(w, cutters)
        for i in (0, 1):
            bag = Counter(t for w in words for t, _ in seen[w][i])
            n = sum(bag.values())
            row += [n, sum(odd for w in words for _, odd in seen[w][i]), round(-sum(c / n * math.log2(c / n) for c in bag.values()), 9) if n else 0.0]
        out.append(tuple(row))
    return out


def verdicts(rows, counted, fence, least):
    """base_failed, outside and kept of every row, with quartiles by sorting."""
    steps = []
    for row in counted:
        own = {}
        for i in (0, 1):
            n, odd, entropy = row[6 + 3 * i : 9 + 3 * i]
            own |= {f"chars_{i}": math.floor(row[2] / max(n, 1) * 1024 + 1e-6), f"odd_{i}": math.floor(odd / max(n, 1) * 1024 + 1e-6), f"entropy_{i}": math.floor(entropy * 1024 + 1e-6)}
        steps.append(own)
    klass = [math.floor(2 * math.log2(r[1]) + 1e-9) if r[1] else -1 for r in counted]
    group = [("l", lang) if lang is not None else ("s", "latin" if re.search("[A-Za-z]", text or "") else "other") for _, text, lang, *_ in rows]
    out = []
    for n, row in enumerate(counted):
        outside = []
        for m, value in steps[n].items():
            own = [k for k in range(len(counted)) if counted[k][1] and klass[k] == klass[n]]
            same = [k for k in own if group[k] == group[n]]
            own = same if len(same) >= least else own if len(own) >= least else []
            if row[1] and own:
                s = sorted(steps[k][m] for k in own)
                q1, q2, q3 = (s[-(-len(s) * q // 4) - 1] for q in (1, 2, 3))
                reach = 200 if m.startswith("entropy") else 50
                if not q2 - max(fence * (q2 - q1), reach) <= value <= q2 + max(fence * (q3 - q2), reach):
                    outside.append(m)
        failed = row[1] < 20 or 100 * row[5] > 30 * row[1]
        out.append((row[0], failed, tuple(sorted(outside)), not failed and not outside))
    return sorted(out, key=str)


NAMES = [*Q.COUNTS, *(f"{m}_{i}" for i in (0, 1) for m in ("tokens", "odd", "entropy"))]


def repeating(rng):
    """Texts with windows and lines that repeat, overlap and touch."""
    words = ["aa", "b", "cé", "日本", "d#", "😀"]
    out = []
    for i in range(60):
        run = [rng.choice(words) for _ in range(rng.randint(0, 14))]
        text = " ".join(run * rng.randint(1, 3) + [rng.choice(words) for _ in range(rng.randint(0, 20))])
        out.append((500 + i, text.replace(" ", "\n", rng.randint(0, 3)) + "\n \n\nlast\nlast\n" * (i % 2), rng.choice(["en", "xx", None]), "s", 1))
    return out


@pytest.mark.parametrize("table, size", [(1 << 21, 4 << 20), (10, 50)])
def test_counts_against_brute_force(spark, monkeypatch, odd, odd_rows, clashing, table, size):
    monkeypatch.setattr(Q, "TABLE_TOKENS", table)
    monkeypatch.setattr(Q, "SLICE_BYTES", size)
    rows = odd_rows + repeating(random.Random(3))
    df = spark.createDataFrame(rows, odd.schema).repartition(3)
    pick = lambda d: sorted([(r.doc_id, *(round(r[c], 9) for c in NAMES)) for r in d.collect()], key=str)
    assert pick(Q.measures(df)) == sorted(brute(rows), key=str)
    assert pick(Q.measures(clashing)) == sorted(brute(odd_rows), key=str)


@pytest.mark.parametrize("fence, least", [(2, 4), (6, 8), (1, 1)])
def test_verdicts_against_brute_force(spark, odd, odd_rows, fence, least):
    rows = odd_rows + repeating(random.Random(3))
    df = spark.createDataFrame(rows, odd.schema).repartition(3)
    got = [(r.doc_id, r.base_failed, tuple(sorted(r.outside)), r.kept) for r in Q.judge(df, fence=fence, least=least).collect()]
    want = verdicts(rows, brute(rows), fence, least)
    assert sorted(got, key=str) == want
    assert {w[3] for w in want} == {True, False}


def test_junk_goes_and_clean_texts_stay(spark):
    """Screamed, sign-ridden and foreign-scripted texts among plain ones of the same language."""
    rng = random.Random(2)
    stems = ["water", "house", "people", "under", "little", "read", "light", "strong", "paper", "garden", "the", "of", "and", "to", "which", "found"]
    plain = [(i, " ".join(rng.choice(stems) for _ in range(rng.randint(60, 100))), "en", "s", 1) for i in range(300)]
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in plain[i][1].split()), "en", "s", 1) for i in range(10)]
    junk += [(1010 + i, " ".join(w + rng.choice(["$$$", "%%%"]) for w in plain[i][1].split()), "en", "s", 1) for i in range(10)]
    junk += [(1020 + i, " ".join(chr(0x13000 + rng.randint(0, 900)) * 3 for _ in range(80)), "en", "s", 1) for i in range(5)]
    df = spark.createDataFrame(plain + junk, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in Q.op11(df).filter("kept").collect()}
    assert not kept & {r[0] for r in junk}
    assert len(kept) >= 295


def test_empty(none):
    assert Q.op11(none).collect() == []
