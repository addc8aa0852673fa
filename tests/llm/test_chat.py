import hashlib
import random

import pytest
from hypothesis import given, strategies as st

from signalmill.llm import chat as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def digests(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text or ""))
    out = set()
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (*t[:4], C.render(t[3], t[4])))
        loss = "".join(t[4] for t in turns if t[3] == "assistant")
        said = "".join(f"{t[3]}\n{t[4]}\n" for t in turns)
        out.add((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def make_rows():
    rng = random.Random(3)
    bits = ["</turn>", "<turn user>", "\\", "\n", "\\/turn>", "### Assistant:", "<", ">", "é😀", "word", " ", "\\\\", "</turn"]
    rows = []
    for conv in range(12):
        for turn in range(rng.randint(1, 40)):
            role = "system" if turn == 0 and conv % 3 == 0 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn, role, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))))
    rows += [(20, t, ("user", "assistant")[t % 2], f"turn {t} " * 5) for t in range(3000)]  # one hot conversation
    rows += [(21, 0, "user", "long " * 5000), (21, 1, "assistant", "longer " * 5000), (21, 2, "user", "short")]
    rows += [(22, None, "user", "no turn"), (22, 1, None, None), (22, 1, "assistant", None), (22, 1, "assistant", "twice"), (22, 1, "assistant", "twice"), (22, 2, "odd>role\n<turn \\", "x")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "still")]
    return rows


def test_read_back(spark):
    rows = make_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = digests(rows) | digests([(-7, i, r, C.SAMPLE) for i, r in enumerate(("user", "assistant"))])
    got = C.op8(df).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("budget, history", [(60, 20), (200, 0), (1024, 192)])
def test_windows(spark, budget, history):
    rows = make_rows()
    windows = C.format_windows(spark.createDataFrame(rows, SCHEMA).repartition(6), budget, history).collect()
    for conv in {r[0] for r in rows}:
        own = sorted((w for w in windows if w["conv_id"] == conv), key=lambda w: w["first_turn"])
        turns, firsts, seen = [], set(), 0
        for w in own:
            parts = C.parse(w["text"])
            assert w["first_turn"] == seen and (w["tokens"] <= budget or w["over_budget"])
            assert not w["over_budget"] or len(parts) - w["repeats"] == 1
            new = parts[w["repeats"] :]
            seen += len(new)
            turns += [p[:2] for p in new]
            assert [(s["start"], s["end"]) for s in w["loss"]] == [p[2:] for p in new if p[0] == "assistant"]
            firsts.add(parts[0][:2])
            if w["repeats"]:
                tail = [p[:2] for p in parts[: w["repeats"]]]
                before = turns[: len(turns) - len(new)]
                system = tail[:1] if before[0][0] == "system" else []
                tail = tail[len(system) :]
                assert not system or system[0] == before[0]
                assert tail == before[len(before) - len(tail) :]
        if turns[0][0] == "system":
            assert firsts == {turns[0]}


def test_regions_are_split_alike(spark):
    """The hot conversation spans many regions and keeps its history over their edges."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t} " * 5) for t in range(2000)]
    windows = sorted(C.format_windows(spark.createDataFrame(rows, SCHEMA), 100, 40).collect(), key=lambda w: w["first_turn"])
    assert all(w["repeats"] >= 1 for w in windows[1:])


@given(st.text(alphabet="\\<>/turn \nabé", max_size=60), st.text(alphabet="\\<> \nxé", max_size=10))
def test_escapes(text, role):
    assert C.unescape(C.escape(text)) == text
    assert [p[:2] for p in C.parse(C.render(role, text) * 2)] == [(role, text)] * 2
    assert C.CLOSE not in C.escape(text) and C.OPEN not in C.escape(text)


def test_empty(spark):
    assert [r["conv_id"] for r in C.op8(spark.createDataFrame([], SCHEMA)).collect()] == [-7]
    assert C.format_windows(spark.createDataFrame([], SCHEMA)).collect() == []
