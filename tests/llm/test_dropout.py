import pytest
from hypothesis import given, settings, strategies as st

from signalmill.llm import dropout as D
from signalmill.llm.vocab import default_path

PATH = default_path("piece_bpe_32k.model")
TEXT = st.text(alphabet=st.one_of(st.sampled_from("abcdetnrs  \n▁é日"), st.characters(exclude_categories=["Cs"])), max_size=80)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4), st.sampled_from([0.0, 0.1, 0.5, 1.0]))
def test_lossless_and_as_the_agenda(texts, rate):
    vocab = D.vocabulary(PATH)
    coder = D.Encoder(vocab, rate)
    got = coder.encode(texts, list(range(len(texts))))
    assert [coder.decode(i) for i in got] == texts
    for text, seed, ids in zip(texts, range(len(texts)), got):
        words = coder.split.findall(" " + text) if text else []
        assert ids == [i for w in words for i in D.merge_one(w, seed, rate, vocab)]


@settings(max_examples=100, deadline=None)
@given(TEXT.filter(lambda t: "▁" not in t and "\x00" not in t))
def test_no_dropout_is_the_vocabularys_own(text):
    import sentencepiece

    coder = D.Encoder(D.vocabulary(PATH), 0.0)
    assert coder.encode([text], [1])[0] == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text)


def test_documents(odd, odd_rows, clashing, none):
    got = D.op3(odd).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["ids"])) for r in got) == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_ids"]) for r in got)
    assert len(got) == len(odd_rows) and all(r["lossless"] for r in got)
    again = D.op3(clashing).collect()
    assert sorted(map(tuple, ((r["doc_id"] or -1, tuple(r["ids"])) for r in got))) == sorted(map(tuple, ((r["doc_id"] or -1, tuple(r["ids"])) for r in again)))
    assert D.op3(none).collect() == []


def test_seeds_and_rates_vary(odd):
    ids = lambda **how: {r["doc_id"]: tuple(r["ids"]) for r in D.encode_dropout(odd, **how).collect()}
    plain, first, second = ids(rate=0.0), ids(seed=1), ids(seed=2)
    assert first == ids(seed=1) and first != second and first != plain
    assert sum(map(len, first.values())) > sum(map(len, plain.values()))
    assert len({i for i, x in first.items() if x == second[i]}) < len(first) / 2


def test_dropped_share():
    n = sum(D.skipped(D.word_key(f"w{i}", 3), i % 9, i, 0.25) for i in range(20000))
    assert abs(n / 20000 - 0.25) < 0.02


def test_every_occurrence_is_cut_on_its_own(spark):
    """One word often, in one document and in many: as the agenda, and with far more than a few segmentations."""
    vocab = D.vocabulary(PATH)
    word = "internationalisation"
    texts = [" ".join([word] * 200), "x" * 60 + " " + word, "", "Ünï çode ▁  日本 😀 " * 3] + [word] * 100
    coder = D.Encoder(vocab, 0.1)
    got = coder.encode_each(texts, list(range(len(texts))))
    for seed, (text, ids) in enumerate(zip(texts, got)):
        words = coder.split.findall(" " + text) if text else []
        assert ids == [i for n, w in enumerate(words) for i in D.merge_one(w, D.occurrence_seed(seed, n), 0.1, vocab)]
        assert coder.decode(ids) == text
    rows = [(i, word) for i in range(300)] + [(1000, " ".join([word] * 300))]
    out = {r["doc_id"]: r for r in D.encode_dropout(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(r["lossless"] for r in out.values())
    assert len({tuple(out[i]["ids"]) for i in range(300)}) > 8
    one = [tuple(D.merge_one(w, D.occurrence_seed(5, n), 0.1, vocab)) for n, w in enumerate([" " + word] * 300)]
    assert len(set(one)) > 8


def test_only_occurrences_that_lose_a_merge_are_merged_again(monkeypatch):
    """Of words of one piece each, the share that keeps all its merges costs no merging."""
    vocab = D.vocabulary(PATH)
    words = [w for w in ("water", "people", "little", "house", "garden") if " " + w in vocab.ids]
    text, merged, plain = " ".join(words * 400), [], D._merge_all
    monkeypatch.setattr(D, "_merge_all", lambda some, *rest: merged.extend(some) or plain(some, *rest))
    got = D.Encoder(vocab, 0.1).encode_each([text], [3])[0]
    expected = [D.merge_one(" " + w, D.occurrence_seed(3, n), 0.1, vocab) for n, w in enumerate(words * 400)]
    assert got == [i for ids in expected for i in ids]
    lost = sum(ids != [vocab.ids[" " + w]] for ids, w in zip(expected, words * 400))
    assert words and lost <= len(merged) < 0.6 * len(expected)


def test_words_of_blanks_marks_and_unknown_characters():
    vocab = D.vocabulary(PATH)
    texts = ["a ", "  ", "", "▁ ▁a a▁", "\x00 b\x00c", "日本語 😀😀 é", "x" * 70 + " y", "q\n\tq \r"]
    for rate in (0.0, 0.3, 1.0):
        coder = D.Encoder(vocab, rate)
        got = coder.encode_each(texts, list(range(len(texts))))
        for seed, (text, ids) in enumerate(zip(texts, got)):
            words = coder.split.findall(" " + text) if text else []
            assert ids == [i for n, w in enumerate(words) for i in D.merge_one(w, D.occurrence_seed(seed, n), rate, vocab)]
            assert coder.decode(ids) == text
