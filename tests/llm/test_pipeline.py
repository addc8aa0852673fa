"""All stages of the corpus pipeline against brute force, on small tables with every odd case."""

import numpy as np

import corpus_pipeline as C
from signalmill.llm import toxicity
from signalmill.llm.vocab import byte_encoder, default_path
from test_lines import brute as without_lines
from test_toxicity import corpus


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def one_of_each(rows):
    """The smallest doc_id of each class of texts that are 0.8 alike; rows without one stay."""
    sets = {}
    for doc, text, _ in rows:
        if doc is not None:
            sets.setdefault(doc, shingles(text))
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept, out = {i for i in ids if find(i) == i}, []
    for doc, text, n in rows:
        if doc is None or doc in kept:
            out.append((doc, text, n))
            kept.discard(doc)
    return out


def test_run(spark, tmp_path, odd_rows):
    docs, labels = corpus(3, 240)
    docs = [(i, t + "\nAll rights reserved by the archive.", lang, f"s{i % 14}", 1) for i, t, lang, _, _ in docs]
    words = docs[11][1].split(" ")
    for k in range(6):  # near copies: a word changed, added or dropped, words in front, words behind
        edited = [words[:50] + ["changed"] + words[51:], words[:20] + ["new"] + words[20:], words[:30] + words[31:], ["in", "front"] + words, words + ["behind"] * 2, words]
        docs.append((5000 + k, " ".join(edited[k]), "en", "s3", 1))
    docs += [(6000 + d if d is not None else None, t, lang, s, n) for d, t, lang, s, n in odd_rows if d is None or d >= 100]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = C.run(spark, str(tmp_path)).collect()

    kept = toxicity.drop_toxic(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    ids = {r["doc_id"] for r in kept}
    assert not ids & {i for i in range(240) if i % 10 == 0} and ids >= {i for i in range(240) if i % 10}  # toxic ones, and only these, are gone
    lined = without_lines([tuple(r) for r in kept], 10)
    final = one_of_each(lined)
    assert sum(5000 <= (d or 0) < 5006 for d, *_ in final) == 0 and 11 in {d for d, *_ in final}
    encode = byte_encoder(default_path())
    want = sorted(((doc, [*encode(text or "").tolist(), 2]) for doc, text, _ in final), key=str)

    pieces, filled, made = {}, {}, []
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
        if r["doc_id"] is None:
            made.append((None, np.frombuffer(r["ids"], "<u4").tolist()))
        else:
            pieces.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert max(filled.values()) <= 1024
    made += [(doc, [x for _, ids in sorted(parts) for x in ids]) for doc, parts in pieces.items()]
    assert sorted(made, key=str) == want


def test_empty_tables(spark, tmp_path, none):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []
