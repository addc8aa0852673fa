import random

import numpy as np
import pytest

from signalmill.llm import toxicity as T

BAD = ["vile", "nasty", "rotten", "foul"]


def corpus(seed, n=900):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 200))]
        toxic, junk = i % 10 == 0, i % 7 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD).upper() + rng.choice([",", "", "."]))
        if junk:
            words = [w + "***" for w in words]
        docs.append((i, " ".join(words), "en", f"s{i % 5}", 1))
        noisy = toxic or rng.random() < 0.04
        labels.append((i, 0 if junk else 1, int(noisy)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(1)
    labels += [(5, None, 1), (None, 1, 1), (99999, 1, 1), (7, 0, None)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(spark, tables):
    """Train on ids below 600, judge the rest by what was planted, not by the noisy labels."""
    docs, labels = tables
    places, models = T.train(docs, labels.filter("doc_id < 600"))
    got = docs.filter("doc_id >= 600").select("doc_id", T.scorer(places, models)("text").alias("c")).collect()
    said = [(r["c"][1] > 0.5) == (r["doc_id"] % 10 == 0) for r in got]
    quality = [(r["c"][0] > 0.5) == (r["doc_id"] % 7 != 0) for r in got]
    assert np.mean(said) > 0.98 and np.mean(quality) > 0.98
    assert {w.decode() for w in places} >= set(BAD) and len(models[1][0]) == len(models[0][0]) + 1


def test_stage_keeps_rows(spark, tables, odd, clashing):
    docs, labels = tables
    kept = {r["doc_id"] for r in T.drop_toxic(docs, labels).collect()}
    assert kept == {i for i in range(900) if i % 10}
    out = T.drop_toxic(clashing, labels)
    assert set(out.columns) == set(clashing.columns)
    assert out.filter("doc_id is null").count() == 2 and out.filter("doc_id = 211").count() == 2


def test_without_labels_or_documents(tables, odd, none):
    docs, labels = tables
    assert T.drop_toxic(odd, labels.limit(0)).count() == odd.count()
    assert T.op5(none, labels).collect() == []
    assert T.drop_toxic(docs, labels.filter("toxic = 0")).count() == 900


def test_the_sample_is_bounded(tables):
    assert T._sample(tables[1], T.CATEGORIES, 50).count() == 50
