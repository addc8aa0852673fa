"""Toxicity by a classifier chain.

The label columns are the chain's categories, in the given order. Each category has a logistic
regression over word features; the probabilities of earlier categories are features of the later
ones. In training these are out-of-fold predictions, so a later model sees what it will see in use.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from signalmill.llm.names import unused
from signalmill.plans.runtime import written

CATEGORIES = ("quality", "toxic")
SAMPLE = 20_000  # labelled documents that the chain is trained on, at most
WORDS = 256  # word features
FOLDS = 3
EDGES = b".,;:!?\"'()[]{}<>*#$%&@-_/\\|+=~`^"
SIGNIFICANT = 30.0  # least chi-square of a word feature
THRESHOLD = 0.5


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, without ASCII marks around them."""
    return [w for w in (x.strip(EDGES) for x in text.encode().lower().split()) if w] if text else []


def features(text: str | None, places: dict[bytes, int]) -> np.ndarray:
    """Log counts of the chosen words, then the shares of bytes outside words and of repeated words."""
    out, words = np.zeros(len(places) + 2), tokens(text)
    for word in words:
        at = places.get(word)
        if at is not None:
            out[at] += 1
    out[: len(places)] = np.log1p(out[: len(places)])
    if words:
        size = len(text.encode())
        out[-2] = 1 - (sum(map(len, words)) + len(words)) / (size + 1)
        out[-1] = 1 - len(set(words)) / len(words)
    return out


def _sample(labels: DataFrame, categories, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids, drawn by a hash of the id, with 0/1 labels and folds."""
    known = labels.filter(" and ".join(f"{c} is not null" for c in ("doc_id", *categories)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = min(1.0, 1.1 * bound / max(1, known.count()))
    few = known.filter(draw < int(share * (1 << 30)) + 1).orderBy(draw, "doc_id").limit(bound)
    return few.select(F.col("doc_id").cast("bigint").alias("_id"), *[(F.col(c) > 0).cast("int").alias(f"y{i}") for i, c in enumerate(categories)], F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).alias("fold"))


def _choose(sample: DataFrame, categories, count: int) -> list[str]:
    """The words whose presence goes most with a category, by chi-square."""
    plain = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    words = F.array_distinct(F.transform(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: F.btrim(w, F.lit(EDGES.decode()))))
    seen = sample.select(F.filter(words, lambda w: w != "").alias("w"), *[f"y{i}" for i in range(len(categories))])
    n, *positive = seen.agg(F.count("*"), *[F.sum(f"y{i}") for i in range(len(categories))]).first()
    by_word = seen.select(F.explode("w").alias("word"), *[f"y{i}" for i in range(len(categories))]).groupBy("word").agg(F.count("*").alias("n"), *[F.sum(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    score = F.lit(0.0)
    for i, p in enumerate(positive):
        rate = (p or 0) / max(n, 1)
        if 0 < rate < 1:
            expected = F.col("n") * rate
            score = F.greatest(score, (F.col(f"y{i}") - expected) ** 2 / (expected * (1 - rate) * (1 - F.col("n") / (n + 1.0))))
    best = by_word.filter("n >= 5").withColumn("score", score).filter(F.col("score") >= SIGNIFICANT)
    return [r["word"] for r in best.orderBy(F.desc("score"), "word").limit(count).collect()]


def _fit(rows: DataFrame, label: str, width: int) -> tuple[np.ndarray, float]:
    """Weights and intercept; a constant where there is one class only."""
    n, p = rows.agg(F.count("*"), F.sum(label)).first()
    if not n or not p or p == n:
        return np.zeros(width), -20.0 if not p else 20.0
    model = LogisticRegression(featuresCol="features", labelCol=label, regParam=1e-3, maxIter=30).fit(rows)
    return model.coefficients.toArray(), float(model.intercept)


def _probability(x: np.ndarray, model: tuple[np.ndarray, float]) -> float:
    return float(1 / (1 + np.exp(-np.clip(x @ model[0] + model[1], -30, 30))))


def _held_out(x: str, model: tuple[np.ndarray, float]):
    """``_probability`` as a column over an array of features."""
    terms = F.zip_with(x, F.array(*[F.lit(float(w)) for w in model[0]]), lambda a, b: a * b)
    score = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) + F.lit(model[1])
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score))))


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, bound: int = SAMPLE, count: int = WORDS) -> tuple[dict[bytes, int], list]:
    """(word places, one model per category) learned from at most ``bound`` labelled documents.

    Rows with a null label, labels without a document and documents without a label are not used.
    """
    few = F.broadcast(_sample(labels, categories, bound))  # bounded by ``bound`` rows of a few numbers
    sample, _ = written(docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text").join(few, "_id"))
    spread = -(-bound // 256)  # small parts keep the batches of feature rows small
    places = {w.encode(): i for i, w in enumerate(_choose(sample, categories, count))}
    vector = F.udf(lambda text: features(text, places).tolist(), "array<double>", useArrow=True)
    rows, _ = written(sample.repartition(spread, "_id").select("fold", *[f"y{i}" for i in range(len(categories))], vector("text").alias("x")))
    models = []
    for i in range(len(categories)):
        width, ready = len(places) + 2 + i, rows.withColumn("features", array_to_vector("x"))
        models.append(_fit(ready, f"y{i}", width))
        if i + 1 < len(categories):
            folds = [_fit(ready.filter(F.col("fold") != f), f"y{i}", width) for f in range(FOLDS)]
            held = F.element_at(F.array(*[_held_out("x", model) for model in folds]), F.col("fold").cast("int") + 1)
            rows, _ = written(rows.withColumn("x", F.concat("x", F.array(held))))
    return places, models


def scorer(places: dict[bytes, int], models: list):
    """Pandas UDF: text -> the probabilities of the categories along the chain."""

    @F.pandas_udf("array<double>")
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            x = features(text, places)
            for model in models:
                x = np.append(x, _probability(x, model))
            out.append(x[-len(models) :])
        return pd.Series(out)

    return score


def drop_toxic(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose last category, toxicity, has a probability over ``threshold``.

    A null or empty text has no words and stays unless the bare model says otherwise; all columns
    pass through unchanged; an empty table of labels rejects nothing.
    """
    chain = unused(docs, "_chain")
    scored = docs.withColumn(chain, scorer(*train(docs, labels, categories))("text"))
    return scored.filter(F.element_at(chain, -1) <= threshold).drop(chain)


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query: every document's probabilities and verdict."""
    chain = docs.select(F.col("doc_id"), scorer(*train(docs, labels))("text").alias("c"))
    return chain.select("doc_id", F.col("c")[0].alias("p_quality"), F.col("c")[1].alias("p_toxic"), (F.col("c")[1] > THRESHOLD).alias("toxic"))
