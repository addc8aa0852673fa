"""What grows with the corpus does not go through the driver whole; fingerprints take part in the near-dedup stage."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from signalmill.llm import collocations as C, simhash as S


def test_links_are_joined_without_broadcasts(spark, monkeypatch):
    plans, keep = [], S.written
    monkeypatch.setattr(S, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    fps = spark.createDataFrame([(x,) for x in (0, 1, 3, 7, 1 << 40, -1)], "fp bigint")
    got = {r["fp"]: r["root"] for r in S.link(fps).collect()}
    assert got == {0: 0, 1: 0, 3: 0, 7: 0, 1 << 40: 0}
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


def test_sketch_comes_block_by_block(spark, monkeypatch):
    state = spark.createDataFrame([(1, 5, 0, 0, 0, 2), (2, 5, 6, 0, 0, 3), (3, 5, 6, 7, 0, None)], "len int, w1 bigint, w2 bigint, w3 bigint, w4 bigint, reach int")

    def whole(self):
        raise AssertionError("the whole sketch at once")

    monkeypatch.setattr(type(state), "collect", whole)
    sketch = C._sketch(state, 2)
    names = np.array([5], np.uint64), np.array([6], np.uint64)
    assert C._reach(sketch, C._name([names[0]])).tolist() == [2] and C._reach(sketch, C._name(list(names))).tolist() == [3]


def test_fingerprints_propose_in_the_near_dedup_stage(spark, monkeypatch):
    """With the prefixes taken away, near copies go by their fingerprints alone."""
    rng = random.Random(9)
    text = [rng.choice("abcdefgh") + str(rng.randint(0, 500)) for _ in range(600)]
    rows = [(1, " ".join(text)), (2, " ".join(text + ["end"])), (3, " ".join(reversed(text)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = S.prefixes
    monkeypatch.setattr(S, "prefixes", lambda *a: plain(*a).withColumn("prefix", F.array().cast("array<bigint>")))
    assert sorted(r["doc_id"] for r in P.drop_near_copies(spark, docs, "").collect()) == [1, 3]


def test_links_found_are_not_sought_again(spark, monkeypatch):
    """Exchanges leave threads and plans at the driver: later components begin with the classes that are known."""
    from signalmill.llm import components

    plans, keep = [], components.written

    def noted(df):
        table = keep(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return table

    monkeypatch.setattr(components, "written", noted)
    chain = [(1 << k) - 1 for k in range(0, 60, 3)]
    got = {r["fp"]: r["root"] for r in S.link(spark.createDataFrame([(x,) for x in chain], "fp bigint")).collect()}
    assert got == dict.fromkeys(chain, 0)
    assert len(plans) <= 9 and sum(plans) <= 60
