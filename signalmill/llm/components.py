"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from signalmill.plans.runtime import discard, written


def connected(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of any orderable type -> (node, component): the smallest node reachable.

    Edges are kept as (hi, lo) with hi > lo. A large star hangs every larger neighbour of a node on
    the smallest one, a small star hangs the smaller ones there, until the edges are stars around
    the smallest node of each component; the number of edges never grows. Each step is an
    aggregation with partial sums and a join of one row per node, whose hot side adaptive execution
    may split; files say little of the number of nodes, so the joins are told not to broadcast. Every round is written to the shared folder and the one before is deleted. The
    result reads the last round's table, which stays. Nulls and loops are dropped; an empty input
    gives an empty result.
    """
    spark = edges.sparkSession
    a, b = F.col("a"), F.col("b")
    stars, path = written(edges.filter(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    mark = _mark(stars)
    while mark[0]:
        least = (
            stars.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
            .unionByName(stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
            .groupBy("u")
            .agg(F.min("v").alias("v"))
            .select(F.col("u").alias("lo"), F.least("u", "v").alias("m"))
        )
        large = stars.join(least.hint("merge"), "lo").select("hi", F.col("m").alias("lo"))  # as many rows as before, some alike
        small = large.join(large.groupBy("hi").agg(F.min("lo").alias("m")).hint("merge"), "hi")
        small = small.select(F.explode(F.array(F.struct(F.col("hi").alias("x"), "m"), F.struct(F.col("lo").alias("x"), "m"))).alias("e"))
        small = small.select(F.col("e.x").alias("hi"), F.col("e.m").alias("lo")).filter("hi <> lo").distinct()
        after, new = written(small)
        discard(spark, path)
        before, mark = mark, _mark(after)
        stars, path = after, new
        if mark == before:
            break
    nodes = stars.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.unionByName(stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def forest(classes: DataFrame) -> DataFrame:
    """(a, b): a result of ``connected`` as edges. Further edges join them in few rounds, a round being many exchanges of the driver's."""
    return classes.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _mark(stars: DataFrame) -> tuple:
    """Number and order-free checksum of the edges: equal marks, equal edges."""
    return tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first())
