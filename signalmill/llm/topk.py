"""Exact top-k inner products by distributed histogram selection.

Vectors are packed into blocks; a cell is one block of queries against a share of the candidate
blocks, scored by matrix products. Each pass counts scores in equal bins of a range that narrows to
the bin of every query's kth value until a bin is one score wide. A last pass keeps the scores at or
above that value. A cell never reports bins below its own kth value, nor more than k ties, since
those cannot be among the k best.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from signalmill.plans.runtime import written

BINS = 256
QUERIES = 1024
ROWS = 2048
PER_CELL = 8


def integer_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors null or with null or non-finite components go."""
    ok = "vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(double(x)) = double('infinity'))"
    return vectors.select("vec_id", "embedding").filter(ok).select(F.col("vec_id").cast("bigint"), F.expr(f"transform(embedding, x -> floor({scale} * double(x)))").alias("v"))


def _blocks(table: DataFrame, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors of one length; body is int64, vector after vector."""

    def kernel(batches):
        made, base = 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            lists, ids, own = batch.column(1), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends, out = np.cumsum(sizes), []
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                for cut in range(0, len(at), rows):
                    pick = at[cut : cut + rows]
                    body = flat[(ends[pick] - dim)[:, None] + np.arange(dim)].astype(np.int64)
                    norm = float(np.sqrt((body.astype(np.float64) ** 2).sum(axis=1)).max())
                    out.append((base + made, int(dim), len(pick), own[pick].tobytes(), ids[pick].tobytes(), body.tobytes(), norm))
                    made += 1
            if out:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["block", "dim", "n", "rows", "ids", "body", "norm"]), preserve_index=False)

    return table.select("vec_id", "v", "row").mapInArrow(kernel, "block bigint, dim bigint, n bigint, rows binary, ids binary, body binary, norm double")


def _product(queries: np.ndarray, others: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products; floats where all sums stay within their integers, else 64-bit integers."""
    if bound < 1 << 24:
        return (queries.astype(np.float32) @ others.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (queries.astype(np.float64) @ others.astype(np.float64).T).astype(np.int64)
    return queries @ others.T


def _cells(queries: DataFrame, others: DataFrame, parts: int, work, schema: str) -> DataFrame:
    """Run ``work(block of queries, blocks of candidates)`` per cell; a cell holds a bounded number of blocks."""
    groups = queries.select(F.col("block").alias("q"), "dim")
    right = others.join(groups, "dim").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))
    left = queries.withColumn("q", F.col("block")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    return left.groupBy("q", "part").cogroup(right.groupBy("q", "part")).applyInPandas(work, schema)


def _unpack(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    body = np.frombuffer(block.body, np.int64).reshape(block.n, block.dim)
    return np.frombuffer(block.rows, np.int64), np.frombuffer(block.ids, np.int64), body


def _scored(query, others: pd.DataFrame, bound: float):
    """Per candidate block: its rows and ids, the scores, and the places where a row meets itself."""
    rows, _, body = _unpack(query)
    for block in others.itertuples():
        theirs, ids, vectors = _unpack(block)
        _, own, at = np.intersect1d(rows, theirs, assume_unique=True, return_indices=True)
        yield theirs, ids, _product(body, vectors, bound), own, at


def _histogram(bound: int, width: int, span: int, bins: int):
    """Counts of scores in [low, low + span), from the highest bin down to where a query's need is met."""

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        counts, query = None, None
        for query in left.itertuples():
            lows, needs = np.asarray(query.lows), np.asarray(query.needs)
            counts = np.zeros(query.n * bins, np.int64)
            first = np.arange(query.n)[:, None] * bins
            for _, _, scores, own, at in _scored(query, right, bound):
                scores -= lows[:, None]
                inside = (scores >= 0) & (scores < span)
                inside[own, at] = False
                counts += np.bincount((first + scores // width)[inside], minlength=len(counts))
        if counts is None:
            return pd.DataFrame({"q": [], "i": [], "bin": [], "n": []})
        counts = counts.reshape(-1, bins)
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        i, b = np.nonzero((counts > 0) & (above < needs[:, None]))
        return pd.DataFrame({"q": np.full(len(i), query.block), "i": i, "bin": b, "n": counts[i, b]})

    return work


def _above(bound: int, k: int):
    """The scores at or above each query's kth value, at most k of a query and cell."""

    def best(found: list) -> list:
        i, score, ids, rows = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((rows, ids, -score, i))
        i = i[order]
        keep = order[np.arange(len(i)) - np.searchsorted(i, i) < k]
        return [tuple(np.concatenate(x)[keep] for x in zip(*found))]

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for query in left.itertuples():
            rows, names, _ = _unpack(query)
            found: list = []
            for theirs, ids, scores, own, at in _scored(query, right, bound):
                take = scores >= np.asarray(query.lows)[:, None]
                take[own, at] = False
                i, j = np.nonzero(take)
                found = best([*found, (i, scores[i, j], ids[j], theirs[j])])
            for i, score, ids, theirs in found:
                out.append(pd.DataFrame({"query_row": rows[i], "query_id": names[i], "vec_id": ids, "row": theirs, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_row", "query_id", "vec_id", "row", "score")})

    return work


def top_k(vectors: DataFrame, asked: Column, k: int = 20, per_block: int = ROWS, per_query: int = QUERIES, bins: int = BINS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each row where ``asked`` over all other rows.

    ``vectors`` has vec_id and v, an array of whole numbers. A row is left out only against itself,
    so the copies of a repeated row score each other. Scores tie to the smaller vec_id. Vectors of
    different lengths have no score. Fewer candidates than k: all of them. No queries or no
    candidates: an empty result. Sums beyond 64 bits wrap around.
    """
    table, _ = written(vectors.select("vec_id", "v", asked.alias("asked")).withColumn("row", F.monotonically_increasing_id()))
    rest, _ = written(_blocks(table, per_block))
    norm, blocks = rest.agg(F.max("norm"), F.count("*")).first()
    chosen = table.filter("asked")
    packed, _ = written(_blocks(chosen.repartition(-(-chosen.count() // per_query) or 1, "row"), per_query))
    bound = int(min((norm or 0.0) ** 2 * (1 + 1e-9) + 1, float(1 << 61)))
    parts = -(-blocks // PER_CELL) or 1
    width = -(-(2 * bound + 1) // bins)
    span = width * bins
    full = lambda x: F.array_repeat(F.lit(x).cast("bigint"), F.col("n").cast("int"))
    state = packed.select("block", full(-bound).alias("lows"), full(k).alias("needs"))
    while True:
        sides = packed.join(state, "block")
        counts = _cells(sides, rest, parts, _histogram(bound, width, span, bins), "q bigint, i int, bin int, n bigint")
        counts = counts.groupBy("q", "i", "bin").agg(F.sum("n").alias("n"))
        ranked = counts.withColumn("cum", F.sum("n").over(Window.partitionBy("q", "i").orderBy(F.desc("bin"))))
        kept = state.select(F.col("block").alias("q"), F.posexplode(F.arrays_zip("lows", "needs")).alias("i", "s")).select("q", "i", "s.lows", "s.needs")
        hit = ranked.join(kept, ["q", "i"]).filter("cum >= needs").groupBy("q", "i").agg(F.max("bin").alias("bin"), F.max_by(F.expr("needs - cum + n"), "bin").alias("left"))
        moved = kept.join(hit, ["q", "i"], "left").select(
            "q", F.struct("i", F.coalesce(F.col("lows") + F.col("bin") * F.lit(width), "lows").alias("lows"), F.coalesce("left", "needs").alias("needs")).alias("s")
        )
        state, _ = written(moved.groupBy("q").agg(F.array_sort(F.collect_list("s")).alias("s")).select(F.col("q").alias("block"), F.col("s.lows").alias("lows"), F.col("s.needs").alias("needs")))
        if width == 1:
            break
        span, width = width, -(-width // bins)
    best = _cells(packed.join(state, "block"), rest, parts, _above(bound, k), "query_row bigint, query_id bigint, vec_id bigint, row bigint, score bigint")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(embeddings: DataFrame) -> DataFrame:
    """The query: every vec_id divisible by 20 against all other rows."""
    return top_k(integer_vectors(embeddings), F.col("vec_id") % 20 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
