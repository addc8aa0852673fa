"""Exact duplicates by composable polynomial fingerprints.

The fingerprint of bytes b1..bn is the polynomial sum of (b + 1) * base^(n - i) under two 31-bit
primes. A chunk acts on a prefix as h -> h * shift + value with shift = base^length, so chunks can
be hashed anywhere and combined in order: (s1, h1) then (s2, h2) is (s1 * s2, h1 * s2 + h2).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from signalmill.plans.runtime import written

PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_000_003, 998_244_353)
CHUNK = 1 << 16
HUGE = 1 << 22
WHITE = b" \t\n\x0b\x0c\r"


def powers(primes=PRIMES) -> list[np.ndarray]:
    """base^(CHUNK - 1) .. base^0 for each prime."""
    out = []
    for base, prime in zip(BASES, primes):
        row = [1]
        for _ in range(CHUNK - 1):
            row.append(row[-1] * base % prime)
        out.append(np.array(row[::-1], np.uint64))
    return out


def fold(data: bytes, tables: list[np.ndarray], primes=PRIMES) -> tuple[int, int]:
    """The polynomials of ``data``, chunk by chunk."""
    state = [0, 0]
    for at in range(0, len(data), CHUNK):
        part = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - at), at).astype(np.uint64) + np.uint64(1)
        for i, (base, prime, table) in enumerate(zip(BASES, primes, tables)):
            value = int(np.dot(part, table[CHUNK - len(part) :]))
            state[i] = (state[i] * pow(base, len(part), prime) + value) % prime
    return state[0], state[1]


def _row(batch_at: int) -> int:
    return (TaskContext.get().partitionId() << 36) + batch_at


def _digests(docs: DataFrame, huge: int, primes) -> DataFrame:
    """(row, doc_id, points, len, f1, f2, sha) of every row; huge texts are hashed chunk by chunk over all tasks."""
    fields = "row bigint, doc_id bigint, points bigint, len bigint, f1 bigint, f2 bigint, sha string, no int, chunk binary"
    names = [f.split()[0] for f in fields.split(", ")]

    def kernel(batches):
        tables, seen = powers(primes), 0
        for batch in batches:
            out = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                data = text.encode().translate(None, WHITE)
                start = (_row(seen), doc_id, len(text), len(data))
                sha = hashlib.sha256(data).hexdigest()
                seen += 1
                if len(data) <= huge:
                    rows = [(*start, *fold(data, tables, primes), sha, None, None)]
                else:
                    rows = [(*start, None, None, sha, i, data[at : at + huge]) for i, at in enumerate(range(0, len(data), huge))]
                for row in rows:
                    for col, value in zip(out, row):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    kinds = [pa.int64()] * 6 + [pa.string(), pa.int32(), pa.binary()]
    mapped, _ = written(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(kernel, fields))
    small = mapped.filter("no is null").drop("no", "chunk")

    def acts(batches):
        tables = powers(primes)
        for batch in batches:
            data = batch.column(2).to_pylist()
            values = [fold(x, tables, primes) for x in data]
            shifts = [[pow(b, len(x), p) for x in data] for b, p in zip(BASES, primes)]
            cols = [pa.array(c, pa.int64()) for c in (*shifts, [v[0] for v in values], [v[1] for v in values])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["row", "no", "s1", "s2", "h1", "h2"])

    parts = mapped.filter("no is not null")
    acted = parts.select("row", "no", "chunk").repartition("row", "no").mapInArrow(acts, "row bigint, no int, s1 bigint, s2 bigint, h1 bigint, h2 bigint")
    steps = F.array_sort(F.collect_list(F.struct("no", "s1", "s2", "h1", "h2")))
    whole = acted.groupBy("row").agg(steps.alias("steps"))
    combine = lambda i: F.aggregate("steps", F.lit(0).cast("bigint"), lambda h, x: (h * x[f"s{i}"] + x[f"h{i}"]) % F.lit(primes[i - 1]))
    whole = whole.select("row", combine(1).alias("f1"), combine(2).alias("f2"))
    facts = parts.filter("no = 0").select("row", "doc_id", "points", "len", "sha").join(whole, "row")
    return small.unionByName(facts.select(small.columns))


def _chunks(docs: DataFrame, primes) -> DataFrame:
    """(f1, f2, len, data): the normalised texts with their fingerprints."""

    def kernel(batches):
        tables = powers(primes)
        for batch in batches:
            data = [(t or "").encode().translate(None, WHITE) for t in batch.column(0).to_pylist()]
            values = [fold(x, tables, primes) for x in data]
            cols = [pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64()), pa.array(list(map(len, data)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(data, pa.binary())], ["f1", "f2", "len", "data"])

    return docs.select("text").mapInArrow(kernel, "f1 bigint, f2 bigint, len bigint, data binary")


def exact_groups(docs: DataFrame, huge: int = HUGE, primes=PRIMES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ASCII white space; a null text is empty. Of a
    group the row with the most code points stays, then the smallest doc_id, then the first row
    read, so exactly one row of a group is kept even where rows or ids repeat. A null doc_id comes
    last in ties. Rows with equal fingerprints and lengths are compared chunk by chunk: a chunk
    whose smallest and largest content over the group differ shows a collision, and the colliding
    group is split by its texts' SHA-256.
    """
    key = ["f1", "f2", "len"]
    rows, _ = written(_digests(docs, huge, primes))
    multi, _ = written(rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    texts = _chunks(docs, primes).join(multi.filter("len > 0"), key, "left_semi")
    starts = F.sequence(F.lit(1).cast("bigint"), F.col("len"), F.lit(CHUNK).cast("bigint"))
    pieces = texts.select(*key, "data", F.explode(starts).alias("at")).select(*key, "at", F.substring("data", F.col("at").cast("int"), F.lit(CHUNK)).alias("part"))
    spans = pieces.groupBy(*key, "at").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    clash = spans.filter("lo <> hi").select(*key).distinct().withColumn("clash", F.lit(True))
    of = multi.join(clash, key, "left")
    marked = rows.join(of.withColumn("multi", F.lit(True)), key, "left").withColumn("sub", F.when(F.col("clash"), F.col("sha")).otherwise(""))
    best = F.max_by(F.struct("row", "doc_id"), F.struct("points", F.col("doc_id").isNotNull(), -F.col("doc_id"), -F.col("row")))
    groups = marked.filter("multi").groupBy(*key, "sub").agg(F.count("*").alias("size"), best.alias("best"))
    out = marked.drop("multi", "clash").join(groups, [*key, "sub"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
r AS (
  SELECT doc_id, sha256(body) AS text_sha256, count(*) OVER (PARTITION BY body) AS group_size,
    first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
