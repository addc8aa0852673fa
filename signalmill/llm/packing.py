"""Best-fit packing by exact-complement hashing over length counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from signalmill.llm.vocab import byte_encoder, default_path
from signalmill.plans.runtime import written

CAPACITY = 1024
END = 2
SLICE = 64  # texts whose ids a task holds at once
LARGEST = 3  # lengths that fill a gap together


def cut(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces of each document's token ids and an end id: task, nth, doc_id, piece, start, length, ids.

    Only a document of over ``capacity`` ids is cut, into pieces of that length; the first may be
    shorter. A null text is empty and gives the end id alone. ``ids`` are little-endian unsigned
    32-bit numbers. ``nth`` counts the pieces of a length within the ``task`` that made them; rows
    repeat as they do in ``docs``, and other columns are not read.
    """

    def kernel(batches):
        encode, task, seen = byte_encoder(path or default_path()), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            out = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                first = len(ids) % capacity or min(len(ids), capacity)
                starts = [0, *range(first, len(ids), capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    for column, value in zip(out, (task, seen[b - a], doc_id, piece, a, b - a, ids[a:b].tobytes())):
                        column.append(value)
                    seen[b - a] += 1
            kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["task", "nth", "doc_id", "piece", "start", "length", "ids"])

    fields = "task bigint, nth bigint, doc_id bigint, piece int, start bigint, length bigint, ids binary"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(kernel, fields)


def complete(left: np.ndarray, gap: int, even: bool = False, most: int = LARGEST) -> list[int] | None:
    """Up to ``most`` available lengths that fill ``gap`` exactly; None if there are none. ``even``: the most even pair, else the most uneven."""
    if gap < 1:
        return None
    if left[gap]:
        return [gap]
    pair = _pair(left, gap, even) if most > 1 else None
    if pair or most < 3:
        return pair
    have = left[: gap + 1] > 0
    sums = np.convolve(have, have)[: gap + 1] > 0  # index of pair sums
    for a in np.flatnonzero(have & sums[::-1])[::-1]:
        left[a] -= 1
        pair = _pair(left, gap - int(a), even)
        left[a] += 1
        if pair:
            return [int(a), *pair]
    return None


def _pair(left: np.ndarray, gap: int, even: bool) -> list[int] | None:
    half = np.arange((gap + 1) // 2, gap)
    fits = half[(left[half] > 0) & (left[gap - half] > (2 * half == gap))]
    long = int(fits[0 if even else -1]) if len(fits) else 0
    return [long, gap - long] if long else None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths): sequences to make, from the number of pieces of each length up to ``capacity``.

    The longest piece left opens a sequence, and combinations of lengths that fill its gap exactly are
    consumed. Where none is left, the residuals are packed by best fit: either at once, with the
    rest of the gap tried again after each piece, or at the end, longest first. A pattern is
    repeated as often as its lengths last, so each step uses up a length, and steps do not grow with
    the number of documents. Small tables may lack the short pieces that pairs and triples use up early,
    so the plan is made with up to one, two and three lengths a gap, and with the most even and the most
    uneven pairs; the plan with the fewest sequences is returned.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    plans = [_plan(left.copy(), capacity, even, again, most) for most in range(LARGEST, 0, -1) for even in (False, True)[: most] for again in (False, True)]
    best = min(plans, key=lambda p: sum(t for t, _ in p))
    assert all(sum(t * p.count(n) for t, p in best) == c for n, c in counts.items())
    return best


def _plan(left: np.ndarray, capacity: int, even: bool, again: bool, most: int) -> list[tuple[int, list[int]]]:
    out, waiting = [], np.zeros_like(left)
    while left.any():
        used, gap = [], capacity
        while gap:
            more = complete(left, gap, even, most) if used else None
            if more is None:
                fits = np.flatnonzero(left[: gap + 1])
                if not len(fits) or used and not again:
                    break
                more = [int(fits[-1])]
            for length in more:
                left[length] -= 1
            used, gap = used + more, gap - sum(more)
        if gap and not again:  # no exact complement: the opening length waits for best fit
            waiting[used[0]] += 1 + left[used[0]]
            left[used[0]] = 0
            continue
        need = np.bincount(used, minlength=capacity + 1)
        times = 1 + int((left[need > 0] // need[need > 0]).min())
        left -= need * (times - 1)
        out.append((times, sorted(used, reverse=True)))
    return out + _best_fit(waiting, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing over counts: groups of equal sequences, by the gap that they have left."""
    open_: list[list[tuple[int, list[int]]]] = [[] for _ in range(capacity + 1)]
    free = np.zeros(capacity + 1, np.int64)
    for length in np.flatnonzero(left)[::-1].tolist():
        count = int(left[length])
        while count:
            fits = np.flatnonzero(free[length:])
            gap = length + int(fits[0]) if len(fits) else capacity
            times, used = open_[gap].pop() if len(fits) else (count, [])
            each = min(count, times)
            if len(fits):
                free[gap] -= times
                if times > each:
                    open_[gap].append((times - each, used))
                    free[gap] += times - each
            elif gap >= 2 * length:  # equal pieces fill a new sequence before the next one opens
                each = -(-count // (gap // length))
                if count >= each * (gap // length):
                    used, gap = [length] * (gap // length - 1), gap - length * (gap // length - 1)
                else:
                    each, used, gap = (each - 1, [length] * (gap // length - 1), gap - length * (gap // length - 1)) if each > 1 else (1, [length] * (count - 1), gap - length * (count - 1))
            open_[gap - length].append((each, [*used, length]))
            free[gap - length] += each
            count -= each * (1 + (len(used) if not len(fits) else 0))
    return [group for groups in open_ for group in groups]


def _places(slots: list[tuple]):
    """(length, rank) -> sequence_id and offset. Each slot is a stretch of ranks of one length in equal sequences."""
    length, low, number, each, at = (np.array(c, np.int64) for c in zip(*sorted(slots))) if slots else (np.zeros(0, np.int64),) * 5
    key = (length << 44) + low

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def locate(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        size, rank = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        i = np.searchsorted(key, (size << 44) + rank, side="right") - 1
        within = rank - low[i]
        return pd.DataFrame({"sequence_id": number[i] + within // each[i], "offset": at[i] + within % each[i] * size})

    return locate


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (of ``cut``, with any further columns) and their sequence_id and offset, gapless from 0.

    Only the counts of the at most ``capacity`` lengths reach the driver, which makes the plan from
    them. A piece finds its place by its rank among the pieces of its length: its task's offset
    plus its place within the task. Pieces that fill a sequence alone need no plan. An empty input
    gives an empty result.
    """
    others = [c for c in pieces.columns if c not in ("task", "nth", "length")]
    table, _ = written(pieces.select("task", "nth", "length", F.struct(*others).alias("others")))
    short = table.filter(F.col("length") < capacity)
    sizes = short.groupBy("task", "length").agg(F.count("*").alias("size"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base, _ = written(sizes.select("task", "length", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")))
    counts = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("size").alias("n")).collect()}
    rank, number, slots = dict.fromkeys(counts, 0), 0, []
    for times, lengths in plan(counts, capacity):
        at = 0
        for length in dict.fromkeys(lengths):
            each = lengths.count(length)
            slots.append((length, rank[length], number, each, at))
            rank[length] += times * each
            at += each * length
        number += times
    place = _places(slots)(F.col("length"), F.col("rank"))
    placed = short.join(base.select("task", "length", "base"), ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = placed.withColumn("place", place).withColumn("sequence_id", F.col("place.sequence_id")).withColumn("offset", F.col("place.offset"))
    alone = table.filter(F.col("length") == capacity)
    alone = alone.withColumn("sequence_id", -1 - F.shiftleft("task", 36) - F.col("nth")).withColumn("offset", F.lit(0).cast("bigint"))
    columns = [F.col("length") if c == "length" else F.col("others")[c].alias(c) for c in pieces.columns if c not in ("task", "nth")]
    return placed.select(*columns, "sequence_id", "offset").unionByName(alone.select(*columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Packed pieces of ``docs`` with their ids."""
    return pack(cut(docs, capacity, path), capacity)


def op2(docs: DataFrame) -> DataFrame:
    """The query: places of all pieces, with a checksum of each piece's ids in place of the ids."""
    return pack(cut(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
