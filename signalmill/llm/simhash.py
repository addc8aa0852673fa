"""SimHash near-duplicates with pigeonring candidates.

A fingerprint's 64 bits are cut into ``limit + 1`` segments on a ring. If two fingerprints differ in
at most ``limit`` bits, then from some start every chain of l consecutive segments holds at most
l * limit / (limit + 1) differences, rounded down: l - 1. So the first segment is equal, the next
two halves hold one difference at most, and so on. The masks of ``chain_masks`` are the sets of bits
that must be equal in each such case; pairs that share one are checked chain by chain, and only
those within every budget get the full comparison, which is the last chain.
"""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalmill.llm.components import connected, forest
from signalmill.plans.runtime import discard, written

BITS = 64
BLOCK = 1 << 14
SLICE = 512  # texts that a task holds as strings at a time
FULL = (1 << 64) - 1
SAMPLED = 16  # one document of so many shows which shingles are common
PARITY = 512  # bits of the sketch that pairs of a bucket are told apart by
COMMON = 200_000  # common shingles that go to the tasks


def fingerprint(words: list[bytes], size: int, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the XXH64 values of the ``size``-word shingles."""
    import xxhash

    if not words:
        return 0
    digest, text = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    starts, ends = starts[:n].tolist(), (ends[size - 1 :] if len(words) > size else ends[-1:]).tolist()
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        values = np.fromiter((digest(text[a:b], seed) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])), ">u8")
        votes += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n).view(">u8")[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fp): SimHash of each whole text as a signed 64-bit number.

    A-Z are lower-cased, words end at ASCII white space. A null or wordless text has fingerprint 0,
    a text of fewer words than ``size`` is one shingle. Other columns are not read.
    """

    def kernel(batches):
        for batch in batches:
            texts = (t.encode().lower().split() if t else [] for t in batch.column(1).to_pylist())
            values = np.fromiter((fingerprint(w, size) for w in texts), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(kernel, "doc_id bigint, fp bigint")


def segments(limit: int) -> list[int]:
    """Masks of the ring's segments, highest bits first."""
    edges = [round(i * BITS / (limit + 1)) for i in range(limit + 2)]
    return [sum(1 << (BITS - 1 - b) for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]


def _halves(mask: int) -> list[int]:
    bits = [b for b in range(BITS) if mask >> b & 1]
    cut = len(bits) // 2
    return [sum(1 << b for b in bits[cut:]), sum(1 << b for b in bits[:cut])]


def chain_masks(limit: int, reach: int) -> list[tuple[int, int]]:
    """(start, mask): the bits that are equal in one of the cases of a chain over ``reach + 1`` segments.

    The j segments after the first hold at most j differences, so of their 2j halves at most j are
    unequal. Each case names ``reach`` halves that may differ; the other halves are equal.
    """
    ring, out = segments(limit), []
    reach = min(reach, limit)
    for start in range(limit + 1):
        cases = [(0, ring[start])]  # halves that may differ so far, bits that are equal
        for j in range(1, reach + 1):
            first, second = _halves(ring[(start + j) % (limit + 1)])
            step = {0: first | second, 1: None, 2: 0}
            grown = []
            for bad, same in cases:
                for more in step:
                    if bad + more <= j:
                        grown += [(bad + more, same | m) for m in ([step[more]] if more != 1 else [first, second])]
            cases = grown
        full = [same for bad, same in cases if bad == reach]
        out += [(start, m) for m in sorted(set(full))]
    return out


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _near(a: Column, b: Column, start: Column, limit: int) -> Column:
    """Whether all chains from ``start`` keep within their budgets; the longest is the whole ring."""
    ring, diff, ok = segments(limit), a.bitwiseXOR(b), F.lit(True)
    for length in range(2, limit + 2):
        if length <= limit:
            masks = [_signed(sum(ring[(s + j) % (limit + 1)] for j in range(length))) for s in range(limit + 1)]
            part = diff.bitwiseAND(F.element_at(F.array(*[F.lit(m).cast("bigint") for m in masks]), start + 1))
        else:
            part = diff
        ok = ok & (F.bit_count(part) <= length - 1)
    return ok


def link(fps: DataFrame, limit: int = 4, reach: int = 2) -> DataFrame:
    """(fp, root) for the distinct ``fps`` that lie within ``limit`` bits of another one.

    Fingerprints that share a chain mask's bits meet in a bucket. First each is compared with the
    bucket's smallest and largest, which joins dense buckets without listing their pairs. Then only
    pairs of different components are compared, and of those only pairs with a member outside the
    bucket's commonest component, so no pair within a large group is listed and no link is lost.

    A fingerprint has a row for each mask, which the planner does not count, so the joins are told not to
    send a side through the driver.
    """
    spark = fps.sparkSession
    masks = chain_masks(limit, reach)
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("bigint")).alias("v")) for i, (s, m) in enumerate(masks)])
    keyed = fps.select("fp").distinct().select("fp", F.inline(keys))
    poles = keyed.groupBy("k", "v").agg(F.min("fp").alias("p"), F.max("fp").alias("q")).filter("p < q")
    met, place = written(keyed.join(poles.hint("merge"), ["k", "v"]))
    near = lambda a, b, s="start": _near(F.col(a), F.col(b), F.col(s), limit)
    stars = met.select("fp", "start", F.explode(F.array("p", "q")).alias("pole")).filter("fp <> pole").filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("pole"))) <= limit)
    stars, old = written(stars.select(F.col("fp").alias("a"), F.col("pole").alias("b")).distinct())
    classes = connected(stars)
    discard(spark, old)
    first = classes.select(F.col("node").alias("fp"), F.col("component").alias("c"))
    sides, aside = written(met.select("k", "v", "start", "fp").join(first.hint("merge"), "fp", "left").withColumn("c", F.coalesce("c", "fp")))
    discard(spark, place)
    share = sides.groupBy("k", "v", "c").agg(F.count("*").alias("n"))
    common = share.groupBy("k", "v").agg(F.max_by("c", F.struct("n", "c")).alias("most"), F.count("*").alias("kinds")).filter("kinds > 1").drop("kinds")
    open_ = sides.join(common.hint("merge"), ["k", "v"])
    rare = open_.filter("c <> most").select("k", "v", F.col("fp").alias("x"), F.col("c").alias("cx"))
    pairs = open_.join(rare.hint("merge"), ["k", "v"]).filter("c <> cx and (c = most or fp < x)").filter(near("fp", "x"))
    more = pairs.select(F.col("c").alias("a"), F.col("cx").alias("b")).distinct()
    out = connected(forest(classes).unionByName(more)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    discard(spark, aside)
    release(spark)
    return out


def near_duplicates(docs: DataFrame, size: int = 4, limit: int = 4, reach: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): every row's class under fingerprints within ``limit`` bits.

    ``component_id`` is the smallest doc_id reachable. Copies share a fingerprint and cost one row.
    Rows without a doc_id take part by their fingerprint; a class of only such rows has a null id.
    """
    rows, _ = written(fingerprints(docs, size))
    byfp = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = byfp.join(link(byfp, limit, reach).hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(roots.join(least.hint("merge"), "root").select("fp", "component_id").hint("merge"), "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted XXH64 values of a text's distinct ``size``-word shingles; a shorter text is one shingle."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    starts, ends = starts[:n].tolist(), (ends[size - 1 :] if len(words) > size else ends[-1:]).tolist()
    return np.unique(np.fromiter((digest(joined[x:y], 42) for x, y in zip(starts, ends)), np.uint64, n).view(np.int64))


def _slices(batches):
    return (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def shingle_sets(docs: DataFrame, size: int = 5) -> DataFrame:
    """(id, s): the shingle set of each text that has words."""

    def kernel(batches):
        for batch in _slices(batches):
            sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
            out = pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], ["id", "s"])
            yield out.filter(pa.array([len(x) > 0 for x in sets]))

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(kernel, "id bigint, s array<bigint>")


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that are frequent in one document of ``SAMPLED``, and their counts there.

    They only order the shingles of a prefix. Any order gives the same pairs, this one fewer candidates.
    """
    some = docs.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(SAMPLED)) == 0)
    counts = shingle_sets(some, size).select(F.explode("s").alias("h")).groupBy("h").count().filter("count > 2")
    rows = counts.orderBy(F.desc("count"), "h").limit(COMMON).collect()
    hashes, times = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    order = np.argsort(hashes)
    return hashes[order], times[order]


def prefixes(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(doc_id, n, digest, sketch, parity, prefix): size, digest and parity sketches (of fitting and of fixed length) of a
    text's shingle set, and the shingles by which it is found.

    Two sets of a Jaccard similarity of at least ``similarity`` share at least ceil(similarity * n) of
    the n shingles of either one. Under one order of all shingles the first n - ceil(similarity * n) + 1
    of both therefore have one in common. Rare ones come first.
    """
    hot = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size))

    def kernel(batches):
        import xxhash

        hashes, times = hot.value
        for batch in _slices(batches):
            sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
            first = []
            for values in sets:
                if len(hashes) and len(values):
                    at = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
                    ordered = values[np.argsort(np.where(hashes[at] == values, times[at], 0), kind="stable")]
                else:
                    ordered = values
                first.append(ordered[: len(values) - math.ceil(similarity * len(values) - 1e-9) + 1])
            digests = pa.array([xxhash.xxh128_digest(x.tobytes()) for x in sets], pa.binary())
            sketches = pa.array([parity_sketch(x) for x in sets], pa.binary())
            fixed = _lists([np.frombuffer(parity_sketch(x, PARITY), np.int64) for x in sets])
            columns = [batch.column(0), pa.array(list(map(len, sets)), pa.int64()), digests, sketches, fixed, _lists(first)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "sketch", "parity", "prefix"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(kernel, "doc_id bigint, n bigint, digest binary, sketch binary, parity array<bigint>, prefix array<bigint>")


def parity_sketch(values: np.ndarray, bits: int | None = None) -> bytes:
    """A bit for each class of hashes: whether their number is odd. ``bits``, or two to four an entry and at least 64.

    Two sets differ in at least as many entries as their sketches differ in bits. A sketch folds to half
    its length by XOR of its halves.
    """
    bits = bits or (1 << max(6, int(2 * len(values) - 1).bit_length()) if len(values) else 64)
    places = values.view(np.uint64) & np.uint64(bits - 1)
    return np.packbits(np.bincount(places.astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits in which two parity sketches differ, the longer one folded."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _enough(shared: Column, n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of ``n`` and ``m`` entries with ``shared`` ones in common are ``similarity`` alike."""
    return shared * (1 + similarity) >= (n + m) * similarity - 1e-6


def _within(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, far): the pairs whose sets may be ``similarity`` alike as far as their sketches tell.

    Sets of n and m entries that are alike differ in at most (n + m) (1 - similarity) / (1 + similarity).
    """

    def kernel(batches):
        for batch in batches:
            a, b, n, m, x, y = (batch.column(i).to_pylist() for i in range(6))
            far = np.array([sketch_distance(p, q) for p, q in zip(x, y)], np.int64)
            keep = far * (1 + similarity) <= (np.array(n, np.int64) + np.array(m, np.int64)) * (1 - similarity) + 1e-6
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far)], ["a", "b", "far"])
            yield out.filter(pa.array(keep))

    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    return both.mapInArrow(kernel, "a bigint, b bigint, far bigint")


def linked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b): edges that connect all that pairs with a Jaccard similarity of at least ``similarity`` among ``pairs`` connect, and no more.

    Sketches drop most pairs. Of the others each text's nearest is compared first, by the whole sets, then
    each text's nearest outside its component, then all that still lie in different components. Sets
    are large, so they are made for the texts of the pairs left only and deleted afterwards.
    """
    spark = pairs.sparkSession
    left, place = written(_within(pairs, nodes, similarity))
    ids = left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets, path = written(shingle_sets(texts.join(ids, "doc_id", "left_semi"), size))
    release(spark)
    sides = [sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}")) for x in "ab"]
    edges = None
    for last in (False, False, True):
        ends = left.select(F.explode(F.array("a", "b")).alias("x"), F.struct("far", "a", "b").alias("p"))
        ask = left.select("a", "b") if last else ends.groupBy("x").agg(F.min("p").alias("p")).select("p.a", "p.b").distinct()
        both = ask.join(sides[0], "a").join(sides[1], "b")
        good, _ = written(both.filter(_enough(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"), similarity)).select("a", "b"))
        edges = good if edges is None else edges.unionByName(good)
        if last:
            break
        classes = connected(edges)
        edges = forest(classes)
        own = lambda x: classes.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        rest = left.join(ask, ["a", "b"], "left_anti").join(own("a"), "a", "left").join(own("b"), "b", "left")
        rest, new = written(rest.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "far"))
        discard(spark, place)
        left, place = rest, new
        release(spark)
        if left.isEmpty():
            break
    discard(spark, path)
    discard(spark, place)
    del both, ask, sides, sets
    release(spark)
    return edges


def release(spark) -> None:
    """Let Spark delete the exchanges of finished queries now instead of at the driver's next collection."""
    gc.collect()
    spark._jvm.System.gc()


def link_similar(nodes: DataFrame, texts: DataFrame, proposed: DataFrame, size: int, similarity: float) -> DataFrame:
    """(id, root) for ``nodes`` (id, n, sketch, parity, prefix) whose shingle set is ``similarity`` alike another one's.

    The pairs ``proposed`` (a, b), those that fingerprints find, are compared first. They do not reach every
    such pair, but every one shares a shingle of its prefixes. A shingle's place in both bounds what two sets
    can share, which drops most pairs; the others are compared by their whole sets. As in ``link``,
    each is first compared with the smallest and largest of its bucket, then only pairs of different
    components with a member outside the bucket's commonest one.
    """
    keyed = nodes.select("id", "n", F.posexplode("prefix").alias("at", "h"))
    buckets = keyed.groupBy("h").agg(F.min("id").alias("p"), F.max("id").alias("q")).filter("p < q")
    met, place = written(keyed.join(buckets, "h"))
    del keyed, buckets
    spark = nodes.sparkSession
    release(spark)

    def reach(n, at, m, other):
        return _enough(F.least(at, other) + 1 + F.least(n - at - 1, m - other - 1), n, m, similarity)

    poles = met.filter("id = p or id = q").select("h", F.col("id").alias("o"), F.col("n").alias("m"), F.col("at").alias("ao"))
    stars = met.select("h", "id", "n", "at", F.explode(F.array("p", "q")).alias("o")).filter("id <> o").join(poles, ["h", "o"]).filter(reach(F.col("n"), F.col("at"), F.col("m"), F.col("ao")))
    stars = stars.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b"))
    tried, old = written(stars.unionByName(proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct())
    del stars, poles
    release(spark)
    stars = linked(tried, nodes, texts, size, similarity)
    classes = connected(stars)
    first = classes.select(F.col("node").alias("id"), F.col("component").alias("c"))
    sides, aside = written(met.select("h", "id", "n", "at").join(first, "id", "left").withColumn("c", F.coalesce("c", "id")))
    discard(spark, place)
    common = sides.groupBy("h", "c").agg(F.count("*").alias("k")).groupBy("h").agg(F.max_by("c", F.struct("k", "c")).alias("most"), F.count("*").alias("kinds"))
    open_ = sides.join(common.filter("kinds > 1").drop("kinds"), "h").join(nodes.select("id", "parity"), "id")
    rare = open_.filter("c <> most").select("h", F.col("id").alias("x"), F.col("c").alias("cx"), F.col("n").alias("m"), F.col("at").alias("ax"), F.col("parity").alias("px"))
    # texts that share a passage and little else differ in too many places of their sketches and make no pair
    apart = sum((F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("px")[i])) for i in range(PARITY // 64)), F.lit(0))
    alike = apart * (1 + similarity) <= (F.col("n") + F.col("m")) * (1 - similarity) + 1e-6
    pairs = open_.join(rare, "h").filter("c <> cx and (c = most or id < x)").filter(reach(F.col("n"), F.col("at"), F.col("m"), F.col("ax"))).filter(alike)
    pairs = pairs.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    pairs, more = written(pairs)
    for path in (old, aside):
        discard(spark, path)
    del sides, common, open_, rare, tried, met
    release(spark)
    out = connected(forest(classes).unionByName(linked(pairs, nodes, texts, size, similarity))).select(F.col("node").alias("id"), F.col("component").alias("root"))
    discard(spark, more)
    return out


def drop_similar(docs: DataFrame, size: int = 5, similarity: float = 0.8, limit: int = 4, reach: int = 2) -> DataFrame:
    """``docs`` with one document, the smallest doc_id, of each class linked by shingle similarity.

    Texts are linked if the Jaccard similarity of their sets of hashed ``size``-word shingles is at
    least ``similarity``. SimHash classes of fingerprints within ``limit`` bits propose near copies, and whole
    sets decide; pairs that are alike though their fingerprints are not are found by prefixes. Repeated rows of one doc_id are one document, texts without words are
    alike, rows without a doc_id stay as they are.
    """
    named = docs.filter("doc_id is not null")
    rows, _ = written(prefixes(named, size, similarity))
    firsts, _ = written(rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")))
    classes, _ = written(near_duplicates(named, size, limit, reach).filter("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).distinct())
    nodes = rows.join(firsts, ["digest", "doc_id"]).select(F.col("doc_id").alias("id"), "n", "sketch", "parity", "prefix")
    keep = firsts.select(F.col("doc_id").alias("id")).distinct().join(link_similar(nodes, named, classes, size, similarity), "id", "left").filter("root is null or root = id").select(F.col("id").alias("kept"))
    stay = named.join(keep, named["doc_id"] == keep["kept"], "left_semi").dropDuplicates(["doc_id"])
    return stay.unionByName(docs.filter("doc_id is null"))


def drop_near_duplicates(docs: DataFrame, size: int = 4, limit: int = 4, reach: int = 2) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest doc_id.

    Repeated rows of one doc_id are one document. Rows without a doc_id stay as they are.
    """
    classes = near_duplicates(docs.filter("doc_id is not null"), size, limit, reach)
    keep = classes.filter("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    stay = docs.join(keep, docs["doc_id"] == keep["kept"], "left_semi").dropDuplicates(["doc_id"])
    return stay.unionByName(docs.filter("doc_id is null"))


def op7(docs: DataFrame) -> DataFrame:
    """The query: classes of all documents with the fingerprint in hexadecimal digits."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
