"""Phrase collocations by dynamic itemset counting.

The corpus is written once as chunks of word codes, dealt over a few shards. Shards are scanned in a
cycle, one a step. Words are counted from the first step on. A longer phrase becomes active in the
step after both its subphrases, the one without its last and the one without its first word, have
reached the threshold, wherever in the cycle that is, and stays active for one full cycle. So pairs
are counted while words still are, and triples while pairs are.

Which phrases have reached the threshold, and when, goes to the tasks as a sketch of one byte a slot
and bounded size. It can only err towards counting a phrase for longer: counts are kept per shard and
a shard counted twice is taken once. A phrase whose counts add up to the threshold has subphrases that
did so too, was therefore active for a whole cycle, and its sum is its exact count.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from signalmill.functions.ordered import attach
from signalmill.llm.names import unused
from signalmill.plans.runtime import discard, shared_folder, written

SHARDS = 3
LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words of a phrase
SHARE = 80  # percent: a phrase found this often inside one longer candidate goes
TOP = 2000
CHUNK_BYTES = 4 << 20
PENDING_BYTES = 32 << 20
SLOTS = 1 << 26  # at most so many bytes of sketch
BLOCK = 1 << 16
BREAK = b"\xff"  # never part of UTF-8
TABLE = bytes(c + 32 if 65 <= c <= 90 else 255 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
GAPS = np.isin(np.arange(256), [9, 32, BREAK[0]])  # bytes that no word holds, once translated
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
KEYS = ["len", *WORDS]  # names of words differ by language, so a phrase's do too


def _numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's number in the order they first come, and the values by number."""
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _chunk(text: bytes, lang: str, seed: int) -> dict:
    """Codes of a text's words in the order they come, from 1 on; the break is 0."""
    import xxhash

    body = np.frombuffer(text, np.uint8)
    gap = GAPS[body]
    padded = np.concatenate([[True], gap, [True]])
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    starts, ends = edges[::2], edges[1::2]
    kind, width = (pa.binary(), np.int32) if len(text) < 1 << 31 else (pa.large_binary(), np.int64)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(width)
    tokens = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body[~gap])])
    numbers, words = _numbered(tokens)
    words = words.to_pylist()
    ids = np.insert(numbers + 1, np.searchsorted(starts, np.flatnonzero(body == BREAK[0])), 0).astype(np.uint32)
    salt = lang.encode() + b"\0"
    names = np.array([0, *(xxhash.xxh3_64_intdigest(salt + w, seed) for w in words)], np.uint64)
    return {"lang": lang, "n": len(starts), "names": names.tobytes(), "codes": ids.tobytes(), "words": BREAK.join(words)}


def _cuts(text: bytes) -> list[bytes]:
    """Parts of about a chunk, each ending where a piece does."""
    parts, at = [], 0
    while at < len(text):
        end = text.find(BREAK, at + CHUNK_BYTES)
        end = len(text) if end < 0 else end + 1
        parts.append(text[at:end])
        at = end
    return parts


def _encoder(seed: int, shards: int):
    def kernel(batches):
        pending: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        made = TaskContext.get().partitionId()

        def flush(lang):
            nonlocal made
            sizes.pop(lang)
            for part in _cuts(BREAK.join(pending.pop(lang))):
                row = _chunk(part, lang, seed)
                if row["n"]:
                    made += 1
                    yield pa.RecordBatch.from_pylist([row | {"shard": made % shards}], schema=schema)

        schema = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("names", pa.binary()), ("codes", pa.binary()), ("words", pa.binary()), ("shard", pa.int32())])
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                lang, body = lang.as_py(), text.as_py().translate(TABLE)
                pending.setdefault(lang, []).append(body)
                sizes[lang] = sizes.get(lang, 0) + len(body) + 1
                if sizes[lang] >= CHUNK_BYTES:
                    yield from flush(lang)
                elif sum(sizes.values()) >= PENDING_BYTES:
                    yield from flush(max(sizes, key=sizes.get))
        for lang in list(pending):
            yield from flush(lang)

    return kernel


def _name(words: list[np.ndarray]) -> np.ndarray:
    """64 bits of each phrase, given the names of its words."""
    out = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        out = (out ^ w) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def _slots(names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(size - 1)
    return (names & mask).astype(np.int64), ((names >> np.uint64(32)) & mask).astype(np.int64)


def _reach(sketch: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The step in which each phrase reached the threshold, or a later one; 0: not yet."""
    a, b = _slots(names, len(sketch))
    return np.minimum(sketch[a], sketch[b])


def _counter(sketch, step: int, shards: int):
    """Counts of one shard's active phrases; ``until`` is the last step in which a phrase is."""
    schema = pa.schema([("len", pa.int32()), *((w, pa.int64()) for w in WORDS), ("c", pa.int64()), ("until", pa.int32())])

    def rows(columns, counts, until):
        n = len(counts)
        fields = [pa.array(np.full(n, len(columns), np.int32))]
        fields += [pa.array(c.view(np.int64)) for c in columns] + [pa.array(np.zeros(n, np.int64))] * (LONGEST - len(columns))
        return pa.RecordBatch.from_arrays([*fields, pa.array(counts.astype(np.int64)), pa.array(until.astype(np.int32))], schema=schema)

    def kernel(batches):
        table = sketch.value
        for batch in batches:
            for row in batch.to_pylist():
                names, codes = np.frombuffer(row["names"], np.uint64), np.frombuffer(row["codes"], np.uint32).astype(np.int64)
                if step <= shards:
                    counts = np.bincount(codes, minlength=len(names))[1:]
                    yield rows([names[1:]], counts, np.full(len(counts), shards))
                known = _reach(table, _name([names]))
                known[0] = 0
                at = np.arange(len(codes))  # starts of the phrases of the last length
                reached = known[codes]  # by place
                ids = codes  # by place: a number of the phrase of the last length within this chunk
                for size in range(2, LONGEST + 1):
                    at = at[at < len(codes) - size + 1]
                    at = at[(reached[at] > 0) & (reached[at + 1] > 0)]
                    if not len(at):
                        break
                    own, found = _numbered(pa.array((ids[at] << 32) | codes[at + size - 1]))
                    spots = np.empty(len(found), np.int64)  # a place of each phrase
                    spots[own] = at
                    columns = [names[codes[spots + i]] for i in range(size)]
                    latest = np.maximum(reached[spots], reached[spots + 1]).astype(np.int64)
                    open_ = latest + shards >= step
                    if open_.any():
                        counts = np.bincount(own, minlength=len(found))
                        yield rows([c[open_] for c in columns], counts[open_], latest[open_] + shards)
                    if size == LONGEST:
                        break
                    now = _reach(table, _name(columns))[own]
                    at, own, now = at[now > 0], own[now > 0], now[now > 0]
                    reached = np.zeros(len(codes), np.uint8)
                    reached[at] = now
                    ids = np.zeros(len(codes), np.int64)
                    ids[at] = own

    return kernel


def _slot_rows(size: int):
    def kernel(batches):
        for batch in batches:
            lens = batch.column(0).to_numpy(zero_copy_only=False)
            words = [batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(1, LONGEST)]
            steps = batch.column(LONGEST).to_numpy(zero_copy_only=False)
            for n in range(1, LONGEST):
                own = lens == n
                for slot in _slots(_name([w[own] for w in words[:n]]), size):
                    yield pa.RecordBatch.from_arrays([pa.array(slot // BLOCK), pa.array(slot % BLOCK), pa.array(steps[own].astype(np.int32))], names=["block", "slot", "step"])

    return kernel


def _block(key, rows):
    import pandas as pd

    body = np.zeros(BLOCK, np.uint8)
    np.maximum.at(body, rows["slot"].to_numpy(), rows["step"].to_numpy().astype(np.uint8))
    return pd.DataFrame({"block": [key[0]], "body": [body.tobytes()]})


def _sketch(state: DataFrame, count: int) -> np.ndarray:
    """Steps in which phrases shorter than the longest reached the threshold, by slot."""
    size = BLOCK
    while size < min(8 * count, SLOTS):
        size *= 2
    reached = state.filter(f"reach is not null and len < {LONGEST}").select("len", *WORDS[:-1], "reach")
    slots = reached.mapInArrow(_slot_rows(size), "block bigint, slot bigint, step int").groupBy("block", "slot").agg(F.max("step").alias("step"))
    out = np.zeros(size, np.uint8)
    # block by block, so that the driver holds the sketch once
    for block, body in slots.groupBy("block").applyInPandas(_block, "block bigint, body binary").toLocalIterator():
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(body, np.uint8)
    return out


def _count(chunks: DataFrame, shards: int, least: int) -> tuple[DataFrame, str]:
    """(len, w1 .. w4, f) of all phrases of ``least`` occurrences or more, and where the table lies."""
    spark = chunks.sparkSession
    counts = [f"c{s}" for s in range(shards)]
    total = sum((F.col(c) for c in counts), F.lit(0))
    sketch, state, path, step = np.zeros(BLOCK, np.uint8), None, None, 0
    while True:
        step += 1
        shared = spark.sparkContext.broadcast(sketch)
        own = chunks.filter(F.col("shard") == (step - 1) % shards).select("names", "codes")
        fresh = own.mapInArrow(_counter(shared, step, shards), f"len int, {', '.join(f'{w} bigint' for w in WORDS)}, c bigint, until int")
        fresh = fresh.select(*KEYS, "c", "until", F.lit(None).cast("int").alias("reach"), *[F.lit(0).cast("bigint").alias(c) for c in counts])
        both = fresh if state is None else fresh.unionByName(state.withColumn("c", F.lit(0).cast("bigint")))
        merged = both.groupBy(*KEYS).agg(F.sum("c").alias("c"), F.max("until").alias("until"), F.max("reach").alias("reach"), *[F.max(c).alias(c) for c in counts])
        shard = counts[(step - 1) % shards]
        merged = merged.withColumn(shard, F.greatest(shard, "c")).drop("c").withColumn("reach", F.coalesce("reach", F.when(total >= least, F.lit(step))))
        old = path
        state, path = written(merged.filter((total >= least) | (F.col("until") > step)))
        if old:
            discard(spark, old)
        shared.destroy()
        last, count = state.filter(f"reach is not null and len < {LONGEST}").agg(F.max("reach"), F.count("*")).first()
        if step >= max(shards, (last or 0) + shards):
            return state.filter("reach is not null").select(*KEYS, total.alias("f")), path
        if last == step:
            sketch = None  # the tasks' copy is gone and the next one is as large
            sketch = _sketch(state, count)


def _names(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """(w, lang, word) of the given word names; two rows for a name mean that two words share it."""

    def kernel(batches):
        for batch in batches:
            for row in batch.to_pylist():
                names = np.frombuffer(row["names"], np.int64)[1:]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([row["lang"]] * len(names), pa.string()), pa.array(row["words"].split(BREAK), pa.binary())], names=["w", "lang", "word"])

    found = chunks.select("lang", "names", "words").mapInArrow(kernel, "w bigint, lang string, word binary")
    return found.join(words, "w", "left_semi").select("w", "lang", F.col("word").cast("string").alias("word")).distinct()


def _phrase(first: int, last: int) -> list[Column]:
    """Columns w1 .. w4 of the words ``first`` to ``last`` of a row's phrase."""
    words = [F.col(WORDS[i]) for i in range(first, last)]
    return [F.lit(last - first).alias("len"), *[x.alias(w) for x, w in zip([*words, *[F.lit(0).cast("bigint")] * (LONGEST - len(words))], WORDS)]]


def _scored(counts: DataFrame) -> DataFrame:
    """Candidates with l, r and score of their lowest cut."""
    found = counts.filter("len > 1")
    cuts = []
    for n in range(2, LONGEST + 1):
        for k in range(1, n):
            own = found.filter(F.col("len") == n)
            left, right = _phrase(0, k), _phrase(k, n)
            cuts.append(own.select(F.struct(*KEYS).alias("p"), F.col("f").alias("a"), F.lit(k).alias("k"), F.struct(*left).alias("first"), F.struct(*right).alias("rest")))
    cuts = reduce(DataFrame.unionByName, cuts)
    for part, name in (("first", "l"), ("rest", "r")):
        facts = counts.select(*[F.col(c).alias(f"{part}_{c}") for c in KEYS], F.col("f").alias(name))
        cuts = attach(cuts.select("*", *[F.col(f"{part}.{c}").alias(f"{part}_{c}") for c in KEYS]), facts, [f"{part}_{c}" for c in KEYS], salt=F.hash("p"))
    score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0)) div cast(l + r as decimal(20, 0))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return cuts.groupBy("p", "a").agg(best.alias("b")).select("p.*", "a", "b.l", "b.r", "b.score")


def _contained(counts: DataFrame) -> DataFrame:
    """(phrase, above): the count of the commonest longer candidate that holds the phrase."""
    parts = [
        counts.filter(F.col("len") == n).select(*_phrase(i, i + size), "f") for n in range(3, LONGEST + 1) for size in range(2, n) for i in range(n - size + 1)
    ]
    return reduce(DataFrame.unionByName, parts).groupBy(*KEYS).agg(F.max("f").alias("above"))


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's highest phrases of two to four words.

    A-Z are lower-cased; a text is cut into pieces at ``.,;:!?`` and line ends, a piece into words at
    blanks and tabs; phrases lie within a piece. ``a`` counts a phrase's occurrences, overlapping ones
    too, ``l`` and ``r`` those of the two sides of its lowest-scoring cut, ``n`` the language's words.
    score = floor(2000000 a / (l + r)). A phrase with fewer than ``least`` occurrences is no candidate;
    one that lies in a longer candidate with ``share`` percent of its occurrences goes. Ties: more
    occurrences, then the phrase's bytes. A null language is ``und``, a null text is empty, repeated
    rows count again, other columns are not read, and an empty table gives no rows.

    Phrases are told apart by 64-bit names of their words. Should two words share a name, everything is
    counted again under other names.
    """
    spark, seed = docs.sparkSession, 0
    text, lang = unused(docs, "_text"), unused(docs, "_lang")
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias(text), F.coalesce(F.col("lang"), F.lit("und")).alias(lang))
    while True:
        folder = f"{shared_folder(spark)}/signalmill-{uuid.uuid4().hex}"
        schema = "lang string, n bigint, names binary, codes binary, words binary, shard int"
        texts.mapInArrow(_encoder(seed, shards), schema).write.partitionBy("shard").parquet(folder)
        chunks = spark.read.schema(schema).parquet(folder)
        counts, state = _count(chunks, shards, least)
        words, place = written(_names(chunks, counts.filter("len = 1").select(F.col("w1").alias("w"))))
        if words.groupBy("w").count().filter("count > 1").isEmpty():
            break
        seed += 1
        for path in (folder, state, place):
            discard(spark, path)
    scored = _scored(counts)
    scored = scored.join(_contained(counts), KEYS, "left").filter(F.col("above").isNull() | (F.col("above").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * share))
    scored = attach(scored, words.select(F.col("w").alias("w1"), "lang"), "w1", salt=F.hash("w2", "w3", "w4"))
    order = [F.desc("score"), F.desc("a")]
    kept = scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top)
    spelled = kept.select("lang", *KEYS, "a", "l", "r", "score", F.posexplode(F.slice(F.array(*WORDS), 1, F.col("len"))).alias("pos", "w")).join(words.select("w", "word"), "w")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    spelled = spelled.groupBy("lang", *KEYS, "a", "l", "r", "score").agg(joined.alias("phrase"))
    total = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", "n", "score")


def op12(docs: DataFrame) -> DataFrame:
    """The query: every language's first 2000 phrases."""
    return collocations(docs)


OP12_SQL = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (
  SELECT lang, unnest(flatten(list_transform(range(1, {LONGEST + 1}), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))))) AS g
  FROM w),
f AS (SELECT lang, g, len(g) AS k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, g, k, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (
  SELECT c.lang, c.g, c.k, c.a, c.cut, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, c.cut) JOIN f y ON y.lang = c.lang AND y.g = list_slice(c.g, c.cut + 1, c.k)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
i AS (
  SELECT lang, list_slice(g, spot, spot + size - 1) AS g, max(f) AS above
  FROM (SELECT lang, g, f, size, unnest(range(1, k - size + 2)) AS spot FROM (SELECT lang, g, k, f, unnest(range(2, k)) AS size FROM f WHERE k > 2))
  GROUP BY ALL),
o AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, n, score FROM b JOIN t USING (lang) LEFT JOIN i ON i.lang = b.lang AND i.g = b.g
  WHERE above IS NULL OR 100::HUGEINT * above < {SHARE}::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o
QUALIFY rank <= {TOP}
"""
