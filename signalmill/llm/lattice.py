"""Subword lattice likelihood.

A word is written either whole, with its discounted training count, or as a path of pieces of an
existing byte-level vocabulary. Its probability sums over all ways: the whole word and every
segmentation, by forward recursion in log space. Pieces hold no white space within, so the lattice
of a document is the chain of its words' lattices and its marginal log probability is their sum
plus that of the end.

    P(word) = max(c - d, 0) / W + d * V / W * sum over segmentations of (prod q(piece)) * q(stop)

c: the word's count, W, V: training words and distinct ones, d = n1 / (n1 + 2 n2) from the numbers
of words seen once and twice. The piece scores q start from the vocabulary's own order and are
re-estimated on all distinct training words by expected counts; the pieces themselves are given.

The lattice of a text has a branch for each common language of the training texts. In a branch a
word may also be drawn by that language's counts c', with P in the part of the pieces:

    P'(word) = max(c' - d, 0) / W' + d * V' / W' * P(word)

The branches, weighted by their training texts, are summed too; no label of the scored text is read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from signalmill.llm.vocab import byte_pieces, default_path, kept
from signalmill.plans.runtime import written

LONGEST = 16  # bytes of a piece
HEAD = 1 << 17  # at most so many of the commonest words are sent to all tasks
HEAD_BYTES = 64  # longer words never are
FLUSH = 1 << 19
ROUNDS = 2  # of re-estimation of the piece scores
BRANCHES = 8  # at most so many languages
MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id) -> bool:
    """Whether a document is no training text; a null id counts as an empty one."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


class Pieces:
    """The vocabulary's pieces by length, found through a code of their bytes."""

    def __init__(self, path: str):
        ranked = sorted((p, i) for p, i in byte_pieces(path).items() if len(p) <= LONGEST)
        found = [p for p, _ in ranked]
        self.order = np.array([i for _, i in ranked])
        self.size = len(found)  # ids 0 .. size - 1, the stop symbol is size
        self.codes, self.ids = [], []
        for n in range(1, LONGEST + 1):
            ids = np.array([i for i, p in enumerate(found) if len(p) == n], np.int64)
            text = np.frombuffer(b"".join(found[i] for i in ids), np.uint8).reshape(-1, n)
            codes = self.code(text, n)[:, 0]
            order = np.argsort(codes)
            self.codes.append(codes[order])
            self.ids.append(ids[order])

    @staticmethod
    def code(text: np.ndarray, n: int) -> np.ndarray:
        """Codes of all spans of ``n`` bytes of the rows of ``text``: exact up to 8 bytes, mixed beyond."""
        width = text.shape[1] - n + 1
        out = np.zeros((len(text), width), np.uint64)
        for i in range(n):
            out = (out << np.uint64(8) if n <= 8 else out * MIX) + text[:, i : i + width]
        return out

    def start(self) -> np.ndarray:
        """Log scores from the vocabulary's order: common pieces come first, as 1 / rank."""
        scores = 1.0 / (np.append(self.order, 1) + 10.0)
        return np.log(scores / scores.sum())

    def arcs(self, text: np.ndarray) -> list[np.ndarray]:
        """Per length, the piece at each place of each row, or -1."""
        out = []
        for n in range(1, min(LONGEST, text.shape[1]) + 1):
            code, table = self.code(text, n), self.codes[n - 1]
            if not len(table):
                out.append(np.full(code.shape, -1))
                continue
            at = np.minimum(np.searchsorted(table, code), len(table) - 1)
            out.append(np.where(table[at] == code, self.ids[n - 1][at], -1))
        return out


def pieces_of(path: str) -> Pieces:
    return kept(("pieces", path), lambda: Pieces(path))


def _total(parts: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials over the first axis."""
    top = parts.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(parts - safe).sum(axis=0))


def forward(arcs: list[np.ndarray], scores: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log sums over all paths from the start to each place, and the arcs' log scores."""
    rows, width = arcs[0].shape
    padded = np.append(scores, -np.inf)  # arc -1: none
    weights = [padded[np.where(a < 0, len(scores), a)] for a in arcs]
    sums = np.full((rows, width + 1), -np.inf)
    sums[:, 0] = 0.0
    for j in range(1, width + 1):
        sums[:, j] = _total(np.stack([sums[:, j - n] + weights[n - 1][:, j - n] for n in range(1, min(j, len(arcs)) + 1)]))
    return sums, weights


def expected(arcs: list[np.ndarray], scores: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over the rows' segmentations; the stop is used once a row."""
    sums, weights = forward(arcs, scores)
    rows, width = arcs[0].shape
    back = np.full((rows, width + 1), -np.inf)
    back[:, width] = 0.0
    for i in range(width - 1, -1, -1):
        back[:, i] = _total(np.stack([weights[n - 1][:, i] + back[:, i + n] for n in range(1, min(width - i, len(arcs)) + 1)]))
    out = np.zeros(len(scores))
    for n, (a, w) in enumerate(zip(arcs, weights), 1):
        use = np.exp(sums[:, : width - n + 1] + w + back[:, n:] - sums[:, width:])
        hit = a >= 0
        out += np.bincount(a[hit], use[hit], len(scores))
    out[-1] += rows
    return out


def _by_length(words: list[bytes]):
    """(places, rows of bytes) of the words of each length, a space in front, in bounded groups."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for places in np.split(order, cuts):
        if not len(places):
            continue
        width = int(sizes[places[0]]) + 1
        for at in range(0, len(places), step := max(1, (1 << 17) // width)):
            some = places[at : at + step]
            yield some, np.frombuffer(b"".join(b" " + words[i] for i in some), np.uint8).reshape(len(some), width)


def segment_scores(words: list[bytes], pieces: Pieces, scores: np.ndarray) -> np.ndarray:
    """Natural log of the sum over all segmentations of each word, the stop included."""
    out = np.empty(len(words))
    for places, text in _by_length(words):
        out[places] = forward(pieces.arcs(text), scores)[0][:, -1] + scores[-1]
    return out


def _counts(docs: DataFrame, languages: list[str]) -> DataFrame:
    """(word, c, c0, c1, ...): all distinct words, their training counts, in all and by language; words hold bytes."""
    classes = {name: i for i, name in enumerate(languages)}
    names = ["c", *(f"c{i}" for i in range(len(languages)))]

    def kernel(batches):
        parts = [Counter() for _ in range(len(languages) + 2)]  # by language, other training texts, held-out texts

        def flush():
            for i, part in enumerate(parts):
                words, counts = list(part), list(part.values())
                part.clear()
                for at in range(0, len(words), 50_000):
                    some, none = words[at : at + 50_000], [0] * len(words[at : at + 50_000])
                    own = counts[at : at + 50_000]
                    cols = [own if i <= len(languages) else none, *(own if i == j else none for j in range(len(languages)))]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), *(pa.array(c, pa.int64()) for c in cols)], ["word", *names])

        for batch in batches:
            for doc_id, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3))):
                part = len(languages) + 1 if held_out(doc_id) else classes.get(lang, len(languages))
                parts[part].update(text.encode().lower().split() if text else ())
                if sum(map(len, parts)) > FLUSH:
                    yield from flush()
        yield from flush()

    counted = docs.mapInArrow(kernel, "word binary, " + ", ".join(f"{n} bigint" for n in names))
    return counted.groupBy("word").agg(*[F.sum(n).alias(n) for n in names])


def learn_pieces(words: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log scores of the pieces and the stop, re-estimated on the distinct training words."""
    spark = words.sparkSession
    pieces = pieces_of(path)
    scores = pieces.start()
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(scores)

        def kernel(batches):
            own, total = pieces_of(path), np.zeros(len(sent.value))
            for batch in batches:
                for _, text in _by_length(batch.column(0).to_pylist()):
                    total += expected(own.arcs(text), sent.value)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "uses"])

        uses = np.full(len(scores), 0.1)
        for row in words.filter("c > 0").select("word").mapInArrow(kernel, "piece bigint, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            uses[row["piece"]] += row["uses"]
        scores = np.log(uses / uses.sum())
    return scores


def score_documents(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS, head: int = HEAD, branches: int = BRANCHES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the model's log10 probability of the whole text, ``base_score`` that of a word
    unigram with half a count added. Words are counted over all training documents; those of the
    ``branches`` commonest values of ``lang`` also by language. At most ``head`` words, the
    commonest, go to all tasks; the others meet their scores in a join on the word, so no table
    that grows with the corpus is sent around. A null text is empty; rows repeat as they do in
    ``docs``; without training words all words come from pieces alone.
    """
    path = path or default_path()
    spark = docs.sparkSession
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    docs = docs.select(F.col("doc_id").cast("bigint"), "text", lang.alias("lang"))
    train = docs.filter(~_held("doc_id")).groupBy("lang").count()
    ends = train.agg(F.sum("count")).first()[0] or 0
    texts = {r["lang"]: r["count"] for r in train.filter("lang is not null").orderBy(F.desc("count"), "lang").limit(branches).collect()}
    languages = list(texts)
    counts, _ = written(_counts(docs, languages))
    classes = range(len(languages))
    # sizes of each count: exact below 64, in steps of an eighth of a doubling above
    level = F.when(F.col("c") < 64, F.col("c")).otherwise(F.floor(F.log2(F.col("c").cast("double")) * 8).cast("bigint") + 1000)
    levels = sorted((r["level"], r["words"], r["tokens"]) for r in counts.filter("c > 0").groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("c").alias("tokens")).collect())
    facts = counts.agg(F.count("*"), *[x for i in classes for x in (F.sum(f"c{i}"), F.count_if(F.col(f"c{i}") > 0))]).first()
    own = [(facts[1 + 2 * i] or 0, facts[2 + 2 * i]) for i in classes]  # words and distinct words by language
    once, twice = (next((w for l, w, _ in levels if l == n), 0) for n in (1, 2))
    distinct, tokens = sum(w for _, w, _ in levels), sum(t for _, _, t in levels)
    discount = once / (once + 2 * twice) if once else 0.5
    total, kinds = tokens + ends, distinct + (ends > 0)
    scores = spark.sparkContext.broadcast(learn_pieces(counts, path, rounds))
    end, inner = np.log10((ends + 0.5) / (total + 1.0)), np.log((tokens + 0.5) / (total + 1.0))
    base = lambda c: np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    size = max(1, len(languages))
    fields = [f"s{i}" for i in range(size)]

    def words(batches):
        pieces = pieces_of(path)
        for batch in batches:
            c = [batch.column(i + 1).to_numpy().astype(float) for i in range(len(languages) + 1)]
            parts = segment_scores(batch.column(0).to_pylist(), pieces, scores.value)
            draw = lambda counted, n, v, rest: np.logaddexp(np.log(np.maximum(counted - discount, 0.0) / n), np.log(discount * v / n) + rest) if n else rest
            with np.errstate(divide="ignore"):
                parts = draw(c[0], tokens, distinct, parts)
                branch = [draw(x, n, v, parts) for x, (n, v) in zip(c[1:], own)] or [parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array((x + inner) / np.log(10.0)) for x in branch)], ["word", "c", *fields])

    known, _ = written(counts.mapInArrow(words, "word binary, c bigint, " + ", ".join(f"{f} double" for f in fields)))
    least, taken = None, 0  # the lowest level of counts whose words all fit the head
    for lev, n, _ in reversed(levels):
        if taken + n > head:
            break
        least, taken = lev, taken + n
    common = known.filter((level >= least) & (F.length("word") <= HEAD_BYTES)).toArrow() if least is not None else known.limit(0).toArrow()
    found = common.column("c").to_numpy().astype(float)
    table = np.stack([base(found), *(common.column(f).to_numpy() for f in fields)], axis=1)
    top = spark.sparkContext.broadcast(({w: i for i, w in enumerate(common.column("word").to_pylist())}, table))

    def sums(batches):
        (places, table), row = top.value, TaskContext.get().partitionId() << 36
        get = places.get
        for batch in batches:
            if not batch.num_rows:
                continue
            heads, rows, words, times = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bag = Counter(text.encode().lower().split() if text else ())
                at = np.fromiter((get(w, -1) for w in bag), np.int64, len(bag))
                k = np.fromiter(bag.values(), np.int64, len(bag))
                inside = at >= 0
                heads.append((row, doc_id, int(k.sum()), int(k[inside].sum()), *(k[inside] @ table[at[inside]]).tolist()))
                rest = [w for w, i in zip(bag, inside.tolist()) if not i]
                words += rest
                times.append(k[~inside])
                rows.append(np.full(len(rest), row))
                row += 1
            marks = [b" %d" % h[0] for h in heads]  # no word holds a space
            heads = list(zip(*heads))
            empty = [None] * len(words)
            cols = [pa.array(np.concatenate((heads[0], *rows)), pa.int64()), pa.array([*marks, *words], pa.binary()), pa.array(np.concatenate((np.zeros(len(marks), np.int64), *times)))]
            cols += [pa.array([*h, *empty], pa.int64() if i < 3 else pa.float64()) for i, h in enumerate(heads[1:])]
            yield pa.RecordBatch.from_arrays(cols, ["row", "word", "k", "doc_id", "n", "known", "b", *(f"h{i}" for i in range(size))])

    parts = docs.drop("lang").mapInArrow(sums, "row bigint, word binary, k bigint, doc_id bigint, n bigint, known bigint, b double, " + ", ".join(f"h{i} double" for i in range(size)))
    joined = parts.join(known, "word", "left")
    unit = F.log10((F.col("c") + 0.5) / F.lit(float(total + 0.5 * (kinds + 1))))
    both = lambda here, there: F.sum(F.coalesce(F.col(here), F.lit(0.0)) + F.coalesce(F.col("k") * there, F.lit(0.0)))
    out = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        (F.sum("n") + 1).alias("n_tokens"),
        (F.sum("known") + F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)) + int(ends > 0)).alias("n_known"),
        (both("b", unit) + F.lit(float(base(ends)))).alias("base_score"),
        *[both(f"h{i}", F.col(f)).alias(f) for i, f in enumerate(fields)],
    )
    weights = [np.log10(n / sum(texts.values())) for n in texts.values()] or [0.0]
    branch = [F.col(f) + F.lit(float(w + end)) for f, w in zip(fields, weights)]
    best = F.greatest(*branch) if len(branch) > 1 else branch[0]
    score = best + F.log10(sum((F.pow(F.lit(10.0), b - best) for b in branch), F.lit(0.0)))
    return out.select("doc_id", _held("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", score.alias("score"))


def _held(doc_id: str):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def op1(docs: DataFrame) -> DataFrame:
    """The query: all documents."""
    return score_documents(docs)
