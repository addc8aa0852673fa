"""Quality rules from the fertility of public tokenisers.

Every word of a text is cut by two vocabularies, one with bytes to fall back on and one of bytes alone.
A text's characters per token, its share of fallback tokens and the entropy of its tokens are compared
with bands learned from all texts of its language, or of its script where no language is given, and of
about its length. What lies outside any band goes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from signalmill.functions.ordered import attach
from signalmill.llm.vocab import PATTERN, default_path, kept
from signalmill.plans.runtime import written

VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")
SLICE_BYTES = 4 << 20
TABLE_TOKENS = 1 << 21  # of the words a task remembers; then it starts anew
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
FEWEST_WORDS = 20
MOST_REPEATED = 30  # percent
#: First code points of some scripts and the ones after their last (fixed values).
SCRIPTS = {
    "latin": (0x41, 0x250), "greek": (0x370, 0x400), "cyrillic": (0x400, 0x530), "hebrew": (0x590, 0x600), "arabic": (0x600, 0x780),
    "devanagari": (0x900, 0x980), "thai": (0xE00, 0xE80), "kana": (0x3040, 0x3100), "han": (0x3400, 0xA000), "hangul": (0xAC00, 0xD7B0),
}


def _piece_cutter(path: str):
    """words -> lists of ids, and which ids are fallback bytes, of a piece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = np.array([model.IsByte(i) or model.IsUnknown(i) for i in range(model.GetPieceSize())])
    return lambda words: model.encode(words, num_threads=1), odd


def _byte_cutter(path: str):
    """The same of a byte-level vocabulary, where a token that is no whole characters counts as fallback."""
    import base64

    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    cutter = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = np.zeros(max(ranks.values()) + 1, bool)
    for piece, i in ranks.items():
        try:
            piece.decode()
        except UnicodeDecodeError:
            odd[i] = True
    return lambda words: [cutter.encode_ordinary(" " + w) for w in words], odd


def _cutter(path: str):
    return kept(("cutter", path), lambda: _piece_cutter(path) if path.endswith(".model") else _byte_cutter(path))


class _Words(dict):
    """Numbers of words, and the tokens of each under every vocabulary."""

    def __init__(self, paths: list[str]):
        self.cutters = [_cutter(p) for p in paths]
        self.chars = np.zeros(0, np.int64)
        self.ends = [np.zeros(1, np.int64) for _ in paths]
        self.tokens = [np.zeros(0, np.int64) for _ in paths]
        self.odd = [np.zeros(0, np.int64) for _ in paths]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def cut(self) -> None:
        """Cut the words that are new."""
        fresh = [w.decode(errors="replace") for w in list(self)[len(self.chars) :]]
        if not fresh:
            return
        self.chars = np.append(self.chars, [len(w) for w in fresh])
        for i, (encode, odd) in enumerate(self.cutters):
            lists = encode(fresh)
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((t for x in lists for t in x), np.int64, int(sizes.sum()))
            starts = np.concatenate([[0], np.cumsum(sizes)])
            odds = np.concatenate([[0], np.cumsum(odd[flat])])
            self.odd[i] = np.append(self.odd[i], odds[starts[1:]] - odds[starts[:-1]])
            self.ends[i] = np.append(self.ends[i], self.ends[i][-1] + starts[1:])
            self.tokens[i] = np.append(self.tokens[i], flat)

    def full(self) -> bool:
        return max(map(len, self.tokens)) + len(self) > TABLE_TOKENS


def _repeated(ids: np.ndarray, doc: np.ndarray, docs: int, window: int = WINDOW) -> np.ndarray:
    """Per document: words in windows that come twice or more in it. Equal hashes propose, the words decide."""
    n = len(ids) - window + 1
    if n <= 0:
        return np.zeros(docs, np.int64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    key = doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(window):
        key = (key ^ mixed[j : j + n]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
    inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
    inside = inside[np.argsort(key[inside], kind="stable")]
    same = key[inside[1:]] == key[inside[:-1]]
    spots = inside[np.append(same, False) | np.append(False, same)]
    if not len(spots):
        return np.zeros(docs, np.int64)
    rows = np.column_stack([doc[spots], *(ids[spots + j] for j in range(window))])
    _, back, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    spots = spots[counts[back.ravel()] > 1]
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, spots, 1)
    np.add.at(edges, spots + window, -1)
    return np.bincount(doc[np.cumsum(edges[:-1]) > 0], minlength=docs)


def _entropies(ids: np.ndarray, doc: np.ndarray, docs: int, ends: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits of entropy of each document's tokens."""
    key, counts = np.unique((doc << 32) | ids, return_counts=True)
    word, owner = key & 0xFFFFFFFF, key >> 32
    length = ends[word + 1] - ends[word]
    first = np.repeat(ends[word] - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    token = tokens[first + np.arange(len(first))]
    pair, weight = (np.repeat(owner, length) << 32) | token, np.repeat(counts, length)
    order = np.argsort(pair, kind="stable")
    pair, weight = pair[order], weight[order]
    starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
    c = np.add.reduceat(weight, starts).astype(float) if len(starts) else np.zeros(0)
    total = np.bincount(pair[starts] >> 32, weights=c * np.log2(c), minlength=docs) if len(starts) else np.zeros(docs)
    some = np.maximum(sizes, 1)
    return np.where(sizes > 0, np.log2(some) - total / some, 0.0)


def _script(text: bytes) -> str:
    """The script with most characters of a text."""
    points = np.frombuffer(text.decode(errors="replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = {name: int(((points >= a) & (points < b)).sum()) for name, (a, b) in SCRIPTS.items()}
    return max(counts, key=counts.get) if any(counts.values()) else "other"


def _measured(texts: list[bytes], words: _Words) -> dict:
    lists = [t.split() for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    ids = np.fromiter((i for x in lists for i in map(words.__getitem__, x)), np.int64, int(sizes.sum()))
    del lists
    words.cut()
    docs, doc = len(texts), np.repeat(np.arange(len(texts)), sizes)
    add = lambda x: np.bincount(doc, weights=x[ids], minlength=docs).astype(np.int64)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    out = {
        "n_words": sizes,
        "word_chars": add(words.chars),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": _repeated(ids, doc, docs),
    }
    for i in range(len(words.cutters)):
        out[f"tokens_{i}"] = add(np.diff(words.ends[i]))
        out[f"odd_{i}"] = add(words.odd[i])
        out[f"entropy_{i}"] = _entropies(ids, doc, docs, words.ends[i], words.tokens[i], out[f"tokens_{i}"])
    return out


FENCE = 6  # a band reaches so many times the way from its group's median to the quartile of that side
LEAST = 50  # texts of one language and length class; below, the class of all languages is taken, and no band below there too
#: Steps a unit in which a measure is compared, and the steps that a band reaches to either side at least.
MEASURES = {"chars": (1024, 50), "odd": (1024, 50), "entropy": (1024, 200)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame, vocabularies: Sequence[str] = VOCABULARIES) -> DataFrame:
    """Per row: doc_id, grp, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and, for each vocabulary i,
    tokens_i, odd_i (fallback tokens) and entropy_i (bits).

    ``grp`` names the bands that hold: ``lang``, or the script with most characters. A word is cut as
    it stands after a blank; white space itself is not measured. A null text has no words.
    """
    paths = [default_path(v) for v in vocabularies]
    counts = [*COUNTS, *[f"{m}_{i}" for i in range(len(paths)) for m in ("tokens", "odd")]]
    shares = [f"entropy_{i}" for i in range(len(paths))]

    def slices(texts):
        part, size = [], 0
        for text in texts:
            part.append(text.as_py())
            size += len(part[-1])
            if size >= SLICE_BYTES:
                yield part
                part, size = [], 0
        if part:
            yield part

    def kernel(batches):
        words = _Words(paths)
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                if words.full():
                    words = _Words(paths)
                got = _measured(part, words)
                names = [f"script {_script(t)}" if x is None else f"lang {x}" for x, t in zip(batch.column(2).slice(at, len(part)).to_pylist(), part)]
                columns = [batch.column(0).slice(at, len(part)), pa.array(names, pa.string()), *[pa.array(got[c].astype(np.int64)) for c in counts], *[pa.array(got[c]) for c in shares]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "grp", *counts, *shares])
                at += len(part)

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"))
    return given.mapInArrow(kernel, f"doc_id bigint, grp string, {', '.join(f'{c} bigint' for c in counts)}, {', '.join(f'{c} double' for c in shares)}")


def _length_class(words: Column) -> Column:
    """Half octaves of the number of words; -1: none."""
    return F.when(words > 0, F.floor(2 * F.log2(words) + 1e-9)).otherwise(-1).cast("int")


def _steps(count: int) -> dict[str, Column]:
    """Every measure of a row in whole steps."""
    out = {}
    for i in range(count):
        tokens = F.greatest(F.col(f"tokens_{i}"), F.lit(1))
        for name, value in (("chars", F.col("word_chars") / tokens), ("odd", F.col(f"odd_{i}") / tokens), ("entropy", F.col(f"entropy_{i}"))):
            out[f"{name}_{i}"] = F.floor(value * MEASURES[name][0] + 1e-6).cast("bigint")
    return out


def bands(measured: DataFrame, count: int, fence: int = FENCE, least: int = LEAST) -> DataFrame:
    """(grp, class, <measure>_low, <measure>_high): the steps from which to which a measure is sound.

    Quartiles are exact: the lowest step at or below which lie that many of the class's texts, from
    counts of all texts. Classes with fewer than ``least`` texts take the band over all groups.
    """
    steps = _steps(count)
    tall = measured.filter("n_words > 0").select("grp", _length_class(F.col("n_words")).alias("class"), F.explode(F.create_map(*[x for k, v in steps.items() for x in (F.lit(k), v)])).alias("measure", "step"))
    counted, _ = written(tall.groupBy("grp", "class", "measure", "step").agg(F.count("*").alias("n")))
    whole = counted.groupBy("class", "measure", "step").agg(F.sum("n").alias("n")).withColumn("grp", F.lit(None).cast("string"))
    every = counted.unionByName(whole)
    own = Window.partitionBy("grp", "class", "measure")
    ranked = every.withColumn("cum", F.sum("n").over(own.orderBy("step"))).withColumn("all", F.sum("n").over(own)).filter(F.col("all") >= least)
    at = [F.min(F.when(F.col("cum") * 4 >= F.col("all") * q, F.col("step"))).alias(f"q{q}") for q in (1, 2, 3)]
    cut = ranked.groupBy("grp", "class", "measure").agg(*at)
    reach = F.create_map(*[x for k, (_, width) in MEASURES.items() for x in (F.lit(k), F.lit(width))])[F.substring_index("measure", "_", 1)]
    low, high = F.col("q2") - F.greatest(fence * (F.col("q2") - F.col("q1")), reach), F.col("q2") + F.greatest(fence * (F.col("q3") - F.col("q2")), reach)
    wide = cut.withColumn("low", low).withColumn("high", high).groupBy("grp", "class").pivot("measure", list(steps)).agg(F.first("low").alias("low"), F.first("high").alias("high"))
    names = [f"{m}_{side}" for m in steps for side in ("low", "high")]
    general = wide.filter("grp is null").select("class", *[F.col(c).alias(f"any_{c}") for c in names])
    groups = counted.select("grp", "class").distinct().join(wide, ["grp", "class"], "left").join(general, "class", "left")
    return groups.select("grp", "class", *[F.coalesce(c, f"any_{c}").alias(c) for c in names])


def judge(docs: DataFrame, vocabularies: Sequence[str] = VOCABULARIES, fence: int = FENCE, least: int = LEAST) -> DataFrame:
    """Per row of ``docs``: its measures, base_failed, ``outside`` (the measures out of their bands) and kept.

    base_failed: fewer than 20 words, or over 30 percent of them in 8-word windows that come twice or more.
    Rows that repeat or have no doc_id are judged each; ``lang`` null: by script; a null text fails; in
    classes without a band nothing is outside. Other columns are not read. An empty table gives no rows.
    """
    count = len(vocabularies)
    measured, _ = written(measures(docs, vocabularies))
    limits, _ = written(bands(measured, count, fence, least))
    steps = _steps(count)
    with_class = measured.withColumn("class", _length_class(F.col("n_words"))).withColumn("spread", F.xxhash64("doc_id", "word_chars"))
    joined = attach(with_class, limits, ["grp", "class"], how="left", salt="spread").drop("spread")
    outside = F.array_compact(F.array(*[F.when((v < F.col(f"{k}_low")) | (v > F.col(f"{k}_high")), F.lit(k)) for k, v in steps.items()]))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = joined.withColumn("base_failed", failed).withColumn("outside", outside)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0)).drop("class", *limits.columns[2:])


def op11(docs: DataFrame) -> DataFrame:
    """The query: every document's base measures and verdict."""
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept")
