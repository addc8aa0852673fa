"""Merge-dropout for piece vocabularies of the merge type.

A word is split into characters and the best-scored adjacent pair that makes a piece is merged,
again and again. With dropout a candidate merge is skipped when the keyed hash of the seed, the
word, its place and its piece falls below the rate, so a seed gives one segmentation on any
machine, and another seed another one. Characters without a piece become byte pieces, so decoding
gives back every text exactly.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from signalmill.llm.vocab import default_path, kept

RATE = 0.1
CACHE = 700_000
SLICE = 1024  # documents that are handled together
SHORT = 48  # characters of words that are merged in batches
MASK = (1 << 64) - 1
STEPS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SPACE = "▁"


class Vocabulary:
    """Pieces with their scores; a space stands for the vocabulary's own space mark."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i).replace(SPACE, " "): i for i in plain}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.cost = np.full(size, np.inf)
        self.cost[plain] = [-model.get_score(i) for i in plain]
        self.bytes = [b""] * size
        for piece, i in self.ids.items():
            self.bytes[i] = piece.encode()
        for byte, i in self.byte.items():
            self.bytes[i] = bytes([byte])
        pairs = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * size + right] = i
        self.size = size
        self.chars = {c: i for c, i in self.ids.items() if len(c) == 1}
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.merged = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        slots = self.slot(np.array(list(pairs), np.int64)).tolist()
        for at, (key, piece) in zip(slots, pairs.items()):  # open addressing: the next free slot
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.merged[at] = key, piece
        self.model = model
        self.length = np.zeros(size, np.int64)  # characters; a character's bytes after its first have none
        for piece, i in self.ids.items():
            self.length[i] = len(piece)
        for byte, i in self.byte.items():
            self.length[i] = byte >> 6 != 2
        self._trees()

    def _trees(self) -> None:
        """The merges by which each piece is made where nothing is skipped, on its own or within a word.

        No merge crosses the ends of a piece that stays, so a piece is always made the same way.
        """
        spelled = list(self.ids)
        ids = np.full((len(spelled), max(map(len, spelled)) + 2), -2, np.int64)
        for r, piece in enumerate(spelled):
            ids[r, 1 : len(piece) + 1] = [self.chars.get(c, -1) for c in piece]
        merges: list = []
        _merge_rounds(ids, np.zeros(len(ids), np.uint64), 0.0, self, merges)
        row, place, made = (np.concatenate(x) for x in zip(*merges))
        piece = np.array(list(self.ids.values()), np.int64)[row]
        order = np.argsort(piece, kind="stable")
        self.tree_place, self.tree_piece = place[order], made[order]
        self.tree_size = np.bincount(piece, minlength=self.size)
        self.tree_start = np.cumsum(self.tree_size) - self.tree_size

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(STEPS[0])) >> np.uint64(64 - self.bits)).astype(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pieces that pairs make, or -1."""
        key = np.where((left < 0) | (right < 0), -2, left * self.size + right).ravel()
        at = self.slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.merged[at], -1)
        open_ = np.flatnonzero((found != key) & (found >= 0) & (key >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.merged[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out.reshape(np.shape(left))


def vocabulary(path: str) -> Vocabulary:
    return kept(("pieces", path), lambda: Vocabulary(path))


def word_key(word: str, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode(), seed & MASK)


def word_keys(words: list[bytes], seeds: list[int]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words, seeds), np.uint64, len(words))


def skipped(key: int, place: int, piece: int, rate: float) -> bool:
    """Whether the candidate merge of ``piece`` at ``place`` of the word is dropped."""
    x = (key + place * STEPS[0] + piece * STEPS[1]) & MASK
    x = ((x ^ (x >> 30)) * STEPS[1]) & MASK
    x = ((x ^ (x >> 27)) * STEPS[2]) & MASK
    return (x ^ (x >> 31)) >> 11 < int(rate * (1 << 53))


def mixed(place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """What a candidate merge adds to the key of its word."""
    return place.astype(np.uint64) * np.uint64(STEPS[0]) + piece.astype(np.uint64) * np.uint64(STEPS[1])


def _low(x: np.ndarray, rate: float) -> np.ndarray:
    _, b, c = (np.uint64(s) for s in STEPS)
    x = (x ^ (x >> np.uint64(30))) * b
    x = (x ^ (x >> np.uint64(27))) * c
    return (x ^ (x >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(rate * (1 << 53)))


def _skipped_all(key: np.ndarray, place: np.ndarray, piece: np.ndarray, rate: float) -> np.ndarray:
    return _low(key + mixed(place, piece), rate)


def merge_one(word: str, seed: int, rate: float, vocab: Vocabulary) -> list[int]:
    """Segmentation of one word by an agenda of candidate merges: best score first, then leftmost."""
    return _by_agenda(word, word_key(word, seed), rate, vocab)


def _by_agenda(word: str, key: int, rate: float, vocab: Vocabulary) -> list[int]:
    ids = [vocab.chars.get(c, -1) for c in word]
    n, agenda = len(ids), []
    prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))

    def offer(i: int) -> None:
        j = nxt[i]
        if i < 0 or j >= n or ids[i] < 0 or ids[j] < 0:
            return
        piece = int(vocab.join(np.array([ids[i]]), np.array([ids[j]]))[0])
        if piece >= 0 and not skipped(key, i, piece, rate):
            heapq.heappush(agenda, (vocab.cost[piece], i, ids[i], j, ids[j], piece))

    for i in range(n - 1):
        offer(i)
    while agenda:
        _, i, left, j, right, piece = heapq.heappop(agenda)
        if ids[i] != left or nxt[i] != j or ids[j] != right:
            continue
        ids[i], ids[j], nxt[i] = piece, -2, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    return _spelled(word, ids, vocab)


def _spelled(word: str, ids: list[int], vocab: Vocabulary) -> list[int]:
    """Pieces by place, characters without one as bytes."""
    out: list[int] = []
    for i, x in enumerate(ids):
        if x >= 0:
            out.append(x)
        elif x == -1:
            out += [vocab.byte[b] for b in word[i].encode()]
    return out


def merge_many(words: list[str], seeds: list[int], rate: float, vocab: Vocabulary) -> list[list[int]]:
    """``merge_one`` of many words, the batch's best candidates merged together round by round."""
    pool, starts, sizes = _merge_all(words, np.fromiter(map(word_key, words, seeds), np.uint64, len(words)), rate, vocab)
    return [pool[a : a + n].tolist() for a, n in zip(starts.tolist(), sizes.tolist())]


def _merge_all(words: list[str], keys: np.ndarray, rate: float, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of many words one after another, and where in them each word's start and how many they are."""
    starts, sizes, pool, end = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
    size, get = np.fromiter(map(len, words), np.int64, len(words)), vocab.chars.get

    def put(rows, counts, values):
        nonlocal end
        starts[rows], sizes[rows] = end + np.cumsum(counts) - counts, counts
        pool.append(np.asarray(values, np.int32))
        end += len(values)

    for i in np.flatnonzero(size > SHORT).tolist():
        ids = _by_agenda(words[i], int(keys[i]), rate, vocab)
        put([i], np.array([len(ids)]), ids)
    widths = (-1, 4, 8, 12, 16, 24, 32, SHORT)
    for low, width in zip(widths, widths[1:]):
        alike = np.flatnonzero((size > low) & (size <= width))
        for at in range(0, len(alike), 1 << 13):
            rows = alike[at : at + (1 << 13)]
            picked = [words[i] for i in rows.tolist()]
            ids = np.full((len(rows), width + 2), -2, np.int64)  # -2: no symbol, -1: a character without a piece
            ids[:, 1:-1][np.arange(width) < size[rows, None]] = [get(c, -1) for w in picked for c in w]
            _merge_rounds(ids, keys[rows], rate, vocab)
            odd = (ids == -1).any(axis=1)
            here = (ids != -2) & ~odd[:, None]
            put(rows, here.sum(axis=1), ids[here])
            for r in np.flatnonzero(odd).tolist():
                spelled = _spelled(picked[r], ids[r, 1:].tolist(), vocab)
                put(rows[r : r + 1], np.array([len(spelled)]), spelled)
    return np.concatenate(pool) if pool else np.zeros(0, np.int32), starts, sizes


def _merge_rounds(ids: np.ndarray, keys: np.ndarray, rate: float, vocab: Vocabulary, merges: list | None = None) -> None:
    """Merge the rows of ``ids``, symbols by place between two guard columns, in place; what is merged away becomes -2.

    Every round makes the best merge of every row. Symbols know their neighbours by position in the flat
    array, so a round costs the rows and not their symbols. ``merges`` gets (row, place, piece) of each round.
    """
    width = ids.shape[1]
    flat, spots = ids.ravel(), np.arange(ids.size)
    prev, nxt = spots - 1, spots + 1
    made, cost = np.full(ids.size, -1, np.int64), np.full(ids.size, np.inf)

    def offer(left: np.ndarray, right: np.ndarray, row: np.ndarray) -> None:
        piece = vocab.join(flat[left], flat[right])
        price = np.where(piece < 0, np.inf, vocab.cost[piece])
        if rate > 0:
            price[_skipped_all(keys[row], left - row * width - 1, np.maximum(piece, 0), rate)] = np.inf
        made[left], cost[left] = piece, price

    some = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))
    offer(some, some + 1, some // width)
    live, table = np.arange(len(ids)), cost.reshape(ids.shape)
    while len(live):
        at = live * width + table[live].argmin(axis=1)
        going = np.isfinite(cost[at])
        live, at = live[going], at[going]
        gone = nxt[at]
        after, before = nxt[gone], prev[at]
        if merges is not None:
            merges.append((live, at - live * width - 1, made[at]))
        flat[at], flat[gone], cost[gone] = made[at], -2, np.inf
        nxt[at], prev[after] = after, at
        offer(at, after, live)
        offer(before, at, live)


def occurrence_seed(seed: int, nth: int) -> int:
    """The seed of the ``nth`` word of a document."""
    return (seed + (nth + 1) * STEPS[2]) & MASK


class Encoder:
    """Texts to ids under one rate; under seeds of whole texts, segmentations of words are kept, up to a bound."""

    def __init__(self, vocab: Vocabulary, rate: float):
        self.vocab, self.rate, self.kept, self.split = vocab, rate, {}, re.compile(r" *[^ ]+| +")

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_merge_all`` at rate 0, by the vocabulary's own encoder where that reads the words as they are."""
        own = [bool(w.strip(" ")) and w[0] == " " and SPACE not in w for w in words]
        found = iter(self.vocab.model.encode([w[1:] for w, o in zip(words, own) if o], num_threads=1))
        ids, table = [next(found) if o else [] for o in own], self.vocab.bytes
        other = [i for i, (w, x) in enumerate(zip(words, ids)) if b"".join([table[p] for p in x]) != w.encode()]
        pool, starts, sizes = _merge_all([words[i] for i in other], np.zeros(len(other), np.uint64), 0.0, self.vocab)
        for i, a, n in zip(other, starts.tolist(), sizes.tolist()):
            ids[i] = pool[a : a + n].tolist()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((p for x in ids for p in x), np.int32, int(sizes.sum())), np.cumsum(sizes) - sizes, sizes

    def _merges(self, pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places and pieces, as ``mixed``, of all merges that plain segmentations are made by, each word's start and number."""
        v = self.vocab
        ends = np.cumsum(v.length[pool])
        offset = ends - v.length[pool]
        offset -= np.repeat(offset[np.minimum(starts, max(len(pool) - 1, 0))], sizes) if len(pool) else 0
        n = v.tree_size[pool]
        total = np.concatenate(([0], np.cumsum(n)))
        source = np.arange(total[-1]) + np.repeat(v.tree_start[pool] - total[:-1], n)
        first = total[starts]
        return mixed(np.repeat(offset, n) + v.tree_place[source], v.tree_piece[source]), first, total[starts + sizes] - first

    def encode_flat(self, texts: list[str], seeds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another and the places where texts begin, with a seed of its own for every word.

        A word keeps its plain segmentation unless one of the merges that make it is skipped: up to the
        first skipped one both ways of merging are the same. So skips are drawn for every occurrence, for these
        few merges, and only occurrences that lose one are merged again.
        """
        words = [self.split.findall(" " + t) if t else [] for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        code = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        names, raw = list(code), [w.encode() for w in code]
        flat = np.fromiter((code[w] for ws in words for w in ws), np.int64, int(counts.sum()))
        nth = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        own = np.repeat(np.array([s & MASK for s in seeds], np.uint64), counts) + (nth + 1).astype(np.uint64) * np.uint64(STEPS[2])
        keys = word_keys([raw[i] for i in flat.tolist()], own.tolist())
        pool, starts, sizes = self._plain(names)
        merges, first, size = self._merges(pool, starts, sizes)
        again = np.zeros(len(flat), bool)
        for at in range(0, len(flat), 1 << 16):
            some = flat[at : at + (1 << 16)]
            n = size[some]
            which = np.repeat(np.arange(len(some)), n)
            source = np.arange(len(which)) + np.repeat(first[some] - (np.cumsum(n) - n), n)
            again[at + which[_low(keys[at + which] + merges[source], self.rate)]] = True
        redo = np.flatnonzero(again)
        more, its, many = _merge_all([names[i] for i in flat[redo].tolist()], keys[redo], self.rate, self.vocab)
        begin, length = starts[flat], sizes[flat]
        begin[redo], length[redo] = its + len(pool), many
        ends = np.concatenate(([0], np.cumsum(length)))
        ids = np.concatenate((pool, more))[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], length)]
        return ids, ends[np.concatenate(([0], np.cumsum(counts)))]

    def encode_each(self, texts: list[str], seeds: list[int]) -> list[list[int]]:
        """As ``encode``, with a seed of its own for every word of a text."""
        ids, ends = self.encode_flat(texts, seeds)
        return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]

    def encode(self, texts: list[str], seeds: list[int]) -> list[list[int]]:
        """Merges never cross from a letter to a space, so words with the spaces before them stand alone."""
        words = [self.split.findall(" " + t) if t else [] for t in texts]
        new: dict[int, set] = {}
        for ws, seed in zip(words, seeds):
            new.setdefault(seed, set()).update(ws)
        for seed, some in new.items():
            some.difference_update(self.kept.setdefault(seed, {}))
        flat, of = [w for some in new.values() for w in some], [seed for seed, some in new.items() for _ in some]
        for w, seed, ids in zip(flat, of, merge_many(flat, of, self.rate, self.vocab)):
            self.kept[seed][w] = ids
        out = []
        for ws, seed in zip(words, seeds):
            own, ids = self.kept[seed], []
            for w in ws:
                ids += own[w]
            out.append(ids)
        if sum(map(len, self.kept.values())) > CACHE:
            self.kept.clear()
        return out

    def decode(self, ids: list[int]) -> str:
        table = self.vocab.bytes
        return b"".join([table[i] for i in ids]).decode()[1:]


def encode_dropout(docs: DataFrame, rate: float = RATE, seed: int = 7, path: str | None = None) -> DataFrame:
    """(doc_id, ids, n_ids, lossless): each text's pieces under merge-dropout, decoded again to compare.

    Merges are skipped by a hash of the document's id, the word and its place among the document's
    words, so every occurrence is cut on its own, the same way on every run. A null or empty text has no
    pieces; a rate of 0 is the vocabulary's plain segmentation; other columns are not read.
    """

    def kernel(batches):
        import xxhash

        coder = kept(("dropout", path, rate), lambda: Encoder(vocabulary(path or default_path("piece_bpe_32k.model")), rate))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                seeds = [seed * 1_000_003 + xxhash.xxh64_intdigest(str(i).encode(), seed & MASK) for i in part.column(0).to_pylist()]
                ids, ends = coder.encode_flat(texts, seeds)
                same = [coder.decode(ids[a:b].tolist()) == t for a, b, t in zip(ends, ends[1:], texts)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                cols = [part.column(0), lists, pa.array(np.diff(ends)), pa.array(same)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "n_ids", "lossless"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(kernel, "doc_id bigint, ids array<int>, n_ids bigint, lossless boolean")


def op3(docs: DataFrame) -> DataFrame:
    """The query: all documents."""
    return encode_dropout(docs)
