"""Whitening of embeddings by QR, a bidiagonal form and its singular values and vectors.

Centred rows are reduced block by block to triangular factors, which are merged in a tree to one R;
rows never leave their tasks and no product of two of them is formed, so small directions keep their
digits. R is brought to upper bidiagonal form by Householder reflections. dqds finds the singular values
of that form; twisted factorisations of its square, less one value, give the directions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from signalmill.plans.runtime import written

SCALE = 256
COMPONENTS = 4
BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 2048
PARTS = 4096  # factors that reach the tree at most, but for more tasks than this
FAN = 16
MODEL_BYTES = 64 << 20  # of all lengths' models together; beyond, they meet the rows in a shuffled join
CLOSE = 1e-3  # relative distance below which directions are made orthogonal to each other
EPS = np.finfo(float).eps


def integer_rows(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * c) of each entry c; rows whose vector is null or holds null or non-finite entries go."""
    ok = "embedding is not null and not exists(embedding, c -> c is null or isnan(c) or abs(double(c)) = double('infinity'))"
    return vectors.select("vec_id", "embedding").filter(ok).select(F.col("vec_id").cast("bigint"), F.expr(f"transform(embedding, c -> floor({scale} * double(c)))").alias("x"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of vectors of one length; body is int64, vector after vector."""
    schema = pa.schema([("dim", pa.int64()), ("ids", pa.list_(pa.int64())), ("body", pa.binary())])

    def kernel(batches):
        for batch in batches:
            lists, ids = batch.column(1), batch.column(0)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            for dim in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == dim)
                step = int(max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim))))
                for cut in range(0, len(at), step):
                    pick = at[cut : cut + step]
                    body = flat[(ends[pick] - dim)[:, None] + np.arange(dim)].astype(np.int64)
                    yield pa.RecordBatch.from_pylist([{"dim": int(dim), "ids": ids.take(pa.array(pick)).to_pylist(), "body": body.tobytes()}], schema=schema)

    return rows.select("vec_id", "x").mapInArrow(kernel, "dim bigint, ids array<bigint>, body binary")


def _with_model(blocks: DataFrame, model: DataFrame, each: int) -> DataFrame:
    """Every block with its length's model; ``each`` bounds the model's bytes per entry of a vector."""
    size = model.agg(F.sum(F.col("dim") * each)).first()[0] or 0
    return blocks.join(F.broadcast(model) if size <= MODEL_BYTES else model, "dim")


def _sums(fit: DataFrame) -> DataFrame:
    """(dim, n, total): the number of vectors of each length and their exact sums, as whole numbers of any size."""

    def kernel(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for dim, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(body, np.int64).reshape(-1, dim)
                own = found.setdefault(dim, [0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)])
                own[0] += len(x)
                own[1] += (x >> 32).sum(axis=0)
                own[2] += (x & 0xFFFFFFFF).sum(axis=0)
        for dim, (n, high, low) in found.items():
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"dim": dim, "i": np.arange(dim), "n": n, "high": high, "low": low}), preserve_index=False)

    parts = fit.select("dim", "body").mapInArrow(kernel, "dim bigint, i bigint, n bigint, high bigint, low bigint")
    whole = F.expr("cast(sum(high) as decimal(20, 0)) * cast(4294967296 as decimal(10, 0)) + cast(sum(low) as decimal(20, 0))").cast("decimal(38,0)").cast("string")
    each = parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), whole.alias("total"))
    return each.groupBy("dim").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "total"))), lambda s: s["total"]).alias("total"))


def _deviations(body: bytes, dim: int, n: int, total: list[str]) -> np.ndarray:
    """n x - S of each row, exact: 64-bit where that holds them and their squares' sum, else Python integers."""
    x = np.frombuffer(body, np.int64).reshape(-1, dim)
    sums = [int(s) for s in total]
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    if most * most * dim < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows, padded to a square."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))]) if len(r) < rows.shape[1] else r


def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            centred = _deviations(row["body"], row["dim"], row["n"], row["total"]).astype(float) / row["n"]
            found[row["dim"]] = _triangle(np.vstack([found[row["dim"]], centred]) if row["dim"] in found else centred)
    part = TaskContext.get().partitionId() % PARTS
    for dim, r in found.items():
        yield pa.RecordBatch.from_pydict({"dim": [dim], "part": [part], "r": [r.tobytes()]}, schema=pa.schema([("dim", pa.int64()), ("part", pa.int64()), ("r", pa.binary())]))


def _merged(key, rows: pd.DataFrame) -> pd.DataFrame:
    dim = int(key[0])
    r = _triangle(np.vstack([np.frombuffer(b).reshape(dim, dim) for b in rows["r"]]))
    return pd.DataFrame({"dim": [dim], "part": [key[1]], "r": [r.tobytes()]})


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, p): diagonal and superdiagonal of U' R P, and the orthogonal P, by Householder reflections."""
    r, d = np.array(r, float), len(r)
    p = np.eye(d)

    def mirror(x):
        v, size = x.copy(), np.linalg.norm(x)
        if size == 0:
            return None
        v[0] += size if x[0] >= 0 else -size
        return v / np.linalg.norm(v)

    for k in range(d):
        if (v := mirror(r[k:, k])) is not None:
            r[k:, k:] -= 2 * np.outer(v, v @ r[k:, k:])
        if k + 2 < d and (v := mirror(r[k, k + 1 :])) is not None:
            r[k:, k + 1 :] -= 2 * np.outer(r[k:, k + 1 :] @ v, v)
            p[:, k + 1 :] -= 2 * np.outer(p[:, k + 1 :] @ v, v)
    return np.diag(r).copy(), np.diag(r, 1).copy(), p


def _shifted(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float], float]:
    """One differential qd transform with shift ``tau``, and the smallest of its differences (negative: the shift was too large)."""
    new_q, new_e, d, least = [], [], q[0] - tau, q[0] - tau
    for i in range(len(e)):
        if d < 0:
            return q, e, least
        top = d + e[i]
        ratio = q[i + 1] / top if top > 0 else 0.0
        new_q.append(top)
        new_e.append(e[i] * ratio if top > 0 else 0.0)
        d = d * ratio - tau if top > 0 else q[i + 1] - tau
        least = min(least, d)
    return [*new_q, d], new_e, least


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values, falling, of the upper bidiagonal with diagonal ``a`` and superdiagonal ``b``."""
    found: list[float] = []
    open_ = [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)]
    while open_:
        q, e, base = open_.pop()
        sweeps = 0
        while q:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (base + q[i]) or e[i] <= EPS * EPS * (base + q[i + 1])), None)
            if len(q) == 1:
                found.append(base + q[0])
                break
            if cut is not None:
                open_ += [(q[: cut + 1], e[:cut], base)]
                q, e, sweeps = q[cut + 1 :], e[cut + 1 :], 0
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            # the smaller eigenvalue of the last two rows, a little less, as shift; no shift after many sweeps
            x, y, z = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-2] * e[-1], q[-1] + e[-1]
            half = (x + z) / 2
            big = half + np.sqrt(max(0.0, ((x - z) / 2) ** 2 + y))
            tau = max(0.0, (x * z - y) / big) * (1 - 8 * EPS) if big > 0 and sweeps < 60 * len(q) else 0.0
            while True:
                new_q, new_e, least = _shifted(q, e, tau)
                if least >= 0 or tau == 0:
                    break
                tau = tau / 4 if tau > 1e-3 * q[-1] else 0.0
            q, e, base, sweeps = new_q, new_e, base + tau, sweeps + 1
    return np.array(sorted(found, reverse=True))


class Twisted:
    """T - value, T the square of a bidiagonal, factored from the top and from the bottom to where they meet best."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: float):
        n, tiny = len(a), EPS * EPS * max(float((a * a).max()), 1e-300)
        safe = lambda x: x if abs(x) > tiny else tiny
        s, top, self.down = np.full(n, -value), np.empty(n), np.empty(max(n - 1, 0))
        for i in range(n):
            top[i] = safe(s[i] + a[i] ** 2)
            if i + 1 < n:
                self.down[i] = a[i] * b[i] / top[i]
                s[i + 1] = b[i] ** 2 * s[i] / top[i] - value
        p, low, self.up = np.empty(n), np.empty(n), np.empty(max(n - 1, 0))
        p[-1] = a[-1] ** 2 - value
        for i in range(n - 2, -1, -1):
            low[i + 1] = safe(b[i] ** 2 + p[i + 1])
            self.up[i] = a[i] * b[i] / low[i + 1]
            p[i] = p[i + 1] * a[i] ** 2 / low[i + 1] - value
        meet = s + p + value
        self.at = r = int(np.argmin(np.abs(meet)))
        self.diagonal = np.concatenate([top[:r], [safe(meet[r])], low[r + 1 :]])

    def outward(self, x: np.ndarray) -> np.ndarray:
        """Solve the transposed factor: from the meeting place to both ends."""
        y, r = x.copy(), self.at
        for i in range(r - 1, -1, -1):
            y[i] -= self.down[i] * y[i + 1]
        for i in range(r, len(y) - 1):
            y[i + 1] -= self.up[i] * y[i]
        return y

    def vector(self) -> np.ndarray:
        start = np.zeros(len(self.diagonal))
        start[self.at] = 1.0
        z = self.outward(start)
        return z / np.linalg.norm(z)

    def solve(self, x: np.ndarray) -> np.ndarray:
        y, r = x.copy(), self.at
        for i in range(1, r + 1):
            y[i] -= self.down[i - 1] * y[i - 1]
        for i in range(len(y) - 2, r - 1, -1):
            y[i] -= self.up[i] * y[i + 1]
        z = self.outward(y / self.diagonal)
        return z / np.abs(z).max()


def directions(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest squared singular values and their right vectors, as rows.

    Vectors of values that lie close together are found by inverse iteration in the same factorisation,
    each kept orthogonal to those before it.
    """
    b = np.where(np.abs(b) <= EPS * (np.abs(a[:-1]) + np.abs(a[1:])), 0.0, b)
    edges = [0, *(np.flatnonzero(b == 0) + 1), len(a)]
    pairs = sorted(((v, lo, hi) for lo, hi in zip(edges, edges[1:]) for v in dqds(a[lo:hi], b[lo : hi - 1])), key=lambda t: (-t[0], t[1]))
    values, vectors, places = [], [], []
    for value, lo, hi in pairs[:count]:
        part = Twisted(a[lo:hi], b[lo : hi - 1], value)
        near = [v[lo:hi] for v, w, at in zip(vectors, values, places) if at == lo and abs(w - value) <= CLOSE * abs(w)]
        z = part.vector()
        if near:
            z = np.random.default_rng(len(vectors)).standard_normal(hi - lo)
            for _ in range(4):
                z = part.solve(z)
                for _ in range(2):
                    for other in near:
                        z = z - (other @ z) * other
                z = z / np.linalg.norm(z)
        vectors.append(np.concatenate([np.zeros(lo), z, np.zeros(len(a) - hi)]))
        values.append(value)
        places.append(lo)
    return np.array(values), np.array(vectors).reshape(len(values), len(a))


def _solved(count: int):
    def kernel(key, rows: pd.DataFrame) -> pd.DataFrame:
        dim = int(key[0])
        r, n = np.frombuffer(rows["r"].iloc[0]).reshape(dim, dim), int(rows["n"].iloc[0])
        scale = float(np.abs(r).max())
        if scale == 0:
            return pd.DataFrame({"dim": [dim], "values": [[]], "vectors": [b""], "explained": [[]]})
        a, b, p = bidiagonal(r / scale)
        values, vectors = directions(a, b, min(count, dim))
        sound = np.sqrt(values) > 8 * dim * EPS * np.sqrt(values[0])
        values, vectors = values[sound], vectors[sound] @ p.T
        share = values / float((r / scale * (r / scale)).sum())
        return pd.DataFrame({"dim": [dim], "values": [(values * scale * scale / n).tolist()], "vectors": [vectors.tobytes()], "explained": [share.tolist()]})

    return kernel


def _projected(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Exact deviations of a block's rows, and the rows whitened."""
    apart = _deviations(row["body"], row["dim"], row["n"], row["total"])
    basis = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
    return apart, (apart.astype(float) / row["n"]) @ basis.T / np.sqrt(np.array(row["values"]))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            if not row["values"]:
                continue
            w = _projected(row)[1]
            own = found.setdefault(row["dim"], [0.0, 0.0])
            own[0] = own[0] + w.sum(axis=0)
            own[1] = own[1] + w.T @ w
    for dim, (sums, products) in found.items():
        i, j = np.indices(products.shape).reshape(2, -1)
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"dim": dim, "i": i, "j": j, "si": sums[i], "sj": sums[j], "p": products.ravel()}), preserve_index=False)


def whitening_model(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(dim, n, total, values, vectors, explained, identity_error), one row per length of vectors.

    Fitted on each distinct vector once. ``values`` are the eigenvalues of the covariance, ``vectors`` the
    unit directions, row after row. Directions without variance, to double precision, are left out, so
    equal vectors alone have none. ``identity_error`` is the largest entry of the whitened vectors'
    covariance less the identity, measured on the fitted vectors.
    """
    fit, _ = written(_blocks(rows.select("x").distinct().select(F.lit(None).cast("bigint").alias("vec_id"), "x")).select("dim", "body"))
    sums, _ = written(_sums(fit))
    parts = _with_model(fit, sums, 64).select("dim", "n", "total", "body").mapInArrow(_factors, "dim bigint, part bigint, r binary")
    size = PARTS
    while size > 1:
        size //= FAN
        parts = parts.withColumn("part", F.col("part") % size).groupBy("dim", "part").applyInPandas(_merged, "dim bigint, part bigint, r binary")
    solved = parts.join(sums.select("dim", "n"), "dim").groupBy("dim").applyInPandas(_solved(components), "dim bigint, values array<double>, vectors binary, explained array<double>")
    model, _ = written(sums.join(solved, "dim"))
    found = _with_model(fit, model, 64 + 8 * components).select("dim", "n", "total", "values", "vectors", "body").mapInArrow(_products, "dim bigint, i bigint, j bigint, si double, sj double, p double")
    each = found.groupBy("dim", "i", "j").agg(*[F.sum(c).alias(c) for c in ("si", "sj", "p")]).join(sums.select("dim", "n"), "dim")
    off = F.abs(F.col("p") / F.col("n") - F.col("si") / F.col("n") * (F.col("sj") / F.col("n")) - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return model.join(each.groupBy("dim").agg(F.max(off).alias("identity_error")), "dim", "left")


def whiten(rows: DataFrame, model: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row, up to ``components`` each."""
    schema = pa.schema(
        [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
    )

    def kernel(batches):
        for batch in batches:
            for row in batch.to_pylist():
                count = len(row["values"])
                if not count:
                    continue
                apart, w = _projected(row)
                squares = (apart * apart).sum(axis=1).tolist()
                squares = [s if s < 1 << 63 else None for s in squares]
                m = len(w)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": [i for i in row["ids"] for _ in range(count)],
                        "component": np.tile(np.arange(1, count + 1, dtype=np.int32), m),
                        "n": np.full(m * count, row["n"]),
                        "deviation": [s for s in squares for _ in range(count)],
                        "whitened": w.ravel(),
                        "explained": np.tile(row["explained"], m),
                        "identity_error": np.full(m * count, row["identity_error"]),
                    },
                    schema=schema,
                )

    out = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return _with_model(_blocks(rows), model, 64 + 8 * components).mapInArrow(kernel, out)


def op13(embeddings: DataFrame) -> DataFrame:
    """The query: the first four components of every vector.

    Rows whose vector is null or holds null or non-finite entries go, empty vectors have no components,
    vectors of another length have a model of their own, repeated rows are returned each but fitted
    once, rows without vec_id stay, other columns are not read. A deviation beyond 64 bits is null.
    """
    rows = integer_rows(embeddings)
    model, _ = written(whitening_model(rows))
    return whiten(rows, model)
