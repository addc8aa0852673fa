import numpy as np
import pytest

from signalmill.llm import whitening as W


@pytest.mark.parametrize("d", [1, 2, 3, 7, 40])
@pytest.mark.parametrize("kind", ["plain", "graded", "repeated", "low rank", "zero"])
def test_singular_values_and_directions(d, kind):
    rng = np.random.default_rng(d)
    m = rng.standard_normal((d + 30, d))
    if kind == "graded":
        m *= 10.0 ** -np.arange(d).clip(max=12)
    if kind == "repeated":
        m = np.linalg.qr(rng.standard_normal((d, d)))[0] * 3.0
    if kind == "low rank":
        m[:, d // 2 :] = 0
    if kind == "zero":
        m *= 0
    r = W._triangle(m)
    a, b, p = W.bidiagonal(r)
    assert np.allclose(p.T @ p, np.eye(d), atol=1e-13)
    true = np.linalg.svd(m, compute_uv=False)
    got = np.sqrt(W.dqds(a, b))
    assert len(got) == d and np.allclose(got, true[:d], rtol=1e-11, atol=1e-13 * max(true[0], 1e-300))
    values, vectors = W.directions(a, b, min(4, d))
    rows = vectors @ p.T
    assert np.allclose(rows @ rows.T, np.eye(len(rows)), atol=1e-10)
    assert np.abs(m.T @ (m @ rows.T) - rows.T * values).max() <= 1e-12 * max(values[0], 1e-300)


def test_small_singular_values_keep_their_digits():
    """A graded bidiagonal: every value to nearly full relative precision, in whole-number arithmetic for truth."""
    from fractions import Fraction

    a, b = np.array([1.0, 1e-6, 1e-12]), np.array([1e-3, 1e-9])
    squares = W.dqds(a, b)
    t = [[Fraction(0)] * 3 for _ in range(3)]
    fa, fb = [Fraction(float(x)) for x in a], [Fraction(float(x)) for x in b]
    for i in range(3):
        t[i][i] = fa[i] ** 2 + (fb[i - 1] ** 2 if i else 0)
        if i < 2:
            t[i][i + 1] = t[i + 1][i] = fa[i] * fb[i]

    def below(x):
        """Eigenvalues under x, by signs of exact pivots."""
        d, n = Fraction(1), 0
        for i in range(3):
            d = t[i][i] - x - (t[i][i - 1] ** 2 / d if i else 0)
            n += d < 0
        return n

    for i, s in enumerate(sorted(squares)):
        assert below(Fraction(s * (1 - 1e-13))) == i and below(Fraction(s * (1 + 1e-13))) == i + 1


def check(df, rows, dims):
    """Every row against NumPy's eigenvectors of the covariance of the distinct vectors."""
    want = {}
    for dim in dims:
        own = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
        x = np.array(sorted({tuple(v) for _, v in own}), float)
        e, v = np.linalg.eigh(np.cov(x.T, bias=True).reshape(dim, dim))
        e, v = e[::-1], v[:, ::-1]
        want[dim] = own, x, e, v
    got = W.op13(df).collect()
    cells = sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got)
    assert cells == sorted((i is None, i or 0, k + 1) for dim in dims for i, _ in want[dim][0] for k in range(min(4, dim)))
    by = {(r.vec_id, r.component): r for r in got}
    for own, x, e, v in want.values():
        sums = [int(s) for s in x.sum(axis=0)]
        for k in range(min(4, len(e))):
            mine = np.array([by[i, k + 1].whitened for i, _ in own])
            true = (np.array([a for _, a in own]) - x.mean(axis=0)) @ v[:, k] / np.sqrt(e[k])
            sign = np.sign(mine @ true)
            assert np.allclose(mine, sign * true, atol=1e-8)
            assert all(abs(by[i, k + 1].explained / (e[k] / e.sum()) - 1) < 1e-10 for i, _ in own)
        for i, a in own:
            assert by[i, 1].deviation == sum((len(x) * int(p) - s) ** 2 for p, s in zip(a, sums))
            assert by[i, 1].n == len(x) and by[i, 1].identity_error < 1e-10


def test_whitening_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ROWS", 7)
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    basis = rng.standard_normal((6, 6))
    rows = [(i, (rng.standard_normal(6) @ basis).tolist()) for i in range(90)] + [(100 + i, rng.standard_normal(2).tolist()) for i in range(20)]
    rows += [(200 + i, rows[5][1]) for i in range(40)] + [(None, rows[6][1]), (300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("-inf")] + [0.0] * 5)]
    df = spark.createDataFrame([*rows, (304, [])], "vec_id bigint, embedding array<double>").repartition(6)
    check(df, rows, [6, 2])
    check(df.withColumn("x", F.lit("a")).withColumn("dim", F.lit(1)).withColumn("n", F.lit(2)), rows, [6, 2])
    assert W.op13(df.limit(0)).collect() == []
    assert W.op13(df.filter("vec_id = 200")).collect() == []
    assert W.op13(df.filter("vec_id >= 300")).collect() == []


def test_shuffled_models_and_large_entries(spark, monkeypatch):
    monkeypatch.setattr(W, "MODEL_BYTES", 0)
    rng = np.random.default_rng(9)
    rows = [(i, (rng.standard_normal(3) * 2e4).tolist()) for i in range(50)]
    check(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), rows, [3])
    huge = [(i, (rng.standard_normal(3) * 1e13).tolist()) for i in range(5)]
    assert {r.deviation for r in W.op13(spark.createDataFrame(huge, "vec_id bigint, embedding array<double>")).collect()} == {None}
