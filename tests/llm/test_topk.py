import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.llm import topk as T


def brute(rows, k):
    out = []
    for i, (a, x) in enumerate(rows):
        if a % 20 == 0:
            scored = sorted((-sum(p * q for p, q in zip(x, y)), b, j) for j, (b, y) in enumerate(rows) if j != i and len(x) == len(y))
            out += [(a, n, b, -s) for n, (s, b, _) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k, bins, sizes, scale", [(20, 256, (2048, 1024), 10), (3, 4, (7, 3), 100), (5, 16, (16, 2), 1 << 14), (500, 8, (32, 8), 2)])
def test_against_brute_force(spark, k, bins, sizes, scale):
    rng = np.random.default_rng(k)
    rows = [(i, rng.integers(-scale, scale, 5).tolist()) for i in range(130)]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [(40, rows[40][1]), (300, [1, 2]), (301, [3, 4]), (320, [5])]  # ties, a repeated row, other lengths
    df = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>").repartition(4)
    got = T.top_k(df, F.col("vec_id") % 20 == 0, k, *sizes, bins).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == brute(rows, k)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.01]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, 1.0]), (None, [1.0, 1.0]), (20, [0.25, 1.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("row", F.lit(1)).withColumn("v", F.lit("x"))
    assert sorted(map(tuple, T.op10(df).collect())) == [(0, 1, 5, 32 * 64 - 64), (0, 2, 20, 32 * 16 - 96), (20, 1, 5, 16 * 64 + 96 * 64), (20, 2, 0, 16 * 32 - 96)]
    assert T.op10(df.limit(0)).collect() == []
    assert T.op10(df.filter("vec_id = 5")).collect() == []
