"""Symbolic approximation: breakpoints, words and their distances as columns."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

ALPHABET = "abcdefghijklmnopqrst"
LOWEST = -1e308
EDGE = 1e-9  # a mean this little below a breakpoint counts as on it, so the last bit of a sum decides no letter
# Two-decimal normal breakpoints of the word distance table.
ROUNDED_BREAKPOINTS = {
    3: (-0.43, 0.43),
    4: (-0.67, 0, 0.67),
    5: (-0.84, -0.25, 0.25, 0.84),
    6: (-0.97, -0.43, 0, 0.43, 0.97),
    7: (-1.07, -0.57, -0.18, 0.18, 0.57, 1.07),
    8: (-1.15, -0.67, -0.32, 0, 0.32, 0.67, 1.15),
}


def gaussian_breakpoints(alpha: int) -> list[float]:
    """Lower edges of ``alpha`` equal-probability normal regions, the first one open."""
    if not 2 <= alpha <= len(ALPHABET):
        raise ValueError("alphabet size is 2 … 20")
    return [LOWEST] + [NormalDist().inv_cdf(i / alpha) for i in range(1, alpha)]


def fitted_breakpoints(values: Sequence[float], alpha: int) -> list[float]:
    """Lower edges at the nearest-rank quantiles of one pattern."""
    ordered = sorted(v for v in values if v == v and abs(v) != float("inf"))
    n = len(ordered)
    return [LOWEST] + [ordered[min(n - 1, i * n // alpha)] for i in range(1, alpha)]


def query_breakpoints(rows: DataFrame, alpha: int, by: str = "query_id", value: str = "value") -> DataFrame:
    """Nearest-rank breakpoints of every query in a table, as an array."""
    w = Window.partitionBy(by)
    ranked = rows.filter(F.col(value).isNotNull()).select(
        by, F.col(value).alias("_v"), (F.row_number().over(w.orderBy(value)) - 1).alias("_r"), F.count(F.lit(1)).over(w).alias("_n")
    )
    cuts = [
        F.max(F.when(F.col("_r") == F.least(F.col("_n") - 1, F.floor(F.lit(i) * F.col("_n") / alpha)), F.col("_v"))) for i in range(1, alpha)
    ]
    return ranked.groupBy(by).agg(F.array(F.lit(LOWEST), *cuts).alias("breakpoints"))


def literal_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def symbol_index(value: Column, breakpoints: Column | Sequence[float]) -> Column:
    """Number of breakpoints at or below the value, to within ``EDGE``, less one."""
    value = value + F.lit(EDGE)
    if not isinstance(breakpoints, Column):
        index = F.lit(-1)
        for b in breakpoints:
            index = index + F.when(value >= F.lit(float(b)), 1).otherwise(0)
        return index
    return F.size(F.filter(breakpoints, lambda b: b <= value)) - 1


def symbolize(values: Column, breakpoints: Column | Sequence[float]) -> Column:
    """Word of an array of segment means."""
    letters = F.lit(ALPHABET)
    return F.array_join(F.transform(values, lambda v: F.substring(letters, symbol_index(v, breakpoints) + 1, F.lit(1))), "")


def symbol_positions(word: Column) -> Column:
    """Alphabet positions of the letters of a word."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.ascii(c) - 97)


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of equal length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def word_distance(a: Column, b: Column, how: str = "mean") -> Column:
    """Mean or largest letter gap over the shared length (NULL for empty words)."""
    n = F.least(F.length(a), F.length(b))
    pa, pb = F.slice(symbol_positions(a), F.lit(1), n), F.slice(symbol_positions(b), F.lit(1), n)
    gaps = F.zip_with(pa, pb, lambda x, y: F.abs(x - y).cast("double"))
    value = F.array_max(gaps) if how == "max" else F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / n
    return F.when(n > 0, value)


def tolerance_regex(word: Column, alpha: int, tolerance: int, low: int = 1, high: int = 1) -> Column:
    """Pattern that accepts letters within the tolerance, each repeated low … high times."""
    times = "" if low == high == 1 else f"{{{low},{high}}}"

    def token(p: Column) -> Column:
        first = F.greatest(F.lit(0), p - tolerance)
        last = F.least(F.lit(alpha - 1), p + tolerance)
        return F.concat(F.lit("["), F.substring(F.lit(ALPHABET), first + 1, last - first + 1), F.lit("]" + times))

    return F.array_join(F.transform(symbol_positions(word), token), "")


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def mindist(a: Column, b: Column, alpha: int, length: int | Column) -> Column:
    """Lower bound of the distance of two series of ``length`` from their words."""
    if alpha not in ROUNDED_BREAKPOINTS:
        raise ValueError("alphabet size is 3 … 8")
    cuts = literal_array(ROUNDED_BREAKPOINTS[alpha])
    length = F.lit(length) if isinstance(length, int) else length

    def gap(x: Column, y: Column) -> Column:
        hi, lo = F.greatest(x, y), F.least(x, y)
        d = F.when(hi - lo <= 1, 0.0).otherwise(F.get(cuts, hi - 1) - F.get(cuts, lo))
        return d * d

    total = F.aggregate(F.zip_with(symbol_positions(a), symbol_positions(b), gap), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(length / F.length(a)) * F.sqrt(total)
