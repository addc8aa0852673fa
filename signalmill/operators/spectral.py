"""Fourier transforms, period detection and additive decomposition."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from signalmill.functions.ordered import BLOCK, attach, framed, known_bins, mark_bins, with_stats
from signalmill.functions.quantiles import quantiles
from signalmill.functions.timeparts import as_us, floor_div, from_us

SIGNAL = ("signal_id",)


def series_length(grid: DataFrame, idx: str = "bin_idx") -> int:
    """Grid points per series: the recorded number, else one small aggregate."""
    n = known_bins(grid, idx)
    return n if n is not None else (grid.agg((F.max(idx) + 1).alias("n")).first()["n"] or 0)


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _fft_rows(df: DataFrame, keys: Sequence[str], at: str, size: int, out: str, twiddle=None) -> DataFrame:
    """FFT of length ``size`` for each key group of rows (at, re, im)."""
    keys = list(keys)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros(size, dtype=complex)
        z[pdf[at].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        z = np.fft.fft(z)
        if twiddle is not None:
            z = z * np.exp(-2j * np.pi * twiddle[1] * float(pdf[twiddle[0]].iloc[0]) * np.arange(size))
        frame = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame({**frame, out: np.arange(size), "re": z.real, "im": z.imag})

    doubles = [T.StructField(n, T.DoubleType()) for n in ("re", "im")]
    schema = T.StructType([*_key_fields(df, keys), T.StructField(out, T.LongType()), *doubles])
    return df.groupBy(*keys).applyInPandas(kernel, schema)


def _split(n: int, block: int) -> tuple[int, int] | None:
    """Two factors of ``n``, both at most ``block``, as even as possible; None if there are none."""
    a = int(n**0.5)
    while a > 1 and n % a:
        a -= 1
    return (n // a, a) if n // a <= block else None


def dft(rows: DataFrame, keys: Sequence[str], n: int, block: int = BLOCK) -> DataFrame:
    """Unnormalised DFT of ``keys, i, re, im`` rows (absent rows are zero).

    Up to ``block`` points one task transforms one series. Longer series use the
    four-step scheme: columns, twiddle factors, rows, each group near sqrt(n). A length
    without two such factors goes through a longer one of a power of two.
    """
    keys = list(keys)
    if n <= block:
        return _fft_rows(rows, keys, "i", n, "k")
    parts = _split(n, block)
    if parts is None:
        return _chirp(rows, keys, n, block)
    n1, n2 = parts
    grid = rows.withColumn("_a", floor_div(F.col("i"), n2)).withColumn("_b", F.pmod("i", F.lit(n2)))
    first = _fft_rows(grid, [*keys, "_b"], "_a", n1, "_k1", ("_b", 1.0 / n))
    second = _fft_rows(first, [*keys, "_k1"], "_b", n2, "_k2")
    return second.select(*keys, (F.col("_k1") + F.col("_k2") * n1).alias("k"), "re", "im")


def _chirp(rows: DataFrame, keys: list[str], n: int, block: int) -> DataFrame:
    """DFT of any length as a convolution with a chirp, over a power of two."""
    size = 1 << (2 * n - 1).bit_length()
    i = F.col("i")
    turn = lambda j: F.lit(np.pi / n) * F.pmod(j * j, F.lit(2 * n))  # pi j^2 / n, kept small
    spin = lambda re, im, c, s: ((re * c - im * s).alias("re"), (re * s + im * c).alias("im"))
    one, half = rows.withColumn("_t", turn(i)), F.col("_t")
    one = one.select(*keys, "i", *spin(F.col("re"), F.col("im"), F.cos(half), -F.sin(half)))
    span = rows.sparkSession.range(-(n - 1), n).select(F.pmod("id", F.lit(size)).alias("i"), turn(F.col("id")).alias("_t"))
    chirp = dft(span.select(F.lit(0).alias("_key"), "i", F.cos("_t").alias("re"), F.sin("_t").alias("im")), ["_key"], size, block)
    chirp = chirp.select("k", F.col("re").alias("_c"), F.col("im").alias("_s"))
    both = dft(one, keys, size, block).join(chirp, "k")
    both = both.select(*keys, F.col("k").alias("i"), *spin(F.col("re"), F.col("im"), F.col("_c"), F.col("_s")))
    back = dft(both.withColumn("im", -F.col("im")), keys, size, block).filter(F.col("k") < n).withColumn("_t", turn(F.col("k")))
    return back.select(*keys, "k", *spin(F.col("re") / size, -F.col("im") / size, F.cos("_t"), -F.sin("_t")))



def spectrum(grid: DataFrame, bin_us: int, by: Sequence[str] = SIGNAL, block: int = BLOCK) -> DataFrame:
    """Magnitude, frequency (Hz) and period (s) of DFT bins 1 … n/2 of a filled grid."""
    n = series_length(grid)
    rows = grid.select(*by, F.col("bin_idx").alias("i"), F.coalesce("value", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))
    secs = bin_us / 1e6
    half = dft(rows, by, n, block).filter(F.col("k").between(1, n // 2))
    return half.select(
        *by,
        "k",
        F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("magnitude"),
        (F.col("k") / F.lit(float(n)) / secs).alias("freq_hz"),
        (F.lit(float(n)) / F.col("k") * secs).alias("period_s"),
    )


def spectral_peaks(spec: DataFrame, k: int = 8, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Local maxima of the magnitudes, the ``k`` strongest per signal."""
    rows = spec.withColumn("_at", F.col("k").cast("bigint"))
    rows = framed(
        rows,
        by,
        {"_l": lambda w: F.lag("magnitude").over(w), "_r": lambda w: F.lead("magnitude").over(w)},
        before=1,
        after=1,
        idx="_at",
    )
    m = F.col("magnitude")
    peaks = rows.filter((m > F.coalesce("_l", F.lit(-1.0))) & (m >= F.coalesce("_r", F.lit(-1.0))) & (m > 0))
    w = Window.partitionBy(*by).orderBy(m.desc(), F.col("k"))
    return peaks.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_at", "_l", "_r")


def spectrogram(
    grid: DataFrame, window: int, hop: int, bin_us: int, start, by: Sequence[str] = SIGNAL, frames_per_task: int = 256
) -> DataFrame:
    """Short-time spectra: one row per frame and frequency bin 1 … window/2."""
    n = series_length(grid)
    total = (n - window) // hop + 1 if n >= window else 0
    by = list(by)
    i = F.col("bin_idx")
    first = F.greatest(F.lit(0).cast("bigint"), floor_div(i - window + hop, hop))
    last = F.least(F.lit(total - 1).cast("bigint"), floor_div(i, hop))
    rows = grid.filter(first <= last).withColumn(
        "_fb", F.explode(F.sequence(floor_div(first, frames_per_task), floor_div(last, frames_per_task)))
    )

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        lo = int(pdf["_fb"].iloc[0]) * frames_per_task
        count = min(frames_per_task, total - lo)
        v = np.zeros((count - 1) * hop + window)
        at = pdf["bin_idx"].to_numpy() - lo * hop
        ok = (at >= 0) & (at < len(v))
        v[at[ok]] = np.nan_to_num(pdf["value"].to_numpy(dtype=float))[ok]
        frames = np.lib.stride_tricks.sliding_window_view(v, window)[::hop][:count]
        mags = np.abs(np.fft.rfft(frames, axis=1))[:, 1 : window // 2 + 1]
        shape = mags.shape
        out = {k: pdf[k].iloc[0] for k in by}
        out["frame"] = np.repeat(np.arange(lo, lo + shape[0]), shape[1])
        out["k"] = np.tile(np.arange(1, shape[1] + 1), shape[0])
        out["magnitude"] = mags.ravel()
        return pd.DataFrame(out)

    schema = T.StructType(
        [*_key_fields(grid, by), T.StructField("frame", T.LongType()), T.StructField("k", T.LongType()), T.StructField("magnitude", T.DoubleType())]
    )
    spec = rows.select(*by, "_fb", "bin_idx", "value").groupBy(*by, "_fb").applyInPandas(kernel, schema)
    centre = (F.col("frame") * hop * 2 + window) * bin_us / 2
    return spec.select(
        *by,
        "frame",
        (F.col("frame") * hop).alias("start_idx"),
        from_us(F.floor(centre) + as_us(start)).alias("center_ts"),
        "k",
        (F.col("k") / F.lit(float(window)) / (bin_us / 1e6)).alias("freq_hz"),
        "magnitude",
    )


def detrend(grid: DataFrame, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Residual of the least-squares line on the index, as ``detrended``."""
    fit = with_stats(grid, by, {"_s": F.regr_slope("value", "bin_idx"), "_c": F.regr_intercept("value", "bin_idx")})
    return fit.withColumn("detrended", F.col("value") - (F.col("_c") + F.col("_s") * F.col("bin_idx"))).drop("_s", "_c")


def autocorrelation(rows: DataFrame, keys: Sequence[str], n: int, value: str, max_lag: int, block: int = BLOCK) -> DataFrame:
    """Sum over t of v(t)·v(t+lag) divided by the sum of squares, for lags 0 … max_lag."""
    keys = list(keys)
    size = 1 << max(1, (2 * n - 1).bit_length())
    real = rows.select(*keys, F.col("bin_idx").alias("i"), F.coalesce(value, F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))
    if size <= block:

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            v = np.zeros(size)
            v[pdf["i"].to_numpy()] = pdf["re"].to_numpy()
            raw = np.fft.irfft(np.abs(np.fft.rfft(v)) ** 2, size)[: max_lag + 1]
            acf = raw / raw[0] if raw[0] > 0 else np.zeros(max_lag + 1)
            return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "lag": np.arange(max_lag + 1), "acf": acf})

        schema = T.StructType([*_key_fields(rows, keys), T.StructField("lag", T.LongType()), T.StructField("acf", T.DoubleType())])
        return real.groupBy(*keys).applyInPandas(kernel, schema)
    power = dft(real, keys, size, block).select(
        *keys, F.col("k").alias("i"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("re"), F.lit(0.0).alias("im")
    )
    back = dft(power, keys, size, block).filter(F.col("k") <= max_lag)
    zero = back.filter(F.col("k") == 0).select(*keys, F.col("re").alias("_z"))
    acf = F.when(F.col("_z") > 0, F.col("re") / F.col("_z")).otherwise(0.0)
    return attach(back, zero, keys, salt="k").select(*keys, F.col("k").alias("lag"), acf.alias("acf"))


def detect_periods(grid: DataFrame, k: int = 3, by: Sequence[str] = SIGNAL, block: int = BLOCK) -> DataFrame:
    """Best ``k`` autocorrelation peaks at lags 4 … n/2 of the detrended series (n >= 8)."""
    n = series_length(grid)
    by = list(by)
    top = n // 2
    acf = autocorrelation(detrend(grid, by), by, n, "detrended", top + 1, block)
    if n < 8:
        acf = acf.filter(F.lit(False))
    near = framed(
        mark_bins(acf, top + 2, "lag"),
        by,
        {"_l": lambda w: F.lag("acf").over(w), "_r": lambda w: F.lead("acf").over(w)},
        before=1,
        after=1,
        idx="lag",
    )
    a = F.col("acf")
    peaks = near.filter(F.col("lag").between(4, top) & (a > 0) & (a > F.col("_l")) & (a >= F.col("_r")))
    w = Window.partitionBy(*by).orderBy(a.desc(), F.col("lag"))
    return (
        peaks.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select(*by, F.col("lag").alias("period_bins"), F.least(a, F.lit(1.0)).alias("score"), "rank")
    )


def decompose(
    grid: DataFrame,
    period: int = -1,
    trend: str = "linefit",
    by: Sequence[str] = SIGNAL,
    fit_until: int | None = None,
) -> DataFrame:
    """Additive parts ``baseline, seasonal, trend, residual`` of a filled grid.

    ``period`` -1 detects one per signal, 0 means none. ``fit_until`` fits on the
    indices before it and extends the parts to the whole grid.
    """
    if trend not in ("linefit", "avg", "none"):
        raise ValueError("trend is linefit, avg or none")
    by = list(by)
    i, v = F.col("bin_idx"), F.col("value")
    used = v if fit_until is None else F.when(i < fit_until, v)
    out = grid.withColumn("_y", used)
    if trend == "linefit":
        x = F.when(F.col("_y").isNotNull(), i)
        out = with_stats(out, by, {"_s": F.regr_slope("_y", x), "_c": F.regr_intercept("_y", x)})
        line = F.coalesce(F.col("_c") + F.col("_s") * i, F.col("_c"))
        out = with_stats(out, by, {"_m": F.avg("_y")}).withColumn("trend", F.coalesce(line, F.col("_m"))).drop("_s", "_c", "_m")
    elif trend == "avg":
        out = with_stats(out, by, {"trend": F.avg("_y")})
    else:
        out = out.withColumn("trend", F.lit(0.0))
    if period == 0:
        out = out.withColumn("seasonal", F.lit(0.0))
    else:
        if period < 0:
            fitted = grid if fit_until is None else mark_bins(grid.filter(i < fit_until), fit_until)
            best = detect_periods(fitted, 1, by).select(*by, F.col("period_bins").alias("_p"))
            out = attach(out, best, by, how="left")
        else:
            out = out.withColumn("_p", F.lit(int(period)))
        p = F.coalesce("_p", F.lit(1))
        out = out.withColumn("_phase", F.when(p > 1, F.pmod(i, p)).otherwise(F.lit(-1)))
        phases = out.groupBy(*by, "_phase").agg(F.avg(F.col("_y") - F.col("trend")).alias("_raw"))
        phases = phases.withColumn("_mid", F.avg("_raw").over(Window.partitionBy(*by)))
        phases = phases.select(
            *by, "_phase", F.when(F.col("_phase") < 0, 0.0).otherwise(F.coalesce(F.col("_raw") - F.col("_mid"), F.lit(0.0))).alias("seasonal")
        )
        out = attach(out, phases, [*by, "_phase"]).drop("_p", "_phase")
    out = out.withColumn("baseline", F.col("trend") + F.col("seasonal"))
    return out.withColumn("residual", F.col("_y") - F.col("baseline")).drop("_y")


def residual_stats(parts: DataFrame, by: Sequence[str] = SIGNAL) -> DataFrame:
    """Explained variance, residual deviation (population) and largest residual z."""
    facts = parts.groupBy(*by).agg(
        F.var_pop("value").alias("_vv"),
        F.var_pop("residual").alias("_vr"),
        F.max(F.abs("residual")).alias("_max"),
    )
    sd = F.sqrt("_vr")
    return facts.select(
        *by,
        F.when(F.col("_vv") > 0, F.greatest(F.lit(0.0), 1 - F.col("_vr") / F.col("_vv"))).otherwise(0.0).alias("variance_explained"),
        sd.alias("residual_std"),
        F.when(sd > 0, F.col("_max") / sd).otherwise(0.0).alias("max_residual_z"),
    )
