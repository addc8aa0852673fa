"""Plain NumPy answers to compare with."""

import numpy as np


def unit(series, m):
    w = np.lib.stride_tricks.sliding_window_view(np.asarray(series, float), m)
    z = w - w.mean(axis=1, keepdims=True)
    n = np.linalg.norm(z, axis=1)
    return np.divide(z, n[:, None], out=np.zeros_like(z), where=n[:, None] > 1e-12), n <= 1e-12


def distances(a, b, m, mass=True):
    za, fa = unit(a, m)
    zb, fb = unit(b, m)
    c = np.clip(za @ zb.T, -1, 1)
    if mass:
        c[np.ix_(fa, fb)] = 1.0
    return np.sqrt(np.maximum(2 * m * (1 - c), 0))


def profile(series, m, lag, mass=False):
    d = distances(series, series, m, mass)
    i = np.arange(len(d))
    d[np.abs(i[:, None] - i[None, :]) <= lag] = np.inf
    return d


def walk(n, seed):
    return np.cumsum(np.random.default_rng(seed).standard_normal(n))


def planted(n, m, at, seed, amplitude=3.0):
    x = walk(n, seed) * 0.3
    for start in at:
        x[start : start + m] = x[start] + amplitude * np.sin(np.linspace(0, 2 * np.pi, m)) + np.random.default_rng(seed + start).normal(0, 0.05, m)
    return x
