"""Seeded random numbers for Arrow batches.

Each number is a hash of (row seed, position), so a row's draws do not depend on the
partition, batch or order it is met in.
"""

from __future__ import annotations

import numpy as np

# The constants of the public SplitMix64 generator.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def uniforms(seeds: np.ndarray, count: int, stream: int = 0) -> np.ndarray:
    """``(len(seeds), count)`` numbers strictly between 0 and 1."""
    base = np.asarray(seeds, dtype=np.int64).astype(np.uint64)
    place = np.arange(1, count + 1, dtype=np.uint64) + np.uint64(stream) * np.uint64(1 << 32)
    z = base[:, None] + place[None, :] * _STEP
    z = (z ^ (z >> np.uint64(30))) * _MIX_1
    z = (z ^ (z >> np.uint64(27))) * _MIX_2
    z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def normals(seeds: np.ndarray, count: int, stream: int = 0) -> np.ndarray:
    """Standard normal numbers by the Box-Muller transform."""
    u, v = uniforms(seeds, count, 2 * stream), uniforms(seeds, count, 2 * stream + 1)
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)


def gammas(seeds: np.ndarray, shape: np.ndarray, count: int, stream: int = 0) -> np.ndarray:
    """Gamma(shape >= 1, 1) numbers by Marsaglia and Tsang's rejection method."""
    d = np.repeat((shape - 1 / 3)[:, None], count, axis=1)
    c = 1 / np.sqrt(9 * d)
    out = np.full(d.shape, np.nan)
    attempt = stream
    while True:
        todo = np.isnan(out)
        if not todo.any():
            return out
        x = normals(seeds, count, 2 * attempt)
        u = uniforms(seeds, count, 4 * attempt + 3)
        v = (1 + c * x) ** 3
        fits = todo & (v > 0)
        safe = np.where(v > 0, v, 1.0)
        fits &= np.log(u) < 0.5 * x**2 + d - d * safe + d * np.log(safe)
        out[fits] = (d * safe)[fits]
        attempt += 2


def betas(seeds: np.ndarray, a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    x, y = gammas(seeds, a, count, 0), gammas(seeds, b, count, 1)
    return x / (x + y)
