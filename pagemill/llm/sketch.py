"""SetSketch registers, and the joint estimate of two sets' similarity from them.

Register i of a set is ``floor(1 - log_b(min over elements of h_i))``, held to 0 .. q + 1, where the
h_i are exponential with rate a. Sketches of unions are the larger registers; as b is near 1, two
sets agree in a register with a chance close to their Jaccard similarity, so bands of registers
are locality-sensitive keys.
"""

from __future__ import annotations

import math

import numpy as np

from pagemill.llm.kernels import mix64, seeds64

BASE, RATE, TOP = 1.001, 20.0, 65534
_U, _W = np.uint64, np.uint32


def _multipliers(m: int) -> tuple[np.ndarray, np.ndarray]:
    s = seeds64(m, 21)
    return ((s & _U(0xFFFFFFFF)).astype(_W) | _W(1))[:, None], ((s >> _U(32)).astype(_W) | _W(1))[:, None]


def minima(hashes: np.ndarray, m: int, block: int = 1024) -> np.ndarray:
    """The smallest of m 32-bit hash values over the elements."""
    a, c = _multipliers(m)
    best = np.full(m, 0xFFFFFFFF, _W)
    lo, hi = (hashes & _U(0xFFFFFFFF)).astype(_W), (hashes >> _U(32)).astype(_W)
    for i in range(0, len(hashes), block):
        x = lo[None, i : i + block] * a
        x += hi[None, i : i + block] * c
        np.minimum(best, x.min(axis=1), out=best)
    return best


def registers(hashes: np.ndarray, m: int) -> np.ndarray:
    """The m registers of a set of 64-bit element hashes (at least one)."""
    u = (minima(hashes, m).astype(np.float64) + 0.5) / 2.0**32
    h = -np.log1p(-u) / RATE
    return np.clip(np.floor(1.0 - np.log(h) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of the union of sets."""
    return np.maximum.reduce(sketches)


def band_keys(regs: np.ndarray, bands: int) -> np.ndarray:
    """Signed 64-bit keys of each sketch's bands; regs has a row for each sketch."""
    n, m = regs.shape
    r = m // bands
    x = regs[:, : r * bands].reshape(n, bands, r).astype(_U)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(seeds64(bands, 22), (n, bands)).copy()
        for j in range(r):
            acc = mix64(acc + x[:, :, j] * _U(0x9E3779B97F4A7C15) + _U(j))
    return acc.view(np.int64)


_GRID = np.linspace(0.0, 1.0, 101)


def joint_estimate(greater: np.ndarray, less: np.ndarray, m: int, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarities, given in how many of m registers the first sketch is greater or less, and the set sizes.

    With ``p(x) = -log_b(1 - x (b - 1) / b)``, the first is greater with chance p(u - v J) and less
    with p(v - u J), where u and v are the shares of the sizes; the three-way likelihood is taken
    on a grid of J up to the largest that the sizes allow.
    """
    greater, less, n_a, n_b = (np.asarray(x, np.float64)[:, None] for x in (greater, less, n_a, n_b))
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    j = np.minimum(_GRID[None, :], np.minimum(u / v, v / u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = np.clip(p(u - v * j), 1e-9, 1), np.clip(p(v - u * j), 1e-9, 1)
    same = np.clip(1 - up - down, 1e-9, 1)
    like = greater * np.log(up) + less * np.log(down) + (m - greater - less) * np.log(same)
    return np.take_along_axis(j, like.argmax(axis=1)[:, None], 1)[:, 0]
