"""Hashed byte trigrams of whole texts, and small linear classifiers in numpy."""

from __future__ import annotations

import numpy as np

from .text import _LOWER, _SPACE, chunks

_TABLES: dict[int, list[np.ndarray]] = {}


def trigrams(data: np.ndarray, bits: int) -> np.ndarray:
    """The hashed trigram that starts at each byte (A-Z lower-cased, white space alike), below 2 ** bits."""
    if bits not in _TABLES:
        rng = np.random.default_rng(bits)
        tables = [rng.integers(0, 1 << bits, 256).astype(np.uint16) for _ in range(3)]
        for t in tables:
            t[65:91] = t[97:123]
            t[_SPACE] = t[32]
        _TABLES[bits] = tables
    a, b, c = _TABLES[bits]
    return a[data[:-2]] ^ b[data[1:-1]] ^ c[data[2:]]


def trigram_shares(data: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """A row for each text: the share of each hashed trigram.  A text under 3 bytes has none."""
    out = np.zeros((len(at) - 1, 1 << bits), np.float32)
    for d in range(len(at) - 1):
        if (n := at[d + 1] - at[d] - 2) > 0:
            out[d] = np.bincount(trigrams(data[at[d] : at[d + 1]], bits), minlength=1 << bits) / n
    return out


def pack(x: np.ndarray) -> list[bytes]:
    """Each row's places that are not zero, then their values; rows of at most 65,536 columns."""
    places = (np.flatnonzero(row).astype(np.uint16) for row in x)
    return [at.tobytes() + row[at].astype(np.float32).tobytes() for at, row in zip(places, x, strict=True)]


def unpack(rows, width: int, more: int = 0) -> np.ndarray:
    """What ``pack`` took, with ``more`` columns of zeros behind."""
    out = np.zeros((len(rows), width + more), np.float32)
    for row, raw in zip(out, rows, strict=True):
        n = len(raw) // 6
        row[np.frombuffer(raw, np.uint16, n)] = np.frombuffer(raw[2 * n :], np.float32)
    return out


def trigram_scores(data: np.ndarray, at: np.ndarray, weights: np.ndarray, bits: int) -> np.ndarray:
    """Share vectors times ``weights`` (2 ** bits, classifiers), without making the vectors."""
    out = np.zeros((len(at) - 1, weights.shape[1]))
    columns = [np.ascontiguousarray(w, dtype=np.float64) for w in weights.T]
    for i, j in chunks(at):
        low, high = at[i], at[j]
        if high - low < 3:
            continue
        h = trigrams(data[low:high], bits)
        start = np.minimum(at[i:j] - low, len(h))
        stop = np.maximum(np.minimum(at[i + 1 : j + 1] - low - 2, len(h)), start)
        run = np.zeros(len(h) + 1)
        for k, w in enumerate(columns):
            np.cumsum(w[h], out=run[1:])
            out[i:j, k] = (run[stop] - run[start]) / np.maximum(stop - start, 1)
    return out


def scale_of(x: np.ndarray) -> np.ndarray:
    """Per column, one over the spread; columns that hardly vary are damped."""
    mean = x.mean(0, dtype=np.float64)
    sd = np.sqrt(sum(((x[i : i + 256] - mean) ** 2).sum(0) for i in range(0, len(x), 256)) / len(x)).astype(x.dtype)
    return 1 / (sd + sd[sd > 0].mean() if (sd > 0).any() else sd + 1)


def _forth(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """x times ``v``, whose last entry is the offset; x is not copied."""
    return x @ v[:-1] + v[-1]


def _back(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.append(x.T @ r, r.sum(keepdims=True))


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """A linear support vector machine: squared hinge loss, classes weighed alike, accelerated gradient.  y: -1, 1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c
    probe = np.random.default_rng(0).normal(size=x.shape[1] + 1).astype(x.dtype)
    for _ in range(20):
        probe = _back(x, weight.astype(x.dtype) * _forth(x, probe))
        norm = np.linalg.norm(probe)
        probe /= norm or 1
    lam = 1e-4
    rate = 1 / (2 * norm + lam)
    w = v = np.zeros(x.shape[1] + 1, x.dtype)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * _forth(x, v))
        g = lam * v - 2 * _back(x, (weight * y * slack).astype(x.dtype))
        new = v - rate * g
        v = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1].astype(np.float64), float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, lam: float = 1e-3, steps: int = 300, balanced: bool = True) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient.  y: 0, 1."""
    weight = np.full(len(y), 1 / max(1, len(y)))
    if balanced and 0 < y.sum() < len(y):
        weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    probe = np.ones(x.shape[1] + 1, x.dtype)
    for _ in range(20):
        probe = _back(x, (weight * _forth(x, probe)).astype(x.dtype))
        norm = np.linalg.norm(probe)
        probe /= norm or 1
    rate = 1 / (norm / 4 + lam)
    w = v = np.zeros(x.shape[1] + 1, x.dtype)
    for k in range(steps):
        g = _back(x, (weight * (sigmoid(_forth(x, v)) - y)).astype(x.dtype))
        g[:-1] += lam * v[:-1]
        new = v - rate * g
        v = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1].astype(np.float64), float(w[-1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset): sigmoid(slope * z + offset) is the chance of y = 1.  The slope is not negative."""
    if len(z) == 0 or y.min() == y.max():
        return 1.0, 0.0
    s = z.std() or 1.0
    w, b = logistic((z[:, None] / s).astype(np.float64), y.astype(np.float64), 1e-3, 500, balanced=False)
    return max(0.0, float(w[0])) / s, b
