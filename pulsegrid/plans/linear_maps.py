"""Filters of one length as dense matrices, made from their definitions alone; the SQL of queries is built on them.

They share no code with the kernels: trends are solved densely, and the band-pass is a transfer function whose impulse
response fills a triangular matrix.
"""

from __future__ import annotations

import numpy as np


def detrend_map(n: int, strength: float) -> np.ndarray:
    """I - (I + strength^2 D'D)^-1 for second differences D."""
    d = np.diff(np.eye(n), 2, axis=0)
    return np.eye(n) - np.linalg.inv(np.eye(n) + strength**2 * d.T @ d)


def bandpass_map(n: int, fps: float, low_hz: float, high_hz: float, order: int = 4) -> np.ndarray:
    """A Butterworth band-pass forward and backward over a series with both ends extended oddly.

    Each pass starts as if its first value had lasted for ever; as nothing constant passes, that value is taken away.
    """
    pad = 3 * (2 * order + 1)
    low, high = 2 * fps * np.tan(np.pi * np.array([low_hz, high_hz]) / fps)
    half = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order)) * (high - low) / 2
    root = np.sqrt(half**2 - low * high)
    analog = np.concatenate([half + root, half - root])
    a = np.poly((2 * fps + analog) / (2 * fps - analog)).real
    b = np.poly([1.0] * order + [-1.0] * order)
    centre = np.exp(2j * np.arctan(np.sqrt(low * high) / (2 * fps)))
    b = b / abs(np.polyval(b, centre) / np.polyval(a, centre))
    m = n + 2 * pad
    h = np.zeros(m)
    for i in range(m):
        h[i] = (b[i] if i < len(b) else 0.0) - sum(a[j] * h[i - j] for j in range(1, min(i, len(a) - 1) + 1))
    run = np.array([[h[i - j] if i >= j else 0.0 for j in range(m)] for i in range(m)])
    run[:, 0] -= run.sum(1)
    extend = np.zeros((m, n))
    extend[pad : pad + n] = np.eye(n)
    for k in range(1, pad + 1):
        extend[pad - k, 0], extend[pad - k, k] = 2.0, -1.0
        extend[pad + n - 1 + k, n - 1], extend[pad + n - 1 + k, n - 1 - k] = 2.0, -1.0
    once = run @ extend
    return (run @ once[::-1])[::-1][pad:-pad]


def matrix_sql(name: str, matrix: np.ndarray) -> str:
    """A table (i, j, v) of the matrix as a common table expression."""
    rows = ", ".join("[" + ", ".join(f"{v:.17e}" for v in row) + "]" for row in matrix)
    return f"{name}_rows AS (SELECT unnest(range(0, {len(matrix)})) AS i, unnest([{rows}]) AS row), {name} AS (SELECT i, unnest(range(0, {matrix.shape[1]})) AS j, unnest(row) AS v FROM {name}_rows)"
