"""Pixel arrays: resizing, channels, weights."""

from __future__ import annotations

import numpy as np


def resized(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """An array (height, width, channels) of another size, by the four pixels around each place; of the same size, as it is."""
    h, w = a.shape[:2]
    if (h, w) == (height, width):
        return a

    def places(n: int, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * old / n - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, old - 1), at - low

    y0, y1, fy = places(height, h)
    x0, x1, fx = places(width, w)
    fy, fx = fy[:, None, None], fx[None, :, None]
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    low = a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return np.round(top * (1 - fy) + low * fy).astype(a.dtype)


def rgba(a: np.ndarray) -> np.ndarray:
    """Four channels: gray three times, and an opaque fourth where there is none."""
    a = np.repeat(a[:, :, :1], 3, axis=2) if a.shape[2] < 3 else a[:, :, :4]
    return a if a.shape[2] == 4 else np.concatenate([a, np.full((*a.shape[:2], 1), 255, dtype=np.uint8)], axis=2)


def ramps(size: int, overlap: int) -> np.ndarray:
    """Weights along a tile's axis, which rise over the overlap at both ends and are never 0."""
    if not overlap:
        return np.ones(size)
    at = np.arange(size)
    return np.minimum(1.0, np.minimum((at + 1) / (overlap + 1), (size - at) / (overlap + 1)))
