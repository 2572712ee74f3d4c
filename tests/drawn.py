"""Statistics of pages by numpy, for comparison."""

from __future__ import annotations

import numpy as np


def otsu(gray: np.ndarray) -> int:
    """The threshold of greatest variance between classes."""
    counts = np.bincount(gray.ravel(), minlength=256).astype(float)
    weight, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * weight - mass * weight[-1]) ** 2 / (weight * (weight[-1] - weight))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1.0)))


def page_metrics(gray: np.ndarray) -> tuple[float, float, float, float]:
    """blur (variance of the Laplacian), contrast (ink against paper), noise (grain left by a 3x3 median), ink (share of dark pixels)."""
    g = gray.astype(np.float64)
    p = np.pad(g, 1, mode="reflect")
    laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    dark = gray <= otsu(gray)
    paper, ink = (g[~dark].mean() if (~dark).any() else 0.0), (g[dark].mean() if dark.any() else 0.0)
    near = np.pad(gray, 1, mode="edge")
    h, w = gray.shape
    median = np.median(np.stack([near[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0)
    return float(laplacian.var()), float((paper - ink) / paper) if paper > 0 else 0.0, float((g - median).std()), float(dark.mean())
