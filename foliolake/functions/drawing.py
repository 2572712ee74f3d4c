"""Boxes and colours of the editor, and the content of scanned pages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def heat_colour(damage: Column, alpha: float) -> Column:
    """From green over yellow to red as damage grows."""
    hue = F.when(damage <= 0.5, 130 - 200 * damage).otherwise(60 - 60 * damage)
    return F.concat(F.lit("hsla("), F.floor(hue + 0.5).cast("string"), F.lit(f", 85%, 45%, {alpha:.2f})"))


def word_crop(line_y: Column, line_h: Column, word_x: Column, word_w: Column, word_h: Column, page_w: Column, page_h: Column, aspect: float, margin: float) -> Column:
    """x, y, w, h of a crop of the given aspect round a word: as high as its line and a margin, at least a little wider than the word, within the page where it fits."""
    high = F.greatest(line_h, word_h, F.lit(1)) * (1 + 2 * margin)
    wide = F.greatest(high * aspect, word_w * 1.15)
    tall = F.when(high * aspect < word_w * 1.15, wide / aspect).otherwise(high)
    inside = lambda middle, size, most: F.when(most < size, (most - size) / 2).otherwise(F.greatest(F.lit(0.0), F.least(middle - size / 2, most - size)))
    return F.struct(inside(word_x + word_w / 2, wide, page_w).alias("x"), inside(line_y + line_h / 2, tall, page_h).alias("y"), wide.alias("w"), tall.alias("h"))


def even_boxes(height: int, width: int, found: list[tuple[int, int]], n: int) -> list[list[int]]:
    """Boxes for ``n`` lines of text: the found ones if as many, else even parts of the inked height, or of the page if nothing was found."""
    if len(found) == n:
        return [[0, a, width, b - a] for a, b in found]
    top, bottom = (found[0][0], found[-1][1]) if found else (0, height)
    step = (bottom - top) / n if n else 0
    return [[0, int(top + k * step), width, max(1, int(step))] for k in range(n)]


def content_box(gray: np.ndarray, dark: int = 60, share: float = 0.97, most: float = 0.12, least: float = 0.3) -> tuple[int, int, int, int]:
    """left, top, right, bottom of the page inside a dark scan border: edge lines that are dark in ``share`` of their pixels go, up to ``most`` of each side; the whole page if too little would stay."""
    black = gray < dark

    def trim(fractions: np.ndarray) -> int:
        bright = np.flatnonzero(fractions < share)
        return min(int(bright[0]) if len(bright) else len(fractions), int(np.ceil(len(fractions) * most)))

    rows, columns = black.mean(axis=1), black.mean(axis=0)
    top, bottom = trim(rows), len(rows) - trim(rows[::-1])
    left, right = trim(columns), len(columns) - trim(columns[::-1])
    whole = right - left < len(columns) * least or bottom - top < len(rows) * least
    return (0, 0, len(columns), len(rows)) if whole else (left, top, right, bottom)
