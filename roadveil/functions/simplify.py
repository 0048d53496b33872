"""Lines and rings with fewer corners."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def furthest(x: np.ndarray, y: np.ndarray, a: int, b: int) -> tuple[int, float]:
    """Of the corners between two, the first of those farthest from the segment between them, and the distance."""
    dx, dy = x[b] - x[a], y[b] - y[a]
    px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
    square = dx * dx + dy * dy
    t = np.clip((px * dx + py * dy) / square, 0, 1) if square else np.zeros(len(px))
    away = np.hypot(px - t * dx, py - t * dy)
    k = int(away.argmax())
    return a + 1 + k, float(away[k])


def kept_corners(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Numbers of the corners that stay: a line is split at the corner farthest from its chord until none is farther than the tolerance. A
    ring is first split at the corner farthest from its beginning, and keeps a third corner. Open pieces are on a list, so a line's
    length sets no depth."""
    n = len(x)
    keep = np.zeros(n, bool)
    keep[[0, -1]] = True
    ring = n > 3 and x[0] == x[-1] and y[0] == y[-1]
    across = int(np.hypot(x - x[0], y - y[0]).argmax()) if ring else 0
    pieces = [(0, across), (across, n - 1)] if ring and across else [(0, n - 1)]
    keep[across] = True
    while pieces:
        a, b = pieces.pop()
        if b - a < 2:
            continue
        at, away = furthest(x, y, a, b)
        if away > tolerance:
            keep[at] = True
            pieces += [(a, at), (at, b)]
    if ring and across and keep.sum() < 4:
        ends = [furthest(x, y, a, b)[::-1] + (a,) for a, b in ((0, across), (across, n - 1)) if b - a > 1]
        keep[max(ends, key=lambda e: (e[0], -e[1]))[1]] = True
    return np.flatnonzero(keep)


def simplified(points: str, tolerance: float) -> Column:
    """A column ``array<struct<x:long,y:long>>`` with the corners that stay; null stays null, and what has two corners or fewer stays as it is."""

    @F.arrow_udf("array<struct<x:long,y:long>>")
    def run(lines: pa.Array) -> pa.Array:
        flat, sizes = lines.flatten(), lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        x, y = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (0, 1))
        rows, counts, at = [], [], 0
        for n in sizes.tolist():
            rows.append(at + (kept_corners(x[at : at + n], y[at : at + n], tolerance) if n > 2 else np.arange(n)))
            counts.append(len(rows[-1]))
            at += n
        kept = flat.take(pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64)))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.append(lines.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, kept)

    return run(points)
