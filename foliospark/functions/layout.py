"""Reading order by recursive cuts through the widest gaps of a page."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from foliospark.params import PARAMS, Params


class Boxes(NamedTuple):
    """Columns of boxes; ``size`` is the type size, one em."""

    x0: np.ndarray
    x1: np.ndarray
    y0: np.ndarray
    y1: np.ndarray
    size: np.ndarray

    def take(self, at: np.ndarray) -> Boxes:
        return Boxes(*(c[at] for c in self))

    def __add__(self, other: Boxes) -> Boxes:
        return Boxes(*(np.concatenate(c) for c in zip(self, other, strict=True)))


def boxes(rows: list[tuple[float, float, float, float, float]]) -> Boxes:
    a = np.array(rows, float).reshape(-1, 5)
    return Boxes(*a.T)


def upper_median(x: np.ndarray, default: float) -> float:
    return float(np.sort(x)[len(x) // 2]) if len(x) else default


def folded_rows(at: np.ndarray, most: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where new rows begin in sorted positions: at a change of kind, and where a position is more than
    ``most`` from the row's first. Equal neighbours go the same way, so only changes are looked at."""
    if not len(at):
        return np.zeros(0, int)
    change = np.ones(len(at), bool)
    change[1:] = ~((at[1:] == at[:-1]) & (most[1:] == most[:-1]) & (kind[1:] == kind[:-1]))
    looked = np.flatnonzero(change)
    begins, anchor, facing = [0], float(at[0]), kind[0]
    for i, y, far, k in zip(looked.tolist(), at[looked].tolist(), most[looked].tolist(), kind[looked].tolist(), strict=True):
        if k != facing or abs(y - anchor) > far:
            begins.append(i)
            anchor, facing = y, k
    return np.array(begins)


def widest_gap(low: np.ndarray, high: np.ndarray, least_side: float) -> tuple[float, float] | None:
    """(width, where it begins) of the widest stretch that no span covers, the first of equals; what
    lies on both sides must be ``least_side`` wide."""
    if len(low) < 2:
        return None
    order = np.argsort(low, kind="stable")
    low, high = low[order], high[order]
    reach = np.maximum.accumulate(high)[:-1]
    width = low[1:] - reach
    room = (width > 0) & (reach - low[0] >= least_side) & (high.max() - low[1:] >= least_side)
    if not room.any():
        return None
    best = int(np.argmax(np.where(room, width, -np.inf)))
    return float(width[best]), float(reach[best])


def _choose(b: Boxes, p: Params) -> tuple[bool, float] | None:
    """(whether the cut is between columns, where), or None where the region stays whole."""
    em = upper_median(b.size, 1.0)
    em = em if em > 0 else 10.0
    height = float(b.y1.max() - b.y0.min())
    columns = widest_gap(b.x0, b.x1, em * p.column_width) if height >= em * p.multiline_height else None
    rows = widest_gap(b.y0, b.y1, 0.0)
    gutter = em * (p.tall_gutter if height >= em * p.tall_region else p.gutter)
    wide = columns is not None and columns[0] >= gutter
    if wide and (rows is not None and columns[0] > rows[0]):
        return True, columns[1]
    if rows is not None and rows[0] >= em * p.row_gap:
        return False, rows[1]
    return (True, columns[1]) if wide else None


def segment(b: Boxes, rtl: bool, p: Params = PARAMS) -> list[np.ndarray]:
    """Groups of box numbers in reading order: rows from the top, columns from the side where
    reading begins."""
    out: list[np.ndarray] = []
    todo = [(np.arange(len(b.x0)), 0)] if len(b.x0) else []
    while todo:
        region, depth = todo.pop()
        cut = _choose(b.take(region), p) if depth < p.cut_depth and len(region) >= p.cut_items else None
        if cut is None:
            out.append(region)
            continue
        columns, at = cut
        below = (b.x1 if columns else b.y1)[region] <= at
        low, high = region[below], region[~below]
        if not len(low) or not len(high):
            out.append(region)
            continue
        first, second = (high, low) if rtl or not columns else (low, high)
        todo += [(second, depth + 1), (first, depth + 1)]
    return out
