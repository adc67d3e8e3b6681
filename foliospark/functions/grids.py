"""Table grids: from painted rules, and from columns of empty space where nothing is ruled."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from foliospark.functions.layout import Boxes, folded_rows, upper_median
from foliospark.functions.lines import Line, Rect
from foliospark.params import PARAMS, Params


@dataclass
class Grid:
    """xs ascend, ys descend."""

    xs: list[float]
    ys: list[float]
    box: Rect
    confidence: float
    ruled: bool

    def cells(self, rtl: bool):
        """(row, column in reading order, box) of every cell."""
        columns = list(zip(self.xs, self.xs[1:], strict=False))
        for row, (top, bottom) in enumerate(zip(self.ys, self.ys[1:], strict=False)):
            for column, (left, right) in enumerate(columns[::-1] if rtl else columns):
                yield row, column, (left, bottom, right, top)


@dataclass
class Table:
    rows: list[list[tuple[str, Rect]]]
    box: Rect
    confidence: float
    texts: list[list[str]] = field(init=False)

    def __post_init__(self) -> None:
        self.texts = [[t for t, _ in r] for r in self.rows]

    def plausible(self, p: Params = PARAMS) -> bool:
        cells = [t for r in self.texts for t in r]
        filled = sum(bool(t) for t in cells)
        return filled >= p.filled_cells and filled >= p.filled_share * len(cells)


def merged(at: np.ndarray, low: np.ndarray, high: np.ndarray, tolerance: float) -> np.ndarray:
    """Boundaries (at, from, to): rules within ``tolerance`` of the first of a run are one."""
    out: list[list[float]] = []
    for i in np.argsort(at, kind="stable").tolist():
        if out and abs(at[i] - out[-1][0]) <= tolerance:
            out[-1][1:] = min(out[-1][1], low[i]), max(out[-1][2], high[i])
        else:
            out.append([at[i], low[i], high[i]])
    return np.array(out, float).reshape(-1, 3)


def ruled_grids(rules: list[tuple[float, float, float, float]], p: Params = PARAMS) -> list[Grid]:
    a = np.array(rules, float).reshape(-1, 4)
    x, y = np.sort(a[:, ::2], axis=1), np.sort(a[:, 1::2], axis=1)
    flat = x[:, 1] - x[:, 0] > y[:, 1] - y[:, 0]
    rows = merged(a[flat, 1::2].mean(1), x[flat, 0], x[flat, 1], p.merge_tolerance)
    columns = merged(a[~flat, ::2].mean(1), y[~flat, 0], y[~flat, 1], p.merge_tolerance)
    if min(len(rows), len(columns)) < p.boundaries:
        return []
    step = np.diff(rows[:, 0])
    typical = upper_median(step, 0.0)
    apart = ~((rows[:-1, 1] < rows[1:, 2]) & (rows[1:, 1] < rows[:-1, 2]))
    if typical > 1.0:
        apart |= step > p.row_outlier * typical
    groups = np.split(rows, np.flatnonzero(apart) + 1)
    return [g for part in groups if len(part) >= p.boundaries and (g := _ruled(part, columns, p))]


def _ruled(rows: np.ndarray, columns: np.ndarray, p: Params) -> Grid | None:
    left, right, bottom, top = rows[:, 1].min(), rows[:, 2].max(), rows[:, 0].min(), rows[:, 0].max()
    width, height = right - left, top - bottom
    if width <= 0 or height <= 0:
        return None
    columns = columns[(columns[:, 1] < top) & (bottom < columns[:, 2]) & (columns[:, 2] - columns[:, 1] >= height * p.rule_span)]
    rows = rows[rows[:, 2] - rows[:, 1] >= width * p.rule_span]
    if min(len(rows), len(columns)) < p.boundaries:
        return None
    cover = [np.minimum((b[:, 2] - b[:, 1]) / whole, 1.0).mean() for b, whole in ((rows, width), (columns, height))]
    ys, xs = np.sort(rows[:, 0])[::-1], np.sort(columns[:, 0])
    return Grid(xs.tolist(), ys.tolist(), (float(left), float(bottom), float(right), float(top)), float(sum(cover) / 2), True)


class _Row:
    """Boxes on one baseline."""

    def __init__(self, b: Boxes, baseline: float) -> None:
        self.b, self.baseline = b, baseline
        self.low, self.high = float(b.x0.min()), float(b.x1.max())
        self.top, self.bottom = float(b.y1.max()), float(b.y0.min())

    @property
    def em(self) -> float:
        return max(upper_median(self.b.size, 10.0), 1.0)

    def leaves(self, x: float, gutter: float) -> bool:
        """Whether the row has nothing at x and a gutter's space around it."""
        b = self.b
        if ((b.x0 < x) & (x < b.x1)).any():
            return False
        before, after = b.x1[b.x1 <= x], b.x0[b.x0 >= x]
        return bool(after.min(initial=np.inf) - before.max(initial=-np.inf) >= gutter)

    def honours(self, boundaries: list[float], gutter: float, share: float) -> bool:
        b = self.b
        for x in boundaries:
            if (b.x0 < x).any() and (b.x1 > x).any() and not self.leaves(x, gutter):
                return False
        edges = [-np.inf, *boundaries, np.inf]
        used = sum(bool(((b.x0 < hi) & (b.x1 > lo)).any()) for lo, hi in zip(edges, edges[1:], strict=False))
        return used >= share * (len(edges) - 1)


def _rows(b: Boxes, p: Params) -> list[_Row]:
    order = np.argsort(-b.y0, kind="stable")
    most = np.maximum(b.size[order] * p.line_drift, p.least_drift)
    starts = folded_rows(b.y0[order], most, np.zeros(len(order), int))
    rows = [_Row(b.take(part), float(b.y0[part[0]])) for part in np.split(order, starts[1:])] if len(order) else []
    out: list[_Row] = []
    for row in rows:  # a row that drifted apart is whole again if its halves lie side by side
        last = out[-1] if out else None
        if last and abs(last.baseline - row.baseline) <= p.row_rejoin * min(last.em, row.em) and not (last.low < row.high and row.low < last.high):
            out[-1] = _Row(last.b + row.b, last.baseline)
        else:
            out.append(row)
    return out


def voted_boundaries(rows: list[_Row], left: float, right: float, gutter: float, p: Params = PARAMS) -> list[float]:
    """Middles of the stretches, a point at a time, that most rows reach across and leave empty."""
    width = int(max(np.ceil(right - left), 1.0))
    if width > p.table_width:
        return []
    slot = lambda x: np.minimum(np.floor(np.maximum(x - left, 0.0) + 0.5), width).astype(int)
    reach, empty = np.zeros(width + 1, int), np.zeros(width + 1, int)
    for row in rows:
        ink = np.zeros(width + 2, int)
        np.add.at(ink, slot(row.b.x0), 1)
        np.add.at(ink, slot(row.b.x1) + 1, -1)
        inked = np.cumsum(ink)[:-1] > 0
        span = slice(int(slot(np.array(row.low))), int(slot(np.array(row.high))) + 1)
        reach[span] += 1
        empty[span] += ~inked[span]
    good = (reach >= len(rows) * p.vote_reach) & (empty >= reach * p.vote_support)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(int)))
    out = []
    for a, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if e - a >= gutter:
            out.append(left + (min(e, width) - (e - a) / 2.0 if e <= width else width - (e - a) / 2.0))
    return out


def borderless_grids(b: Boxes, p: Params = PARAMS) -> list[Grid]:
    rows = _rows(b, p)
    if len(rows) < p.borderless_rows:
        return []
    step = -np.diff([r.baseline for r in rows])
    breaks = np.flatnonzero(step > p.band_outlier * max(upper_median(step, 1.0), 1.0)) + 1
    bands = np.split(np.arange(len(rows)), breaks)
    return [g for band in bands if len(band) >= p.borderless_rows and (g := _borderless([rows[i] for i in band], p))]


def _borderless(rows: list[_Row], p: Params) -> Grid | None:
    em = max(upper_median(np.concatenate([r.b.size for r in rows]), 10.0), 1.0)
    gutter = em * p.borderless_gap
    extent = lambda: (min(r.low for r in rows), max(r.high for r in rows))
    found = voted_boundaries(rows, *extent(), gutter, p)
    if len(found) + 1 < p.borderless_columns:
        return None
    good = [i for i, r in enumerate(rows) if r.honours(found, gutter, p.occupancy)]
    rows = rows[good[0] : good[-1] + 1] if good else []
    if len(rows) < p.borderless_rows:
        return None
    left, right = extent()
    found = voted_boundaries(rows, left, right, gutter, p)
    spanning = sum(any(r.low < x < r.high for x in found) for r in rows)
    if len(found) + 1 < p.borderless_columns or spanning < len(rows) * p.spanning_rows:
        return None
    ys = [rows[0].top, *((a.bottom + c.top) / 2 for a, c in zip(rows, rows[1:], strict=False)), rows[-1].bottom]
    return Grid([left, *found, right], ys, (left, ys[-1], right, ys[0]), p.inferred_confidence, False)


def fill_from_lines(grid: Grid, lines: list[Line], rtl: bool) -> tuple[Table, list[int]]:
    """The table, and the lines that it took: those whose middle lies in a cell. On a shared edge
    a line is in both cells."""
    a = np.array([x.box for x in lines], float).reshape(-1, 4)
    x, y = (a[:, 0] + a[:, 2]) / 2, (a[:, 1] + a[:, 3]) / 2
    rows: list[list[tuple[str, Rect]]] = [[] for _ in grid.ys[1:]]
    taken: set[int] = set()
    for row, _, box in grid.cells(rtl):
        inside = np.flatnonzero((x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3])).tolist()
        taken.update(inside)
        inside.sort(key=lambda i: (-lines[i].baseline, -lines[i].box[0] if rtl else lines[i].box[0]))
        rows[row].append((" ".join(lines[i].text for i in inside), box))
    return Table(rows, grid.box, grid.confidence), sorted(taken)
