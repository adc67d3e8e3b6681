"""From positioned glyphs to lines of logical text.

A line's glyphs are read in visual order; word gaps, marks and composed overlays are settled
there, then the line is reordered (UAX #9) and only then normalised. The other order would
break ligatures apart in the wrong direction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from foliospark.functions import characters as ch
from foliospark.functions.bidi import is_rtl, reorder
from foliospark.functions.font_text import Font
from foliospark.functions.interpreter import PageGlyphs, Style
from foliospark.functions.layout import Boxes, folded_rows, segment, upper_median
from foliospark.params import PARAMS, Params

Rect = tuple[float, float, float, float]


@dataclass
class Line:
    text: str
    baseline: float
    box: Rect
    rtl: bool
    style: Style
    unresolved: int
    glyphs: int

    @property
    def rate(self) -> float:
        return 1.0 - self.unresolved / self.glyphs if self.glyphs else 1.0


@dataclass
class Region:
    lines: list[Line]
    extras: list[int]
    box: Rect


class PlacedGlyphs:
    """A page's glyphs with their texts, and with anchors that marks and overlays take from hosts."""

    def __init__(self, page: PageGlyphs, fonts: dict[str, Font], params: Params = PARAMS) -> None:
        self.page, self.fonts, self.params = page, fonts, params
        self.size = page.size
        self.along, self.across = page.along.astype(float), page.across.astype(float)
        self.start, self.advance = self.along.copy(), page.advance
        self.moves = np.abs(page.advance) >= self.size * params.negligible_advance
        self.overlaid = np.zeros(len(page), bool)
        self.decoded = self._decode()
        self.actual: list[str | None] = [None] * len(page)
        for span in page.spans:
            end = min(span.end, len(page))
            if span.text is not None and span.start < end:
                self.actual[span.start : end] = [self._logical(span.text, span.start, end), *[""] * (end - span.start - 1)]
        #: The text of each glyph; None where nothing resolves it.
        self.text = [d if a is None else a for a, d in zip(self.actual, self.decoded, strict=True)] if page.spans else self.decoded
        self._anchor()

    def _decode(self) -> list[str | None]:
        page = self.page
        pair = page.style * (1 << 32) + page.code
        distinct, at = np.unique(pair, return_inverse=True)
        texts = []
        for p in distinct.tolist():
            font = self.fonts.get(page.styles[p >> 32].font)
            texts.append(font.decode(p & 0xFFFFFFFF) if font else None)
        return np.array([*texts, None], object)[at].tolist() if len(page) else []

    def _logical(self, text: str, start: int, end: int) -> str:
        """The stated text; reversed if its letters are the drawn ones backwards, in visual order."""
        letters = lambda s: [c for c in s if not ch.all_white(c) and not ch.is_mark(c)]
        stated = letters(text)
        drawn = [self.decoded[i] for i in range(start, end) if self.moves[i]]
        painted = letters("".join(drawn)) if None not in drawn else []
        backwards = len(stated) > 1 and is_rtl("".join(stated)) and stated != painted and stated[::-1] == painted
        return text[::-1] if backwards else text

    def _anchor(self) -> None:
        """In paint order: a mark takes the line of its host, an overlay its host's whole anchor."""
        still = np.flatnonzero(~self.moves)
        if not len(still):
            return
        turn, reach = self.page.turn, self.params.overlay_window
        for i in still.tolist():
            near = np.abs(self.across - self.across[i]) <= self.size[i]
            if ch.is_mark(self.text[i] or ""):
                hosts = self.moves & near & (turn == turn[i]) & (self.along <= self.along[i]) & (self.along[i] <= self.along + self.advance)
                hosts = np.flatnonzero(hosts)
                if len(hosts):
                    self.across[i] = self.across[hosts[np.argmin(np.abs(self.across[hosts] - self.across[i]))]]
                continue
            window = slice(max(0, i - reach), i + reach + 1)
            hosts = (self.moves & near)[window] & (self.along[window] < self.along[i]) & (self.along[i] < (self.along + self.advance)[window])
            if hosts.any():
                host = window.start + int(np.argmax(hosts))
                self.along[i], self.across[i], self.overlaid[i] = self.along[host], self.across[host], True

    @property
    def rtl(self) -> bool:
        return any(is_rtl(t) for t in {t for t in self.text if t})

    def boxes(self) -> Boxes:
        """What reading order sees: a quarter of the height below the baseline, the rest above it."""
        page = self.page
        upright = page.turn % 2 == 0
        w, h = np.where(upright, page.advance, self.size), np.where(upright, self.size, page.advance)
        return Boxes(page.x, page.x + w, page.y - h * 0.25, page.y + h * 0.75, self.size)

    def rows(self, ids: np.ndarray) -> list[np.ndarray]:
        """Glyphs of each line, from the top; a line's drift is measured from its first glyph."""
        ids = ids[np.lexsort((self.along[ids], -self.across[ids]))]
        most = np.maximum(self.size[ids] * self.params.line_drift, self.params.least_drift)
        return np.split(ids, folded_rows(self.across[ids], most, self.page.turn[ids])[1:]) if len(ids) else []

    def lines(self, ids: np.ndarray) -> list[Line]:
        return [line for row in self.rows(ids) if (line := self._line(row))]

    def within(self, box: Rect) -> str:
        """The text of the glyphs whose middle of the baseline lies in the box."""
        page = self.page
        x = page.x + page.advance / 2
        inside = (x >= box[0]) & (x <= box[2]) & (page.y >= box[1]) & (page.y <= box[3])
        return " ".join(line.text for line in self.lines(np.flatnonzero(inside)))

    def _line(self, ids: np.ndarray) -> Line | None:
        order = ids[np.argsort(self.along[ids], kind="stable")]
        texts = [self.text[i] for i in order.tolist()]
        lost = None in texts
        shown = "".join(ch.LOST if t is None else t for t in texts) if lost else "".join(texts)
        rtl = is_rtl(shown)
        simple = not lost and not rtl and self.moves[order].all() and ch.LOST not in shown and not any(ch.is_mark(t) or not t for t in set(texts))
        visual, unresolved = self._plain(order, texts) if simple else self._pieces(order, texts, rtl)
        text = ch.finish(reorder(ch.unify_digits(visual), rtl))
        if not text:
            return None
        return Line(text, float(self.page.y[ids[0]]), self._box(order), rtl, self._style(ids), unresolved, len(ids))

    def _gap_share(self, texts: list[str | None]) -> float:
        painted = any(t and ch.all_white(t) for t in set(texts))
        return self.params.word_gap if painted else self.params.word_gap_inferred

    def _plain(self, order: np.ndarray, texts: list[str]) -> tuple[str, int]:
        """A left-to-right line of glyphs that all move the pen and all have text."""
        edge = np.maximum.accumulate(self.start[order] + self.advance[order])
        wide = self.start[order][1:] - edge[:-1] > self.size[order][1:] * self._gap_share(texts)
        if not wide.any():
            return "".join(texts), 0
        out = [texts[0]]
        for t, before, gap in zip(texts[1:], texts, wide.tolist(), strict=False):
            out.append(" " + t if gap and before != " " else t)
        return "".join(out), 0

    def _pieces(self, order: np.ndarray, texts: list[str | None], rtl: bool) -> tuple[str, int]:
        share = self._gap_share(texts)
        pieces: list[tuple[str, bool]] = []  # text, and whether the file states it
        unresolved, edge = 0, None
        slot = None  # where the marks of the last base go
        overlay = None  # (its slot, composed, base) if the last glyph was a composed overlay
        for i, text in zip(order.tolist(), texts, strict=True):
            start, stated = float(self.start[i]), self.actual[i] is not None
            end = start + float(self.advance[i])
            lost = text is None
            text = ch.LOST if lost else text
            if not lost and not text.strip(ch.LOST):  # declared to carry no text
                edge = end if edge is None else max(edge, end)
                continue
            unresolved += text == ch.LOST
            moves = bool(self.moves[i])
            if moves and edge is not None and start - edge > float(self.size[i]) * share and (not pieces or pieces[-1] != (" ", False)):
                pieces.append((" ", False))
                slot = None
            edge = end if edge is None else max(edge, end)
            if self.overlaid[i] and ch.all_white(text):
                continue
            waiting, overlay = overlay, None
            if waiting and moves and (merged := ch.merge_composed(text, waiting[2], waiting[1])) is not None:
                del pieces[waiting[0]]
                pieces.append((merged, False))
                slot = len(pieces) - 1
                continue
            if ch.is_mark(text):
                pieces.insert(slot if rtl and slot is not None else len(pieces), (text, stated))
            else:
                pieces.append((text, stated))
                slot = len(pieces) - 1
            base = None if moves else ch.composed_base(text)
            overlay = (len(pieces) - 1, text, base) if base else None
        return "".join(_visual(t) for t, _ in pieces), unresolved

    def _box(self, ids: np.ndarray) -> Rect:
        page = self.page
        x, y, turn, size = page.x[ids], page.y[ids], page.turn[ids], self.size[ids]
        ahead = page.advance[ids] * np.where(turn >= 2, -1.0, 1.0)
        ax, ay = np.where(turn % 2 == 0, ahead, 0.0), np.where(turn % 2 == 1, ahead, 0.0)
        return (
            float(np.minimum(x, x + ax).min()),
            float(np.minimum(y - size * 0.25, y + ay).min()),
            float(np.maximum(x, x + ax).max()),
            float(np.maximum(y + size * 0.75, y + ay).max()),
        )

    def _style(self, ids: np.ndarray) -> Style:
        """The style with which the most glyphs of the line go together, the first of equals."""
        styles = self.page.styles
        if len(styles) == 1:
            return styles[0]
        index = self.page.style[ids].tolist()
        counts = {s: index.count(s) for s in dict.fromkeys(index)}
        weight = {s: sum(n for o, n in counts.items() if styles[o].merges(styles[s])) for s in counts}
        return styles[max(counts, key=weight.get)]


def _visual(text: str) -> str:
    """Several letters in one glyph are stored logically; reordering would turn them around."""
    letters = "".join(c for c in text if not c.isdecimal())
    return text[::-1] if len(text) > 1 and is_rtl(letters) else text


def _union(rects: list[Rect]) -> Rect:
    if not rects:
        return 0.0, 0.0, 0.0, 0.0
    a = np.array(rects)
    return tuple(map(float, (*a[:, :2].min(0), *a[:, 2:].max(0))))


def regions(placed: PlacedGlyphs, extras: list[Rect], order: list[list[tuple[int, int]]] | None = None) -> list[Region]:
    """Regions in reading order. ``extras`` are boxes of images that take part in it; ``order``: the
    glyph ranges of each run that a tagged file states, in which images have no place."""
    out: list[Region] = []
    if order is not None:
        for ranges in order:
            ids = np.concatenate([np.arange(a, min(b, len(placed.text))) for a, b in ranges]) if ranges else np.zeros(0, int)
            if found := placed.lines(ids):
                out.append(Region(found, [], _union([x.box for x in found])))
        return out
    n = len(placed.text)
    em = upper_median(placed.size, 10.0)
    more = np.array(extras, float).reshape(-1, 4)
    all_boxes = placed.boxes() + Boxes(more[:, 0], more[:, 2], more[:, 1], more[:, 3], np.full(len(more), em))
    for ids in segment(all_boxes, placed.rtl, placed.params):
        found, own = placed.lines(ids[ids < n]), (ids[ids >= n] - n).tolist()
        if found or own:
            out.append(Region(found, own, _union([x.box for x in found] + [extras[k] for k in own])))
    return out
