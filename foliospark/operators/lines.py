"""Lines of logical text from a table of glyphs, a page at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from foliospark.functions.interpreter import BLACK, PageGlyphs, Style
from foliospark.functions.lines import PlacedGlyphs
from foliospark.operators.geometry import KEYS
from foliospark.operators.groups import by_page
from foliospark.params import PARAMS, Params

_LINE = "line int, text string, baseline double, x0 double, y0 double, x1 double, y1 double, rtl boolean, unresolved int, glyphs int"


class _Given:
    """A font whose texts stand in the table: the code is the glyph's number."""

    def __init__(self, texts: list[str | None]) -> None:
        self.texts = texts

    def decode(self, code: int) -> str | None:
        return self.texts[code]


def build_lines(glyphs: DataFrame, p: Params = PARAMS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Lines of glyphs (glyph_idx, x, y, advance, size, turn, text or null), from the top. Gaps, marks,
    overlays, digits, reordering and normalisation are a sequence of decisions along a line, so a
    page is one group."""

    def built(c: list) -> list[tuple]:
        order = np.argsort(c[0], kind="stable")
        x, y, advance, size, turn = (v[order] for v in c[1:6])
        sizes, style = np.unique(size, return_inverse=True)
        texts = [c[6][i] for i in order.tolist()]
        page = PageGlyphs(np.arange(len(order)), x, y, advance, turn.astype(np.int64), style, [Style(BLACK, "given", s, 0) for s in sizes.tolist()])
        lines = PlacedGlyphs(page, {"given": _Given(texts)}, p).lines(np.arange(len(order)))
        return [(i, v.text, v.baseline, *v.box, v.rtl, v.unresolved, v.glyphs) for i, v in enumerate(lines)]

    return by_page(glyphs, keys, ("glyph_idx", "x", "y", "advance", "size", "turn", "text"), _LINE, built)
