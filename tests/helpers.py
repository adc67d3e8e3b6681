import numpy as np

from foliospark.functions.font_text import Font
from foliospark.functions.interpreter import BLACK, Interpreter, PageGlyphs, Span, Style
from foliospark.functions.lines import PlacedGlyphs
from foliospark.sources.pdf_pages import RawFont


class MapFont:
    """A font that decodes by a dictionary."""

    two_byte, resolvable = False, True

    def __init__(self, texts: dict[int, str]):
        self.texts = texts

    def decode(self, code: int):
        return self.texts.get(code)

    def widths(self, codes):
        return np.full(len(codes), 0.5)


def painted(rows, spans=(), size=11.0, turn=0):
    """rows: (x, y, advance, text or None) in paint order -> placed glyphs."""
    n = len(rows)
    texts = {i: r[3] for i, r in enumerate(rows) if r[3] is not None}
    page = PageGlyphs(
        np.arange(n), *(np.array([float(r[k]) for r in rows]) for k in range(3)), np.full(n, turn), np.zeros(n, int), [Style(BLACK, "F", size, 0)], spans=[Span(a, b, t, None) for a, b, t in spans]
    )
    return PlacedGlyphs(page, {"F": MapFont(texts)})


def line_texts(placed):
    return [x.text for x in placed.lines(np.arange(len(placed.text)))]


def interpret(source: bytes, subtype: str = "Type1", widths: list[float] | None = None):
    fonts = {"F1": Font(RawFont("F1", subtype, base_encoding="WinAnsiEncoding", widths=widths or [500.0] * 256, default_width=500.0))}
    return Interpreter(fonts).page(source)
