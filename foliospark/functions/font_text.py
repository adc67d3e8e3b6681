"""From character codes to text: the sources that a font has and which of them to trust."""

from __future__ import annotations

from unicodedata import normalize

import numpy as np

from foliospark.functions.cff import glyph_names
from foliospark.functions.cmap import CMap, parse_cmap
from foliospark.functions.glyph_names import Encoding, glyph_name_text
from foliospark.functions.truetype import MIRRORED, TATWEEL, glyph_characters
from foliospark.sources.pdf_pages import RawFont

# Characters that separate digit groups, and letters that share a glyph.
SEPARATORS = frozenset(",.\u060c\u066b\u066c\u02d9")
VARIANTS = {"\u064a": "yeh", "\u06cc": "yeh", "\u0649": "yeh", "\u0647": "heh", "\u06be": "heh", "\u06c1": "heh", "\u06d5": "heh", "\u0643": "kaf", "\u06a9": "kaf"}
EQUAL_SEPARATORS = ({",", "\u066c"}, {".", "\u066b"})
MIN_SAMPLE, MAX_DISAGREEMENT, MIN_CONFUSIONS = 8, 1 / 3, 3
UNKNOWN_WIDTH = 0.5


def _nfkc(c: str) -> str:
    return normalize("NFKC", c)


def variant(c: str) -> str | None:
    return VARIANTS.get(_nfkc(c))


def same_letter(a: str, b: str) -> bool:
    return a == b or _nfkc(a) == _nfkc(b)


def shares_glyph(a: str, b: str) -> bool:
    return not same_letter(a, b) and variant(a) is not None and variant(a) == variant(b)


def digit_value(c: str) -> int | None:
    for zero in (0x30, 0x660, 0x6F0):
        if 0 <= ord(c) - zero <= 9:
            return ord(c) - zero
    return None


def same_meaning(a: str, b: str) -> bool:
    if same_letter(a, b) or shares_glyph(a, b):
        return True
    return (digit_value(a) is not None and digit_value(a) == digit_value(b)) or {a, b} in EQUAL_SEPARATORS


def arabic_letter(c: str) -> str | None:
    base = _nfkc(c)
    return base if len(base) == 1 and ("\u0621" <= base <= "\u063a" or "\u0641" <= base <= "\u064a") else None


def letter_confusion(mapped: str, drawn: str) -> bool:
    letter = arabic_letter(drawn)
    return letter is not None and (mapped.isspace() or (arabic_letter(mapped) or letter) != letter)


def resolves_ambiguity(mapped: str, drawn: str) -> bool:
    """Whether a map's text says more than the drawn glyph can: a letter of the same shape, or a
    ligature's letters one by one."""
    if len(mapped) == 1:
        return shares_glyph(mapped, drawn)
    spelled, parts = _nfkc(mapped), _nfkc(drawn)
    return len(parts) > 1 and len(spelled) == len(parts) and all(a == b or shares_glyph(a, b) for a, b in zip(spelled, parts, strict=True))


def map_is_wrong(cmap: CMap, testimony: dict[int, str]) -> bool:
    """testimony: the character that the font program draws for each code."""
    compared = disagreed = confused = 0
    for code, drawn in testimony.items():
        mapped = cmap.get(code)
        if mapped is None or len(mapped) != 1 or drawn in MIRRORED:
            continue
        compared += 1
        if not same_meaning(mapped, drawn):
            disagreed += 1
            confused += letter_confusion(mapped, drawn)
    return compared >= MIN_SAMPLE and (disagreed > compared * MAX_DISAGREEMENT or confused >= MIN_CONFUSIONS)


class Font:
    def __init__(self, raw: RawFont) -> None:
        self.name, self.two_byte, self.raw = raw.name, raw.two_byte, raw
        self.cmap = parse_cmap(raw.to_unicode) if raw.to_unicode is not None else CMap()
        self.encoding = Encoding(None, []) if raw.two_byte else Encoding(raw.base_encoding, raw.differences)
        self.names = glyph_names(raw.cff) if raw.cff and not raw.two_byte else {}
        drawn = glyph_characters(raw.truetype) if raw.truetype else {}
        if raw.cid_to_gid is None:
            self.drawn = drawn
        else:
            gids = np.frombuffer(raw.cid_to_gid[: len(raw.cid_to_gid) // 2 * 2], ">u2").tolist()
            self.drawn = {cid: drawn[g] for cid, g in enumerate(gids) if g and g in drawn}
        self.wrong_map = bool(len(self.cmap) and self.drawn) and map_is_wrong(self.cmap, self.drawn)
        self.corrections = {} if raw.two_byte and not len(self.cmap) else self._corrections()
        self._text: dict[int, str | None] = {}
        self._widths: np.ndarray | None = None

    def _corrections(self) -> dict[int, str]:
        """Where the map and the font's own names give different separators, the names win."""
        out = {}
        for code in range(256):
            mapped = self.cmap.get(code)
            if mapped not in SEPARATORS:
                continue
            named = self.encoding.get(code)
            named = glyph_name_text(self.names.get(code)) if named is None else named
            if named in SEPARATORS and named != mapped:
                out[code] = named
        return out

    def decode(self, code: int) -> str | None:
        if code not in self._text:
            self._text[code] = self._decode(code)
        return self._text[code]

    def _decode(self, code: int) -> str | None:
        if code in self.corrections:
            return self.corrections[code]
        drawn = self.drawn.get(code)
        if drawn == TATWEEL:
            return TATWEEL
        mapped = self.cmap.get(code)
        if self.wrong_map and drawn is not None and drawn not in MIRRORED:
            return mapped if mapped is not None and resolves_ambiguity(mapped, drawn) else drawn
        sources = (mapped, self.encoding.get(code), glyph_name_text(self.names.get(code)), drawn)
        return next((t for t in sources if t is not None), None)

    @property
    def resolvable(self) -> bool:
        return len(self.cmap) > 0 or len(self.encoding) > 0

    def widths(self, codes: np.ndarray) -> np.ndarray:
        """Widths in ems."""
        if self._widths is None:
            if self.two_byte:
                table = np.full(1 << 16, self.raw.default_width)
                for first, last, w in reversed(self.raw.cid_widths):  # the first range that has a code wins
                    table[first : last + 1] = w
            else:
                table = np.full(256, self.raw.missing_width)
                own = self.raw.widths[: max(0, 256 - self.raw.first_char)]
                table[self.raw.first_char : self.raw.first_char + len(own)] = own
            self._widths = table / 1000.0
        return self._widths[codes]


def font_map(raws: list[RawFont]) -> dict[str, Font]:
    """By name; of two fonts of one name the last counts."""
    return {r.name: Font(r) for r in raws}
