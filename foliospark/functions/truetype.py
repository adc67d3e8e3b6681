"""Characters by glyph from a TrueType program's cmap, and stretched kashidas by outline."""

from __future__ import annotations

import struct

TATWEEL = "\u0640"
# Punctuation that a right-to-left font may draw mirrored.
MIRRORED = frozenset("()[]{}<>\u00ab\u00bb\u2039\u203a\ufd3e\ufd3f")


def presentation_form(c: str) -> bool:
    return "\ufb50" <= c <= "\ufdff" or "\ufe70" <= c <= "\ufeff"


def _private(point: int) -> bool:
    return 0xE000 <= point <= 0xF8FF or 0xF0000 <= point <= 0xFFFFD or 0x100000 <= point <= 0x10FFFD


def _tables(program: bytes) -> dict[bytes, bytes]:
    (n,) = struct.unpack_from(">H", program, 4)
    out: dict[bytes, bytes] = {}
    for i in range(n):
        tag, _, offset, length = struct.unpack_from(">4sIII", program, 12 + 16 * i)
        if offset + length <= len(program):
            out.setdefault(tag, program[offset : offset + length])
    return out


def _segments(t: bytes):
    """(character, glyph) of a format 4 subtable."""
    (double,) = struct.unpack_from(">H", t, 6)
    n = double // 2
    ends, starts, deltas, offsets = (struct.unpack_from(f">{n}H", t, 14 + k * double + (2 if k else 0)) for k in range(4))
    table = 16 + 3 * double
    for i in range(n):
        for code in range(starts[i], ends[i] + 1):
            if not offsets[i]:
                yield code, (code + deltas[i]) & 0xFFFF
                continue
            at = table + 2 * i + offsets[i] + 2 * (code - starts[i])
            glyph = int.from_bytes(t[at : at + 2], "big")
            if glyph:
                yield code, (glyph + deltas[i]) & 0xFFFF


def _groups(t: bytes):
    (n,) = struct.unpack_from(">I", t, 12)
    for i in range(n):
        start, end, glyph = struct.unpack_from(">III", t, 16 + 12 * i)
        for k in range(min(end - start, 0xFFFF) + 1 if end >= start else 0):
            if glyph + k > 0xFFFF:
                break
            yield start + k, glyph + k


def _cmap(cmap: bytes):
    (n,) = struct.unpack_from(">H", cmap, 2)
    best = (0, b"")
    for i in range(n):
        platform, encoding, offset = struct.unpack_from(">HHI", cmap, 4 + 8 * i)
        rank = {(3, 10): 2, (3, 1): 1}.get((platform, encoding), 0)
        if rank > best[0]:
            best = (rank, cmap[offset:])
    kind = int.from_bytes(best[1][:2], "big") if best[0] else 0
    return _segments(best[1]) if kind == 4 else _groups(best[1]) if kind == 12 else ()


def _outline(tables: dict[bytes, bytes], glyph: int) -> tuple[int, int, int, int] | None:
    """(contours, x_min, y_min, y_max), or None for an empty glyph."""
    long, loca = struct.unpack_from(">H", tables[b"head"], 50)[0], tables[b"loca"]
    if long > 1 or len(loca) < (glyph + 2) * (4 if long else 2):
        return None
    a, b = struct.unpack_from(">II", loca, 4 * glyph) if long else (2 * x for x in struct.unpack_from(">HH", loca, 2 * glyph))
    part = tables[b"glyf"][a:b]
    if len(part) < 10:
        return None
    contours, x_min, y_min, _, y_max = struct.unpack_from(">hhhhh", part)
    return contours, x_min, y_min, y_max


def glyph_characters(program: bytes) -> dict[int, str]:
    """Of several characters of a glyph a presentation form wins, then the lower one. Glyphs that no
    character has, but whose outline is the tatweel's at another width, are tatweels."""
    out: dict[int, str] = {}
    try:
        tables = _tables(program)
        for point, glyph in _cmap(tables.get(b"cmap", b"\0\0\0\0")):
            if not glyph or _private(point) or point > 0x10FFFF or 0xD800 <= point <= 0xDFFF:
                continue
            c = chr(point)
            if glyph not in out or (not presentation_form(c), c) < (not presentation_form(out[glyph]), out[glyph]):
                out[glyph] = c
    except (struct.error, IndexError):
        pass
    try:
        bar = min((g for g, c in out.items() if c == TATWEEL), default=None)
        shape = _outline(tables, bar) if bar is not None else None
        if shape and shape[0] > 0:
            for glyph in range(struct.unpack_from(">H", tables[b"maxp"], 4)[0]):
                if glyph not in out and _outline(tables, glyph) == shape:
                    out[glyph] = TATWEEL
    except (struct.error, KeyError):
        pass
    return out
