"""Glyph names by code from a CFF font program (name-keyed fonts; the first font of the set)."""

from __future__ import annotations

import struct
from string import ascii_lowercase, ascii_uppercase

# The standard strings that precede a font's own, in order, as far as they name
# glyphs of text; the Latin letters stand where ``*A`` and ``*a`` do.
_NAMES = (
    ".notdef space exclam quotedbl numbersign dollar percent ampersand quoteright parenleft parenright asterisk plus "
    "comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater "
    "question at *A bracketleft backslash bracketright asciicircum underscore quoteleft *a braceleft bar braceright asciitilde "
    "exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft "
    "guilsinglright fi fl endash dagger daggerdbl periodcentered paragraph bullet quotesinglbase quotedblbase "
    "quotedblright guillemotright ellipsis perthousand questiondown grave acute circumflex tilde macron breve dotaccent "
    "dieresis ring cedilla hungarumlaut ogonek caron emdash AE ordfeminine Lslash Oslash OE ordmasculine ae dotlessi "
    "lslash oslash oe germandbls onesuperior logicalnot mu trademark Eth onehalf plusminus Thorn onequarter divide "
    "brokenbar degree thorn threequarters twosuperior registered minus eth multiply threesuperior copyright Aacute "
    "Acircumflex Adieresis Agrave Aring Atilde Ccedilla Eacute Ecircumflex Edieresis Egrave Iacute Icircumflex Idieresis "
    "Igrave Ntilde Oacute Ocircumflex Odieresis Ograve Otilde Scaron Uacute Ucircumflex Udieresis Ugrave Yacute "
    "Ydieresis Zcaron aacute acircumflex adieresis agrave aring atilde ccedilla eacute ecircumflex edieresis egrave "
    "iacute icircumflex idieresis igrave ntilde oacute ocircumflex odieresis ograve otilde scaron uacute ucircumflex "
    "udieresis ugrave yacute ydieresis zcaron"
)
STANDARD_STRINGS = _NAMES.replace("*A", " ".join(ascii_uppercase)).replace("*a", " ".join(ascii_lowercase)).split()
STANDARD_COUNT = 391


class _Bad(ValueError):
    pass


def _index(data: bytes, at: int) -> tuple[list[bytes], int]:
    (n,) = struct.unpack_from(">H", data, at)
    if not n:
        return [], at + 2
    size = data[at + 2]
    if not 1 <= size <= 4:
        raise _Bad
    table = at + 3
    offsets = [int.from_bytes(data[table + i * size : table + (i + 1) * size], "big") for i in range(n + 1)]
    base = table + (n + 1) * size - 1
    return [data[base + a : base + b] for a, b in zip(offsets, offsets[1:], strict=False)], base + offsets[-1]


def _dict(data: bytes) -> dict[int, list[float]]:
    out: dict[int, list[float]] = {}
    operands: list[float] = []
    at = 0
    while at < len(data):
        b = data[at]
        at += 1
        if b <= 21:
            if b == 12:
                b = 1200 + data[at]
                at += 1
            out[b], operands = operands, []
        elif b == 28:
            operands.append(struct.unpack_from(">h", data, at)[0])
            at += 2
        elif b == 29:
            operands.append(struct.unpack_from(">i", data, at)[0])
            at += 4
        elif b == 30:
            while at < len(data) and data[at] & 15 != 15 and data[at] >> 4 != 15:
                at += 1
            at += 1
            operands.append(0)
        elif 32 <= b <= 246:
            operands.append(b - 139)
        elif 247 <= b <= 254:
            step = (b - 247) * 256 + 108 if b < 251 else (b - 251) * 256 + 108
            operands.append(step + data[at] if b < 251 else -step - data[at])
            at += 1
    return out


def _charset(data: bytes, at: int, glyphs: int) -> list[int]:
    """String numbers by glyph."""
    if at <= 2:
        return list(range(glyphs))
    out, kind = [0], data[at]
    at += 1
    while len(out) < glyphs:
        (first,) = struct.unpack_from(">H", data, at)
        at += 2
        left = 0
        if kind == 1:
            left = data[at]
            at += 1
        elif kind == 2:
            (left,) = struct.unpack_from(">H", data, at)
            at += 2
        out += range(first, first + left + 1)
    return out[:glyphs]


def _codes(data: bytes, at: int) -> dict[int, int]:
    """Glyph by code of a font's own encoding."""
    kind, n = data[at] & 127, data[at + 1]
    if kind == 0:
        return {data[at + 2 + i]: i + 1 for i in range(n)}
    out, glyph = {}, 1
    for i in range(n):
        first, left = data[at + 2 + 2 * i], data[at + 3 + 2 * i]
        for code in range(first, min(first + left, 255) + 1):
            out[code] = glyph
            glyph += 1
    return out


def glyph_names(program: bytes) -> dict[int, str]:
    """Names by code; empty for damaged and CID-keyed fonts."""
    try:
        if program[0] != 1:
            return {}
        _, at = _index(program, program[2])
        tops, at = _index(program, at)
        strings, _ = _index(program, at)
        top = _dict(tops[0])
        if 1230 in top:
            return {}
        charstrings, _ = _index(program, int(top[17][0]))
        charset = _charset(program, int(top.get(15, [0])[0]), len(charstrings))
        own = int(top.get(16, [0])[0])

        def name(sid: int) -> str | None:
            if sid < STANDARD_COUNT:
                return STANDARD_STRINGS[sid] if sid < len(STANDARD_STRINGS) else None
            return strings[sid - STANDARD_COUNT].decode("latin-1") if sid - STANDARD_COUNT < len(strings) else None

        if own > 1:
            codes = _codes(program, own)
        else:  # the standard encoding: printable ASCII in the order of the standard strings
            by_sid = {sid: g for g, sid in enumerate(charset)}
            codes = {code: by_sid[code - 31] for code in range(32, 127) if code - 31 in by_sid}
        found = {code: name(charset[g]) for code, g in codes.items() if g < len(charset)}
        return {code: n for code, n in found.items() if n and n != ".notdef"}
    except (IndexError, struct.error, _Bad, KeyError):
        return {}
