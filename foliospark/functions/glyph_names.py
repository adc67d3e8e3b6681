"""Byte encodings and glyph names.

The full public glyph list is not available here. Known are the names of the three base encodings and
common signs, accented letters, letters of the Greek, Cyrillic, Hebrew, Arabic and kana scripts by
rule from their Unicode names, ``afii`` numbers by rule, and the algorithmic ``uniXXXX`` and ``uXXXXXX`` forms.
"""

from __future__ import annotations

import re
import unicodedata

# Glyph names whose characters no rule gives, for Latin, punctuation and Arabic.
NAMED = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&",
    "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-",
    "hyphenminus": "-", "minus": "−", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3",
    "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";",
    "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\",
    "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|",
    "braceright": "}", "asciitilde": "~", "exclamdown": "¡", "cent": "¢", "sterling": "£",
    "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨",
    "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«", "logicalnot": "¬",
    "registered": "®", "macron": "¯", "degree": "°", "plusminus": "±", "acute": "´",
    "mu": "µ", "paragraph": "¶", "periodcentered": "·", "cedilla": "¸", "ordmasculine": "º",
    "guillemotright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾",
    "questiondown": "¿", "AE": "Æ", "ae": "æ", "Eth": "Ð", "eth": "ð", "multiply": "×",
    "Oslash": "Ø", "oslash": "ø", "Thorn": "Þ", "thorn": "þ", "germandbls": "ß",
    "divide": "÷", "dotlessi": "ı", "Lslash": "Ł", "lslash": "ł", "OE": "Œ", "oe": "œ",
    "florin": "ƒ", "circumflex": "ˆ", "caron": "ˇ", "breve": "˘", "dotaccent": "˙",
    "ring": "˚", "ogonek": "˛", "tilde": "˜", "hungarumlaut": "˝", "endash": "–",
    "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚",
    "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "dagger": "†",
    "daggerdbl": "‡", "bullet": "•", "ellipsis": "…", "perthousand": "‰",
    "guilsinglleft": "‹", "guilsinglright": "›", "fraction": "⁄", "Euro": "€",
    "trademark": "™", "fi": "ﬁ", "fl": "ﬂ", "tatweel": "ـ", "kashida": "ـ",
    "afii57388": "،", "afii57403": "؛", "afii57407": "؟", "afii57440": "ـ",
}
# Names of mathematical and other signs.
SIGNS = {
    "partialdiff": "∂", "Delta": "∆", "increment": "∆", "product": "∏", "summation": "∑", "radical": "√",
    "infinity": "∞", "integral": "∫", "approxequal": "≈", "notequal": "≠", "lessequal": "≤", "greaterequal": "≥",
    "lozenge": "◊", "Omega": "Ω", "apple": "\uf8ff", "arrowleft": "←", "arrowup": "↑", "arrowright": "→",
    "arrowdown": "↓", "arrowboth": "↔", "universal": "∀", "existential": "∃", "emptyset": "∅", "gradient": "∇",
    "element": "∈", "notelement": "∉", "suchthat": "∋", "proportional": "∝", "angle": "∠", "logicaland": "∧",
    "logicalor": "∨", "intersection": "∩", "union": "∪", "therefore": "∴", "similar": "∼", "congruent": "≅",
    "equivalence": "≡", "propersubset": "⊂", "propersuperset": "⊃", "minute": "′", "second": "″", "house": "⌂",
    "spade": "♠", "club": "♣", "heart": "♥", "diamond": "♦", "nbspace": "\xa0", "softhyphen": "\xad", "sfthyphen": "\xad",
    "kgreenlandic": "ĸ", "eng": "ŋ", "Eng": "Ŋ", "longs": "ſ", "dcroat": "đ", "Dcroat": "Đ", "hbar": "ħ", "Hbar": "Ħ",
    "tbar": "ŧ", "Tbar": "Ŧ", "IJ": "Ĳ", "ij": "ĳ", "napostrophe": "ŉ", "Idot": "İ", "mugreek": "μ",
    "Deltagreek": "Δ", "Omegagreek": "Ω", "sigma1": "ς", "theta1": "ϑ", "phi1": "ϕ", "omega1": "ϖ", "Upsilon1": "ϒ",
}
#: Accents that a letter's name may end in, as combining characters.
ACCENTS = {
    "grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "ring": "̊", "caron": "̌", "cedilla": "̧", "breve": "̆", "ogonek": "̨",
    "macron": "̄", "dotaccent": "̇", "hungarumlaut": "̋", "commaaccent": "̧", "tonos": "́", "dieresistonos": "̈́", "dotbelow": "̣", "hookabove": "̉",
}
#: Scripts whose letters the list names by their Unicode names: first and last character, ending of the names.
SCRIPTS = ((0x0391, 0x03C9, ""), (0x0400, 0x045F, "cyrillic"), (0x05D0, 0x05EA, "hebrew"), (0x05D0, 0x05EA, ""), (0x0621, 0x064A, "arabic"), (0x3041, 0x3093, "hiragana"), (0x30A1, 0x30F6, "katakana"), (0xFE80, 0xFEF4, "arabic"))
#: First and last afii number, and the character of the first.
AFII = (
    (10017, 10022, 0x0410), (10023, 10023, 0x0401), (10024, 10049, 0x0416), (10050, 10050, 0x0490), (10051, 10061, 0x0402), (10062, 10062, 0x040E), (10065, 10070, 0x0430),
    (10071, 10071, 0x0451), (10072, 10097, 0x0436), (10098, 10098, 0x0491), (10099, 10109, 0x0452), (10110, 10110, 0x045E), (10145, 10145, 0x040F), (10193, 10193, 0x045F),
    (57392, 57401, 0x0660), (57409, 57434, 0x0621), (57441, 57458, 0x0641), (57664, 57690, 0x05D0),
)


def _letters() -> dict[str, str]:
    """GREEK SMALL LETTER ALPHA is alpha, the capital Alpha; ARABIC LETTER BEH FINAL FORM is behfinalarabic."""
    out: dict[str, str] = {}
    for first, last, ending in SCRIPTS:
        for point in range(first, last + 1):
            name = unicodedata.name(chr(point), "")
            m = re.fullmatch(r"[A-Z]+ (CAPITAL |SMALL )?LETTER (.+?)(?: (FINAL|INITIAL|MEDIAL|ISOLATED) FORM)?", name)
            if m is None or (m[1] is None and first < 0x0460):
                continue
            stem = re.sub(" WITH | AND | ", "", m[2]).lower().replace("lamda", "lambda").replace("dialytika", "dieresis")
            if m[1] == "CAPITAL ":
                stem = stem.capitalize()
            if m[3] != "ISOLATED":
                out.setdefault(stem + (m[3] or "").lower() + ending, chr(point))
    return out


def _codec(name: str) -> dict[int, str]:
    out = {}
    for b in range(32, 256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            continue
        if unicodedata.category(c) != "Cc":
            out[b] = c
    return out


def _standard() -> dict[int, str]:
    """ASCII with the two typographic quotes; codes above it carry no text."""
    return {b: chr(b) for b in range(32, 127)} | {0x27: "’", 0x60: "‘"}


#: Byte to character of each base encoding.
BASE = {"WinAnsiEncoding": _codec("cp1252"), "MacRomanEncoding": _codec("mac_roman"), "StandardEncoding": _standard()}


LETTERS = _letters()


def _accented(name: str) -> str | None:
    for n in range(len(name) - 1, 0, -1):
        base = name[:n] if n == 1 else LETTERS.get(name[:n])
        if name[n:] in ACCENTS and base and base.isalpha() and base.isascii() == (n == 1):
            comma = name[n:] == "commaaccent" and base in "Ss"
            c = unicodedata.normalize("NFC", base + ("\u0326" if comma else ACCENTS[name[n:]]))
            if len(c) == 1:
                return c
    return None


def _component(name: str) -> str | None:
    known = NAMED.get(name) or SIGNS.get(name) or LETTERS.get(name)
    if known:
        return known
    if len(name) == 1 and name.isascii() and name.isalpha():
        return name
    if (c := _accented(name)) is not None:
        return c
    if name.startswith("uni"):
        units = name[3:].replace("uni", "")
        if re.fullmatch("(?:[0-9A-Fa-f]{4})+", units):  # UTF-16, so pairs of surrogates are one character
            return bytes.fromhex(units).decode("utf-16-be", "replace")
    if m := re.fullmatch(r"u([0-9A-Fa-f]{4,6})", name):
        p = int(m[1], 16)
        return None if p > 0x10FFFF or 0xD800 <= p <= 0xDFFF else chr(p)
    if m := re.fullmatch(r"afii([0-9]{5})", name):
        return next((chr(point + int(m[1]) - first) for first, last, point in AFII if first <= int(m[1]) <= last), None)
    return None


def glyph_name_text(name: str | None) -> str | None:
    """The text of a glyph name: what stands before the first dot, parts joined by ``_``; None if
    any part is unknown."""
    if not name:
        return None
    stem = name.split(".")[0]
    parts = [_component(p) for p in stem.split("_")] if stem else [None]
    return None if None in parts else "".join(parts)


class Encoding:
    def __init__(self, base: str | None, differences: list[tuple[int, str]]) -> None:
        self.base = BASE.get(base or "", BASE["StandardEncoding"] if base == "PDFDocEncoding" else {})
        self.names = dict(differences)

    def __len__(self) -> int:
        return len(self.base) + len(self.names)

    def get(self, code: int) -> str | None:
        """A difference counts even where its name is unknown; codes over 255 have nothing."""
        if code in self.names:
            return glyph_name_text(self.names[code])
        return self.base.get(code)
