"""Character classes and the text repairs that follow reordering."""

from __future__ import annotations

import re
from unicodedata import normalize

#: Unicode White_Space, which is narrower than str.isspace.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Combining marks that ride on a base: general, Arabic, and their spacing presentation forms.
MARKS = "\\u0300-\\u036f\\u064b-\\u065f\\u0670\\u06d6-\\u06ed\\u08d3-\\u08ff\\ufe70-\\ufe7f"
FORMS = "\\ufb50-\\ufdff\\ufe70-\\ufeff"
ARABIC = "\\u0600-\\u06ff\\u0750-\\u077f\\ufb50-\\ufeff"
LOST = "\ufffd"
_white, _all_white = re.compile(f"[{WHITE}]+"), re.compile(f"[{WHITE}]+")
_marks = re.compile(f" *[{MARKS}]+")
_stranded = re.compile(f" (?=[{MARKS}])")
_bar = re.compile("\u0640+")
_digits = re.compile("[0-9\u0660-\u0669\u06f0-\u06f9]+")
_ZEROS = (0x30, 0x660, 0x6F0)


def all_white(text: str) -> bool:
    return _all_white.fullmatch(text) is not None


def is_mark(text: str) -> bool:
    """Whether a glyph's text is only marks, spaces that carry them apart."""
    return bool(text) and _marks.fullmatch(text if text.isascii() else normalize("NFKC", text)) is not None


def tidy(text: str) -> str:
    return _white.sub(" ", text).strip(" ")


def drop_mark_bases(text: str) -> str:
    """Without the spaces that stand directly before a mark."""
    return text if text.isascii() else _stranded.sub("", text)


def _arabic_letter(c: str) -> bool:
    return c.isalpha() and re.match(f"[{ARABIC}]", c) is not None


def drop_joins(text: str) -> str:
    """Without the bars that stretch a join between two Arabic letters; other bars stay."""

    def keep(m: re.Match) -> str:
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        stretched = before and after and _arabic_letter(before) and _arabic_letter(after)
        return "" if stretched else m[0]

    return _bar.sub(keep, text) if "\u0640" in text else text


def _system(c: str) -> int:
    return next(k for k, zero in enumerate(_ZEROS) if 0 <= ord(c) - zero <= 9)


def unify_digits(text: str) -> str:
    """Each run of digits of mixed scripts in the script that leads in it."""

    def one_script(m: re.Match) -> str:
        systems = [_system(c) for c in m[0]]
        latin, arabic, extended = (systems.count(k) for k in range(3))
        if max(latin, arabic, extended) == len(systems):
            return m[0]
        to = 1 if arabic > latin and arabic >= extended else 2 if extended > latin and extended > arabic else 0
        return "".join(chr(_ZEROS[to] + ord(c) - _ZEROS[s]) for c, s in zip(m[0], systems, strict=True))

    return text if text.isascii() else _digits.sub(one_script, text)


def composed_base(text: str) -> str | None:
    """The base letter of a single composed letter of one base and one mark."""
    if len(text) != 1:
        return None
    parts = normalize("NFD", text)
    return parts[0] if len(parts) == 2 and re.match(f"[{MARKS}]", parts[1]) and parts[0] != text else None


def merge_composed(host: str, base: str, composed: str) -> str | None:
    """The host with its only ``base`` composed; None where there is no one such letter."""
    if composed in host:
        return host
    return host.replace(base, composed) if host.count(base) == 1 else None


def finish(text: str) -> str:
    """Normalisation and tidying of logical text."""
    text = text if text.isascii() else normalize("NFKC", text)
    return tidy(drop_mark_bases(drop_joins(text)))
