"""ToUnicode character maps: code to string, single codes and unexpanded ranges."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(rb"%[^\n]*|<<|>>|<(?P<hex>[^>]*)>?|(?P<open>\[)|(?P<close>\])|(?P<paren>\()|(?P<word>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|.", re.DOTALL)


def utf16(data: bytes) -> str:
    """UTF-16BE; lone surrogates become U+FFFD, an odd last byte goes."""
    return data[: len(data) // 2 * 2].decode("utf-16-be", "replace")


def _code(data: bytes) -> int:
    return int.from_bytes(data[:4], "big")


def _tokens(data: bytes):
    at = 0
    while m := _TOKEN.match(data, at):
        at = m.end()
        if m["hex"] is not None:
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", m["hex"])
            yield bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif m["open"] or m["close"]:
            yield m[0].decode()
        elif m["word"]:
            yield m["word"].decode("utf-8", "replace")
        elif m["paren"]:  # a string: skipped, nested and escaped parentheses too
            depth = 1
            while depth and at < len(data):
                c = data[at : at + 1]
                at += 2 if c == b"\\" else 1
                depth += (c == b"(") - (c == b")")


@dataclass
class CMap:
    single: dict[int, str] = field(default_factory=dict)
    #: (first, last, text of the first) or (first, last, list of texts), in file order.
    ranges: list[tuple[int, int, str | list[str]]] = field(default_factory=list)
    code_bytes: int = 2

    def __len__(self) -> int:
        return len(self.single) + sum(max(hi - lo, 0) + 1 for lo, hi, _ in self.ranges)

    def get(self, code: int) -> str | None:
        if code in self.single:
            return self.single[code]
        for lo, hi, text in self.ranges:
            if lo <= code <= hi:
                if isinstance(text, str):
                    return bump_last(text, code - lo)
                if code - lo < len(text):
                    return text[code - lo]
        return None


def bump_last(text: str, by: int) -> str:
    """The text with its last character moved on; unchanged where no such character exists."""
    if not text:
        return text
    point = ord(text[-1]) + by
    return text if point > 0x10FFFF or 0xD800 <= point <= 0xDFFF else text[:-1] + chr(point)


def parse_cmap(data: bytes) -> CMap:
    out, section = CMap(), None
    pending: list = []
    listed: list[str] | None = None
    for t in _tokens(data):
        if isinstance(t, str) and t not in "[]":
            if t.startswith("begin"):
                section, pending, listed = t[5:], [], None
            elif t.startswith("end"):
                section = None
            else:
                pending = []
            continue
        if section == "codespacerange" and isinstance(t, bytes):
            out.code_bytes = len(t) if 1 <= len(t) <= 2 else out.code_bytes
        elif section == "bfchar" and isinstance(t, bytes):
            pending.append(t)
            if len(pending) == 2:
                out.single[_code(pending[0])] = utf16(pending[1])
                pending = []
        elif section == "bfchar":
            pending = []
        elif section == "bfrange":
            if listed is not None:
                if t == "]":
                    out.ranges.append((_code(pending[0]), _code(pending[1]), listed))
                    pending, listed = [], None
                elif isinstance(t, bytes):
                    listed.append(utf16(t))
            elif t == "[":
                if len(pending) == 2:
                    listed = []
                else:
                    pending = []
            elif isinstance(t, bytes):
                pending.append(t)
                if len(pending) == 3:
                    out.ranges.append((_code(pending[0]), _code(pending[1]), utf16(pending[2])))
                    pending = []
    return out
