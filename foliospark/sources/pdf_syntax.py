"""PDF syntax: objects from bytes, for files and for content streams."""

from __future__ import annotations

import re
import struct
from typing import Any, NamedTuple


class PdfError(ValueError):
    """The bytes are not a PDF file that this reader understands."""


class Name(str):
    __slots__ = ()


class Ref(NamedTuple):
    number: int
    generation: int


class Keyword(str):
    """An operator, or a word such as ``obj``."""

    __slots__ = ()


class Stream(NamedTuple):
    info: dict
    raw: bytes


_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_TOKEN = re.compile(
    rb"(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|$))"
    rb"|/(?P<name>[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)"
    rb"|(?P<open><<|\[|\(|<)|(?P<close>>>|\]|[)>{}])"
    rb"|(?P<word>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)"
)
_REF = re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|$)")
_NUMBERS = re.compile(rb"([\x00\t\n\x0c\r 0-9+.-]*)\]")
_SPACE, _NUMBER, _AFTER = rb"[\x00\t\n\x0c\r ]", rb"[+-]?(?:\d+\.?\d*+|\.\d++)", rb"(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|$)"
#: An array of numbers and hexadecimal strings, as text is shown with, and its items.
_SHOWN = re.compile(rb"(?:" + _SPACE + rb"++|<[0-9A-Fa-f]*+>|" + _NUMBER + _AFTER + rb")*+\]")
_SHOWN_ITEM = re.compile(rb"<([0-9A-Fa-f]*)>|(" + _NUMBER + rb")")
#: Numbers and an operator behind them.
_PLAIN_OPERATION = re.compile(_SPACE + rb"*+((?:" + _NUMBER + _SPACE + rb"++)*+)([A-Za-z'\"][A-Za-z0-9'\"*]*+)" + _AFTER)
_NO_OPERATORS = {b"true", b"false", b"null", b"ID", b"BI"}
_PLAIN = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
_STRING_PART = re.compile(rb"[^()\\]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_WORDS = {b"true": True, b"false": False, b"null": None}
_END = object()


def single(text: bytes) -> float:
    """A real number as files are read: rounded to 32 bits, then widened."""
    try:
        return struct.unpack("f", struct.pack("f", float(text)))[0]
    except (ValueError, OverflowError):
        return 0.0


class Reader:
    """A cursor over bytes that yields objects."""

    def __init__(self, data: bytes, at: int = 0, references: bool = True) -> None:
        self.data, self.at, self.references = data, at, references

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def next(self) -> Any:
        """The next object or Keyword; _END at the end."""
        self.skip()
        m = _TOKEN.match(self.data, self.at)
        if m is None:
            if self.at >= len(self.data):
                return _END
            self.at += 1
            return self.next()
        self.at = m.end()
        kind, text = m.lastgroup, m[m.lastgroup]
        if kind == "number":
            if b"." in text:
                return single(text)
            value = int(text)
            if self.references and value >= 0 and (r := _REF.match(self.data, self.at)):
                self.at = r.end()
                return Ref(value, int(r[1]))
            return value
        if kind == "name":
            if b"#" in text:
                text = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), text)
            return Name(text.decode("utf-8", "replace"))
        if kind == "word":
            return _WORDS[text] if text in _WORDS else Keyword(text.decode("latin-1"))
        if kind == "close":
            return Keyword(text.decode("latin-1"))
        if text == b"(":
            return self._string()
        if text == b"<":
            end = self.data.find(b">", self.at)
            end = len(self.data) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return self._many(">>" if text == b"<<" else "]")

    def _many(self, close: str) -> Any:
        items = []
        if close == "]" and (m := _NUMBERS.match(self.data, self.at)):  # only numbers, as widths are
            parts = m[1].replace(b"\x00", b" ").split()
            if all(map(_PLAIN.match, parts)):
                self.at = m.end()
                return [single(p) if b"." in p else int(p) for p in parts]
        if close == "]" and not self.references and (m := _SHOWN.match(self.data, self.at)):
            found = _SHOWN_ITEM.findall(self.data, self.at, m.end())
            self.at = m.end()
            return [(single(n) if b"." in n else int(n)) if n else bytes.fromhex((h + b"0" * (len(h) % 2)).decode()) for h, n in found]
        while (x := self.next()) is not _END:
            if isinstance(x, Keyword):
                if x == close:
                    break
                if x in ("endobj", "stream", "endstream"):
                    self.at -= len(x)
                    break
                continue
            items.append(x)
        if close == "]":
            return items
        return {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}

    def _string(self) -> bytes:
        out, depth, data = [], 1, self.data
        while self.at < len(data):
            if m := _STRING_PART.match(data, self.at):
                out.append(m[0])
                self.at = m.end()
                continue
            c = data[self.at : self.at + 1]
            self.at += 1
            if c == b"(":
                depth += 1
            elif c == b")":
                depth -= 1
                if not depth:
                    break
            else:
                c = data[self.at : self.at + 1]
                self.at += 1
                if c in _ESCAPES:
                    c = _ESCAPES[c]
                elif c in (b"\r", b"\n"):
                    if c == b"\r" and data[self.at : self.at + 1] == b"\n":
                        self.at += 1
                    c = b""
                elif m := re.match(rb"[0-7]{1,3}", data[self.at - 1 : self.at + 2]):
                    self.at += len(m[0]) - 1
                    c = bytes([int(m[0], 8) & 255])
            out.append(c)
        return b"".join(out)


def operations(content: bytes):
    """(operator, operands) of a content stream; inline images are passed over."""
    r = Reader(content, references=False)
    operands: list = []
    while True:
        if not operands and (m := _PLAIN_OPERATION.match(content, r.at)) and m[2] not in _NO_OPERATORS:
            r.at = m.end()
            yield m[2].decode("latin-1"), [single(p) if b"." in p else int(p) for p in m[1].replace(b"\x00", b" ").split()]
            continue
        x = r.next()
        if x is _END:
            return
        if not isinstance(x, Keyword):
            operands.append(x)
            continue
        if x == "ID":
            m = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").search(content, r.at)
            r.at = m.end() if m else len(content)
            operands = []
            continue
        yield str(x), operands
        operands = []


at_end = _END
