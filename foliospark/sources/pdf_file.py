"""The object graph of a PDF file: cross-reference tables and streams, object streams, and a
scan of the whole file where these are broken. Encrypted files are read if they open without a password."""

from __future__ import annotations

import re
from typing import Any

from foliospark.sources.pdf_crypt import Crypt
from foliospark.sources.pdf_filters import ABBREVIATIONS, decode
from foliospark.sources.pdf_syntax import Keyword, PdfError, Reader, Ref, Stream, at_end

_OBJECT = re.compile(rb"(?<![0-9])(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj\b")


class Locked(PdfError):
    """An encrypted file that doesn't open without a password."""


class PdfFile:
    def __init__(self, data: bytes) -> None:
        if b"%PDF-" not in data[:1024]:
            raise PdfError("no PDF header")
        self.data = data
        #: Object number to an offset, or (object stream, index).
        self.places: dict[int, int | tuple[int, int]] = {}
        self.trailer: dict = {}
        #: Whether the tables were of no use and the objects were found by a scan.
        self.repaired = False
        self._objects: dict[int, Any] = {}
        self._packed: dict[int, list] = {}
        self._crypt: Crypt | None = None
        try:
            self._read_tables()
            self._unlock()
        except Locked:
            raise
        except (PdfError, ValueError, IndexError, KeyError, TypeError, AttributeError):
            self.places, self.trailer = {}, {}
        if "Root" not in self.trailer or not isinstance(self.get(self.trailer["Root"]), dict):
            self.repaired = True
            self._scan()
            if self._unlock():
                self._scan()
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            raise PdfError("no document catalog")

    def _unlock(self) -> bool:
        """Whether the file turns out to be encrypted; what was read of it is forgotten then."""
        if "Encrypt" not in self.trailer or self._crypt:
            return False
        d = self.get(self.trailer["Encrypt"])
        if not isinstance(d, dict):
            raise Locked("the file is encrypted")
        d = {k: self.get(v) for k, v in d.items()}
        d["CF"] = {k: self.get(v) for k, v in d["CF"].items()} if isinstance(d.get("CF"), dict) else {}
        ids = self.get(self.trailer.get("ID"))
        first = self.get(ids[0]) if isinstance(ids, list) and ids else b""
        try:
            self._crypt = Crypt(d, first if isinstance(first, bytes) else b"")
        except (PdfError, ValueError, IndexError, TypeError) as e:
            raise Locked(str(e)) from e
        own = self.trailer["Encrypt"]
        self._objects = {own.number: d} if isinstance(own, Ref) else {}
        self._packed = {}
        return True

    def get(self, x: Any) -> Any:
        """The object itself, references followed."""
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            x = self._load(x.number)
        return None

    def _load(self, number: int) -> Any:
        if number not in self._objects:
            self._objects[number] = None
            place = self.places.get(number)
            if isinstance(place, tuple):
                self._objects[number] = self._unpacked(place[0], number)
            elif place is not None:
                self._objects[number] = self._object_at(place, number)
        return self._objects[number]

    def _object_at(self, offset: int, number: int | None = None) -> Any:
        m = _OBJECT.match(self.data, Reader(self.data, offset).at)
        if m is None:
            m = _OBJECT.search(self.data, max(0, offset - 16), offset + 64)
        if m is None or (number is not None and int(m[1]) != number):
            return None
        r = Reader(self.data, m.end())
        value = r.next()
        if isinstance(value, Keyword) or value is at_end:
            return None
        if isinstance(value, dict):
            r.skip()
            if self.data.startswith(b"stream", r.at):
                value = Stream(value, self._stream_bytes(value, r.at + 6))
        return self._crypt.opened(value, int(m[1]), int(m[2])) if self._crypt else value

    def _stream_bytes(self, info: dict, at: int) -> bytes:
        if self.data.startswith(b"\r\n", at):
            at += 2
        elif self.data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        n = self.get(info.get("Length"))
        if isinstance(n, int) and n >= 0 and re.match(rb"[\x00\t\n\x0c\r ]*endstream", self.data[at + n : at + n + 24]):
            return self.data[at : at + n]
        end = self.data.find(b"endstream", at)
        raw = self.data[at : end if end >= 0 else len(self.data)]
        return raw[:-2] if raw.endswith(b"\r\n") else raw[:-1] if raw[-1:] in (b"\n", b"\r") else raw

    def _unpacked(self, holder: int, number: int) -> Any:
        if holder not in self._packed:
            stream = self._load(holder)
            self._packed[holder] = []
            if isinstance(stream, Stream):
                body = self.stream_data(stream)
                first, count = int(self.get(stream.info["First"])), int(self.get(stream.info["N"]))
                head = Reader(body[:first], references=False)
                pairs = [(head.next(), head.next()) for _ in range(count)]
                self._packed[holder] = [(n, Reader(body, first + o).next()) for n, o in pairs if isinstance(n, int) and isinstance(o, int)]
        return next((v for n, v in self._packed[holder] if n == number), None)

    def filters(self, info: dict) -> tuple[list[str], list[dict]]:
        names = self.get(info.get("Filter", info.get("F")))
        names = [self.get(n) for n in names] if isinstance(names, list) else [names] if names is not None else []
        params = self.get(info.get("DecodeParms", info.get("DP")))
        params = [self.get(p) for p in params] if isinstance(params, list) else [params]
        params = [({k: self.get(v) for k, v in p.items()} if isinstance(p, dict) else {}) for p in params] + [{}] * len(names)
        return [ABBREVIATIONS.get(str(n), str(n)) for n in names], params[: len(names)]

    def stream_data(self, stream: Stream) -> bytes:
        return decode(stream.raw, *self.filters(stream.info))

    def _read_tables(self) -> None:
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise PdfError("no startxref")
        todo, seen = [Reader(self.data, at + 9).next()], set()
        while todo:
            offset = todo.pop(0)
            if not isinstance(offset, int) or offset in seen or not 0 <= offset < len(self.data):
                continue
            seen.add(offset)
            r = Reader(self.data, offset)
            r.skip()
            trailer = self._table(r) if self.data.startswith(b"xref", r.at) else self._table_stream(r.at)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            todo += [trailer.get("XRefStm"), trailer.get("Prev")]

    def _table(self, r: Reader) -> dict:
        r.at += 4
        r.references = False
        while True:
            first = r.next()
            if first == "trailer":
                r.references = True
                trailer = r.next()
                return trailer if isinstance(trailer, dict) else {}
            count = r.next()
            if not isinstance(first, int) or not isinstance(count, int):
                raise PdfError("bad cross-reference table")
            for number in range(first, first + count):
                offset, _, use = r.next(), r.next(), r.next()
                if use == "n":
                    self.places.setdefault(number, offset)

    def _table_stream(self, at: int) -> dict:
        stream = self._object_at(at)
        if not isinstance(stream, Stream):
            raise PdfError("bad cross-reference stream")
        info, body = stream.info, self.stream_data(stream)
        w = [int(x) for x in info["W"]]
        index = info.get("Index") or [0, info["Size"]]
        at = 0
        for first, count in zip(index[::2], index[1::2], strict=True):
            for number in range(first, first + count):
                fields = []
                for n in w:
                    fields.append(int.from_bytes(body[at : at + n], "big"))
                    at += n
                kind = fields[0] if w[0] else 1
                if kind == 1:
                    self.places.setdefault(number, fields[1])
                elif kind == 2:
                    self.places.setdefault(number, (fields[1], fields[2]))
        return info

    def _scan(self) -> None:
        """Finds objects by their headers; later ones win."""
        self._objects.clear()
        self.places = {int(m[1]): m.start() for m in _OBJECT.finditer(self.data)}
        for number in list(self.places):
            stream = self._load(number)
            if isinstance(stream, Stream) and stream.info.get("Type") == "ObjStm":
                self._unpacked(number, -1)
                for n, _ in self._packed[number]:
                    self.places.setdefault(n, (number, 0))
            if isinstance(stream, Stream) and stream.info.get("Type") == "XRef":
                self.trailer |= {k: v for k, v in stream.info.items() if k in ("Root", "Encrypt", "Info", "ID")}
        for m in re.finditer(rb"trailer", self.data):
            found = Reader(self.data, m.end()).next()
            if isinstance(found, dict):
                self.trailer |= found
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            for number in self.places:
                x = self._load(number)
                if isinstance(x, dict) and x.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(number, 0)
