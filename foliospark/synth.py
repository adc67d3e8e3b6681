"""Deterministic inputs made from the driver's tables: a small PDF writer."""

from __future__ import annotations

import zlib


class PdfWriter:
    """Objects of one file, numbered from 1 in the order of adding."""

    def __init__(self) -> None:
        self.objects: list[bytes] = []

    def add(self, body: bytes | str) -> int:
        self.objects.append(body if isinstance(body, bytes) else body.encode("latin-1"))
        return len(self.objects)

    def reserve(self) -> int:
        return self.add(b"null")

    def set(self, number: int, body: bytes | str) -> None:
        self.objects[number - 1] = body if isinstance(body, bytes) else body.encode("latin-1")

    def stream(self, data: bytes, extra: str = "", compress: bool = True) -> int:
        if compress:
            data, extra = zlib.compress(data, 6), extra + "/Filter/FlateDecode"
        return self.add(f"<</Length {len(data)}{extra}>>stream\n".encode("latin-1") + data + b"\nendstream")

    def file(self, root: int, extra: str = "") -> bytes:
        out, offsets = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
        for number, body in enumerate(self.objects, 1):
            offsets.append(len(out))
            out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
        at = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(offsets) + 1)
        out += b"".join(b"%010d 00000 n \n" % o for o in offsets)
        out += b"trailer\n<</Size %d/Root %d 0 R%s>>\nstartxref\n%d\n%%%%EOF\n" % (len(offsets) + 1, root, extra.encode("latin-1"), at)
        return bytes(out)


def literal(data: bytes) -> bytes:
    return b"(" + data.replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)").replace(b"\r", rb"\r") + b")"


def simple_pdf(pages: list[dict]) -> bytes:
    """Pages of {content, box, rotate, fonts: {name: dict body}, xobjects: {name: (dict body, data)}};
    all but content may be missing."""
    w = PdfWriter()
    catalog, tree = w.reserve(), w.reserve()
    shared: dict[str, int] = {}
    kids = []
    for p in pages:
        fonts = p.get("fonts", {"F1": "<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding/FirstChar 0/Widths[" + "500 " * 256 + "]>>"})
        refs = "".join(f"/{n} {shared.setdefault(body, 0) or shared.__setitem__(body, w.add(body)) or shared[body]} 0 R" for n, body in fonts.items())
        objects = "".join(f"/{n} {w.stream(data, body)} 0 R" for n, (body, data) in p.get("xobjects", {}).items())
        content = w.stream(p["content"])
        box = " ".join(map(str, p.get("box", (0, 0, 612, 842))))
        kids.append(w.add(f"<</Type/Page/Parent {tree} 0 R/MediaBox[{box}]/Rotate {p.get('rotate', 0)}/Contents {content} 0 R/Resources<</Font<<{refs}>>/XObject<<{objects}>>>>>>"))
    w.set(tree, f"<</Type/Pages/Count {len(kids)}/Kids[{' '.join(f'{k} 0 R' for k in kids)}]>>")
    w.set(catalog, f"<</Type/Catalog/Pages {tree} 0 R>>")
    return w.file(catalog)


LINES_PER_PAGE, SIZE, LEADING, TOP = 60, 12, 13, 800


def document_pdf(doc_id: int, text: str) -> bytes:
    """A file with a painted line for each line of the text that isn't blank, and one defect by
    doc_id: no text layer (% 10), invisible text (% 7), a code without a meaning (% 11)."""
    lines = [x for x in text.split("\n") if x.strip(" ")]
    parts = [lines[i : i + LINES_PER_PAGE] for i in range(0, len(lines), LINES_PER_PAGE)] or [[]]
    pages = []
    for part in parts:
        if doc_id % 10 == 0:
            image = ("/Type/XObject/Subtype/Image/Width 1/Height 1/BitsPerComponent 8/ColorSpace/DeviceGray", b"\x80")
            pages.append({"content": b"q 612 0 0 842 0 0 cm /Im0 Do Q", "xobjects": {"Im0": image}})
            continue
        body = [b"BT /F1 %d Tf %d Tr" % (SIZE, 3 if doc_id % 7 == 0 else 0)]
        for i, line in enumerate(part):
            shown = line.encode("cp1252", "replace")
            if doc_id % 7 and doc_id % 11 == 0 and i == len(part) - 1:
                shown = shown[:-1] + b"\x81"
            body.append(b"1 0 0 1 0 %d Tm %s Tj" % (TOP - LEADING * i, literal(shown)))
        pages.append({"content": b"\n".join([*body, b"ET"])})
    return simple_pdf(pages)
