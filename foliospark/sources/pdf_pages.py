"""What the layout engine needs of a PDF file: pages, fonts, forms, images, structure."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, NamedTuple

from foliospark.sources.pdf_file import PdfFile
from foliospark.sources.pdf_filters import IMAGE_FILTERS
from foliospark.sources.pdf_syntax import Name, PdfError, Ref, Stream

A4 = (0.0, 0.0, 595.276, 841.89)
MAX_PARENTS, MAX_FORMS, MAX_STRUCTURE = 64, 8, 64
_IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class PageInfo(NamedTuple):
    number: int
    box: tuple[float, float, float, float]
    rotation: int


@dataclass
class RawFont:
    name: str
    subtype: str
    base_font: str | None = None
    encoding_name: str | None = None
    route: str = "none"
    to_unicode: bytes | None = None
    first_char: int = 0
    widths: list[float] = field(default_factory=list)
    missing_width: float = 0.0
    default_width: float = 1000.0
    cid_widths: list[tuple[int, int, float]] = field(default_factory=list)
    base_encoding: str | None = None
    differences: list[tuple[int, str]] = field(default_factory=list)
    cff: bytes | None = None
    truetype: bytes | None = None
    cid_to_gid: bytes | None = None

    @property
    def two_byte(self) -> bool:
        return self.subtype == "Type0"


class RawForm(NamedTuple):
    name: str
    content: bytes
    matrix: tuple[float, ...]


class RawImage(NamedTuple):
    name: str
    width: int
    height: int
    bits: int
    space: str
    palette: tuple[str, bytes] | None
    filters: list[str]
    data: bytes
    has_mask: bool


class Element(NamedTuple):
    tag: str
    depth: int
    page: int | None
    mcids: list[int]


def flatten_differences(items: list) -> list[tuple[int, str]]:
    """Codes and names from ``[code name name ... code name ...]``; codes over 255 only count."""
    out, code = [], 0
    for x in items:
        if isinstance(x, Name):
            if code <= 255:
                out.append((code, str(x)))
            code += 1
        elif isinstance(x, (int, float)) and not isinstance(x, bool):
            code = max(0, int(x))
    return out


def cid_width_ranges(items: list) -> list[tuple[int, int, float]]:
    """(first, last, width) from both forms of a W array; what is no number ends it."""
    out, i = [], 0
    while i < len(items) and _is_number(items[i]):
        first = max(0, int(items[i]))
        follow = items[i + 1] if i + 1 < len(items) else None
        if isinstance(follow, list):
            out += [(first + k, first + k, float(w)) for k, w in enumerate(follow) if _is_number(w) and first + k < 1 << 32]
            i += 2
            continue
        if follow is None:
            break
        width = items[i + 2] if i + 2 < len(items) else None
        if _is_number(follow) and _is_number(width):
            out.append((first, max(0, int(follow)), float(width)))
        i += 3
    return out


#: Color space names of images, by the space that they count as.
IMAGE_SPACES = {
    "DeviceGray": "gray", "G": "gray", "CalGray": "gray", "DeviceRGB": "rgb", "RGB": "rgb", "CalRGB": "rgb",
    "DeviceCMYK": "cmyk", "CMYK": "cmyk", "Indexed": "indexed", "I": "indexed",
}
COMPONENTS = {"gray": 1, "rgb": 3, "cmyk": 4}


def _is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


class PdfPages:
    """Reads pages of one file; ``pages`` is in document order."""

    def __init__(self, data: bytes) -> None:
        self.file = PdfFile(data)
        self._nodes: list[dict] = []
        self._number: dict[int, int] = {}
        root = self.file.get(self.file.trailer["Root"])
        self._walk(root.get("Pages"), set(), 0)
        if self.file.repaired and not self._nodes:
            raise PdfError("a damaged file without pages")
        self.pages = [self._info(i) for i in range(len(self._nodes))]
        self.catalog = root

    def _get(self, holder: Any, key: str) -> Any:
        return self.file.get(holder.get(key)) if isinstance(holder, dict) else None

    def _walk(self, ref: Any, seen: set, depth: int) -> None:
        if isinstance(ref, Ref):
            if ref.number in seen:
                return
            seen.add(ref.number)
        node = self.file.get(ref)
        if not isinstance(node, dict) or depth > MAX_PARENTS:
            return
        kids = self._get(node, "Kids")
        if isinstance(kids, list) and node.get("Type") != "Page":
            for k in kids:
                self._walk(k, seen, depth + 1)
            return
        self._nodes.append(node)
        if isinstance(ref, Ref):
            self._number[ref.number] = len(self._nodes)

    def inherited(self, index: int, key: str) -> Any:
        node: Any = self._nodes[index]
        for _ in range(MAX_PARENTS):
            if not isinstance(node, dict):
                return None
            if key in node:
                return self.file.get(node[key])
            node = self._get(node, "Parent")
        return None

    def _info(self, index: int) -> PageInfo:
        box = self.inherited(index, "MediaBox")
        box = [self.file.get(x) for x in box] if isinstance(box, list) else []
        if len(box) == 4 and all(map(_is_number, box)):
            x, y = sorted(map(float, box[::2])), sorted(map(float, box[1::2]))
            rect = (x[0], y[0], x[1], y[1])
        else:
            rect = A4
        turn = self.inherited(index, "Rotate")
        turn = int(turn) % 360 if _is_number(turn) else 0
        return PageInfo(index + 1, rect, turn if turn % 90 == 0 else 0)

    def content(self, index: int) -> bytes:
        parts = self._get(self._nodes[index], "Contents")
        parts = parts if isinstance(parts, list) else [parts]
        streams = [self.file.get(p) for p in parts]
        return b"\n".join(self.file.stream_data(s) for s in streams if isinstance(s, Stream))

    def _resources(self, index: int) -> dict:
        found = self.inherited(index, "Resources")
        return found if isinstance(found, dict) else {}

    def _forms(self, resources: dict, prefix: str, depth: int, seen: set):
        """(qualified name, stream, resources) of all forms; an object counts once a page."""
        xobjects = self._get(resources, "XObject")
        if depth >= MAX_FORMS or not isinstance(xobjects, dict):
            return
        for name, value in xobjects.items():
            if isinstance(value, Ref):
                if value in seen:
                    continue
                seen.add(value)
            stream = self.file.get(value)
            if not isinstance(stream, Stream) or self._get(stream.info, "Subtype") != "Form":
                continue
            inner = self._get(stream.info, "Resources")
            inner = inner if isinstance(inner, dict) else resources
            yield prefix + name, stream, inner
            yield from self._forms(inner, f"{prefix}{name}/", depth + 1, seen)

    def forms(self, index: int) -> list[RawForm]:
        out = []
        for name, stream, _ in self._forms(self._resources(index), "", 0, set()):
            m = self._get(stream.info, "Matrix")
            m = [float(v) for v in map(self.file.get, m) if _is_number(v)] if isinstance(m, list) else []
            out.append(RawForm(name, self.file.stream_data(stream), tuple(m) if len(m) == 6 else _IDENTITY))
        return out

    def fonts(self, index: int) -> list[RawFont]:
        own = self._resources(index)
        out = self._fonts_of(own, "")
        for name, _, resources in self._forms(own, "", 0, set()):
            out += self._fonts_of(resources, name + "/")
        return out

    def _fonts_of(self, resources: dict, prefix: str) -> list[RawFont]:
        fonts = self._get(resources, "Font")
        if not isinstance(fonts, dict):
            return []
        return [self._font(prefix + name, d) for name, d in ((n, self.file.get(v)) for n, v in fonts.items()) if isinstance(d, dict)]

    def _stream_of(self, holder: Any, key: str) -> bytes | None:
        stream = self._get(holder, key)
        return self.file.stream_data(stream) if isinstance(stream, Stream) else None

    def _number_of(self, holder: Any, key: str, default: float) -> float:
        x = self._get(holder, key)
        return float(x) if _is_number(x) else default

    def _font(self, name: str, d: dict) -> RawFont:
        text = lambda key: str(x) if isinstance(x := self._get(d, key), Name) else None
        route = "to_unicode" if "ToUnicode" in d else "encoding" if "Encoding" in d else "none"
        raw = RawFont(name, text("Subtype") or "", text("BaseFont"), text("Encoding"), route, self._stream_of(d, "ToUnicode"))
        if raw.two_byte:
            kids = self._get(d, "DescendantFonts")
            child = self.file.get(kids[0]) if isinstance(kids, list) and kids else None
            if isinstance(child, dict):
                raw.default_width = self._number_of(child, "DW", 1000.0)
                w = self._get(child, "W")
                raw.cid_widths = cid_width_ranges([self._deep(x) for x in w]) if isinstance(w, list) else []
                if raw.encoding_name in ("Identity-H", "Identity-V"):
                    self._cid_program(child, raw)
            return raw
        raw.first_char = max(0, int(self._number_of(d, "FirstChar", 0)))
        widths = self._get(d, "Widths")
        raw.widths = [float(w) for w in map(self.file.get, widths) if _is_number(w)] if isinstance(widths, list) else []
        descriptor = self._get(d, "FontDescriptor")
        raw.missing_width = self._number_of(descriptor, "MissingWidth", 0.0)
        raw.cff = self._stream_of(descriptor, "FontFile3")
        encoding = self._get(d, "Encoding")
        if isinstance(encoding, dict):
            base = self._get(encoding, "BaseEncoding")
            raw.base_encoding = str(base) if isinstance(base, Name) else None
            diff = self._get(encoding, "Differences")
            raw.differences = flatten_differences([self.file.get(x) for x in diff]) if isinstance(diff, list) else []
        else:
            raw.base_encoding = raw.encoding_name
        return raw

    def _deep(self, x: Any) -> Any:
        x = self.file.get(x)
        return [self.file.get(y) for y in x] if isinstance(x, list) else x

    def _cid_program(self, child: dict, raw: RawFont) -> None:
        table = self._get(child, "CIDToGIDMap")
        if isinstance(table, Stream):
            raw.cid_to_gid = self.file.stream_data(table)
        elif table is not None and table != "Identity":
            return
        raw.truetype = self._stream_of(self._get(child, "FontDescriptor"), "FontFile2")

    def images(self, index: int) -> list[RawImage]:
        xobjects = self._get(self._resources(index), "XObject")
        out = []
        for name, value in xobjects.items() if isinstance(xobjects, dict) else ():
            stream = self.file.get(value)
            if not isinstance(stream, Stream) or self._get(stream.info, "Subtype") != "Image":
                continue
            w, h = (self._get(stream.info, k) for k in ("Width", "Height"))
            if not (isinstance(w, int) and isinstance(h, int) and w > 0 and h > 0):
                continue
            filters, _ = self.file.filters(stream.info)
            data = stream.raw if filters and filters[-1] in IMAGE_FILTERS else self.file.stream_data(stream)
            bits = self._get(stream.info, "BitsPerComponent")
            bits = min(16, max(1, bits)) if isinstance(bits, int) else 8
            space = self._get(stream.info, "ColorSpace")
            out.append(RawImage(str(name), w, h, bits, self._space(space), self._palette(space), filters, data, "SMask" in stream.info or "Mask" in stream.info))
        return out

    def _space(self, space: Any) -> str:
        if isinstance(space, list) and space and isinstance(space[0], Name):
            if space[0] == "ICCBased":
                profile = self.file.get(space[1]) if len(space) > 1 else None
                n = self._get(profile.info, "N") if isinstance(profile, Stream) else None
                return {1: "gray", 3: "rgb", 4: "cmyk"}.get(n, "other")
            space = space[0]
        return IMAGE_SPACES.get(str(space), "other") if isinstance(space, Name) else "other"

    def _palette(self, space: Any) -> tuple[str, bytes] | None:
        if not isinstance(space, list) or len(space) < 4 or space[0] not in ("Indexed", "I"):
            return None
        base = self._space(self.file.get(space[1]))
        table = self.file.get(space[3])
        table = self.file.stream_data(table) if isinstance(table, Stream) else table
        return (base, table) if base in COMPONENTS and isinstance(table, bytes) else None

    def structure(self) -> tuple[bool, list[Element]]:
        """Whether the file says that it is tagged, and its structure elements, parents first."""
        mark = self._get(self.catalog, "MarkInfo")
        marked = isinstance(mark, dict) and mark.get("Marked") is True
        root = self._get(self.catalog, "StructTreeRoot")
        out: list[Element] = []
        if isinstance(root, dict):
            roles = self._get(root, "RoleMap")
            roles = {k: str(v) for k, v in ((k, self.file.get(v)) for k, v in roles.items()) if isinstance(v, Name)} if isinstance(roles, dict) else {}
            self._elements(root, 0, None, roles, set(), out)
        return marked, out

    def _elements(self, node: dict, depth: int, page: int | None, roles: dict, seen: set, out: list[Element]) -> None:
        if depth > MAX_STRUCTURE:
            return
        on = node.get("Pg")
        page = self._number.get(on.number, page) if isinstance(on, Ref) else page
        kids = self.file.get(node.get("K"))
        mcids, children = [], []
        for kid in kids if isinstance(kids, list) else [kids]:
            if isinstance(kid, int) and not isinstance(kid, bool):
                if kid >= 0:
                    mcids.append(kid)
                continue
            if isinstance(kid, Ref):
                if kid in seen:
                    continue
                seen.add(kid)
            child = self.file.get(kid)
            if isinstance(child, dict):
                n = child.get("MCID")
                if isinstance(n, int):
                    mcids += [n] if n >= 0 else []
                else:
                    children.append(child)
        tag = node.get("S")
        if isinstance(tag, Name):
            out.append(Element(roles.get(tag, str(tag)), depth, page, mcids))
        for child in children:
            self._elements(child, depth + 1, page, roles, seen, out)
