"""One document in hand: a thin facade over the extraction tables of a single file.

    doc = Document("report.pdf")
    doc.text, doc.page(5).tables[0].to_rows(), doc.to_html()

For corpora use the tables themselves (foliospark.operators); this collects one file's pages.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import columns as C
from foliospark.operators import detect, document, extract, render
from foliospark.sources.pdf_syntax import PdfError


class DocumentError(PdfError):
    """The file is there but can't be read as a PDF."""


def _preview(text: str, n: int = 30) -> str:
    return repr(text if len(text) <= n else text[:n] + "…")


def _box(r: Row) -> tuple[float, float, float, float] | None:
    return (r["x0"], r["y0"], r["x1"], r["y1"]) if r["x0"] is not None else None


@dataclass(frozen=True)
class Line:
    text: str
    baseline: float
    direction: str
    font: str
    size: float
    color: str
    confidence: float
    bbox: tuple[float, float, float, float]

    def __str__(self) -> str:
        return self.text

    def __repr__(self) -> str:
        return f"<Line {self.size:.1f}pt {_preview(self.text)}>"


@dataclass(frozen=True)
class TextBlock:
    reading_index: int
    bbox: tuple[float, float, float, float]
    confidence: float
    lines: tuple[Line, ...]
    kind: str = "text"

    @property
    def text(self) -> str:
        return "\n".join(x.text for x in self.lines)

    def __str__(self) -> str:
        return self.text

    def __repr__(self) -> str:
        return f"<TextBlock {self.reading_index} {len(self.lines)} line(s) {_preview(self.text)}>"


@dataclass(frozen=True)
class Cell:
    text: str
    row: int
    column: int
    bbox: tuple[float, float, float, float]

    def __str__(self) -> str:
        return self.text

    def __repr__(self) -> str:
        return f"<Cell r{self.row} c{self.column} {self.text!r}>"


@dataclass(frozen=True)
class TableBlock:
    reading_index: int
    bbox: tuple[float, float, float, float]
    confidence: float
    rows: tuple[tuple[Cell, ...], ...]
    kind: str = "table"

    @property
    def row_count(self) -> int:
        return len(self.rows)

    @property
    def column_count(self) -> int:
        return len(self.rows[0]) if self.rows else 0

    @property
    def text(self) -> str:
        return "\n".join("\t".join(r) for r in self.to_rows())

    def to_rows(self) -> list[list[str]]:
        return [[c.text for c in r] for r in self.rows]

    def __repr__(self) -> str:
        return f"<TableBlock {self.reading_index} {self.row_count}x{self.column_count}>"


@dataclass(frozen=True)
class ImageBlock:
    reading_index: int
    bbox: tuple[float, float, float, float] | None
    name: str
    width: int
    height: int
    format: str | None
    data: bytes | None
    unsupported_reason: str | None
    is_background: bool
    dropped_transparency: bool
    kind: str = "image"
    text: str = ""

    @property
    def file_name(self) -> str:
        return f"{self.name}.{self.format}"

    def save(self, path: str | os.PathLike) -> None:
        if self.data is None:
            raise ValueError(f"image {self.name} was not decoded: {self.unsupported_reason}")
        with open(path, "wb") as f:
            f.write(self.data)

    def __repr__(self) -> str:
        what = f"{self.file_name} {self.width}x{self.height}" if self.data is not None else f"not decoded: {self.unsupported_reason}"
        return f"<ImageBlock {self.reading_index} {what}>"


class Page:
    def __init__(self, row: Row) -> None:
        self.number: int = row["page"]
        box = row["box"]
        self.width, self.height = box["x1"] - box["x0"], box["y1"] - box["y0"]
        self.rotation: int = row["rotation"]
        self.tagged: bool = row["tagged"]
        self.verdict: str = row["verdict"]
        self.confidence: float = row["confidence"]
        self.reasons: list[str] = list(row["reasons"])
        self.lines = [_line(r) for r in row["told_lines"]]
        self.blocks = [_block(b, [x for x, r in zip(self.lines, row["told_lines"], strict=True) if r["block"] == b["seq"]]) for b in row["blocks"]]

    @property
    def needs_ocr(self) -> bool:
        return self.verdict == "needs_ocr"

    @property
    def text(self) -> str:
        return "\n".join(b.text for b in self.blocks if b.text)

    @property
    def images(self) -> list[ImageBlock]:
        return [b for b in self.blocks if b.kind == "image"]

    @property
    def tables(self) -> list[TableBlock]:
        return [b for b in self.blocks if b.kind == "table"]

    def __str__(self) -> str:
        return self.text

    def __repr__(self) -> str:
        return f"<Page {self.number} {self.verdict} confidence={self.confidence:.2f} {len(self.blocks)} block(s)>"


def _line(r: Row) -> Line:
    rate = 1 - r["unresolved"] / r["glyphs"] if r["glyphs"] else 1.0
    return Line(r["text"], r["baseline"], "rtl" if r["rtl"] else "ltr", r["font"], r["size"], r["css"], rate, _box(r))


def _block(b: Row, lines: list[Line]):
    if b["kind"] == "text":
        return TextBlock(b["seq"], _box(b), b["confidence"], tuple(lines))
    if b["kind"] == "table":
        rows = tuple(tuple(Cell(c["text"], i, k, _box(c)) for k, c in enumerate(row)) for i, row in enumerate(b["cells"]))
        return TableBlock(b["seq"], _box(b), b["confidence"], rows)
    p = b["picture"]
    data = bytes(p["data"]) if p["data"] is not None else None
    return ImageBlock(b["seq"], _box(b), p["name"], p["width"], p["height"], p["format"], data, p["reason"], p["background"], p["lost_mask"])


class Document:
    """All pages of one file, extracted when it is opened."""

    def __init__(self, path: str | os.PathLike, spark: SparkSession | None = None) -> None:
        self.path = os.fspath(path)
        with open(self.path, "rb") as f:  # missing and forbidden files fail as such
            content = f.read()
        self.spark = spark or SparkSession.builder.getOrCreate()
        pages = extract.extract(self.spark.createDataFrame([(self.path, bytearray(content))], "doc_id string, content binary"))
        self._judged: DataFrame = pages.persist()
        failed = pages.where("error IS NOT NULL").select("error").first()
        if failed:
            raise DocumentError(f"{self.path}: {failed['error']}")
        self._table = detect.judged(self._judged)
        told = F.transform("lines", lambda x: x.withField("css", C.css_hex(C.rgb8(x["color"]["space"], x["color"]["parts"]))))
        self.pages = [Page(r) for r in self._table.withColumn("told_lines", told).orderBy("page").collect()]

    @property
    def page_count(self) -> int:
        return len(self.pages)

    @property
    def text(self) -> str:
        return "\n\n".join(p.text for p in self.pages if not p.needs_ocr and p.text)

    @property
    def confidence(self) -> float:
        return sum(p.confidence for p in self.pages) / len(self.pages) if self.pages else 0.0

    @property
    def pages_needing_ocr(self) -> list[int]:
        return [p.number for p in self.pages if p.needs_ocr]

    @property
    def tagged_pages(self) -> list[int]:
        return [p.number for p in self.pages if p.tagged]

    @property
    def images(self) -> list[tuple[int, ImageBlock]]:
        return [(p.number, b) for p in self.pages for b in p.images]

    @property
    def text_blocks(self) -> list[TextBlock]:
        return [b for p in self.pages for b in p.blocks if b.kind == "text"]

    def page(self, number: int) -> Page:
        for p in self.pages:
            if p.number == number:
                return p
        raise IndexError(f"no page {number} in {self.path}")

    def heading_sizes(self) -> list[tuple[float, int]]:
        rows = render.heading_levels(extract.lines_of(self._judged)).orderBy(F.desc("size")).collect()
        return [(r["size"], r["level"]) for r in rows]

    def to_html(self, *, include_images: bool = True, include_color: bool = True, title: str = "Extracted document") -> str:
        row = render.document_html(self._table, title, include_images, include_color).first()
        return row["html"] if row else ""

    def to_json(self) -> str:
        row = render.document_json(self._table).first()
        return row["json"] if row else '{"page_count": 0, "pages": []}'

    def __len__(self) -> int:
        return len(self.pages)

    def __iter__(self):
        return iter(self.pages)

    def __repr__(self) -> str:
        return f"<Document {self.path!r} {len(self)} page(s) confidence={self.confidence:.2f}>"


def extract_text(path: str | os.PathLike, spark: SparkSession | None = None) -> str:
    return Document(path, spark).text


def golden(doc: Document) -> str:
    """Pages with their verdicts, reasons and texts, for comparison with a stored run."""
    out = []
    for p in doc.pages:
        out.append(f"# page {p.number} [{p.verdict}] confidence={p.confidence:.2f}")
        out += [f"# ! {r}" for r in p.reasons]
        out.append(p.text)
    return "\n".join(out) + "\n"


def save_document(doc: Document, out: str | os.PathLike) -> str:
    """Writes .txt, .json or .html by the name's ending; into a folder, all three. Returns a summary."""
    target = os.fspath(out)
    stem = os.path.splitext(os.path.basename(doc.path))[0]
    kinds = {".txt": lambda: doc.text, ".json": doc.to_json, ".html": doc.to_html}
    ending = os.path.splitext(target)[1].lower()
    todo = {target: kinds[ending]} if ending in kinds else {os.path.join(target, stem + e): make for e, make in kinds.items()}
    for path, make in todo.items():
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(make())
    needs = ", ".join(map(str, doc.pages_needing_ocr)) or "none"
    return f"{len(doc)} page(s), mean confidence {doc.confidence:.2f}, pages needing OCR: {needs}"


def write_corpus(judged: DataFrame, path: str) -> None:
    """Writes every document's text, JSON and HTML as tables under ``path``: the sink for corpora."""
    for name, rows in (("text", document.document_text(judged)), ("json", render.document_json(judged)), ("html", render.document_html(judged))):
        rows.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
