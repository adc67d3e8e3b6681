"""PDF files to a table of pages: parsing a file, then working on each page by itself.

Both steps are narrow Arrow stages. A page carries what its file gave it (content, fonts, forms,
images), so the pages of one long file may be spread over the cluster between the steps.
"""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.blocks import Block
from foliospark.functions.interpreter import Style
from foliospark.functions.page import PageResult, page_inputs, process
from foliospark.session import prepare
from foliospark.sources.pdf_syntax import PdfError

BOX = "x0:double,y0:double,x1:double,y1:double"
CELL = f"struct<text:string,{BOX}>"
STYLE = "font:string,size:double,mode:int,color:struct<space:string,parts:array<double>>"
LINE = f"struct<seq:int,block:int,text:string,baseline:double,{BOX},rtl:boolean,{STYLE},unresolved:int,glyphs:int>"
PICTURE = "struct<name:string,width:int,height:int,format:string,data:binary,reason:string,lost_mask:boolean,background:boolean>"
BLOCK = f"struct<seq:int,kind:string,{BOX},confidence:double,cells:array<array<{CELL}>>,picture:{PICTURE}>"
FONT = "struct<name:string,subtype:string,base_font:string,encoding:string,route:string,resolvable:boolean>"
PAGE = (
    f"page int, box struct<{BOX}>, rotation int, tagged boolean, n_glyphs long, n_invisible long, n_rules long, fonts array<{FONT}>, "
    f"lines array<{LINE}>, blocks array<{BLOCK}>, image_boxes array<struct<{BOX}>>, error string"
)
INPUT = f"page int, box struct<{BOX}>, rotation int, input binary, error string"
GLYPH = "page int, glyph_idx long, code int, text string, x double, y double, advance double, size double, turn int, font string, mode int"
#: Rows of an Arrow batch: a row is a whole file or page.
BATCH_ROWS = 64


def read_pdfs(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(doc_id, content) of the files in a folder; doc_id is the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), "content")


def _box(b) -> dict:
    return dict(zip(("x0", "y0", "x1", "y1"), b, strict=True)) if b else dict.fromkeys(("x0", "y0", "x1", "y1"))


def parse_pages(pdfs: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """A row for each page of ``pdfs`` (doc_id, content), or of the pages numbered; a file that can't
    be read gives one row that says why."""
    prepare(pdfs.sparkSession, BATCH_ROWS)
    wanted = set(pages) if pages is not None else None
    kind = pdfs.schema["doc_id"].dataType.simpleString()

    def parsed(batches):
        for batch in batches:
            ids, files = batch.column("doc_id"), batch.column("content")
            for i in range(batch.num_rows):
                rows = []
                try:
                    for p in page_inputs(files[i].as_py() or b"", wanted):
                        rows.append({"page": p.info.number, "box": _box(p.info.box), "rotation": p.info.rotation, "input": pickle.dumps(p), "error": None})
                except (PdfError, RecursionError) as e:
                    rows = [{"page": None, "box": None, "rotation": None, "input": None, "error": str(e) or type(e).__name__}]
                if rows:
                    for b in pa.Table.from_pylist(rows, schema=_INPUT_TYPES).to_batches():
                        yield pa.RecordBatch.from_arrays([pa.array([ids[i].as_py()] * b.num_rows, ids.type), *b.columns], names=["doc_id", *_INPUT_TYPES.names])

    return pdfs.select("doc_id", "content").mapInArrow(parsed, f"doc_id {kind}, {INPUT}")


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


_BOX_TYPE = pa.struct([(n, pa.float64()) for n in ("x0", "y0", "x1", "y1")])
_INPUT_TYPES = pa.schema([("page", pa.int32()), ("box", _BOX_TYPE), ("rotation", pa.int32()), ("input", pa.binary()), ("error", pa.string())])


def _style(s: Style) -> dict:
    return {"font": s.font, "size": s.size, "mode": s.mode, "color": {"space": s.color[0], "parts": list(s.color[1:])}}


def _block(seq: int, b: Block) -> dict:
    p = b.picture
    return {
        "seq": seq,
        "kind": b.kind,
        **_box(b.box),
        "confidence": b.confidence if b.kind != "image" else None,
        "cells": [[{"text": t, **_box(c)} for t, c in row] for row in b.table.rows] if b.table else None,
        "picture": {**p._asdict(), "background": b.background} if p else None,
    }


def page_record(r: PageResult) -> dict:
    owner = {id(x): seq for seq, b in enumerate(r.blocks) for x in b.lines or ()}
    hidden = {i for i, s in enumerate(r.glyphs.styles) if s.mode in (3, 7)}
    return {
        "page": r.info.number,
        "box": _box(r.info.box),
        "rotation": r.info.rotation,
        "tagged": r.tagged,
        "n_glyphs": len(r.glyphs),
        "n_invisible": int(sum((r.glyphs.style == i).sum() for i in hidden)),
        "n_rules": len(r.glyphs.rules),
        "fonts": [{"name": f.name, "subtype": f.raw.subtype, "base_font": f.raw.base_font, "encoding": f.raw.encoding_name, "route": f.raw.route, "resolvable": f.resolvable} for f in r.fonts],
        "lines": [
            {"seq": i, "block": owner.get(id(x)), "text": x.text, "baseline": x.baseline, **_box(x.box), "rtl": x.rtl, **_style(x.style), "unresolved": x.unresolved, "glyphs": x.glyphs}
            for i, x in enumerate(r.lines)
        ],
        "blocks": [_block(i, b) for i, b in enumerate(r.blocks)],
        "image_boxes": [_box(b) for _, b in r.images if b],
        "error": None,
    }


def interpret_pages(parsed: DataFrame) -> DataFrame:
    """PAGE rows from the rows of ``parse_pages``."""
    prepare(parsed.sparkSession, BATCH_ROWS)
    kind = parsed.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, {PAGE}"
    schema = _arrow(ddl)

    def worked(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["input"] is None:
                    rows.append({"doc_id": row["doc_id"], "error": row["error"]})
                else:
                    rows.append({"doc_id": row["doc_id"], **page_record(process(pickle.loads(row["input"])))})
            yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    return parsed.select("doc_id", "input", "error").mapInArrow(worked, ddl)


def extract(pdfs: DataFrame, pages: list[int] | None = None, spread: bool = False) -> DataFrame:
    """PAGE rows of ``pdfs`` (doc_id, content). ``spread`` deals pages out anew between the steps,
    for corpora with a few very long files."""
    parsed = parse_pages(pdfs, pages)
    if spread:
        parsed = parsed.repartition("doc_id", "page")
    return interpret_pages(parsed)


def glyphs(parsed: DataFrame) -> DataFrame:
    """A row for each glyph, in paint order, of the rows of ``parse_pages``."""
    from foliospark.functions.font_text import font_map
    from foliospark.functions.interpreter import Interpreter
    from foliospark.functions.lines import PlacedGlyphs

    kind = parsed.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, {GLYPH}"
    schema = _arrow(ddl)

    def told(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if row["input"] is None:
                    continue
                page = pickle.loads(row["input"])
                fonts = font_map(page.fonts)
                g = Interpreter(fonts, page.forms).page(page.content)
                n = len(g)
                texts = PlacedGlyphs(g, fonts).decoded
                names = [g.styles[s].font for s in g.style.tolist()]
                modes = [g.styles[s].mode for s in g.style.tolist()]
                cols = [[row["doc_id"]] * n, [page.info.number] * n, range(n), g.code, texts, g.x, g.y, g.advance, g.size, g.turn, names, modes]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return parsed.select("doc_id", "input").mapInArrow(told, ddl)


def lines_of(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", F.explode("lines").alias("line")).select("doc_id", "page", "line.*")


def blocks_of(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", F.explode("blocks").alias("block")).select("doc_id", "page", "block.*")


def fonts_of(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", F.explode("fonts").alias("font")).select("doc_id", "page", "font.*")


def images_of(pages: DataFrame) -> DataFrame:
    """Placed images; a picture that is never drawn has a null box."""
    return blocks_of(pages).where("kind = 'image'").select("doc_id", "page", "seq", "x0", "y0", "x1", "y1", "picture.*")


def cells_of(pages: DataFrame) -> DataFrame:
    tables = blocks_of(pages).where("kind = 'table'").select("doc_id", "page", "seq", "confidence", F.posexplode("cells").alias("row", "cells"))
    return tables.select("doc_id", "page", "seq", "confidence", "row", F.posexplode("cells").alias("column", "cell")).select("doc_id", "page", "seq", "confidence", "row", "column", "cell.*")
