"""Renderings of extracted pages: headings, HTML, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import columns as C
from foliospark.operators.extract import lines_of
from foliospark.params import PARAMS, Params

STYLE = (
    "body{max-width:46rem;margin:auto;padding:1rem;line-height:1.8}.page+.page{border-top:1px solid #8886;margin-top:3rem}"
    ".page-number{font-size:.75rem;opacity:.5}table{border-collapse:collapse;width:100%}th,td{border:1px solid #8888;padding:.4em;text-align:start}"
    "img{max-width:100%}img.background{opacity:.55}.needs-ocr,.undecoded{font-style:italic;opacity:.7}"
)


def heading_levels(lines: DataFrame, p: Params = PARAMS) -> DataFrame:
    """(doc_id, bucket, size, level) of the sizes that stand out above a document's body size.

    ``lines``: doc_id, size, text. The body is the size bucket with the most characters, the larger
    of equals."""
    weights = lines.groupBy("doc_id", C.size_bucket("size", p).alias("bucket")).agg(F.sum(F.length("text")).alias("chars"))
    body = F.max(F.struct("chars", "bucket")).over(Window.partitionBy("doc_id"))
    larger = weights.withColumn("body", body["bucket"]).where(F.col("bucket") * p.size_bucket >= F.col("body") * p.size_bucket * p.heading_ratio)
    level = F.least(F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("bucket"))), F.lit(p.heading_levels))
    return larger.select("doc_id", "bucket", (F.col("bucket") * p.size_bucket).alias("size"), level.cast("int").alias("level"))


def document_direction(lines: DataFrame) -> DataFrame:
    """(doc_id, rtl): whether most characters are in right-to-left lines."""
    chars = F.length("text")
    return lines.groupBy("doc_id").agg((2 * F.sum(F.when(F.col("rtl"), chars).otherwise(0)) > F.sum(chars)).alias("rtl"))


def text_html(text: Column, level: Column, rgb: Column, rtl: Column, confidence: Column, color: bool = True) -> Column:
    tag = F.when(level.isNull(), F.lit("p")).otherwise(F.concat(F.lit("h"), level.cast("string")))
    shown = F.when(C.worth_showing(rgb), F.concat(F.lit(' style="color:'), C.css_hex(rgb), F.lit('"'))).otherwise("") if color else F.lit("")
    side = F.when(rtl, "").otherwise(' dir="ltr"')
    doubt = F.when(confidence < 1, F.concat(F.lit(' data-confidence="'), C.two_digits(confidence), F.lit('"'))).otherwise("")
    return F.concat(F.lit("<"), tag, shown, side, doubt, F.lit(">"), C.escape_html(text), F.lit("</"), tag, F.lit(">\n"))


def table_html(cells: Column, rtl: Column, confidence: Column) -> Column:
    """``cells``: array of rows of texts. Rows through the first full one are the head."""
    full = lambda row: (F.size(row) > 0) & F.forall(row, lambda t: t != "")
    head = F.coalesce(F.array_position(F.transform(cells, full), F.lit(True)).cast("int"), F.lit(0))
    rows = lambda part, tag: F.array_join(
        F.transform(part, lambda row: F.concat(F.lit("<tr>"), F.array_join(F.transform(row, lambda t: F.concat(F.lit(f"<{tag}>"), C.escape_html(t), F.lit(f"</{tag}>"))), ""), F.lit("</tr>\n"))), ""
    )
    n = F.size(cells)
    opened = F.concat(F.lit('<table dir="'), F.when(rtl, "rtl").otherwise("ltr"), F.lit('" data-confidence="'), C.two_digits(confidence), F.lit('">\n'))
    top = F.when(head > 0, F.concat(F.lit("<thead>\n"), rows(F.slice(cells, F.lit(1), head), "th"), F.lit("</thead>\n"))).otherwise("")
    rest = F.when(head < n, F.concat(F.lit("<tbody>\n"), rows(F.slice(cells, head + 1, F.greatest(n - head, F.lit(0))), "td"), F.lit("</tbody>\n"))).otherwise("")
    return F.concat(opened, top, rest, F.lit("</table>\n"))


def image_html(picture: Column, images: bool = True) -> Column:
    mime = F.when(picture["format"] == "jpg", "image/jpeg").when(picture["format"] == "jp2", "image/jp2").otherwise("image/png")
    name = F.concat_ws(".", picture["name"], picture["format"])
    missing = lambda what: F.concat(F.lit('<p class="undecoded">[image: '), C.escape_html(what), F.lit("]</p>\n"))
    shown = F.concat(
        F.lit("<img"), F.when(picture["background"], ' class="background"').otherwise(""), F.lit(' alt="'), C.escape_html(name), F.lit('" width="'), picture["width"].cast("string"),
        F.lit('" height="'), picture["height"].cast("string"), F.lit('" src="data:'), mime, F.lit(";base64,"), F.regexp_replace(F.base64(picture["data"]), r"[\r\n]", ""), F.lit('">\n'),
    )
    return F.when(picture["reason"].isNotNull(), missing(picture["reason"])).otherwise(shown if images else missing(name))


def block_html(pages: DataFrame, images: bool = True, color: bool = True) -> DataFrame:
    """(doc_id, page, seq, html) of every block."""
    lines = lines_of(pages)
    levels = heading_levels(lines).select("doc_id", "bucket", "level")
    direction = document_direction(lines).select("doc_id", F.col("rtl").alias("doc_rtl"))
    rows = pages.select("doc_id", "page", "lines", F.explode("blocks").alias("b"))
    rows = rows.withColumn("own", F.filter("lines", lambda x: x["block"] == F.col("b.seq"))).withColumn("first", F.get("own", F.lit(0)))
    rows = rows.withColumn("bucket", C.size_bucket("first.size")).join(levels, ["doc_id", "bucket"], "left").join(direction, "doc_id", "left")
    rgb = C.rgb8("first.color.space", "first.color.parts")
    text = text_html(F.array_join(F.transform("own", lambda x: x["text"]), " "), F.col("level"), rgb, F.col("first.rtl"), F.col("b.confidence"), color)
    cells = F.transform("b.cells", lambda row: F.transform(row, lambda c: c["text"]))
    table = table_html(cells, F.coalesce("doc_rtl", F.lit(False)), F.col("b.confidence"))
    html = F.when(F.col("b.kind") == "text", text).when(F.col("b.kind") == "table", table).otherwise(image_html(F.col("b.picture"), images))
    return rows.select("doc_id", "page", F.col("b.seq").alias("seq"), html.alias("html"))


def document_html(judged: DataFrame, title: str = "Extracted document", images: bool = True, color: bool = True) -> DataFrame:
    """(doc_id, html) of judged pages: a section for each, with a notice where it needs OCR. The pages
    are gone through three times (sizes, direction, blocks), so keep them (persist or store) first."""
    blocks = block_html(judged, images, color).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "html"))), lambda x: x["html"]), "").alias("body"))
    rows = judged.select("doc_id", "page", "verdict", "confidence", "reasons").join(blocks, ["doc_id", "page"], "left")
    reason = F.concat(F.lit(" ("), C.escape_html(F.get("reasons", F.lit(0))), F.lit(")"))
    notice = F.when(F.col("verdict") == "needs_ocr", F.concat(F.lit('<p class="needs-ocr">No text layer on this page — it needs OCR.'), F.coalesce(reason, F.lit("")), F.lit("</p>\n"))).otherwise("")
    number = F.col("page").cast("string")
    section = F.concat(
        F.lit('<section class="page" id="page-'), number, F.lit('" data-confidence="'), C.two_digits("confidence"), F.lit('">\n<div class="page-number">'), number, F.lit("</div>\n"),
        notice, F.coalesce("body", F.lit("")), F.lit("</section>\n"),
    )
    whole = rows.select("doc_id", "page", section.alias("html")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "html"))), lambda x: x["html"]), "").alias("body"))
    whole = whole.join(document_direction(lines_of(judged)), "doc_id", "left").withColumn("rtl", F.coalesce("rtl", F.lit(False)))
    head = F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="'), F.when(F.col("rtl"), "ar").otherwise("en"), F.lit('" dir="'), F.when(F.col("rtl"), "rtl").otherwise("ltr"),
        F.lit('">\n<head>\n<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">\n<title>'), C.escape_html(F.lit(title)),
        F.lit(f"</title>\n<style>{STYLE}</style>\n</head>\n<body>\n"),
    )
    return whole.select("doc_id", F.concat(head, "body", F.lit("</body>\n</html>\n")).alias("html"))


def document_json(judged: DataFrame) -> DataFrame:
    """(doc_id, json) of judged pages: pages with their blocks; null boxes and reasons are left out, image bytes too."""
    box = lambda x: F.when(x["x0"].isNotNull(), F.array(x["x0"], x["y0"], x["x1"], x["y1"]))
    side = lambda rtl: F.when(rtl, "rtl").otherwise("ltr")
    hex_ = lambda c: C.css_hex(C.rgb8(c["space"], c["parts"]))
    rate = lambda x: F.when(x["glyphs"] > 0, 1 - x["unresolved"] / x["glyphs"]).otherwise(1.0)
    line = lambda x: F.struct(
        x["text"].alias("text"), box(x).alias("bbox"), x["baseline"].alias("baseline"), x["font"].alias("font"), x["size"].alias("size"),
        hex_(x["color"]).alias("color"), side(x["rtl"]).alias("direction"), rate(x).alias("confidence"),
    )
    own = lambda b: F.filter("lines", lambda x: x["block"] == b["seq"])
    is_text, is_table, is_image = (lambda b, k=k: b["kind"] == k for k in ("text", "table", "image"))
    only = lambda condition, value: F.when(condition, value)
    rows = lambda b: F.transform(b["cells"], lambda row: F.transform(row, lambda c: F.struct(c["text"].alias("text"), box(c).alias("bbox"))))
    block = lambda b: F.struct(
        b["seq"].alias("reading_index"),
        box(b).alias("bbox"),
        b["kind"].alias("type"),
        only(is_text(b), F.array_join(F.transform(own(b), lambda x: x["text"]), "\n")).alias("text"),
        b["confidence"].alias("confidence"),
        only(is_text(b), F.transform(own(b), line)).alias("lines"),
        only(is_table(b), F.size(b["cells"])).alias("row_count"),
        only(is_table(b), F.coalesce(F.size(F.get(b["cells"], F.lit(0))), F.lit(0))).alias("column_count"),
        rows(b).alias("rows"),
        only(is_image(b) & b["picture"]["reason"].isNull(), F.concat_ws(".", b["picture"]["name"], b["picture"]["format"])).alias("name"),
        only(is_image(b) & b["picture"]["reason"].isNull(), b["picture"]["width"]).alias("width"),
        only(is_image(b) & b["picture"]["reason"].isNull(), b["picture"]["height"]).alias("height"),
        only(is_image(b), b["picture"]["background"]).alias("is_background"),
        b["picture"]["reason"].alias("unsupported_reason"),
    )
    page = F.struct(
        F.col("page").alias("number"), (F.col("box.x1") - F.col("box.x0")).alias("width"), (F.col("box.y1") - F.col("box.y0")).alias("height"), "rotation", "verdict", "confidence", "reasons", "tagged",
        F.transform("blocks", block).alias("blocks"),
    )
    told = F.to_json("told", {"pretty": "true", "ignoreNullFields": "true"})
    whole = judged.select("doc_id", "page", page.alias("told")).groupBy("doc_id").agg(F.collect_list(F.struct("page", told.alias("json"))).alias("pages"))
    parts = F.array_join(F.transform(F.array_sort("pages"), lambda x: x["json"]), ",\n")
    return whole.select("doc_id", F.concat(F.lit('{\n  "page_count" : '), F.size("pages").cast("string"), F.lit(',\n  "pages" : [ '), parts, F.lit(" ]\n}")).alias("json"))
