"""Queries over the PDF files made from ``documents``: extraction, verdicts, reports."""

from __future__ import annotations

import base64
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import columns as C
from foliospark.operators import detect, document, extract, render
from foliospark.plans.inputs import document_pages, document_pdfs, parsed_documents
from foliospark.session import prepare, table
from foliospark.synth import LEADING, LINES_PER_PAGE, SIZE, TOP

#: Painted lines of each document, as the file writer lays them out, and what each page then is.
LINES = f"""
WITH ln AS (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents
), painted AS (
  SELECT doc_id, lang, raw, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n FROM ln WHERE trim(raw) <> ''
), line AS (
  SELECT doc_id, lang, n, (n // {LINES_PER_PAGE} + 1)::INT AS page, n % {LINES_PER_PAGE} AS row, raw,
         n = max(n) OVER (PARTITION BY doc_id, n // {LINES_PER_PAGE}) AND doc_id % 10 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 = 0 AS spoiled
  FROM painted
), shown AS (
  SELECT *, CASE WHEN spoiled THEN left(raw, length(raw) - 1) || chr(65533) ELSE raw END AS visual FROM line
), told AS (
  SELECT *, trim(regexp_replace(visual, ' +', ' ', 'g')) AS text FROM shown
), pages AS (
  SELECT doc_id, any_value(lang) AS lang, page, doc_id % 10 = 0 AS blank, doc_id % 7 = 0 AS hidden,
         CASE WHEN doc_id % 10 = 0 THEN 0 ELSE sum(length(raw)) END::BIGINT AS glyphs,
         CASE WHEN doc_id % 10 = 0 THEN 0 ELSE count_if(spoiled) END::BIGINT AS bad,
         CASE WHEN doc_id % 10 = 0 THEN 0 ELSE sum(length(text)) END::BIGINT AS chars,
         CASE WHEN doc_id % 10 = 0 THEN 0 ELSE sum(length(replace(text, ' ', ''))) END::BIGINT AS visible,
         string_agg(text, chr(10) ORDER BY n) AS text
  FROM told GROUP BY doc_id, page
), judged AS (
  SELECT *, CASE WHEN blank THEN 'needs_ocr' WHEN hidden OR bad > 0 THEN 'degraded' ELSE 'ok' END AS verdict,
         CASE WHEN blank THEN 0.0 ELSE 1.0 - bad / glyphs - least(bad / chars, 0.5) - CASE WHEN hidden THEN 0.1 ELSE 0 END END AS confidence
  FROM pages
)
"""


def extract_text_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.document_text(detect.judged(document_pages(spark, sf_dir)))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.page_text(document_pages(spark, sf_dir)).where("text <> ''")


def verdict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and mean confidence by language and verdict."""
    verdicts = detect.assess(document_pages(spark, sf_dir))
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return verdicts.join(langs, "doc_id").groupBy("lang", "verdict").agg(F.count("*").alias("pages"), F.round(F.avg("confidence"), 6).alias("confidence"))


def signals_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.signals(document_pages(spark, sf_dir))


def verdict_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = detect.assess(document_pages(spark, sf_dir))
    return v.select("doc_id", "page", "rank", "verdict", F.round("confidence", 6).alias("confidence"), F.array_join("reasons", "; ").alias("reasons"))


def doc_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = document.document_report(detect.judged(document_pages(spark, sf_dir)))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("doc_id", "page_count", F.round("confidence", 6).alias("confidence"), listed("pages_needing_ocr"), listed("tagged_pages"))


def page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_documents(spark, sf_dir).select("doc_id", "page", "box.*", "rotation")


def font_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.fonts_of(document_pages(spark, sf_dir))


def image_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = extract.images_of(document_pages(spark, sf_dir))
    return images.select("doc_id", "page", "x0", "y0", "x1", "y1", "name", "width", "height", "format", "background")


def line_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = extract.lines_of(document_pages(spark, sf_dir))
    return lines.select("doc_id", "page", "text", "baseline", "x0", "y0", "x1", "y1", "rtl", "font", "size", "mode", "unresolved", "glyphs")


def glyph_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs in paint order, summed up by page."""
    g = extract.glyphs(parsed_documents(spark, sf_dir))
    return g.groupBy("doc_id", "page").agg(F.count("*").alias("glyphs"), F.max("x").alias("right"), F.min("y").alias("bottom"), F.sum("code").alias("codes"), F.count("text").alias("resolved"))


def block_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = document.block_confidence(extract.lines_of(document_pages(spark, sf_dir)))
    return out.groupBy("doc_id", "page").agg(F.round(F.min("confidence"), 6).alias("confidence"))


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as lines, their sizes as type sizes, brands as documents."""
    lines = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_size").cast("double").alias("size"), F.col("p_name").alias("text"))
    return render.heading_levels(lines)


def doc_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line is right to left where its number in its order is odd."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2 == 1).alias("rtl"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text"))
    return render.document_direction(lines)


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = document_pages(spark, sf_dir).persist()
    text = document.block_text(pages).where("kind = 'text'").select("doc_id", "page", "seq")
    return render.block_html(pages).join(text, ["doc_id", "page", "seq"]).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "html"))), lambda x: x["html"]), "").alias("html"))


def html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.document_html(detect.judged(document_pages(spark, sf_dir)).persist())


def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.document_json(detect.judged(document_pages(spark, sf_dir)))


def json_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the JSON rendering says when it is read back."""
    j = json_documents(spark, sf_dir)
    return j.select("doc_id", F.get_json_object("json", "$.page_count").cast("long").alias("page_count"), F.get_json_object("json", "$.pages[0].verdict").alias("verdict"))


def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files cut off after their header are reported, not dropped."""
    cut = document_pdfs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.expr("substring(content, 1, 40)")).otherwise(F.col("content")).alias("content"))
    return extract.extract(cut).groupBy("doc_id").agg(F.bool_or(F.col("error").isNotNull()).alias("failed"), F.count("page").alias("pages"))


def block_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of blocks, and whether they are numbered without gaps."""
    b = extract.blocks_of(document_pages(spark, sf_dir))
    return b.groupBy("doc_id", "page").agg(F.count_if(F.col("kind") == "text") > 0, F.count_if(F.col("kind") == "image"), F.max("seq") + 1 == F.count("*")).toDF("doc_id", "page", "has_text", "images", "dense")


def block_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a page's blocks, joined in reading order."""
    b = document.block_text(document_pages(spark, sf_dir)).where("text <> ''")
    return b.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text"))


def line_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = extract.lines_of(document_pages(spark, sf_dir))
    return lines.groupBy("doc_id", "page").agg(F.round(F.min(C.resolution_rate("unresolved", "glyphs")), 6).alias("lowest"), F.count("*").alias("lines"))


def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second pages alone: the others are not interpreted."""
    pages = extract.extract(document_pdfs(spark, sf_dir), [2], spread=True)
    return document.page_text(pages)


def image_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 2 by 2 samples built from part numbers: what becomes of each."""
    prepare(spark)

    def told(batches):
        from foliospark.functions.pictures import picture
        from foliospark.sources.pdf_pages import RawImage

        spaces, codecs = ("gray", "rgb", "cmyk", "indexed", "other"), ([], ["FlateDecode"], ["DCTDecode"], ["JPXDecode"], ["CCITTFaxDecode"], ["ASCII85Decode", "JBIG2Decode"])
        for b in batches:
            keys = b.column("p_partkey").to_pylist()
            made = [picture(RawImage("Im", 2, 2, 1 if k % 7 == 0 else 8, spaces[k % 5], ("rgb", bytes(6)) if k % 2 else None, codecs[k % 6], bytes(k % 17), False)) for k in keys]
            yield pa.RecordBatch.from_arrays([b.column("p_partkey"), pa.array([p.format for p in made], pa.string()), pa.array([p.reason for p in made], pa.string())], names=["p_partkey", "format", "reason"])

    return table(spark, sf_dir, "part").select("p_partkey").mapInArrow(told, "p_partkey long, format string, reason string")


QUERIES = {
    f.__name__: f
    for f in (
        extract_text_by_doc, page_texts, verdict_report, signals_per_page, verdict_reasons, doc_confidence, page_info, font_inventory, image_inventory,
        line_inventory, glyph_totals, block_confidences, heading_levels, doc_direction, html_blocks, html_documents, json_documents, json_page_counts, parse_errors,
        block_inventory, block_texts, line_rates, page_lookup, image_reasons,
    )
}

def _gray_png(sample: int) -> str:
    """A picture of one gray sample as base64."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    parts = chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), chunk(b"IDAT", zlib.compress(bytes([0, sample]))), chunk(b"IEND", b"")
    return base64.b64encode(b"\x89PNG\r\n\x1a\n" + b"".join(parts)).decode()


_ESCAPED = "replace(replace(replace(replace(replace(TEXT, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"
ORACLE_SQL = {
    "block_inventory": LINES + "SELECT doc_id, page, NOT blank AS has_text, blank::BIGINT AS images, true AS dense FROM judged",
    "block_texts": LINES + "SELECT doc_id, page, text FROM judged WHERE NOT blank",
    "line_rates": LINES + "SELECT doc_id, page, round(min(1 - spoiled::INT / length(raw)), 6) AS lowest, count(*) AS lines FROM told WHERE doc_id % 10 <> 0 GROUP BY doc_id, page",
    "page_lookup": LINES + "SELECT doc_id, page, CASE WHEN blank THEN '' ELSE text END AS text FROM judged WHERE page = 2",
    "image_reasons": """
WITH p AS (SELECT p_partkey, p_partkey % 7 = 0 AS one, p_partkey % 5 AS s, p_partkey % 6 AS f, p_partkey % 17 AS n, p_partkey % 2 = 1 AS pal FROM part),
r AS (SELECT *, CASE WHEN f IN (2, 3) THEN NULL WHEN f = 4 THEN 'CCITTFaxDecode is not decoded' WHEN f = 5 THEN 'JBIG2Decode is not decoded' WHEN one THEN '1-bit samples are not yet unpacked'
 WHEN s = 3 AND NOT pal THEN 'indexed image with no palette' WHEN s = 4 THEN 'unresolved colour space'
 WHEN s = 0 AND n < 4 THEN 'truncated: ' || n || ' sample bytes for a 2x2 image needing 4' WHEN s = 1 AND n < 12 THEN 'truncated: ' || n || ' sample bytes for a 2x2 image needing 12'
 WHEN s = 2 AND n < 16 THEN 'truncated: ' || n || ' sample bytes for a 2x2 CMYK image needing 16' WHEN s = 3 AND n < 4 THEN 'truncated: ' || n || ' index bytes for a 2x2 image' END AS reason FROM p)
SELECT p_partkey, CASE WHEN reason IS NULL THEN CASE f WHEN 2 THEN 'jpg' WHEN 3 THEN 'jp2' ELSE 'png' END END AS format, reason FROM r""",
    "extract_text_by_doc": LINES + "SELECT doc_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page) FILTER (WHERE NOT blank), '') AS text FROM judged GROUP BY doc_id",
    "page_texts": LINES + "SELECT doc_id, page, text FROM judged WHERE NOT blank",
    "verdict_report": LINES + "SELECT lang, verdict, count(*) AS pages, round(avg(confidence), 6) AS confidence FROM judged GROUP BY lang, verdict",
    "signals_per_page": LINES
    + """SELECT doc_id, page, glyphs AS glyph_count, bad AS unresolved, (CASE WHEN blank THEN 1 ELSE 1 END)::BIGINT AS font_count, 0::BIGINT AS unmappable_fonts,
 CASE WHEN hidden THEN glyphs ELSE 0 END AS invisible_glyphs, 0::BIGINT AS residual_presentation_forms, bad AS replacement_chars, chars AS text_len, visible AS visible_text_len,
 false AS mixed_digit_separators, CASE WHEN blank THEN 1.0 ELSE 0.0 END::DOUBLE AS image_coverage FROM judged""",
    "verdict_reasons": LINES
    + """SELECT doc_id, page, CASE verdict WHEN 'ok' THEN 0 WHEN 'degraded' THEN 1 ELSE 2 END AS rank, verdict, round(confidence, 6) AS confidence,
 CASE WHEN blank THEN 'no text layer: the page paints no glyphs at all'
      WHEN bad > 0 THEN bad || ' of ' || glyphs || ' glyph codes unresolved'
      WHEN hidden THEN 'text is painted invisibly — this looks like an OCR layer over a scan' ELSE '' END AS reasons FROM judged""",
    "doc_confidence": LINES
    + """SELECT doc_id, count(*) AS page_count, round(avg(confidence), 6) AS confidence,
 coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (WHERE blank), '') AS pages_needing_ocr, '' AS tagged_pages FROM judged GROUP BY doc_id""",
    "page_info": LINES + "SELECT doc_id, page, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, 612.0::DOUBLE AS x1, 842.0::DOUBLE AS y1, 0 AS rotation FROM judged",
    "font_inventory": LINES + "SELECT doc_id, page, 'F1' AS name, 'Type1' AS subtype, 'Helvetica' AS base_font, 'WinAnsiEncoding' AS encoding, 'encoding' AS route, true AS resolvable FROM judged",
    "image_inventory": LINES
    + "SELECT doc_id, page, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, 612.0::DOUBLE AS x1, 842.0::DOUBLE AS y1, 'Im0' AS name, 1 AS width, 1 AS height, 'png' AS format, true AS background FROM judged WHERE blank",
    "line_inventory": LINES
    + f"""SELECT doc_id, page, text, ({TOP} - {LEADING} * row)::DOUBLE AS baseline, 0.0::DOUBLE AS x0, ({TOP} - {LEADING} * row - {SIZE} * 0.25)::DOUBLE AS y0, ({SIZE} * 0.5 * length(raw))::DOUBLE AS x1,
 ({TOP} - {LEADING} * row + {SIZE} * 0.75)::DOUBLE AS y1, false AS rtl, 'F1' AS font, {SIZE}::DOUBLE AS size, CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 0 END AS mode,
 spoiled::INT AS unresolved, length(raw)::INT AS glyphs FROM told WHERE doc_id % 10 <> 0""",
    "glyph_totals": LINES
    + f"""SELECT doc_id, page, sum(length(raw))::BIGINT AS glyphs, max({SIZE} * 0.5 * (length(raw) - 1))::DOUBLE AS "right", min({TOP} - {LEADING} * row)::DOUBLE AS bottom,
 sum(CASE WHEN spoiled THEN list_sum(list_transform(string_split(left(raw, length(raw) - 1), ''), lambda c: ord(c))) + 129 ELSE list_sum(list_transform(string_split(raw, ''), lambda c: ord(c))) END)::BIGINT AS codes,
 sum(length(raw) - spoiled::INT)::BIGINT AS resolved FROM told WHERE doc_id % 10 <> 0 GROUP BY doc_id, page""",
    "block_confidences": LINES + "SELECT doc_id, page, round(1 - bad / glyphs, 6) AS confidence FROM judged WHERE NOT blank",
    "heading_levels": """
WITH w AS (SELECT p_brand AS doc_id, (p_size * 2)::BIGINT AS bucket, sum(length(p_name)) AS chars FROM part GROUP BY 1, 2),
b AS (SELECT doc_id, arg_max(bucket, chars * 1000 + bucket) AS body FROM w GROUP BY doc_id)
SELECT doc_id, bucket, bucket * 0.5::DOUBLE AS size, least(row_number() OVER (PARTITION BY doc_id ORDER BY bucket DESC), 6)::INT AS level
FROM w JOIN b USING (doc_id) WHERE bucket * 0.5::DOUBLE >= body * 0.5::DOUBLE * 1.15::DOUBLE""",
    "doc_direction": "SELECT l_orderkey AS doc_id, 2 * sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity::INT ELSE 0 END) > sum(l_quantity::INT) AS rtl FROM lineitem GROUP BY l_orderkey",
    "html_blocks": LINES
    + f"""SELECT doc_id, page, '<p dir="ltr"' || CASE WHEN bad > 0 THEN ' data-confidence="' || printf('%.2f', 1 - bad / glyphs) || '"' ELSE '' END || '>' || {_ESCAPED.replace('TEXT', "replace(text, chr(10), ' ')")} || '</p>' || chr(10) AS html
 FROM judged WHERE NOT blank""",
    "html_documents": LINES
    + f""", section AS (
  SELECT doc_id, page, '<section class="page" id="page-' || page || '" data-confidence="' || printf('%.2f', confidence) || '">' || chr(10) || '<div class="page-number">' || page || '</div>' || chr(10)
   || CASE WHEN blank THEN '<p class="needs-ocr">No text layer on this page — it needs OCR. (no text layer: the page paints no glyphs at all)</p>' || chr(10)
     || '<img class="background" alt="Im0.png" width="1" height="1" src="data:image/png;base64,{_gray_png(128)}">' || chr(10)
    ELSE '<p dir="ltr"' || CASE WHEN bad > 0 THEN ' data-confidence="' || printf('%.2f', 1 - bad / glyphs) || '"' ELSE '' END || '>' || {_ESCAPED.replace('TEXT', "replace(text, chr(10), ' ')")} || '</p>' || chr(10) END
   || '</section>' || chr(10) AS html FROM judged
) SELECT doc_id, '<!DOCTYPE html>' || chr(10) || '<html lang="en" dir="ltr">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10)
 || '<meta name="viewport" content="width=device-width, initial-scale=1">' || chr(10) || '<title>Extracted document</title>' || chr(10) || '<style>{render.STYLE}</style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10)
 || string_agg(html, '' ORDER BY page) || '</body>' || chr(10) || '</html>' || chr(10) AS html FROM section GROUP BY doc_id""",
    "json_page_counts": LINES + "SELECT doc_id, count(*) AS page_count, arg_min(verdict, page) AS verdict FROM judged GROUP BY doc_id",
    "parse_errors": LINES + "SELECT doc_id, doc_id % 2 = 0 AS failed, (CASE WHEN doc_id % 2 = 0 THEN 0 ELSE count(*) END)::BIGINT AS pages FROM judged GROUP BY doc_id",
}
