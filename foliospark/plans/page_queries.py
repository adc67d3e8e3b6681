"""Queries over files with the page features that plain documents lack: what is extracted beside the
text that the tables hold."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark import synth_pages as P
from foliospark.operators import document, extract, render
from foliospark.operators.detect import judged
from foliospark.plans.document_queries import LINES
from foliospark.plans.inputs import document_pages
from foliospark.session import dealt, prepare, spread, table
from foliospark.synth import LINES_PER_PAGE


def made_files(spark: SparkSession, sf_dir: str, maker: str) -> DataFrame:
    """(doc_id, content): a file of ``synth_pages`` for each document."""
    prepare(spark, extract.BATCH_ROWS)

    def written(batches):
        from foliospark import synth_pages

        make = getattr(synth_pages, maker)
        for b in batches:
            files = [make(i, t or "") for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(files, pa.binary())], names=["doc_id", "content"])

    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).mapInArrow(written, "doc_id long, content binary")


def _pages(spark: SparkSession, sf_dir: str, maker: str) -> DataFrame:
    return extract.extract(made_files(spark, sf_dir, maker))


def _text(pages: DataFrame) -> DataFrame:
    return document.page_text(pages.where("page IS NOT NULL")).where("text <> ''")


def arabic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right-to-left lines with marks, numbers, Latin words, brackets, ligatures, initial forms and stretched joins."""
    return _text(_pages(spark, sf_dir, "arabic_pdf"))


def arabic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction, font and glyphs of the same lines."""
    lines = extract.lines_of(_pages(spark, sf_dir, "arabic_pdf").where("page IS NOT NULL"))
    return lines.groupBy("doc_id", "page", "rtl", "font").agg(F.count("*").alias("lines"), F.sum("unresolved").alias("unresolved"), F.sum("glyphs").alias("glyphs"))


def column_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns, painted row by row, read one after the other."""
    return _text(_pages(spark, sf_dir, "columns_pdf"))


def tagged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines painted from the bottom up, read in the order of the tags where a file has them."""
    pages = _pages(spark, sf_dir, "tagged_pdf").where("page IS NOT NULL")
    return _text(pages).join(pages.select("doc_id", "page", "tagged"), ["doc_id", "page"])


def form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines painted by the page, by a form and by a form in a form, in turn."""
    return _text(_pages(spark, sf_dir, "forms_pdf"))


def form_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts of pages with nested forms."""
    fonts = extract.fonts_of(_pages(spark, sf_dir, "forms_pdf").where("page IS NOT NULL"))
    return fonts.groupBy("name", "base_font", "route").agg(F.count("*").alias("pages"))


def drawn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that only the embedded font program explains."""
    return _text(_pages(spark, sf_dir, "drawn_pdf"))


def packed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with object and cross-reference streams; of three one is plain, one locked by RC4, one by AES."""
    return _text(_pages(spark, sf_dir, "packed_pdf"))


def _order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark, 256)
    item = F.struct(
        "l_linenumber",
        F.array(
            F.concat(F.lit("line number "), F.col("l_linenumber").cast("string")), F.concat(F.lit("part "), F.lpad(F.col("l_partkey").cast("string"), 9, "0")),
            F.concat(F.lit("quantity "), F.lpad(F.col("l_quantity").cast("int").cast("string"), 4, "0")), F.concat(F.lit("returned "), F.col("l_returnflag")),
        ).alias("cells"),
    )
    total = F.array(
        F.lit("all the lines"), F.concat(F.lit("parts "), F.lpad(F.count("*").cast("string"), 9, "0")),
        F.concat(F.lit("quantity "), F.lpad(F.sum(F.col("l_quantity").cast("int")).cast("string"), 4, "0")), F.lit("of the order"),
    )
    rows = F.concat(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["cells"]), F.array(total))
    orders = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias("doc_id")).agg(rows.alias("rows"))

    def written(batches):
        from foliospark.synth_pages import table_pdf

        for b in batches:
            files = [table_pdf(f"Items of order {i}", f"Order {i}", rows, i % 2 == 1) for i, rows in zip(b.column("doc_id").to_pylist(), b.column("rows").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(files, pa.binary())], names=["doc_id", "content"])

    return extract.extract(orders.mapInArrow(written, "doc_id long, content binary"))


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of ruled tables whose first row spans all columns."""
    cells = extract.cells_of(_order_pages(spark, sf_dir))
    return cells.select("doc_id", "seq", "row", "column", "text", F.round("confidence", 6).alias("confidence"), "x0", "y0", "x1", "y1")


def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.block_text(_order_pages(spark, sf_dir)).select("doc_id", "page", "seq", "kind", "text")


def order_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.block_html(_order_pages(spark, sf_dir)).select("doc_id", "seq", "html")


_JSON = "page_count long, pages array<struct<number int, width double, height double, rotation int, verdict string, confidence double, tagged boolean, blocks array<struct<reading_index int, type string, text string, name string, is_background boolean, lines array<struct<text string, baseline double, font string, size double, color string, direction string, confidence double>>>>>>"


def json_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON rendering read back: every block of every page, with its lines."""
    told = render.document_json(judged(document_pages(spark, sf_dir))).select("doc_id", F.from_json("json", _JSON).alias("j"))
    rows = told.select("doc_id", "j.page_count", F.explode("j.pages").alias("p")).select("doc_id", "page_count", "p.*")
    rows = rows.withColumn("b", F.explode("blocks"))
    of = lambda f: F.array_join(F.transform("b.lines", f), "|")
    return rows.groupBy("doc_id", "page_count", F.col("number").alias("page"), "width", "height", "rotation", "verdict", F.round("confidence", 6).alias("confidence"), "tagged").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b.reading_index", F.coalesce("b.text", "b.name").alias("shown")))), lambda x: x["shown"]), "\n").alias("shown"),
        F.max("b.type").alias("kind"),
        F.max(F.coalesce("b.is_background", F.lit(False))).alias("background"),
        F.max(of(lambda x: F.concat_ws(",", x["font"], x["color"], x["direction"], x["size"].cast("int").cast("string")))).alias("first_styles").alias("styles"),
    )


QUERIES = {
    f.__name__: f
    for f in (arabic_pages, arabic_lines, column_pages, tagged_pages, form_pages, form_fonts, drawn_pages, packed_pages, order_cells, order_blocks, order_html, json_blocks)
}

_TOLD = f"translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '([{P.CONSONANTS}])a', '\\1{P.VOWEL_MARKS[0]}', 'g'), '([{P.CONSONANTS}])e', '\\1{P.VOWEL_MARKS[1]}', 'g'), '([{P.CONSONANTS}])i', '\\1{P.VOWEL_MARKS[2]}', 'g'), '([{P.CONSONANTS}])o', '\\1{P.VOWEL_MARKS[3]}', 'g'), '([{P.CONSONANTS}])u', '\\1{P.VOWEL_MARKS[4]}', 'g'), '{P.CONSONANTS}{P.VOWELS}0123456789', '{P.CONSONANT_LETTERS}{P.VOWEL_LETTERS}{P.DIGITS}')"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Lines of each document as Arabic words in logical order.
ARABIC = f"""
WITH ln AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents
), cut AS (
  SELECT doc_id, k, regexp_extract_all(translate(raw, '{_UPPER}', '{_UPPER.lower()}'), '[a-z]+|[0-9]+') AS ws FROM ln
), line AS (
  SELECT doc_id, ws, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n FROM cut WHERE len(ws) > 0
), told AS (
  SELECT doc_id, n, (n // {LINES_PER_PAGE} + 1)::INT AS page, ws, list_transform(ws, lambda w: CASE WHEN regexp_full_match(w, '[a-z]{{2}}') THEN w ELSE replace({_TOLD}, '{P.LIGATURE}', '{P.LIGATURE_TEXT}') END) AS ar FROM line
), shown AS (
  SELECT *, doc_id % 3 = 0 AND NOT regexp_full_match(ws[1], '[a-z]{{2}}') AS bracketed FROM told
)
"""
_PLAIN = f"""
WITH ln AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents
), line AS (
  SELECT doc_id, trim(regexp_replace(raw, ' +', ' ', 'g')) AS text, length(raw) AS chars, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n FROM ln WHERE trim(raw) <> ''
), paged AS (
  SELECT *, (n // {LINES_PER_PAGE} + 1)::INT AS page FROM line
)
"""
_BY_PAGE = _PLAIN + "SELECT doc_id, page, string_agg(text, chr(10) ORDER BY n) AS text FROM paged GROUP BY doc_id, page"
_ITEMS = """
WITH item AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber, cells) AS r, count(*) OVER (PARTITION BY doc_id) + 1 AS n FROM (
    SELECT l_orderkey AS doc_id, l_linenumber, l_quantity::INT AS quantity,
           ['line number ' || l_linenumber, 'part ' || lpad(l_partkey::VARCHAR, 9, '0'), 'quantity ' || lpad(l_quantity::INT::VARCHAR, 4, '0'), 'returned ' || l_returnflag] AS cells FROM lineitem
  )
), rows AS (
  SELECT doc_id, r, n, cells FROM item UNION ALL SELECT DISTINCT doc_id, 0, n, ['Order ' || doc_id, '', '', ''] FROM item
  UNION ALL SELECT doc_id, n, n, ['all the lines', 'parts ' || lpad((n - 1)::VARCHAR, 9, '0'), 'quantity ' || lpad(sum(quantity)::VARCHAR, 4, '0'), 'of the order'] FROM item GROUP BY doc_id, n
), conf AS (
  SELECT *, (1 + (2 + 3 * n / (n + 1)) / 5) / 2 AS confidence FROM rows
)
"""
ORACLE_SQL = {
    "arabic_pages": ARABIC
    + "SELECT doc_id, page, string_agg(CASE WHEN bracketed THEN '(' || ar[1] || ')' || array_to_string(list_transform(ar[2:], lambda w: ' ' || w), '') ELSE array_to_string(ar, ' ') END, chr(10) ORDER BY n) AS text FROM shown GROUP BY doc_id, page",
    "arabic_lines": ARABIC
    + f"""SELECT doc_id, page, rtl, 'F1' AS font, count(*) AS lines, 0::BIGINT AS unresolved, sum(glyphs)::BIGINT AS glyphs FROM (
 SELECT doc_id, page, len(list_filter(ws, lambda w: NOT regexp_full_match(w, '[a-z]{{2}}'))) > 0 AS rtl, 2 * bracketed::INT + list_sum(list_transform(ws, lambda w: length(w) + CASE
   WHEN NOT regexp_full_match(w, '[a-z]{{2}}') AND regexp_matches(w, '^([{P.CONSONANTS}]|[{P.VOWELS}x])[a-z]') AND NOT regexp_matches(w, '^[{P.CONSONANTS}][{P.VOWELS}]')
    AND len(regexp_extract_all(w, '[{P.CONSONANTS}][{P.VOWELS}]|[0-9]+|.')) > 4 THEN 1 ELSE 0 END)) AS glyphs FROM shown
) GROUP BY doc_id, page, rtl""",
    "column_pages": _PLAIN
    + f""", col AS (
  SELECT *, n // {2 * LINES_PER_PAGE} AS sheet, n % {2 * LINES_PER_PAGE} AS i, count(*) OVER (PARTITION BY doc_id, n // {2 * LINES_PER_PAGE}) AS m FROM line
) SELECT doc_id, (sheet + 1)::INT AS page, string_agg(text, chr(10) ORDER BY n) AS text FROM col GROUP BY doc_id, sheet""",
    "tagged_pages": _PLAIN + "SELECT doc_id, page, doc_id % 5 <> 0 AS tagged, string_agg(text, chr(10) ORDER BY CASE WHEN doc_id % 5 = 0 THEN -n ELSE n END) AS text FROM paged GROUP BY doc_id, page",
    "form_pages": _BY_PAGE,
    "drawn_pages": _BY_PAGE,
    "packed_pages": _BY_PAGE,
    "form_fonts": _PLAIN
    + "SELECT f AS name, 'Helvetica' AS base_font, 'encoding' AS route, count(*) AS pages FROM (SELECT DISTINCT doc_id, page FROM paged), (SELECT unnest(['F1', 'Fm0/G1', 'Fm0/In0/G1']) AS f) GROUP BY f",
    "order_cells": _ITEMS
    + f"""SELECT doc_id, 1 AS seq, r::INT AS row, (c - 1)::INT AS "column", cells[c] AS text, round(confidence, 6) AS confidence,
 (50 + {P.PITCH} * (c - 1))::DOUBLE AS x0, (650 - {P.ROW} * (r + 1))::DOUBLE AS y0, (50 + {P.PITCH} * c)::DOUBLE AS x1, (650 - {P.ROW} * r)::DOUBLE AS y1 FROM conf, (SELECT unnest([1, 2, 3, 4]) AS c)""",
    "order_blocks": _ITEMS
    + """SELECT doc_id, 1 AS page, 0 AS seq, 'text' AS kind, 'Items of order ' || doc_id AS text FROM conf WHERE r = 0
 UNION ALL SELECT doc_id, 1, 1, 'table', string_agg(array_to_string(cells, chr(9)), chr(10) ORDER BY r) FROM conf GROUP BY doc_id""",
    "order_html": _ITEMS
    + """, part AS (
  SELECT doc_id, r, confidence, '<tr>' || array_to_string(list_transform(cells, lambda t: CASE WHEN r <= 1 THEN '<th>' || t || '</th>' ELSE '<td>' || t || '</td>' END), '') || '</tr>' || chr(10) AS html FROM conf
) SELECT doc_id, 0 AS seq, '<p dir="ltr">Items of order ' || doc_id || '</p>' || chr(10) AS html FROM conf WHERE r = 0
 UNION ALL SELECT doc_id, 1, '<table dir="ltr" data-confidence="' || printf('%.2f', any_value(confidence)) || '">' || chr(10) || '<thead>' || chr(10) || string_agg(html, '' ORDER BY r) FILTER (WHERE r <= 1) || '</thead>' || chr(10)
  || coalesce('<tbody>' || chr(10) || string_agg(html, '' ORDER BY r) FILTER (WHERE r > 1) || '</tbody>' || chr(10), '') || '</table>' || chr(10) FROM part GROUP BY doc_id""",
    "json_blocks": LINES
    + """, style AS (SELECT doc_id, page, string_agg('F1,#000000,ltr,12', '|') AS styles FROM told GROUP BY doc_id, page)
SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS page_count, page, 612.0::DOUBLE AS width, 842.0::DOUBLE AS height, 0 AS rotation, verdict, round(confidence, 6) AS confidence, false AS tagged,
 CASE WHEN blank THEN 'Im0.png' ELSE text END AS shown, CASE WHEN blank THEN 'image' ELSE 'text' END AS kind, blank AS background, CASE WHEN NOT blank THEN styles END AS styles FROM judged JOIN style USING (doc_id, page)""",
}
