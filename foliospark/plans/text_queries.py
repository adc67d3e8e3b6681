"""Queries over text: direction, reordering, repairs, separators, colors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import columns as C
from foliospark.functions import text_udfs as U
from foliospark.operators import detect, geometry
from foliospark.session import prepare, table

LATIN = "abcdefghijklmnopqrstuvwxyz"
#: Arabic letters for Latin ones, and the presentation form of each letter in its word's middle or alone.
ARABIC = "".join(chr(0x0627 + k) for k in (0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 26, 27, 28, 29, 30, 31, 32))
FORMS = "".join(map(chr, (0xFE8D, 0xFE8F, 0xFE95, 0xFE99, 0xFE9D, 0xFEA1, 0xFEA5, 0xFEA9, 0xFEAB, 0xFEAD, 0xFEAF, 0xFEB1, 0xFEB5, 0xFEB9, 0xFEBD, 0xFEC1, 0xFEC5, 0xFEC9, 0xFECD, 0xFED1, 0xFED5, 0xFED9, 0xFEDD, 0xFEE1, 0xFEE5, 0xFEE9)))


def _transliterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line, logical, visual): every line of each text in Arabic letters, and the same as a
    page paints it, backwards and in presentation forms. A line without a letter is an empty one."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    latin = F.trim(F.regexp_replace(F.lower(F.regexp_replace("text", "[^A-Za-z ]", "")), " +", " "))
    rows = lines.select("doc_id", "line", latin.alias("latin"))
    return rows.select("doc_id", "line", F.translate("latin", LATIN, ARABIC).alias("logical"), F.reverse(F.translate("latin", LATIN, FORMS)).alias("visual"))


_TRANSLITERATED = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, unnest(range(len(lines)))::INT AS line, unnest(lines) AS text FROM d),
l AS (SELECT doc_id, line, trim(regexp_replace(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' +', ' ', 'g')) AS latin FROM x),
t AS (SELECT doc_id, line, translate(latin, '{LATIN}', '{ARABIC}') AS logical FROM l)
"""


def bidi_nfkc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _transliterated(spark, sf_dir).select("doc_id", "line", U.normalize_nfkc(U.bidi_reorder("visual", C.is_rtl("visual"))).alias("text"))


def logical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _transliterated(spark, sf_dir).select("doc_id", "line", U.logical_text("visual").alias("text"))


def text_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document is transliterated."""
    docs = table(spark, sf_dir, "documents").where("text RLIKE '[A-Za-z]'")
    text = F.when(F.col("doc_id") % 3 == 0, F.translate(F.lower("text"), LATIN, ARABIC)).otherwise(F.col("text"))
    return docs.select("doc_id", C.is_rtl(text).alias("rtl"))


def page_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source reads right to left if any of its texts does."""
    return text_direction(spark, sf_dir).groupBy((F.col("doc_id") % 7).alias("page")).agg(F.bool_or("rtl").alias("rtl"))


def tidy_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.concat(F.lit("  "), F.regexp_replace("text", " ", "  "), F.lit("　\t"))
    return table(spark, sf_dir, "documents").select("doc_id", C.tidy_whitespace(wide).alias("text"))


def strip_tatweel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars in every gap between letters go, those at word ends stay."""
    rows = _transliterated(spark, sf_dir)
    barred = F.regexp_replace(F.regexp_replace("logical", "(?<=[^ ])(?=[^ ])", "ــ"), " ", "ـ ")
    return rows.select("doc_id", "line", C.drop_joins(barred).alias("text"))


def strip_mark_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _transliterated(spark, sf_dir)
    return rows.select("doc_id", "line", C.drop_mark_bases(F.regexp_replace("logical", " ", " َ ")).alias("text"))


def unify_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's digits with the first in Arabic-Indic: the other script leads from three digits on."""
    prepare(spark)
    key = F.col("o_orderkey").cast("string")
    mixed = F.concat(F.translate(F.substring(key, 1, 1), "0123456789", "٠١٢٣٤٥٦٧٨٩"), F.substring(key, 2, 20))
    return table(spark, sf_dir, "orders").select("o_orderkey", U.unify_digits(F.concat(F.lit("n "), mixed)).alias("text"))


def presentation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _transliterated(spark, sf_dir)
    return rows.select("doc_id", "line", C.presentation_forms("visual").alias("forms"), C.presentation_forms("logical").alias("left_over"))


def stranded_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _transliterated(spark, sf_dir)
    return rows.select("doc_id", "line", C.stranded_marks(F.regexp_replace("logical", " ", " َ")).alias("stranded"), C.replacement_characters(F.regexp_replace("logical", " ", "�")).alias("lost"))


def extractor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters, forms, marks and a phrase check of visual text, before and after normalisation."""
    prepare(spark)
    rows = _transliterated(spark, sf_dir).withColumn("nfkc", U.normalize_nfkc("visual"))
    both = rows.select("doc_id", "logical", F.explode(F.array(F.struct(F.lit("raw").alias("how"), F.col("visual").alias("t")), F.struct(F.lit("nfkc").alias("how"), F.col("nfkc").alias("t")))).alias("x"))
    return both.groupBy("x.how").agg(F.sum(F.length("x.t")).alias("chars"), F.sum(C.presentation_forms(F.col("x.t"))).alias("forms"), F.count_if(F.col("x.t") == F.reverse("logical")).alias("reversed"))


def mixed_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two totals in thousands, the second with a separator by the key's parity."""
    whole = F.floor(F.col("o_totalprice")).cast("long") + 1000
    grouped = lambda sep: F.concat((F.floor(whole / 1000) % 1000).cast("string"), F.lit(sep), F.lpad((whole % 1000).cast("string"), 3, "0"))
    text = F.concat(grouped(","), F.lit(" and "), F.when(F.col("o_orderkey") % 2 == 0, grouped(",")).otherwise(grouped(".")))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.mixed_separators(text).alias("mixed"))


def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("<b a='1' c=\"2\">&amp;"), F.col("text"), F.lit("</b>"))
    return table(spark, sf_dir, "documents").select("doc_id", C.escape_html(marked).alias("html"))


def color_css(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colors of four spaces from quantities and discounts in fifths."""
    part = lambda c: (F.col(c).cast("int") % 6 / 5.0).cast("double")
    space = F.element_at(F.array(*map(F.lit, ("gray", "rgb", "cmyk", "unknown"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    parts = F.array(part("l_quantity"), part("l_partkey"), part("l_suppkey"), part("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.rgb8(space, parts).alias("rgb"))
    return rows.select("l_orderkey", "l_linenumber", C.css_hex("rgb").alias("css"), C.worth_showing("rgb").alias("shown"))


def orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.col("l_partkey") % 7 - 3).cast("double"), (F.col("l_suppkey") % 5 - 2).cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.quarter_turns(a, b).alias("turn"))


def page_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", C.page_rotation(F.col("o_custkey").cast("int") % 25 * 45 - 540).alias("rotation"))


def media_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda name, m: (F.col(name) % m).cast("double")
    box = C.rect(c("l_partkey", 91), c("l_suppkey", 83), c("l_orderkey", 97), c("l_linenumber", 5))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.*")


def render_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = C.render_mode((F.col("l_partkey") % 11).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", mode.alias("mode"), C.is_visible_mode(mode).alias("visible"), C.visible_color(mode, F.col("l_returnflag"), F.col("l_linestatus")).alias("color"))


def judge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals from event numbers, so that every check fires somewhere."""
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        n.alias("event_id"),
        (n % 50).alias("glyph_count"),
        F.least(n % 50, n % 7 * (n % 3)).alias("unresolved"),
        F.lit(4).cast("long").alias("font_count"),
        F.when(n % 11 == 0, 1).otherwise(0).cast("long").alias("unmappable_fonts"),
        F.when(n % 13 == 0, n % 50).otherwise(0).alias("invisible_glyphs"),
        F.when(n % 17 == 0, 2).otherwise(0).cast("long").alias("residual_presentation_forms"),
        F.least(n % 50, n % 7 * (n % 3)).alias("replacement_chars"),
        (n % 61).alias("text_len"),
        F.greatest(n % 61 - 3, F.lit(0)).alias("visible_text_len"),
        (n % 19 == 0).alias("mixed_digit_separators"),
        (n % 5 / 4.0).cast("double").alias("image_coverage"),
    )
    out = detect.verdicts(rows)
    return out.select("event_id", "rank", "verdict", F.round("confidence", 6).alias("confidence"), F.size("reasons").alias("n_reasons"))


def mark_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks, marks on a space, presentation forms of marks, letters and letters with marks."""
    prepare(spark)
    kinds = F.array(*map(F.lit, ("\u064e", " \u0651\u064e", "\ufe76", "\u0628", "\u0628\u064e", "", "\u0301")))
    return table(spark, sf_dir, "part").select("p_partkey", U.is_mark(F.get(kinds, (F.col("p_partkey") % 7).cast("int"))).alias("mark"))


def hamza_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A composed overlay over hosts with one, two or no base letters, or composed already."""
    prepare(spark)
    hosts = F.array(*map(F.lit, ("\u0644\u0627", "\u0627\u0627", "\u0628", "\u0625", "\u0627")))
    return table(spark, sf_dir, "part").select("p_partkey", U.merge_overlay(F.get(hosts, (F.col("p_partkey") % 5).cast("int")), F.lit("\u0625")).alias("text"))


def text_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as UTF-16 with a mark, or as Latin-1 bytes."""
    wide = F.concat(F.expr("x'FEFF'"), F.encode(F.concat("p_name", F.lit(" \u0627")), "UTF-16BE"))
    data = F.when(F.col("p_partkey") % 2 == 0, wide).otherwise(F.encode(F.concat("p_name", F.lit("\u00e9")), "ISO-8859-1"))
    return table(spark, sf_dir, "part").select("p_partkey", C.text_string(data).alias("text"))


def encoding_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's item numbers set the code, each followed by as many names as its tax says."""
    one = lambda code, name: F.struct(code.cast("int").alias("code"), name.cast("string").alias("name"))
    items = F.array(one(F.col("p_partkey") % 258, F.lit(None)), one(F.lit(None), F.lit("a")), one(F.lit(None), F.lit("b")), one(F.lit(7), F.lit(None)), one(F.lit(None), F.lit("c")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(C.flatten_differences(items)).alias("d"))
    return rows.select("p_partkey", "d.*")


_N = "event_id % 50 AS g, least(event_id % 50, event_id % 7 * (event_id % 3)) AS u, event_id % 61 AS len, greatest(event_id % 61 - 3, 0) AS vis, event_id % 5 / 4.0 AS cov"
_digits = "٠١٢٣٤٥٦٧٨٩"
QUERIES = {
    f.__name__: f
    for f in (
        bidi_nfkc_roundtrip, logical_lines, text_direction, page_direction, tidy_whitespace, strip_tatweel, strip_mark_bases, unify_digits, presentation_forms, stranded_marks,
        extractor_scores, mixed_separators, html_escape, color_css, orientation, page_rotation, media_box, render_modes, judge_events, mark_glyphs, hamza_merge, text_strings, encoding_differences,
    )
}
ORACLE_SQL = {
    "mark_glyphs": "SELECT p_partkey, p_partkey % 7 IN (0, 1, 2, 6) AS mark FROM part",
    "hamza_merge": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN chr(1604) || chr(1573) WHEN 3 THEN chr(1573) WHEN 4 THEN chr(1573) END AS text FROM part",
    "text_strings": "SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' ' || chr(1575) ELSE chr(233) END AS text FROM part",
    "encoding_differences": """
WITH k AS (SELECT p_partkey, (p_partkey % 258)::INT AS c FROM part), d AS (SELECT p_partkey, c AS code, 'a' AS name FROM k UNION ALL SELECT p_partkey, c + 1, 'b' FROM k UNION ALL SELECT p_partkey, 7, 'c' FROM k)
SELECT p_partkey, code::INT AS code, name FROM d WHERE code <= 255""",
    "bidi_nfkc_roundtrip": _TRANSLITERATED + "SELECT doc_id, line, logical AS text FROM t",
    "logical_lines": _TRANSLITERATED + "SELECT doc_id, line, logical AS text FROM t",
    "text_direction": "SELECT doc_id, doc_id % 3 = 0 AS rtl FROM documents WHERE regexp_matches(text, '[A-Za-z]')",
    "page_direction": "SELECT doc_id % 7 AS page, bool_or(doc_id % 3 = 0) AS rtl FROM documents WHERE regexp_matches(text, '[A-Za-z]') GROUP BY 1",
    "tidy_whitespace": "SELECT doc_id, trim(regexp_replace(replace(text, chr(10), ' '), ' +', ' ', 'g')) AS text FROM documents",
    "strip_tatweel": _TRANSLITERATED + "SELECT doc_id, line, replace(logical, ' ', chr(1600) || ' ') AS text FROM t",
    "strip_mark_bases": _TRANSLITERATED + "SELECT doc_id, line, replace(logical, ' ', chr(1614) || ' ') AS text FROM t",
    "unify_digits": f"""SELECT o_orderkey, 'n ' || CASE WHEN length(o_orderkey::VARCHAR) = 1 THEN translate(o_orderkey::VARCHAR, '0123456789', '{_digits}') ELSE o_orderkey::VARCHAR END AS text FROM orders""",
    "presentation_forms": _TRANSLITERATED + "SELECT doc_id, line, length(replace(logical, ' ', ''))::BIGINT AS forms, 0::BIGINT AS left_over FROM t",
    "stranded_marks": _TRANSLITERATED + "SELECT doc_id, line, (length(logical) - length(replace(logical, ' ', '')))::BIGINT AS stranded, (length(logical) - length(replace(logical, ' ', '')))::BIGINT AS lost FROM t",
    "extractor_scores": _TRANSLITERATED
    + """SELECT how, sum(length(logical))::BIGINT AS chars, CASE how WHEN 'raw' THEN sum(length(replace(logical, ' ', ''))) ELSE 0 END::BIGINT AS forms, CASE how WHEN 'raw' THEN count_if(logical = '') ELSE count(*) END::BIGINT AS reversed
 FROM t, (VALUES ('raw'), ('nfkc')) AS h(how) GROUP BY how""",
    "mixed_separators": "SELECT o_orderkey, o_orderkey % 2 = 1 AS mixed FROM orders",
    "html_escape": """SELECT doc_id, '&lt;b a=&#39;1&#39; c=&quot;2&quot;&gt;&amp;amp;' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') || '&lt;/b&gt;' AS html FROM documents""",
    "color_css": """
WITH p AS (SELECT l_orderkey, l_linenumber, l_linenumber % 4 AS s, l_quantity::INT % 6 AS a, l_partkey % 6 AS b, l_suppkey % 6 AS c, l_linenumber % 6 AS k FROM lineitem),
v AS (SELECT l_orderkey, l_linenumber, CASE s WHEN 0 THEN a * 51 WHEN 1 THEN a * 51 WHEN 2 THEN round((5 - a) * (5 - k) * 10.2)::INT ELSE 0 END AS r,
 CASE s WHEN 0 THEN a * 51 WHEN 1 THEN b * 51 WHEN 2 THEN round((5 - b) * (5 - k) * 10.2)::INT ELSE 0 END AS g,
 CASE s WHEN 0 THEN a * 51 WHEN 1 THEN c * 51 WHEN 2 THEN round((5 - c) * (5 - k) * 10.2)::INT ELSE 0 END AS bl FROM p)
SELECT l_orderkey, l_linenumber, printf('#%02x%02x%02x', r, g, bl) AS css, (r + g + bl > 0 AND 2126 * r + 7152 * g + 722 * bl <= 2167500) AS shown FROM v""",
    "orientation": """
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey % 7 - 3 AS a, l_suppkey % 5 - 2 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN a = 0 AND b = 0 THEN 0 WHEN abs(a) > abs(b) THEN CASE WHEN a > 0 THEN 0 ELSE 2 END
 WHEN abs(a) = abs(b) AND a < 0 THEN 2 WHEN b > 0 THEN 1 ELSE 3 END AS turn FROM v""",
    "page_rotation": """
WITH v AS (SELECT o_orderkey, ((o_custkey % 25 * 45 - 540) % 360 + 360) % 360 AS t FROM orders) SELECT o_orderkey, CASE WHEN t IN (0, 90, 180, 270) THEN t ELSE 0 END::INT AS rotation FROM v""",
    "media_box": """
WITH v AS (SELECT l_orderkey, l_linenumber, (l_partkey % 91)::DOUBLE AS a, (l_suppkey % 83)::DOUBLE AS b, (l_orderkey % 97)::DOUBLE AS c, (l_linenumber % 5)::DOUBLE AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, least(a, c) AS x0, least(b, d) AS y0, greatest(a, c) AS x1, greatest(b, d) AS y1 FROM v""",
    "render_modes": """
WITH v AS (SELECT *, CASE WHEN l_partkey % 11 <= 7 THEN l_partkey % 11 ELSE 0 END::INT AS mode FROM lineitem)
SELECT l_orderkey, l_linenumber, mode, mode NOT IN (3, 7) AS visible, CASE WHEN mode IN (1, 5) THEN l_linestatus ELSE l_returnflag END AS color FROM v""",
    "judge_events": f"""
WITH e AS (SELECT event_id, {_N} FROM events),
c AS (SELECT *, CASE WHEN g = 0 THEN 0 ELSE 1 - u / g END AS rate, event_id % 13 = 0 AND g > 0 AS hidden, event_id % 11 = 0 AS unmapped, event_id % 17 = 0 AS forms, event_id % 19 = 0 AS mixed FROM e),
k AS (SELECT *, [rate < 0.5, rate >= 0.5 AND rate < 1, unmapped, forms, hidden, mixed, cov >= 0.5 AND vis <= 4, cov >= 0.5 AND vis > 4 AND len < 50, len < 2] AS t FROM c),
r AS (SELECT *, CASE WHEN g = 0 OR t[1] OR t[7] OR t[9] THEN 2 WHEN t[2] OR unmapped OR forms OR hidden OR mixed OR t[8] THEN 1 ELSE 0 END AS rank FROM k)
SELECT event_id, rank, ['ok', 'degraded', 'needs_ocr'][rank + 1] AS verdict,
 round(CASE WHEN rank = 2 THEN 0 ELSE greatest(0, least(1, rate - CASE WHEN len > 0 THEN least((CASE WHEN forms THEN 2 ELSE 0 END + u) / len, 0.5) ELSE 0 END - CASE WHEN unmapped THEN 0.05 ELSE 0 END - CASE WHEN hidden THEN 0.1 ELSE 0 END)) END, 6)::DOUBLE AS confidence,
 CASE WHEN g = 0 THEN 1 ELSE len(list_filter(t, lambda x: x)) END::INT AS n_reasons FROM r""",
}
