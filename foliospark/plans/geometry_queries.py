"""Queries over glyphs and boxes that are whole-number functions of the driver's keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import columns as C
from foliospark.operators import geometry as G
from foliospark.operators import lines as L
from foliospark.session import table

LINE = ("doc_id", "page", "line")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with ``n``, a number within its order, for line numbers repeat."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order))


ITEMS = "li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS n FROM lineitem)"


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a page, its items are glyphs: three baselines 14 apart, drift below 3."""
    d = lambda c: c.cast("double")
    return items(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"),
        F.lit(1).alias("page"),
        F.col("n").cast("long").alias("glyph_idx"),
        d(F.col("l_partkey") % 400).alias("x"),
        d(700 - 14 * (F.col("n") % 3) + F.col("l_suppkey") % 3).alias("y"),
        d(F.col("l_partkey") % 400).alias("along"),
        d(700 - 14 * (F.col("n") % 3) + F.col("l_suppkey") % 3).alias("across"),
        F.lit(6.0).alias("advance"),
        F.lit(12.0).alias("size"),
        F.lit(0).alias("turn"),
        F.when(F.col("l_partkey") % 5 == 0, " ").otherwise("a").alias("text"),
        F.concat(F.lit("F"), (F.col("l_suppkey") % 2).cast("string")).alias("font"),
        F.lit(0).alias("mode"),
        F.lit("#000000").alias("color"),
    )


_GLYPHS = (
    """
WITH """
    + ITEMS
    + """, g AS (SELECT l_orderkey AS doc_id, 1 AS page, n::BIGINT AS glyph_idx, l_partkey % 400 AS x, 700 - 14 * (n % 3) + l_suppkey % 3 AS y, n % 3 AS band,
  CASE WHEN l_partkey % 5 = 0 THEN ' ' ELSE 'a' END AS text, 'F' || (l_suppkey % 2) AS font FROM li),
ln AS (SELECT *, (dense_rank() OVER (PARTITION BY doc_id ORDER BY band) - 1)::INT AS line FROM g)
"""
)


def _lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.group_lines(_glyphs(spark, sf_dir))


def line_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lined(spark, sf_dir).select("doc_id", "page", "glyph_idx", "line")


def line_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.line_boxes(_lined(spark, sf_dir))


def word_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.word_gaps(_lined(spark, sf_dir)).select("doc_id", "page", "line", "glyph_idx", "gap_before")


def dominant_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dominant_styles(_lined(spark, sf_dir)).select("doc_id", "page", "line", "font", "votes")


def mark_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth item is a mark without advance."""
    mark = F.col("glyph_idx") % 4 == 0
    rows = _glyphs(spark, sf_dir).withColumns({"is_mark": mark, "advance": F.when(mark, 0.0).otherwise(60.0)})
    return G.mark_hosts(rows).select("doc_id", "glyph_idx", "host_across")


def actual_text_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spans for each order, the second over the first's end."""
    glyphs = _glyphs(spark, sf_dir).select("doc_id", "page", "glyph_idx")
    span = lambda seq, a, b, t: F.struct(F.lit(seq).alias("seq"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text"))
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.explode(F.array(span(0, 1, 4, "first"), span(1, 3, 6, "second"))).alias("s")).select("doc_id", "page", "s.*")
    return G.apply_actual_text(glyphs, spans).select("doc_id", "glyph_idx", "actual")


def glyphs_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("box_id"), F.lit(97.0).alias("x0"), F.lit(686.0).alias("y0"), F.lit(303.0).alias("x1"), F.lit(702.0).alias("y1")
    )
    return G.text_within(_glyphs(spark, sf_dir), boxes).select("doc_id", "box_id", "glyph_idx")


def widest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _glyphs(spark, sf_dir).select("doc_id", "page", F.col("x").alias("low"), (F.col("x") + 6).alias("high"))
    return G.widest_gaps(spans, 10.0).select("doc_id", "width", "at")


def xy_cut_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a page of 1 to 4 cards of six lines; even customers read right to left."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 4 + 1).cast("int").alias("cards"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("cards") - 1)).alias("card")).select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("row"))
    x, y = F.col("card") * 150.0, 700.0 - 13 * F.col("row")
    items = rows.select(
        F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("row") * 10 + F.col("card")).cast("long").alias("item"), x.alias("x0"), (x + 110).alias("x1"), (y - 3).alias("y0"), (y + 9).alias("y1"),
        F.lit(12.0).alias("size"), (F.col("c_custkey") % 2 == 0).alias("rtl"),
    )
    return G.xy_cut(items).select("doc_id", "item", "region")


def _elements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each item is an element with its number as content id, every third one inline; it covers four
    glyphs, and pages of even orders have too many other glyphs."""
    li = items(spark, sf_dir)
    key = F.col("l_orderkey").alias("doc_id")
    n = F.col("n").cast("long")
    elements = li.select(key, n.alias("seq"), F.when(n % 3 == 0, "Span").otherwise("Para").alias("tag"), F.when(n % 2 == 0, F.lit(1)).alias("page"), F.array(n.cast("int")).alias("mcids"))
    spans = li.select(key, F.lit(1).alias("page"), n.cast("int").alias("mcid"), (4 * (40 - n)).alias("start"), (4 * (40 - n) + 4).alias("end"))
    pages = li.groupBy(key).agg((4 * F.count("*") * F.when(F.first("l_orderkey") % 2 == 0, 2).otherwise(1)).alias("n_glyphs")).withColumn("page", F.lit(1))
    return elements, spans, pages


def reading_order_from_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, spans, pages = _elements(spark, sf_dir)
    roles = elements.select("doc_id").distinct().select("doc_id", F.lit("Para").alias("tag"), F.lit("P").alias("role"))
    out = G.reading_order(G.translate_roles(elements, roles), spans, pages)
    return out.select("doc_id", "tag", "start", "end")


def tagged_glyph_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, spans, pages = _elements(spark, sf_dir)
    return G.glyph_indices(G.reading_order(elements, spans, pages)).groupBy("doc_id").agg(F.count("*").alias("glyphs"), F.min("glyph_idx").alias("first"), F.max("glyph_idx").alias("last"))


def rules_from_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c, m: (F.col(c) % m).cast("double")
    x, y = n("l_partkey", 50), n("l_suppkey", 40)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.rule_of(F.col("l_linenumber") % 2 == 0, x, y, x + n("l_orderkey", 9), y + n("l_partkey", 7)).alias("r"))
    return rows.where("r IS NOT NULL").select("l_orderkey", "l_linenumber", "r.*")


def _ctm():
    n = lambda c, m: (F.col(c) % m).cast("double")
    return F.struct((n("l_partkey", 300) + 1).alias("a"), (n("l_suppkey", 3) - 1).alias("b"), (n("l_orderkey", 5) - 2).alias("c"), (n("l_partkey", 200) + 1).alias("d"), (n("l_suppkey", 700) - 50).alias("e"), (n("l_partkey", 900) - 50).alias("f"))


_BOXED = """
WITH """ + ITEMS + """, m AS (SELECT l_orderkey AS doc_id, l_linenumber, n, l_partkey % 300 + 1 AS a, l_suppkey % 3 - 1 AS b, l_orderkey % 5 - 2 AS c, l_partkey % 200 + 1 AS d, l_suppkey % 700 - 50 AS e, l_partkey % 900 - 50 AS f FROM li),
bx AS (SELECT doc_id, l_linenumber, n, least(e, e + a, e + c, e + a + c) AS x0, least(f, f + b, f + d, f + b + d) AS y0, greatest(e, e + a, e + c, e + a + c) AS x1, greatest(f, f + b, f + d, f + b + d) AS y1 FROM m),
v AS (SELECT *, greatest(least(x1, 600) - greatest(x0, 0), 0) * greatest(least(y1, 800) - greatest(y0, 0), 0) AS shown FROM bx)
"""


def image_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's images are drawn once for each of its items of that number; odd ones never."""
    li = items(spark, sf_dir)
    name = F.concat(F.lit("Im"), F.col("n").cast("string"))
    images = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), name.alias("name"))
    uses = li.where("n % 2 = 0").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), name.alias("name"), _ctm().alias("ctm"), F.col("n").alias("glyph_idx"))
    return G.place_images(images, uses).select("doc_id", "name", "box.*")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), "l_linenumber", C.placement(_ctm()).alias("box"))


def _sheet():
    return F.struct(*(F.lit(v).alias(k) for k, v in (("x0", 0.0), ("y0", 0.0), ("x1", 600.0), ("y1", 800.0))))


def image_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), _sheet().alias("page_box"))
    return G.page_coverage(_boxes(spark, sf_dir), pages).select("doc_id", F.round(F.col("coverage") * 480000).cast("long").alias("covered"))


def backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.struct(*(F.lit(v).alias(k) for k, v in (("x0", 0.0), ("y0", 0.0), ("x1", 300.0), ("y1", 200.0))))
    return _boxes(spark, sf_dir).select("doc_id", "l_linenumber", C.is_background(F.col("box"), wide).alias("background"))


def block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), "l_linenumber", "l_partkey")
    return G.number_blocks(blocks, F.desc("l_partkey"), "l_linenumber").select("doc_id", "l_linenumber", "reading_index")


def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(G.upper_median(F.collect_list("l_quantity")).alias("median"))
    return rows


def overlay_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth item is an overlay without advance."""
    loose = F.col("glyph_idx") % 4 == 0
    rows = _glyphs(spark, sf_dir).withColumns({"is_mark": F.lit(False), "advance": F.when(loose, 0.0).otherwise(60.0)})
    return G.overlay_anchors(rows).select("doc_id", "glyph_idx", "along", "across")


def along_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, x, y = F.col("n") % 4, (F.col("l_partkey") % 400).cast("double") + 1, (F.col("l_suppkey") % 90).cast("double") + 1
    return items(spark, sf_dir).select("l_orderkey", "n", C.along(turn, x, y).alias("along"), C.across(turn, x, y).alias("across"))


def lines_from_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a line of letters in key order; gaps between them begin words; one code in eleven is lost."""
    rows = _glyphs(spark, sf_dir).withColumns(
        {"y": F.lit(100.0), "x": F.col("glyph_idx") * 6.0 + F.floor(F.col("glyph_idx") / 3) * 3.0, "text": F.when(F.col("x") % 11 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("a")))}
    )
    return L.build_lines(rows).select("doc_id", "line", "text", "baseline", "x0", "y0", "x1", "y1", "rtl", "unresolved", "glyphs")


QUERIES = {
    f.__name__: f
    for f in (
        overlay_anchors, along_across, lines_from_glyphs,
        line_grouping, line_bbox, word_gaps, dominant_style, mark_hosts, actual_text_overlay, glyphs_in_boxes, widest_gap, xy_cut_regions, reading_order_from_tags,
        tagged_glyph_order, rules_from_rects, image_placement, image_coverage, backgrounds, block_index, upper_medians,
    )
}
_TAGS = """
WITH """ + ITEMS + """, e AS (SELECT l_orderkey AS doc_id, n, sum(CASE WHEN n % 3 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY n) AS run,
  CASE WHEN n % 3 = 0 THEN 'Span' ELSE 'P' END AS tag FROM li WHERE l_orderkey % 2 = 1)
"""
ORACLE_SQL = {
    "overlay_anchors": _GLYPHS
    + """SELECT m.doc_id, m.glyph_idx, arg_min(h.x, h.glyph_idx)::DOUBLE AS along, arg_min(h.y, h.glyph_idx)::DOUBLE AS across FROM g m JOIN g h ON m.doc_id = h.doc_id AND m.glyph_idx % 4 = 0 AND h.glyph_idx % 4 <> 0
 AND abs(h.glyph_idx - m.glyph_idx) <= 8 AND abs(h.y - m.y) <= 12 AND h.x < m.x AND m.x < h.x + 60 GROUP BY m.doc_id, m.glyph_idx""",
    "along_across": "WITH " + ITEMS + """, v AS (SELECT l_orderkey, n, (l_partkey % 400 + 1)::DOUBLE AS x, (l_suppkey % 90 + 1)::DOUBLE AS y FROM li)
SELECT l_orderkey, n, CASE n % 4 WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN -x ELSE -y END AS along, CASE n % 4 WHEN 0 THEN y WHEN 1 THEN -x WHEN 2 THEN -y ELSE x END AS across FROM v""",
    "lines_from_glyphs": _GLYPHS
    + """, v AS (SELECT doc_id, glyph_idx AS n, glyph_idx * 6 + glyph_idx // 3 * 3 AS px, x % 11 = 0 AS lost FROM g)
SELECT doc_id, 0 AS line, string_agg(CASE WHEN n % 3 = 0 AND n > 1 THEN ' ' ELSE '' END || CASE WHEN lost THEN chr(65533) ELSE 'a' END, '' ORDER BY n) AS text, 100::DOUBLE AS baseline, min(px)::DOUBLE AS x0, 97::DOUBLE AS y0,
 max(px + 6)::DOUBLE AS x1, 109::DOUBLE AS y1, false AS rtl, count_if(lost)::INT AS unresolved, count(*)::INT AS glyphs FROM v GROUP BY doc_id""",
    "line_grouping": _GLYPHS + "SELECT doc_id, page, glyph_idx, line FROM ln",
    "line_bbox": _GLYPHS + "SELECT doc_id, page, line, min(x)::DOUBLE AS x0, min(y - 3)::DOUBLE AS y0, max(x + 6)::DOUBLE AS x1, max(y + 9)::DOUBLE AS y1 FROM ln GROUP BY doc_id, page, line",
    "word_gaps": _GLYPHS
    + """, w AS (SELECT *, max(x + 6) OVER (PARTITION BY doc_id, line ORDER BY x, glyph_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge,
 lag(text) OVER (PARTITION BY doc_id, line ORDER BY x, glyph_idx) AS before, bool_or(text = ' ') OVER (PARTITION BY doc_id, line) AS painted FROM ln)
SELECT doc_id, page, line, glyph_idx, coalesce((x - edge) * 100 > CASE WHEN painted THEN 300 ELSE 180 END AND before <> ' ', false) AS gap_before FROM w""",
    "dominant_style": _GLYPHS
    + """, c AS (SELECT doc_id, page, line, font, count(*) AS votes, min(glyph_idx) AS f FROM ln GROUP BY doc_id, page, line, font)
SELECT doc_id, page, line, font, votes FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY votes DESC, f) = 1""",
    "mark_hosts": _GLYPHS
    + """SELECT m.doc_id, m.glyph_idx, arg_min(h.y, abs(h.y - m.y) * 100 + h.glyph_idx)::DOUBLE AS host_across FROM g m JOIN g h ON m.doc_id = h.doc_id AND m.glyph_idx % 4 = 0 AND h.glyph_idx % 4 <> 0
 AND abs(h.y - m.y) <= 12 AND m.x BETWEEN h.x AND h.x + 60 GROUP BY m.doc_id, m.glyph_idx""",
    "actual_text_overlay": "WITH " + ITEMS + "SELECT l_orderkey AS doc_id, n::BIGINT AS glyph_idx, CASE n WHEN 1 THEN 'first' WHEN 2 THEN '' WHEN 3 THEN 'second' WHEN 4 THEN '' WHEN 5 THEN '' END AS actual FROM li",
    "glyphs_in_boxes": _GLYPHS + "SELECT doc_id, 0 AS box_id, glyph_idx FROM g WHERE x + 3 BETWEEN 97 AND 303 AND y BETWEEN 686 AND 702",
    "widest_gap": _GLYPHS
    + """, w AS (SELECT doc_id, x, max(x + 6) OVER (PARTITION BY doc_id ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, min(x) OVER (PARTITION BY doc_id) AS s, max(x + 6) OVER (PARTITION BY doc_id) AS e FROM g)
SELECT doc_id, (x - reach)::DOUBLE AS width, reach::DOUBLE AS at FROM w WHERE x > reach AND reach - s >= 10 AND e - x >= 10 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY x - reach DESC, x) = 1""",
    "xy_cut_regions": """
WITH c AS (SELECT c_custkey AS doc_id, c_custkey % 4 + 1 AS cards, unnest(range(c_custkey % 4 + 1)) AS card FROM customer), r AS (SELECT *, unnest(range(6)) AS row FROM c)
SELECT doc_id, (row * 10 + card)::BIGINT AS item, (CASE WHEN doc_id % 2 = 0 THEN cards - 1 - card ELSE card END)::INT AS region FROM r""",
    "reading_order_from_tags": _TAGS + """SELECT doc_id, first_value(tag) OVER (PARTITION BY doc_id, run ORDER BY n) AS tag, (4 * (40 - n))::BIGINT AS start, (4 * (40 - n) + 4)::BIGINT AS "end" FROM e""",
    "tagged_glyph_order": _TAGS + "SELECT doc_id, 4 * count(*) AS glyphs, min(4 * (40 - n))::BIGINT AS first, max(4 * (40 - n) + 3)::BIGINT AS last FROM e GROUP BY doc_id",
    "rules_from_rects": """
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS x, l_suppkey % 40 AS y, l_orderkey % 9 AS w, l_partkey % 7 AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 OR h <= 3 AND w > h THEN x ELSE x + w / 2 END::DOUBLE AS x0, CASE WHEN l_linenumber % 2 = 1 THEN y WHEN h <= 3 AND w > h THEN y + h / 2 ELSE y END::DOUBLE AS y0,
 CASE WHEN l_linenumber % 2 = 1 OR h <= 3 AND w > h THEN x + w ELSE x + w / 2 END::DOUBLE AS x1, CASE WHEN l_linenumber % 2 = 1 THEN y + h WHEN h <= 3 AND w > h THEN y + h / 2 ELSE y + h END::DOUBLE AS y1
FROM v WHERE CASE WHEN l_linenumber % 2 = 1 THEN least(w, h) = 0 AND greatest(w, h) >= 4 ELSE (h <= 3 AND w > h AND w >= 4) OR (w <= 3 AND h > w AND h >= 4) END""",
    "image_placement": _BOXED
    + """SELECT doc_id, 'Im' || n AS name, CASE WHEN n % 2 = 0 THEN x0 END::DOUBLE AS x0, CASE WHEN n % 2 = 0 THEN y0 END::DOUBLE AS y0,
 CASE WHEN n % 2 = 0 THEN x1 END::DOUBLE AS x1, CASE WHEN n % 2 = 0 THEN y1 END::DOUBLE AS y1 FROM bx""",
    "image_coverage": _BOXED + "SELECT o_orderkey AS doc_id, least(coalesce(sum(shown), 0), 480000)::BIGINT AS covered FROM orders LEFT JOIN v ON o_orderkey = doc_id GROUP BY o_orderkey",
    "backgrounds": _BOXED
    + "SELECT doc_id, l_linenumber, 10 * (greatest(least(x1, 300) - greatest(x0, 0), 0) * greatest(least(y1, 200) - greatest(y0, 0), 0)) >= 420000 AS background FROM bx",
    "block_index": "SELECT l_orderkey AS doc_id, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey DESC, l_linenumber) - 1)::INT AS reading_index FROM lineitem",
    "upper_medians": "WITH s AS (SELECT l_orderkey AS doc_id, list_sort(list(l_quantity)) AS q FROM lineitem GROUP BY l_orderkey) SELECT doc_id, q[len(q) // 2 + 1] AS median FROM s",
}
