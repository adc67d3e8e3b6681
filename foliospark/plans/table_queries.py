"""Queries over table grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import grids as R
from foliospark.session import table


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order has a grid of 2 to 5 rows and 2 to 4 columns of 100 by 20 points, its rules doubled
    a point apart, and a far rule below."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 4 + 2).cast("int").alias("rows"), (F.col("o_custkey") % 3 + 2).cast("int").alias("cols"))
    rule = lambda x0, y0, x1, y1: F.struct(*(v.cast("double").alias(n) for v, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)))
    zero, w, h = F.lit(0), F.col("cols") * 100, F.col("rows") * 20
    across = F.transform(F.sequence(F.lit(0), F.col("rows")), lambda r: rule(zero, r * 20, w, r * 20))
    twice = F.transform(F.sequence(F.lit(0), F.col("rows")), lambda r: rule(zero, r * 20 + 1, w, r * 20 + 1))
    down = F.transform(F.sequence(F.lit(0), F.col("cols")), lambda c: rule(c * 100, zero, c * 100, h))
    far = F.array(rule(zero, F.lit(-400), w, F.lit(-400)))
    return o.select("doc_id", F.lit(1).alias("page"), F.explode(F.concat(across, twice, down, far)).alias("r")).select("doc_id", "page", "r.*")


_GRID = "WITH o AS (SELECT o_orderkey AS doc_id, (o_custkey % 4 + 2)::INT AS rows, (o_custkey % 3 + 2)::INT AS cols FROM orders)"


def ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = R.find_ruled(_rules(spark, sf_dir))
    return g.select("doc_id", "grid_id", (F.size("ys") - 1).alias("rows"), (F.size("xs") - 1).alias("cols"), F.round("confidence", 6).alias("confidence"), "ruled")


def merged_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_rules(_rules(spark, sf_dir)).select("doc_id", "upright", "at", "low", "high")


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of fixed cells for each order; odd orders read right to left."""
    o = table(spark, sf_dir, "orders")
    edges = lambda n, step: F.transform(F.sequence(F.lit(0), n), lambda k: (k * step).cast("double"))
    cols, rows = (F.col("o_custkey") % 3 + 2).cast("int"), (F.col("o_custkey") % 4 + 2).cast("int")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("grid_id"), edges(cols, 100).alias("xs"), F.reverse(edges(rows, 20)).alias("ys"), (F.col("o_orderkey") % 2 == 1).alias("rtl"))


def cell_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cell_boxes(_grids(spark, sf_dir)).select("doc_id", "row", "column", "x0", "y0", "x1", "y1")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item is a line of 10 by 4 points; middles fall on shared edges now and then."""
    x, y = (F.col("l_partkey") % 400).cast("double"), (F.col("l_suppkey") % 100).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_partkey").alias("line"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("text"), y.alias("baseline"), (x - 5).alias("x0"), (y - 2).alias("y0"), (x + 5).alias("x1"), (y + 2).alias("y1")
    )


def _left_to_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cell_boxes(_grids(spark, sf_dir).withColumn("rtl", F.lit(False)))


def fill_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fill_cells(_left_to_right(spark, sf_dir), _lines(spark, sf_dir)).where("text <> ''").select("doc_id", "row", "column", "text")


def plausible_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose row and column meet the key's parity, or any where the key divides by three, are full."""
    cells = _left_to_right(spark, sf_dir)
    full = (F.col("doc_id") % 3 == 0) | ((F.col("row") + F.col("column")) % 4 == F.col("doc_id") % 4)
    return R.plausible(cells.withColumn("text", F.when(full, "x").otherwise(""))).select("doc_id", "cells", "filled")


_CELLS = _GRID + ", c AS (SELECT doc_id, rows, cols, unnest(range(rows))::INT AS row FROM o), k AS (SELECT *, unnest(range(cols))::INT AS \"column\" FROM c)"


def borderless_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's page has 4 to 12 rows of 3 to 6 columns of items, aligned, without rules."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 9 + 4).cast("int").alias("rows"), (F.col("c_custkey") % 4 + 3).cast("int").alias("cols"))
    c = c.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r")).select("*", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("k"))
    x, y = F.col("k") * 60.0, 700.0 - 14 * F.col("r")
    items = c.select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("r") * 10 + F.col("k")).alias("item"), x.alias("x0"), (x + 30).alias("x1"), y.alias("y0"), (y + 10).alias("y1"), F.lit(10.0).alias("size"))
    g = R.find_borderless(items)
    return g.select("doc_id", (F.size("ys") - 1).alias("rows"), (F.size("xs") - 1).alias("cols"), "confidence", "ruled")


def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c, m: (F.col(c) % m).cast("double")
    x, y = n("l_partkey", 300), n("l_suppkey", 90)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_partkey").alias("grid_id"), (F.col("l_linenumber") % 2 == 0).alias("ruled"), x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 30).alias("y1"))


def accepted_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.accept_grids(_inferred(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("grids"), F.count_if("ruled").alias("ruled"))


def line_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("grid_id"))
    return R.owners(claims).select("doc_id", "line", "grid_id")


def row_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 14 points apart; an extra 100 points at the seventh row make two bands."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), (F.col("c_custkey") % 9 + 4).cast("int"))).alias("r"))
    rows = c.select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), "r", (700.0 - 14 * F.col("r") - F.when(F.col("r") >= 7, 100).otherwise(0)).alias("baseline"))
    return R.row_bands(rows).select("doc_id", "r", "band")


QUERIES = {f.__name__: f for f in (ruled_tables, merged_rules, cell_boxes, fill_cells, plausible_tables, borderless_tables, accepted_grids, line_owners, row_bands)}
ORACLE_SQL = {
    "ruled_tables": _GRID + "SELECT doc_id, 0 AS grid_id, rows, cols, 1.0::DOUBLE AS confidence, true AS ruled FROM o",
    "merged_rules": _GRID
    + """SELECT doc_id, false AS upright, (unnest(range(rows + 1)) * 20)::DOUBLE AS at, 0::DOUBLE AS low, (cols * 100)::DOUBLE AS high FROM o
 UNION ALL SELECT doc_id, true, (unnest(range(cols + 1)) * 100)::DOUBLE, 0::DOUBLE, (rows * 20)::DOUBLE FROM o UNION ALL SELECT doc_id, false, -400::DOUBLE, 0::DOUBLE, (cols * 100)::DOUBLE FROM o""",
    "cell_boxes": _CELLS
    + """, a AS (SELECT *, CASE WHEN doc_id % 2 = 1 THEN cols - 1 - "column" ELSE "column" END AS p FROM k)
SELECT doc_id, row, "column", (p * 100)::DOUBLE AS x0, ((rows - row - 1) * 20)::DOUBLE AS y0, (p * 100 + 100)::DOUBLE AS x1, ((rows - row) * 20)::DOUBLE AS y1 FROM a""",
    "fill_cells": _CELLS
    + """SELECT k.doc_id, row, "column", string_agg('p' || l_partkey, ' ' ORDER BY l_suppkey % 100 DESC, l_partkey % 400, l_partkey) AS text FROM k JOIN lineitem ON l_orderkey = k.doc_id
 AND l_partkey % 400 BETWEEN "column" * 100 AND "column" * 100 + 100 AND l_suppkey % 100 BETWEEN (rows - row - 1) * 20 AND (rows - row) * 20 GROUP BY k.doc_id, row, "column\"""",
    "plausible_tables": _CELLS
    + """, f AS (SELECT doc_id, count(*) AS cells, count_if(doc_id % 3 = 0 OR (row + "column") % 4 = doc_id % 4) AS filled FROM k GROUP BY doc_id)
SELECT doc_id, cells, filled::BIGINT AS filled FROM f WHERE filled >= 4 AND 2 * filled >= cells""",
    "borderless_tables": """
SELECT c_custkey AS doc_id, (c_custkey % 9 + 4)::INT AS rows, (c_custkey % 4 + 3)::INT AS cols, 0.5::DOUBLE AS confidence, false AS ruled FROM customer WHERE c_custkey % 9 >= 1 AND c_custkey % 4 >= 1""",
    "accepted_grids": """
WITH g AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 = 0 AS ruled, l_partkey % 300 AS x, l_suppkey % 90 AS y FROM lineitem),
k AS (SELECT * FROM g WHERE ruled OR NOT EXISTS (SELECT 1 FROM g r WHERE r.ruled AND r.doc_id = g.doc_id AND abs(r.x - g.x) < 60 AND abs(r.y - g.y) < 30))
SELECT doc_id, count(*) AS grids, count_if(ruled)::BIGINT AS ruled FROM k GROUP BY doc_id""",
    "line_owners": "SELECT l_orderkey AS doc_id, l_linenumber AS line, min(l_partkey) AS grid_id FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "row_bands": "WITH r AS (SELECT c_custkey AS doc_id, unnest(range((c_custkey % 9 + 5)::INT))::INT AS r FROM customer) SELECT doc_id, r, CASE WHEN r >= 7 THEN 1 ELSE 0 END::BIGINT AS band FROM r",
}
