"""Table operators: grids of a page, their cells, and what fills them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.grids import borderless_grids, merged, ruled_grids
from foliospark.functions.layout import Boxes
from foliospark.operators.geometry import KEYS, banded
from foliospark.operators.groups import by_page
from foliospark.params import PARAMS, Params

_GRID = "grid_id int, xs array<double>, ys array<double>, confidence double, ruled boolean"


def _rows(grids) -> list[tuple]:
    return [(i, g.xs, g.ys, g.confidence, g.ruled) for i, g in enumerate(grids)]


def find_ruled(rules: DataFrame, p: Params = PARAMS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Grids of painted rules (x0, y0, x1, y1)."""
    return by_page(rules, keys, ("x0", "y0", "x1", "y1"), _GRID, lambda c: _rows(ruled_grids(np.stack(c, 1), p)))


def find_borderless(items: DataFrame, p: Params = PARAMS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Grids of aligned boxes (item, x0, x1, y0, y1, size)."""

    def find(c: list) -> list[tuple]:
        order = np.argsort(c[0], kind="stable")
        return _rows(borderless_grids(Boxes(*(x[order] for x in c[1:])), p))

    return by_page(items, keys, ("item", "x0", "x1", "y0", "y1", "size"), _GRID, find)


def merge_rules(rules: DataFrame, p: Params = PARAMS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, upright, at, low, high): rules within the tolerance of the first of a run are one. Where a
    run begins depends on where the one before began, so a page's rules are folded in one pass."""

    def fold(c: list) -> list[tuple]:
        x, y = np.sort([c[0], c[2]], axis=0), np.sort([c[1], c[3]], axis=0)
        upright = x[1] - x[0] <= y[1] - y[0]
        found = []
        for side, at, span in ((False, y, x), (True, x, y)):
            own = upright == side
            low, high = span[0][own], span[1][own]
            order = np.lexsort((high, low))  # equal places in a fixed order
            found += [(side, *m) for m in merged(at.mean(0)[own][order], low[order], high[order], p.merge_tolerance).tolist()]
        return found

    return by_page(rules, keys, ("x0", "y0", "x1", "y1"), "upright boolean, at double, low double, high double", fold)


def cell_boxes(grids: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A row for each cell of grids (grid_id, xs, ys, rtl); columns count from the side where reading
    begins."""
    n = F.size("xs") - 1
    rows = grids.where((F.size("xs") > 1) & (F.size("ys") > 1)).select(*keys, "grid_id", "rtl", "xs", "ys", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("ys") - 2)).alias("row"))
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("column"))
    at = F.when(F.col("rtl"), F.col("n") - 1 - F.col("column")).otherwise(F.col("column"))
    return cells.select(*keys, "grid_id", "row", "column", F.get("xs", at).alias("x0"), F.get("ys", F.col("row") + 1).alias("y0"), F.get("xs", at + 1).alias("x1"), F.get("ys", "row").alias("y1"))


def fill_cells(cells: DataFrame, lines: DataFrame, rtl: bool = False, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, grid_id, row, column, text): lines (line, text, baseline, x0, y0, x1, y1) whose middle lies in
    a cell, edges included, from the top and in reading direction."""
    lines, cells = banded(lines, (F.col("y0") + F.col("y1")) / 2, cells, F.col("y0"), F.col("y1"), keys)
    a, b = cells.alias("c"), lines.alias("l")
    x, y = (F.col("l.x0") + F.col("l.x1")) / 2, (F.col("l.y0") + F.col("l.y1")) / 2
    on = F.lit(True)
    for k in (*keys, "band"):
        on = on & (F.col(f"c.{k}") == F.col(f"l.{k}"))
    on = on & x.between(F.col("c.x0"), F.col("c.x1")) & y.between(F.col("c.y0"), F.col("c.y1"))
    side = -F.col("l.x0") if rtl else F.col("l.x0")
    hit = F.when(F.col("l.line").isNotNull(), F.struct((-F.col("l.baseline")).alias("down"), side.alias("side"), F.col("l.line").alias("line"), F.col("l.text").alias("text")))
    joined = a.join(b, on, "left").groupBy(*(F.col(f"c.{k}") for k in keys), F.col("c.grid_id"), F.col("c.row"), F.col("c.column")).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    return joined.select(*keys, "grid_id", "row", "column", F.array_join(F.transform("hits", lambda h: h["text"]), " ").alias("text"))


def plausible(filled: DataFrame, p: Params = PARAMS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, grid_id, cells, filled): grids with enough filled cells to be tables."""
    counts = filled.groupBy(*keys, "grid_id").agg(F.count("*").alias("cells"), F.count_if(F.col("text") != "").alias("filled"))
    return counts.where((F.col("filled") >= p.filled_cells) & (F.col("filled") >= p.filled_share * F.col("cells")))


def accept_grids(grids: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """All ruled grids, and the inferred ones (box fields x0 to y1) that no ruled one overlaps."""
    ruled = grids.where("ruled").select(*keys, *(F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")))
    hit = (F.col("x0") < F.col("r_x1")) & (F.col("r_x0") < F.col("x1")) & (F.col("y0") < F.col("r_y1")) & (F.col("r_y0") < F.col("y1"))
    on = hit
    a, b = grids.where("NOT ruled").alias("a"), ruled.alias("b")
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return grids.where("ruled").unionByName(a.join(b, on, "left_anti").select("a.*"))


def owners(claims: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, line, grid_id): of the grids that claim a line the first owns it."""
    return claims.groupBy(*keys, "line").agg(F.min("grid_id").alias("grid_id"))


def row_bands(rows: DataFrame, p: Params = PARAMS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds ``band`` to rows (baseline): a step far beyond the page's typical one begins a new band."""
    order = Window.partitionBy(*keys).orderBy(F.desc("baseline"))
    step = F.lag("baseline").over(order) - F.col("baseline")
    from foliospark.operators.geometry import upper_median

    stepped = rows.withColumn("step", step)
    typical = F.greatest(upper_median(F.filter(F.collect_list("step").over(Window.partitionBy(*keys)), lambda x: x.isNotNull())), F.lit(1.0))
    fresh = F.coalesce((F.col("step") > typical * p.band_outlier).cast("int"), F.lit(0))
    marked = stepped.withColumn("fresh", fresh)
    return marked.withColumn("band", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("step", "fresh")
