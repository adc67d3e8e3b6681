"""Glyph and box operators over tables: lines, gaps, styles, hosts, placements.

Every operator works within a page, given by ``keys`` (doc_id and page unless said otherwise), so
joins and windows are hashed by page and a page's rows are all that any task sorts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import columns as C
from foliospark.params import PARAMS, Params

KEYS = ("doc_id", "page")


def upper_median(values: Column) -> Column:
    """The middle of a sorted array, the upper one of two."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def group_lines(glyphs: DataFrame, p: Params = PARAMS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds ``line`` (from 0, top to bottom) to glyphs (glyph_idx, along, across, size, turn).

    A fold over the page's glyphs in order: a line's drift is measured from its first glyph, so
    gaps between neighbours can't tell lines apart."""
    row = F.struct((-F.col("across")).alias("down"), "along", F.col("glyph_idx").cast("bigint").alias("glyph_idx"), "across", F.col("turn").cast("int").alias("turn"), F.greatest(F.col("size") * p.line_drift, F.lit(p.least_drift)).alias("most"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).cast("double").alias("anchor"), F.lit(-1).cast("int").alias("turn"), F.array().cast("array<int>").alias("begins"))

    def step(acc: Column, g: Column) -> Column:
        fresh = (acc["at"] == 0) | (g["turn"] != acc["turn"]) | (F.abs(g["across"] - acc["anchor"]) > g["most"])
        return F.struct(  # only the places where lines begin are kept, so a page's fold stays linear
            (acc["at"] + 1).alias("at"), F.when(fresh, g["across"]).otherwise(acc["anchor"]).alias("anchor"), F.when(fresh, g["turn"]).otherwise(acc["turn"]).alias("turn"), F.when(fresh, F.concat(acc["begins"], F.array(acc["at"]))).otherwise(acc["begins"]).alias("begins")
        )

    pages = glyphs.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_all")).withColumn("_begins", F.aggregate("_all", start, step)["begins"])
    lines = pages.select(*keys, "_begins", F.posexplode("_all").alias("_at", "_g"))
    number = F.size(F.filter("_begins", lambda x: x <= F.col("_at"))) - 1
    lines = lines.select(*keys, F.col("_g.glyph_idx").alias("glyph_idx"), number.alias("line"))
    return glyphs.join(lines, [*keys, "glyph_idx"])


def word_gaps(glyphs: DataFrame, p: Params = PARAMS, keys: tuple[str, ...] = (*KEYS, "line")) -> DataFrame:
    """Adds ``gap_before``: whether a word begins at this glyph. Glyphs: glyph_idx, along, advance,
    size, text. A line that paints spaces needs wider gaps."""
    line = Window.partitionBy(*keys)
    order = line.orderBy("along", "glyph_idx")
    edge = F.max(F.col("along") + F.col("advance")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    painted = F.bool_or((F.col("text") != "") & F.col("text").rlike(f"^{C.WHITE}+$")).over(line)
    share = F.when(painted, p.word_gap).otherwise(p.word_gap_inferred)
    after_space = F.coalesce(F.lag("text").over(order) == " ", F.lit(False))
    moves = F.abs(F.col("advance")) >= F.col("size") * p.negligible_advance
    wide = moves & (F.col("along") - edge > F.col("size") * share) & ~after_space
    return glyphs.withColumn("gap_before", F.coalesce(wide, F.lit(False)))


def line_boxes(glyphs: DataFrame, keys: tuple[str, ...] = (*KEYS, "line")) -> DataFrame:
    """(keys, x0, y0, x1, y1) of lines of glyphs (x, y, advance, size, turn)."""
    ahead = F.when(F.col("turn") >= 2, -F.col("advance")).otherwise(F.col("advance"))
    ax, ay = F.when(F.col("turn") % 2 == 0, ahead).otherwise(0.0), F.when(F.col("turn") % 2 == 1, ahead).otherwise(0.0)
    x, y, size = F.col("x"), F.col("y"), F.col("size")
    return glyphs.groupBy(*keys).agg(
        F.min(F.least(x, x + ax)).alias("x0"),
        F.min(F.least(y - 0.25 * size, y + ay)).alias("y0"),
        F.max(F.greatest(x, x + ax)).alias("x1"),
        F.max(F.greatest(y + 0.75 * size, y + ay)).alias("y1"),
    )


def dominant_styles(glyphs: DataFrame, keys: tuple[str, ...] = (*KEYS, "line")) -> DataFrame:
    """(keys, font, size, mode, color, votes): the style that the most glyphs of a line go together
    with, the first of equals. Styles are counted before they are compared."""
    style = ["font", "size", "mode", "color"]
    counts = glyphs.groupBy(*keys, *style).agg(F.count("*").alias("n"), F.min("glyph_idx").alias("first"))
    other = counts.select(*keys, *(F.col(c).alias(f"o_{c}") for c in style), F.col("n").alias("o_n"))
    together = (F.col("font") == F.col("o_font")) & (F.col("mode") == F.col("o_mode")) & (F.col("color") == F.col("o_color")) & (F.abs(F.col("size") - F.col("o_size")) < 0.01)
    votes = counts.join(other, list(keys)).where(together).groupBy(*keys, *style, "first").agg(F.sum("o_n").alias("votes"))
    best = F.max_by(F.struct(*style, "votes"), F.struct("votes", -F.col("first"))).alias("best")
    return votes.groupBy(*keys).agg(best).select(*keys, "best.*")


def mark_hosts(glyphs: DataFrame, p: Params = PARAMS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, glyph_idx, host_across) of marks (is_mark, no advance): the nearest line of a glyph that
    moves the pen, faces alike and holds the mark within its advance, ends included."""
    moves = F.abs(F.col("advance")) >= F.col("size") * p.negligible_advance
    marks = glyphs.where(F.col("is_mark") & ~moves).select(*keys, "glyph_idx", "along", "across", "size", "turn")
    hosts = glyphs.where(moves).select(*keys, F.col("turn"), F.col("glyph_idx").alias("h_idx"), F.col("along").alias("h_along"), F.col("across").alias("h_across"), F.col("advance").alias("h_advance"))
    far = F.abs(F.col("h_across") - F.col("across"))
    # Joined by bands of lines as high as the page's largest mark, so a mark meets the hosts of three bands, not of the page.
    tall = marks.groupBy(*keys).agg(F.greatest(F.max("size"), F.lit(1e-3)).alias("band_size"))
    marks = marks.join(tall, list(keys)).withColumn("band", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col("across") / F.col("band_size")) + k)))
    hosts = hosts.join(tall, list(keys)).withColumn("band", F.floor(F.col("h_across") / F.col("band_size"))).drop("band_size")
    near = marks.join(hosts, [*keys, "turn", "band"]).where((far <= F.col("size")) & F.col("along").between(F.col("h_along"), F.col("h_along") + F.col("h_advance")))
    return near.groupBy(*keys, "glyph_idx").agg(F.min_by("h_across", F.struct(far, "h_idx")).alias("host_across"))


def overlay_anchors(glyphs: DataFrame, p: Params = PARAMS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, glyph_idx, along, across) of overlays: glyphs without advance that are no marks (is_mark) take
    the anchors of the first glyph within the window of paint order in whose advance they lie, ends
    excluded. Hosts move the pen and so are never moved themselves."""
    moves = F.abs(F.col("advance")) >= F.col("size") * p.negligible_advance
    loose = glyphs.where(~moves & ~F.col("is_mark")).select(*keys, F.col("glyph_idx"), F.col("along").alias("at"), F.col("across").alias("level"), "size")
    hosts = glyphs.where(moves).select(*keys, F.col("glyph_idx").alias("h_idx"), "along", "across", "advance")
    # Joined by stretches of paint order as long as the window: the own one and its neighbours.
    part = lambda c: F.floor(F.col(c) / max(p.overlay_window, 1))
    loose = loose.withColumn("part", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: part("glyph_idx") + k)))
    hosts = hosts.withColumn("part", part("h_idx"))
    near = F.col("h_idx").between(F.col("glyph_idx") - p.overlay_window, F.col("glyph_idx") + p.overlay_window) & (F.abs(F.col("across") - F.col("level")) <= F.col("size"))
    inside = (F.col("along") < F.col("at")) & (F.col("at") < F.col("along") + F.col("advance"))
    hits = loose.join(hosts, [*keys, "part"]).where(near & inside)
    return hits.groupBy(*keys, "glyph_idx").agg(F.min_by(F.struct("along", "across"), "h_idx").alias("host")).select(*keys, "glyph_idx", "host.*")


#: Bands at most that a page's points are dealt to where they are joined with ranges, and points of a band.
BANDS, BAND_POINTS = 64, 16


def banded(points: DataFrame, at: Column, ranges: DataFrame, low: Column, high: Column, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``band`` to join by besides the keys: points by the place of ``at`` between the page's
    smallest and largest, ranges once for each band that they touch. So a point meets the ranges near it,
    not all of the page. A range on a page without points keeps a row of a null band."""
    bands = F.greatest(F.least(F.floor(F.count("*") / BAND_POINTS), F.lit(BANDS)), F.lit(1))
    extent = points.groupBy(*keys).agg(F.min(at).alias("band_from"), F.greatest((F.max(at) - F.min(at)) * 1.000001 / bands, F.lit(1e-9)).alias("band_step"))
    place = lambda x: F.floor((x - F.col("band_from")) / F.col("band_step"))
    inside = lambda x: F.greatest(F.least(place(x), F.lit(BANDS + 1)), F.lit(-1))
    points = points.join(extent, list(keys)).withColumn("band", place(at)).drop("band_from", "band_step")
    touched = F.when((low <= high) & F.col("band_from").isNotNull(), F.sequence(inside(low), inside(high)))
    ranges = ranges.join(extent, list(keys), "left").withColumn("band", F.explode_outer(touched)).drop("band_from", "band_step")
    return points, ranges


def apply_actual_text(glyphs: DataFrame, spans: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds ``actual``: the text that a span (seq, start, end, text) states, on its first glyph, and an
    empty text on the others; of several spans the last closed wins."""
    within = F.col("glyph_idx").between(F.col("start"), F.col("end") - 1)
    points, ranges = banded(glyphs.select(*keys, "glyph_idx"), F.col("glyph_idx"), spans.select(*keys, "seq", "start", "end", F.col("text").alias("stated")), F.col("start"), F.col("end") - 1, keys)
    hits = points.join(ranges, [*keys, "band"]).where(within)
    told = hits.groupBy(*keys, "glyph_idx").agg(F.max_by(F.when(F.col("glyph_idx") == F.col("start"), F.col("stated")).otherwise(""), "seq").alias("actual"))
    return glyphs.join(told, [*keys, "glyph_idx"], "left")


def text_within(glyphs: DataFrame, boxes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, box_id, glyph_idx): glyphs whose middle of the baseline lies in a box, edges included."""
    middle = F.col("x") + F.col("advance") / 2
    glyphs, boxes = banded(glyphs, F.col("y"), boxes, F.col("y0"), F.col("y1"), keys)
    return glyphs.join(boxes, [*keys, "band"]).where(middle.between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))).select(*keys, "box_id", "glyph_idx")


def widest_gaps(spans: DataFrame, least_side: float | Column = 0.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, width, at) of the widest stretch that no span (low, high) covers, the first of equals,
    with ``least_side`` on both sides."""
    page = Window.partitionBy(*keys)
    reach = F.max("high").over(page.orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumns({"at": reach, "start": F.min("low").over(page), "end": F.max("high").over(page)})
    width = F.col("low") - F.col("at")
    good = rows.where((width > 0) & (F.col("at") - F.col("start") >= least_side) & (F.col("end") - F.col("low") >= least_side))
    return good.groupBy(*keys).agg(F.max_by(F.struct(width.alias("width"), "at"), F.struct(width, -F.col("low"))).alias("best")).select(*keys, "best.*")


def place_images(images: DataFrame, uses: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A row for each time that an image (name) is drawn by a use (name, ctm, glyph_idx), with its box;
    one with a null box if it never is."""
    drawn = uses.select(*keys, "name", C.placement(F.col("ctm")).alias("box"), "glyph_idx")
    return images.join(drawn, [*keys, "name"], "left")


def page_coverage(boxes: DataFrame, pages: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, coverage) of every page (page_box), from image boxes (box)."""
    rows = pages.join(boxes.select(*keys, "box"), list(keys), "left")
    shown = F.coalesce(F.sum(C.visible_area(F.col("box"), F.col("page_box"))), F.lit(0.0))
    total = C.area(F.col("page_box"))
    return rows.groupBy(*keys, "page_box").agg(F.when(total > 0, F.least(shown / total, F.lit(1.0))).otherwise(0.0).alias("coverage")).drop("page_box")


def xy_cut(items: DataFrame, p: Params = PARAMS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, item, region): boxes (item, x0, x1, y0, y1, size, rtl) with the number of their region in
    reading order. The cuts are recursive, so a page is one group of arrays."""
    import numpy as np

    from foliospark.functions.layout import Boxes, segment
    from foliospark.operators.groups import by_page

    def cut(c: list) -> list[tuple]:
        order = np.argsort(c[0], kind="stable")
        region = np.zeros(len(order), int)
        for k, ids in enumerate(segment(Boxes(*(x[order] for x in c[1:6])), bool(c[6][0]), p)):
            region[ids] = k
        return list(zip(c[0][order].astype(np.int64).tolist(), region.tolist(), strict=True))

    kind = items.schema["item"].dataType.simpleString()
    return by_page(items, keys, ("item", "x0", "x1", "y0", "y1", "size", "rtl"), f"item {kind}, region int", cut)


def number_blocks(blocks: DataFrame, *order: Column | str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds ``reading_index``, dense from 0 within a page, in the order given."""
    return blocks.withColumn("reading_index", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def reading_order(elements: DataFrame, spans: DataFrame, pages: DataFrame, p: Params = PARAMS) -> DataFrame:
    """(doc_id, page, run, tag, range_seq, start, end): the order that tags state, for pages of which
    they cover enough. ``elements``: doc_id, seq, tag, page or null, mcids; ``spans``: doc_id, page, mcid,
    start, end; ``pages``: doc_id, page, n_glyphs."""
    from foliospark.functions.structure import INLINE

    on = pages.select("doc_id", F.col("page").alias("on_page"), "n_glyphs").where("n_glyphs > 0")
    own = elements.join(on, "doc_id").where(F.col("page").isNull() | (F.col("page") == F.col("on_page")))
    parts = own.select("doc_id", "on_page", "n_glyphs", "seq", "tag", F.posexplode_outer("mcids").alias("pos", "mcid"))
    found = spans.select("doc_id", F.col("page").alias("on_page"), "mcid", "start", "end")
    rows = parts.join(found, ["doc_id", "on_page", "mcid"], "left")
    page = Window.partitionBy("doc_id", "on_page")
    block = (~F.col("tag").isin(*INLINE) & (F.coalesce("pos", F.lit(0)) == 0)).cast("int")
    first = F.row_number().over(Window.partitionBy("doc_id", "on_page", "seq").orderBy(F.asc_nulls_first("pos"), "start")) == 1
    rows = rows.withColumn("opens", F.when(first, block).otherwise(0))
    rows = rows.withColumn("run", F.sum("opens").over(page.orderBy("seq", F.asc_nulls_first("pos"), "start").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where("start IS NOT NULL").withColumn("covered", F.sum(F.col("end") - F.col("start")).over(page))
    rows = rows.where(F.col("covered") / F.col("n_glyphs") >= p.structure_coverage)
    order = Window.partitionBy("doc_id", "on_page", "run").orderBy("seq", "pos", "start")
    tag = F.first("tag").over(order)
    return rows.select("doc_id", F.col("on_page").alias("page"), "run", tag.alias("tag"), (F.row_number().over(order) - 1).alias("range_seq"), "start", "end")


def translate_roles(elements: DataFrame, roles: DataFrame) -> DataFrame:
    """Elements with tags by their role (doc_id, tag, role), one step."""
    return elements.join(roles, ["doc_id", "tag"], "left").withColumn("tag", F.coalesce("role", "tag")).drop("role")


def glyph_indices(ranges: DataFrame) -> DataFrame:
    """A row for each glyph of ranges (start, end); empty ranges have none."""
    return ranges.where("end > start").withColumn("glyph_idx", F.explode(F.sequence("start", F.col("end") - 1)))
