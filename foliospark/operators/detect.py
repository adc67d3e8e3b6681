"""Whether a page's text layer can be trusted: signals, verdict, reasons and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import columns as C
from foliospark.params import PARAMS, Params

#: Verdicts from the best to the worst; their order is their rank.
VERDICTS = ("ok", "degraded", "needs_ocr")
OK, DEGRADED, NEEDS_OCR = range(3)


def image_coverage(boxes: Column, page: Column) -> Column:
    """The images' visible share of the page; overlaps count twice, the sum at most once."""
    covered = F.aggregate(boxes, F.lit(0.0), lambda total, b: total + C.visible_area(b, page))
    return F.when(C.area(page) > 0, F.least(covered / C.area(page), F.lit(1.0))).otherwise(0.0)


def _measures() -> dict[str, Column]:
    total = lambda field: F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x[field])
    return {
        "glyph_count": F.col("n_glyphs"),
        "unresolved": total("unresolved"),
        "font_count": F.size("fonts").cast("long"),
        "unmappable_fonts": F.size(F.filter("fonts", lambda f: ~f["resolvable"])).cast("long"),
        "invisible_glyphs": F.col("n_invisible"),
        "residual_presentation_forms": C.presentation_forms("_text"),
        "replacement_chars": C.replacement_characters("_text"),
        "text_len": F.length("_text").cast("long"),
        "visible_text_len": C.visible_length("_text"),
        "mixed_digit_separators": C.mixed_separators("_text"),
        "image_coverage": image_coverage(F.col("image_boxes"), F.col("box")),
    }


def measured(pages: DataFrame) -> DataFrame:
    """The readable pages with their eleven signals; a page's text is its lines without separators."""
    text = F.array_join(F.transform("lines", lambda x: x["text"]), "")
    return pages.where("error IS NULL").withColumn("_text", text).withColumns(_measures()).drop("_text")


def signals(pages: DataFrame) -> DataFrame:
    """(doc_id, page) and the eleven signals of each readable page."""
    return measured(pages).select("doc_id", "page", *_measures())


def resolution_rate() -> Column:
    return F.when(F.col("glyph_count") == 0, 0.0).otherwise(1 - F.col("unresolved") / F.col("glyph_count"))


def invisible_rate() -> Column:
    return F.when(F.col("glyph_count") == 0, 0.0).otherwise(F.col("invisible_glyphs") / F.col("glyph_count"))


def _percent(x: Column) -> Column:
    return F.format_number(x * 100, 0)


def _checks(p: Params) -> list[tuple[Column, int, Column]]:
    """(condition, rank, reason), in the order in which reasons are told."""
    c, rate = F.col, resolution_rate()
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    full = c("image_coverage") >= p.image_page
    little = c("visible_text_len") <= p.image_page_little
    return [
        (rate < p.needs_ocr_rate, NEEDS_OCR, text("only ", _percent(rate), "% of glyph codes could be resolved")),
        ((rate >= p.needs_ocr_rate) & (rate < p.degraded_rate), DEGRADED, text(c("unresolved"), " of ", c("glyph_count"), " glyph codes unresolved")),
        (c("unmappable_fonts") > 0, DEGRADED, text(c("unmappable_fonts"), " of ", c("font_count"), " fonts have neither /ToUnicode nor a usable /Encoding")),
        (c("residual_presentation_forms") > 0, DEGRADED, text(c("residual_presentation_forms"), " presentation-form characters survived normalisation")),
        (invisible_rate() > p.invisible_rate, DEGRADED, text("text is painted invisibly — this looks like an OCR layer over a scan")),
        (c("mixed_digit_separators"), DEGRADED, text("digits are grouped with both `,` and `.` — some numbers may have the wrong separator, and so the wrong value")),
        (full & little, NEEDS_OCR, text("images cover ", _percent(c("image_coverage")), "% of the page and it has almost no text (", c("visible_text_len"), " characters) — the content is inside the image")),
        (full & ~little & (c("text_len") < p.image_page_sparse), DEGRADED, text("images cover ", _percent(c("image_coverage")), "% of the page and only ", c("text_len"), " characters of text were found — the image may hold text that is not extracted")),
        (c("text_len") < p.least_text, NEEDS_OCR, text("glyphs were painted but produced almost no text")),
    ]


def verdicts(signals: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Adds rank, verdict, confidence and reasons to rows of signals."""
    checks = _checks(p)
    blank = F.col("glyph_count") == 0
    rank = F.greatest(*(F.when(condition, rank).otherwise(OK) for condition, rank, _ in checks))
    reasons = F.filter(F.array(*(F.when(condition, reason) for condition, _, reason in checks)), lambda r: r.isNotNull())
    out = signals.withColumn("rank", F.when(blank, NEEDS_OCR).otherwise(rank))
    out = out.withColumn("verdict", F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("rank") + 1))
    bad = F.when(F.col("text_len") > 0, F.least((F.col("residual_presentation_forms") + F.col("replacement_chars")) / F.col("text_len"), F.lit(0.5))).otherwise(0.0)
    unread = F.when(F.col("font_count") > 0, 0.2 * F.col("unmappable_fonts") / F.col("font_count")).otherwise(0.0)
    score = resolution_rate() - bad - unread - F.when(invisible_rate() > p.invisible_rate, 0.1).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    first = F.array(F.lit("no text layer: the page paints no glyphs at all"))
    return out.withColumns({"confidence": F.when(F.col("rank") == NEEDS_OCR, 0.0).otherwise(score), "reasons": F.when(blank, first).otherwise(reasons)})


def judged(pages: DataFrame, p: Params = PARAMS) -> DataFrame:
    """The readable pages with signals, rank, verdict, confidence and reasons, in the same pass."""
    return verdicts(measured(pages), p)


def assess(pages: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Signals and verdict of every readable page."""
    return judged(pages, p).select("doc_id", "page", *_measures(), "rank", "verdict", "confidence", "reasons")
