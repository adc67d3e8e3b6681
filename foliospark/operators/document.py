"""Questions about whole documents, as aggregates over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(ordered: Column, separator: str) -> Column:
    """The texts of an array of (order, text), in order, without empty ones."""
    texts = F.filter(F.transform(F.array_sort(ordered), lambda x: x["text"]), lambda t: t != "")
    return F.array_join(texts, separator)


def block_text(pages: DataFrame) -> DataFrame:
    """(doc_id, page, seq, kind, text): lines apart by newlines, cells by tabs, images empty."""
    own = lambda b: F.array_join(F.transform(F.filter("lines", lambda x: x["block"] == b["seq"]), lambda x: x["text"]), "\n")
    table = lambda b: F.array_join(F.transform(b["cells"], lambda row: F.array_join(F.transform(row, lambda c: c["text"]), "\t")), "\n")
    text = lambda b: F.when(b["kind"] == "text", own(b)).when(b["kind"] == "table", table(b)).otherwise("")
    rows = pages.select("doc_id", "page", F.explode(F.transform("blocks", lambda b: F.struct(b["seq"].alias("seq"), b["kind"].alias("kind"), text(b).alias("text")))).alias("b"))
    return rows.select("doc_id", "page", "b.*")


def _own_text() -> Column:
    own = lambda b: F.array_join(F.transform(F.filter("lines", lambda x: x["block"] == b["seq"]), lambda x: x["text"]), "\n")
    table = lambda b: F.array_join(F.transform(b["cells"], lambda row: F.array_join(F.transform(row, lambda c: c["text"]), "\t")), "\n")
    texts = F.transform("blocks", lambda b: F.when(b["kind"] == "text", own(b)).when(b["kind"] == "table", table(b)).otherwise(""))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


def page_text(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text) of every readable page, whatever its verdict."""
    return pages.where("error IS NULL").select("doc_id", "page", _own_text().alias("text"))


def document_text(judged: DataFrame) -> DataFrame:
    """(doc_id, text) of judged pages: those that don't need OCR and aren't empty, a blank line apart."""
    rows = judged.select("doc_id", "page", "verdict", _own_text().alias("text"))
    kept = F.when((F.col("verdict") != "needs_ocr") & (F.col("text") != ""), F.struct(F.col("page").alias("at"), "text"))
    return rows.groupBy("doc_id").agg(_joined(F.collect_list(kept), "\n\n").alias("text"))


def document_report(judged: DataFrame) -> DataFrame:
    """(doc_id, page_count, confidence, pages_needing_ocr, tagged_pages) of judged pages."""
    pages_where = lambda condition: F.sort_array(F.collect_list(F.when(condition, F.col("page"))))
    return judged.groupBy("doc_id").agg(
        F.count("*").alias("page_count"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"),
        pages_where(F.col("verdict") == "needs_ocr").alias("pages_needing_ocr"),
        pages_where(F.col("tagged")).alias("tagged_pages"),
    )


def verdict_tally(verdicts: DataFrame, *by: str) -> DataFrame:
    """Pages by verdict and by any other columns."""
    return verdicts.groupBy(*by, "verdict").agg(F.count("*").alias("pages"))


def block_confidence(lines: DataFrame) -> DataFrame:
    """(doc_id, page, block, confidence) of text blocks, from rows of lines."""
    total = F.sum("glyphs")
    return lines.where("block IS NOT NULL").groupBy("doc_id", "page", "block").agg(F.when(total > 0, 1 - F.sum("unresolved") / total).otherwise(1.0).alias("confidence"))
