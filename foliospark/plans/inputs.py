"""Inputs of the registered queries, made from the driver's tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliospark.operators.detect import assess
from foliospark.operators.extract import BATCH_ROWS, extract, parse_pages
from foliospark.session import prepare, spread, table


def document_pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): a PDF file for each document, with defects by doc_id."""
    prepare(spark, BATCH_ROWS)
    from foliospark.synth import document_pdf

    def written(batches):
        for b in batches:
            files = [document_pdf(i, t or "") for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(files, pa.binary())], names=["doc_id", "content"])

    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).mapInArrow(written, "doc_id long, content binary")


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(document_pdfs(spark, sf_dir))


def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pages(document_pdfs(spark, sf_dir))


def document_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(document_pages(spark, sf_dir))
