"""A landing folder of PDF files as a stream: the same stateless page stages, and verdict counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.operators.detect import judged
from foliospark.operators.extract import extract

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def landing_pages(spark: SparkSession, folder: str, glob: str = "*.pdf", files_per_batch: int = 1000) -> DataFrame:
    """Judged pages of the files that arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return judged(extract(files.select(F.col("path").alias("doc_id"), "content")))


def verdict_counts(pages: DataFrame) -> DataFrame:
    """Running totals by verdict; complete or update mode."""
    return pages.groupBy("verdict").agg(F.count("*").alias("pages"), F.avg("confidence").alias("confidence"))
