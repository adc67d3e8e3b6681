"""From documents to packed training sequences, in five stages.

toxicity        rows whose predicted toxicity reaches the threshold go
near_duplicates one row of each group of near copies stays: the one with the smallest doc_id (null last)
decontamination rows that leak a benchmark item go
secrets         secrets in the texts are masked; all rows stay, n_chars follows the text
packing         texts become token ids, packed into sequences

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return
the columns of ``docs``. ``run`` writes each stage's rows to the shared folder and reads them back,
so a lost executor costs a part of one stage. The last stage's rows are those of
``pack_hierarchical``, ids included.

Defined results: every stage decides row by row, never by doc_id alone. Rows of one id with several
texts are several documents; of rows that are equal in id and text one stays, the first by its
other columns. Rows with a null doc_id are documents like others. Null, empty and blank texts are no
duplicates of each other, leak nothing and hold no secret: all their rows reach packing. Extra columns
go along, whatever their names, up to packing. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.op03_jaccard import row_classes
from foliospark.llm.op06_decontaminate import find_leaks
from foliospark.llm.op08_toxicity import machine_for, score_toxicity
from foliospark.llm.op09_packing import pack_hierarchical
from foliospark.llm.op10_secrets import redact_secrets
from foliospark.llm.scratch import dropped, release, results, stored
from foliospark.session import table


def _guarded(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on the rows of ``docs``, whose other columns than doc_id and text bear names meanwhile
    that none of its results has."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = work(docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"in_{c}") for c in others)))
    return out.select(*(F.col(f"`in_{c}`").alias(c) if c in others else c for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = machine_for(docs, spark, sf_dir)
    return _guarded(docs, lambda rows: score_toxicity(rows, machine).where("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = row_classes(docs.select("doc_id", "text")).where("class_set IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    firsts = rows.groupBy("class_set").agg(first).select(F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"))
    # A row is known by its id's and its text's hashes, which are never null: what is joined by them lies
    # where the grouping wants it. Ids that are numbers have hashes of their own.
    key = lambda c: [F.col(c).isNull().alias("none"), F.xxhash64(c).alias("id_hash")]
    whole = docs.where(some).select(F.struct(*docs.columns).alias("row"), *key("doc_id"), F.xxhash64("text").alias("hash"))
    kept = whole.join(firsts.select(*key("id"), "hash"), ["hash", "none", "id_hash"])
    once = kept.groupBy("hash", "none", "id_hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.select("row.*").unionByName(docs.where(~some))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _guarded(docs, lambda rows: find_leaks(rows, table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = _guarded(docs, redact_secrets)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_hierarchical(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack),
]
#: SQL can express neither the trained scores nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before, held = table(spark, sf_dir, "documents"), None, results()
    for name, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            dropped(spark, before)
        release(spark, held)
        before = path
    return docs
