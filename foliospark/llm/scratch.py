"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where the session names none and runs locally."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="foliospark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Rows of a stored file of a table whose size is known; small tables have a file for each core.
FILE_ROWS = 1 << 17
#: Without native libraries, each file and folder made in a local store gets its mode from a child process, and
#: until that has begun its program, it counts with all memory of the JVM it comes from, once more. So there
#: is no file of checksums beside each file (the pages hold checksums of their own, see _READ) and no mark of success.
_WRITE = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
_READ = {"parquet.page.verify-checksum.enabled": "true"}


def stored(df: DataFrame, name: str, rows: int | None = None, narrow: bool = False) -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here, every executor can
    read it, and the shuffle files of the write are no longer needed. ``rows``: about how many rows
    it has, for fewer files than shuffle partitions where it is small. ``narrow``: a row is a few numbers
    that cost little to make, so FILE_ROWS of them make one file."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1 if narrow else spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = f"{scratch_dir(spark)}/foliospark/{name}-{uuid.uuid4().hex}.parquet"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.options(**_WRITE).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.options(**_READ).schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: What a plan may consist of if its rows come in the same partitions and order each time they are read.
_REPEATING = {"Project", "Filter", "LogicalRelation", "DataSourceV2ScanRelation", "LocalRelation", "LogicalRDD", "MapInArrow"}


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` if it reads files (or local rows) without a shuffle, so that its rows come in the same partitions
    and order each time, also in a task that runs again; else a stored copy of it, which does."""
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = {plan.apply(i).getClass().getSimpleName() for i in range(_size(plan))}
    return df if nodes <= _REPEATING else result(df, name)


def _size(plan) -> int:
    return 1 + sum(_size(plan.children().apply(i)) for i in range(plan.children().size()))


class Workspace:
    """Stored tables of one job, all of which are deleted when it ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str, rows: int | None = None, narrow: bool = False) -> tuple[DataFrame, str]:
        out, path = stored(df, name, rows, narrow)
        self.paths.append(path)
        return out, path

    def stored(self, df: DataFrame, name: str, rows: int | None = None, narrow: bool = False) -> DataFrame:
        return self.table(df, name, rows, narrow)[0]

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            dropped(self.spark, path)


_results: list[str] = []


def result(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` as a stored table that stays until ``release``."""
    out, path = stored(df, name, rows)
    _results.append(path)
    return out


def release(spark: SparkSession, before: int = 0) -> None:
    """Deletes the stored results from number ``before`` on, which nothing may read any more."""
    while len(_results) > before:
        dropped(spark, _results.pop())


def results() -> int:
    """How many stored results there are."""
    return len(_results)
