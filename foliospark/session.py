"""Session helpers: table paths, Arrow batch size and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one of the driver's tables; any store that Spark's readers know will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that Python workers
    can import it wherever they run (the same as ``--py-files``)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).parent
    target = os.path.join(tempfile.mkdtemp(), "foliospark.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def prepare(spark: SparkSession, batch_rows: int = 1000) -> None:
    """Readies a session for Arrow stages: package shipped, and at most ``batch_rows`` rows
    in an Arrow batch, since rows here are whole texts or files and may be long."""
    ship_package(spark)
    now = spark.conf.get(_BATCH_ROWS, None)
    if now is None or not 0 < int(now) <= batch_rows:
        spark.conf.set(_BATCH_ROWS, str(batch_rows))


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores where a few partitions hold them, for stages whose work for each
    row is far larger than the row. Inputs of many partitions stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys over the session's number of shuffle partitions. A later groupBy on the keys
    needs no other exchange, and partitions that are small in bytes but long in work aren't merged."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
