"""What every operator needs from the session: a shared folder, a table, and the package on the executors."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


#: Rows that Spark hands a Python task at a time where the session says nothing else, so that batches of long texts stay small.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Put this package on the executors' Python path, once per application, and bound the rows of Arrow batches."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, None) is None:
        spark.conf.set(rows, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp()) / root.name
    spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", root.parent, root.name))
    _SHIPPED.add(app)


#: Bytes that adaptive execution aims to give a task of a shuffle, and the partitions that it starts from.
TASK_BYTES, PARTS = 16 << 20, 600
_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def small_tasks(spark: SparkSession) -> None:
    """Shuffles in tasks of TASK_BYTES at most, so that a task's sorts and hash tables stay as they are when tables grow. A session's own smaller tasks stay."""
    size, parts = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    now = re.fullmatch(r"([0-9]+)([kmg]?)b?", (spark.conf.get(size, None) or "").lower())
    if not now or int(now[1]) * _UNITS[now[2]] > TASK_BYTES:
        spark.conf.set(size, f"{TASK_BYTES}b")
    if spark.conf.get(parts, None) is None:
        spark.conf.set(parts, max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores: a file of few bytes and many rows is one task, however much each row costs. Select the columns that are needed first."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The cluster names the folder in spark.checkpoint.dir. Only where that is unset, as in
    tests on one machine, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        made = spark.sparkContext.getCheckpointDir()
        if not made:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
            made = spark.sparkContext.getCheckpointDir()
        base = made
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of settled frames that nothing reads any more."""
    for df in frames:
        forget(df.sparkSession, df.settled_path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a path of shared_dir() by the file system that it lies in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
