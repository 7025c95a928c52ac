"""Where intermediate results go: the shared folder named by spark.checkpoint.dir.

Executors can be lost at any time, so lineage is only ever cut through files
every executor can read. Only a session that names no folder (a test on one
machine) gets a temporary one.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of their table, that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 16_000_000
#: Whether a query's shuffle files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a Python worker gets at once, and how many while a table is written: whole texts of 10,000 rows, Spark's number, are held several times over on both sides.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a fresh local one only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named is None:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="pagewright-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Compute df once, into a table of the shared folder, and go on from that.

    A table is columns, compressed, of known size: the optimizer plans joins by
    it, where checkpoints carry on estimates that are products of products.
    What was shuffled for it goes at once, not when the driver happens to collect
    its garbage. Python workers get few rows at once.
    """
    path, conf = fresh_path(df.sparkSession, "table"), df.sparkSession.conf
    before = {key: conf.get(key) for key in (CLEANUP, BATCH)}
    conf.set(CLEANUP, "true")
    if not 0 < int(before[BATCH]) < BATCH_ROWS:
        conf.set(BATCH, str(BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            conf.set(key, value)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() has written and that nothing reads any more."""
    for df in tables:
        where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame) -> DataFrame:
    """df, computed, counted and weighed; marked for broadcast if it is small, else left to a shuffle join."""
    df = cut(df)
    sc = df.sparkSession.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    size = where.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    if size > BROADCAST_BYTES or df.count() > BROADCAST_ROWS:
        return df
    marked = F.broadcast(df)
    marked._cut_path = df._cut_path
    return marked
