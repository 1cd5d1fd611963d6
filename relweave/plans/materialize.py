"""Lineage cuts that survive the loss of executors.

A cut is a Parquet table below the shared folder named by ``spark.checkpoint.dir``. It is compressed (a
plain RDD checkpoint is not), can be read again after any executor is gone, and is a table scan to
Catalyst, so later stages still prune its columns and push filters into it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; in local mode a temporary one is set where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="relweave-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir() or own


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder, deleted with the cuts."""
    path = f"{shared_dir(spark)}/relweave-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str = "cut", by: str | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of what was written; ``by`` a column, a filter on which then reads that part only."""
    spark = df.sparkSession
    path = scratch(spark, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counts(df: DataFrame, label: str, n: str = "n") -> tuple[DataFrame, int, int]:
    """`materialize`, with the sum and the greatest value of the column ``n``, seen while the rows are written."""
    seen = Observation()
    table = materialize(df.observe(seen, F.sum(n).alias("total"), F.max(n).alias("most")), label)
    return table, seen.get["total"] or 0, seen.get["most"] or 0


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system; nothing happens if it isn't there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def release() -> None:
    """Delete all cuts; frames that read them can't be used any more. Runs when the driver ends, and may be called between jobs of a long-lived one."""
    while _written:
        spark, path = _written.pop()
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already; the other cuts are still tried
            continue
