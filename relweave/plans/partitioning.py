"""Enough partitions for work that is heavy for its bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the scan has fewer partitions than the cluster has cores.

    That is so for small files only: the splits of a large input outnumber the cores, and nothing is shuffled then.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
