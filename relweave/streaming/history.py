"""The case history as a stream: the snapshot of newest results is kept up to date by each batch of new lines.

The query language itself has no streaming operator; this follows the append-only log that runs write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relweave.functions.text import epoch_seconds
from relweave.plans.materialize import drop
from relweave.runs.results import HISTORY


def history_stream(spark: SparkSession, path: str, schema: str = HISTORY) -> DataFrame:
    """New lines of a folder of JSON-lines files; lines that can't be read are passed over."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def newest(entries: DataFrame) -> DataFrame:
    order = Window.partitionBy("case_id").orderBy(F.desc_nulls_last(epoch_seconds(F.coalesce("ts", "timestamp"))), F.desc("run_id"))
    return entries.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def follow(stream: DataFrame, snapshot: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Fold new entries into the snapshot table, one version of the table a batch.

    A batch that is repeated after a failure writes the same version again from the version before, so its entries count once; older
    versions are removed.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        entries = newest(batch)
        if number > 0:
            entries = newest(spark.read.parquet(f"{snapshot}/version={number - 1}").unionByName(entries))
        entries.write.mode("overwrite").parquet(f"{snapshot}/version={number}")
        if number > 1:
            drop(spark, f"{snapshot}/version={number - 2}")

    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
