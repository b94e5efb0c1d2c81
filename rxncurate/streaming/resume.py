"""Results that arrive while a run goes on: an append-only log, and its current state.

Each micro-batch overwrites its own partition of the log, so a batch that is run again after a
failure leaves no second copy; the state is the latest row of each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_results(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes a stream of results to the log at path; with once it ends when all input is read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_id", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def current_results(spark: SparkSession, path: str, key: str = "idx", order: str | None = None) -> DataFrame:
    """The last row of each key: by batch, then by the column `order`, if given."""
    last = [F.col("batch_id").desc()] + ([F.col(order).desc()] if order else [])
    w = Window.partitionBy(key).orderBy(*last)
    return spark.read.parquet(path).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "batch_id")
