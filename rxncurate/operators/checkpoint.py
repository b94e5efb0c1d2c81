"""A checkpoint of results in hash buckets, of which an update reads and writes only those that it touches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxncurate.operators.review import pending_rows, upsert

BUCKETS = 256
_COMMITS = "update string, buckets int, touched int"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        df = spark.read.schema(schema).parquet(path)
        df.isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return df


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a checkpoint, with the columns of schema; none where there is no checkpoint yet."""
    df = _read(spark, f"{path}/rows", f"{schema}, bucket int")
    return spark.createDataFrame([], schema) if df is None else df.drop("bucket")


def committed(spark: SparkSession, path: str, update: str) -> bool:
    """Whether an update was written in whole."""
    log = _read(spark, f"{path}/commits", _COMMITS)
    return log is not None and not log.where(F.col("update") == update).isEmpty()


def apply_update(spark: SparkSession, path: str, new: DataFrame, update: str, key: str = "idx", version: str | None = None, buckets: int = BUCKETS) -> int:
    """Replaces the rows of equal key in the checkpoint at path by those of new, and returns the number of
    buckets written. Of several new rows of a key one stays: see upsert.

    Buckets are partitions of the table. Those of the keys of new are read (their numbers, at most `buckets`
    small ones, are brought to the driver, so that the others are not even listed), joined and overwritten;
    the rest stays as it is. Then the update's name goes into a log. An update in the log is not applied
    again; one that was cut short is not in the log, and to apply it again gives what it would have given,
    as an upsert twice is an upsert once. One writer at a time, always with the same number of buckets."""
    if committed(spark, path, update):
        return 0
    log = _read(spark, f"{path}/commits", _COMMITS)
    other = None if log is None else log.where(F.col("buckets") != buckets).select("buckets").first()
    if other is not None:
        raise ValueError(f"the checkpoint has {other[0]} buckets")
    rows = new.withColumn("bucket", bucket_of(key, buckets))
    touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
    old = _read(spark, f"{path}/rows", f"{fields}, bucket int")
    before = rows.limit(0) if old is None else old.where(F.col("bucket").isin(touched))
    merged = upsert(before, rows, key, version)
    if touched:
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
    spark.createDataFrame([(update, buckets, len(touched))], _COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return len(touched)


def resume(spark: SparkSession, path: str, rows: DataFrame, schema: str) -> DataFrame:
    """(idx, reason) of the rows (idx, title, paragraph) that a run has yet to answer: see pending_rows."""
    return pending_rows(rows, read_checkpoint(spark, path, schema))
