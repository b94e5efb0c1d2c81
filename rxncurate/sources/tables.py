"""Table reading shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; columns and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
