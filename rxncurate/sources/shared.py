"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, the folder that all executors share. Where that
    setting is unset a local session (tests) uses one temporary folder of this process; on a cluster
    that is an error, as executors do not share the driver's folders."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="rxncurate-")
            atexit.register(shutil.rmtree, _own_dir, True)
        base = _own_dir
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts lineage, and later
    stages survive lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
