"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxncurate.sources.shared import shared_dir, stored  # noqa: F401

#: The letters that ASCII lower-casing changes.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: white space between words, as a Java pattern.
WHITE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a text, cut at white space; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), WHITE), "")


def let(value: Column, f) -> Column:
    """f(value) with value evaluated once for a row, also where f uses it inside lambda functions."""
    return F.element_at(F.transform(F.array(value), f), 1)


def id_crc(c: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def deal(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """docs' (doc_id, t: the text, null as empty) with block, from 0 on, and the number of blocks of about block_bytes
    of text. The block comes from the row's id and text, so a second reading, however its input is split, deals
    each row alike. Only rows of one id and text that fill half a block are spread further, by their
    input partition; how many such rows there are is counted first (fewer than two for each block)."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t")).withColumn("_h", F.xxhash64(F.col("doc_id").cast("string"), "t"))
    size = F.octet_length("t") + 8
    sums = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"))
    found = sums.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.collect_list(F.when((F.col("n") > 1) & (2 * F.col("b") > block_bytes), F.struct("_h", F.ceil(2 * F.col("b") / block_bytes).alias("parts")))).alias("hot")).first()
    blocks = max(1, math.ceil(int(found["b"]) / block_bytes))
    key = F.col("_h")
    if found["hot"]:
        parts = F.create_map(*[F.lit(x) for r in found["hot"] for x in (r["_h"], r["parts"])])
        key = F.xxhash64("_h", F.pmod(F.spark_partition_id(), F.coalesce(F.try_element_at(parts, F.col("_h")), F.lit(1))))
    return rows.select("doc_id", "t", F.pmod(key, F.lit(blocks)).cast("int").alias("block")), blocks


#: Most partitions that blocks are dealt to; beyond, a task works on several, one after the other.
MOST_TASKS = 32_768


def to_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """rows (block, ...) with one block a task, or the blocks of a task one after the other."""
    parts = min(blocks, MOST_TASKS)
    dealt = rows.repartitionById(parts, "block")
    return dealt if parts == blocks else dealt.sortWithinPartitions("block")


def block_runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame | None]]:
    """(block, rows) for each run of rows of a block, in order, and (block, None) when it has ended."""
    now = None
    for b in batches:
        for block, rows in b.groupby("block", sort=False):
            if now is not None and block != now:
                yield now, None
            now = block
            yield block, rows
    if now is not None:
        yield now, None


def release() -> None:
    """Gives memory that is free back to the system, where the C library can: a worker process outlives
    its tasks, and what it keeps is missing elsewhere on the executor."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
