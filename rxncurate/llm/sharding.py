"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table; shards take turns, each
claiming its next free slot, until the table is full. A document's slot is its key's hash modulo
the table size; the table, of a fixed size, is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime, and at least some hundred slots for each shard, so that shards differ by under 1 %.
TABLE_SIZE = 65_537
#: The largest table that may be broadcast (16 bytes a slot).
MAX_TABLE_SIZE = 4_000_037


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], table_size: int = TABLE_SIZE) -> list[int]:
    """For every slot, the index of the shard that owns it. Depends on names and size alone; adding
    or removing a shard moves few slots of the others."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if table_size > MAX_TABLE_SIZE or table_size < max(2, len(shards)) or any(table_size % k == 0 for k in range(2, int(table_size**0.5) + 1)):
        raise ValueError(f"table_size must be a prime from the number of shards to {MAX_TABLE_SIZE}")
    at = [_number(f"offset:{s}") % table_size for s in shards]
    skip = [_number(f"skip:{s}") % (table_size - 1) + 1 for s in shards]
    owner, free = [-1] * table_size, table_size
    while True:
        for k in range(len(shards)):
            slot = at[k]
            while owner[slot] >= 0:
                slot = (slot + skip[k]) % table_size
            owner[slot] = k
            at[k] = (slot + skip[k]) % table_size
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, table_size: int) -> Column:
    """Slot of a key: its md5 hash modulo the table size. A null key counts as empty text."""
    number = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    return (number % table_size).cast("int")


def table_frame(spark: SparkSession, shards: Sequence[str], table_size: int = TABLE_SIZE) -> DataFrame:
    """The lookup table as (slot, shard_index, shard)."""
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, table_size)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    return (
        spark.range(0, table_size, 1, 1).select(F.col("id").cast("int").alias("slot"), F.element_at(owners, (F.col("id") + 1).cast("int")).cast("int").alias("shard_index"))
        .withColumn("shard", F.element_at(names, F.col("shard_index") + 1))
    )


def assign_shards(df: DataFrame, key: str, shards: Sequence[str], table_size: int = TABLE_SIZE) -> DataFrame:
    """All rows and columns of df, then shard_slot, shard_index and shard (columns of these names are
    replaced). No shuffle: the table is broadcast, which MAX_TABLE_SIZE bounds. Rows with equal keys
    share a shard; null keys go where the empty text goes; an empty table stays empty.
    """
    keep = [F.col(f"d.`{c}`") for c in df.columns if c not in ("shard_slot", "shard_index", "shard")]
    t = F.broadcast(table_frame(df.sparkSession, shards, table_size)).alias("t")
    placed = df.withColumn("shard_slot", slot_of(F.col(key), table_size)).alias("d")
    return placed.join(t, F.col("d.shard_slot") == F.col("t.slot")).select(*keep, "d.shard_slot", "t.shard_index", "t.shard")
