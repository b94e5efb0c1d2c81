"""Exact duplicates through an extendible-hash index on shared files.

Texts that are equal byte for byte after ASCII lower-casing are combined by an aggregation whose
key is the text itself. The entries are dealt to buckets by leading bits of a 64-bit hash: the
directory doubles its depth, and a bucket is split, until no bucket is overfull. One task owns a
bucket, that is a range of hashes, chains the entries of equal hash and writes the bucket in order.
Documents then look up their hash in the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxncurate.llm.common import ascii_lower, stored

#: Entries that a bucket holds before it is split.
BUCKET_CAPACITY = 20_000
#: The directory stops doubling here (2**20 slots); later overfull buckets stay whole and exact.
MAX_DEPTH = 20


def text_hash(text: Column, hash_bits: int = 64) -> Column:
    """64-bit hash as a non-negative number of 63 bits; fewer hash_bits, for tests, force collisions."""
    h = F.shiftrightunsigned(F.xxhash64(text), 1)
    return h if hash_bits >= 63 else F.shiftleft(F.shiftrightunsigned(h, 63 - hash_bits), 63 - hash_bits)


def directory(entries: DataFrame, capacity: int = BUCKET_CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(slot, bucket, depth, key_from) for entries with a column `hash`, slots being the leading
    max_depth bits. From depth 0 on, each overfull bucket is split in two by the next bit."""
    fine = entries.groupBy(F.shiftrightunsigned("hash", 63 - max_depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    levels = (
        fine.select("n", "slot", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"))
        .groupBy("depth", F.expr(f"shiftright(slot, {max_depth} - depth)").alias("prefix")).agg(F.sum("n").alias("n"))
    )
    parent = levels.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"), F.col("n").alias("above_n"))
    split_from = levels.withColumn("above", F.shiftright("prefix", 1)).join(parent, ["depth", "above"], "left")
    leaf = split_from.where(((F.col("n") <= capacity) | (F.col("depth") == max_depth)) & (F.col("above_n").isNull() | (F.col("above_n") > capacity)))
    first = F.expr(f"shiftleft(prefix, {max_depth} - depth)")
    # Slots without an entry point nowhere, so only used ones are listed.
    used = fine.select("slot", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(slot, {max_depth} - depth)"))
    return used.join(leaf.select("depth", "prefix", first.alias("first_slot")), ["depth", "prefix"]).select(
        "slot", (F.shiftleft(F.lit(1).cast("long"), max_depth + 1).bitwiseOR(F.col("first_slot"))).alias("bucket"), "depth",
        F.shiftleft("first_slot", 63 - max_depth).alias("key_from"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_CAPACITY, max_depth: int = MAX_DEPTH, hash_bits: int = 64) -> DataFrame:
    """The index: (bucket, hash, chain, text_sha256, keep_id, group_size), one row for each distinct text.

    Copies are combined before the shuffle, so a text with most rows is no hot spot. Raises if two
    texts that differ in a byte share hash and SHA-256, which look-ups tell texts apart by.
    """
    text = ascii_lower(F.col(text_col))
    entries = stored(
        docs.select(F.col(id_col).alias("id"), text.alias("t"))
        .groupBy(text_hash(F.col("t"), hash_bits).alias("hash"), "t")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("hash", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    slot = F.shiftrightunsigned("hash", 63 - max_depth)
    owned = (
        entries.withColumn("slot", slot).join(directory(entries, capacity, max_depth).select("slot", "bucket"), "slot").drop("slot")
        .repartition("bucket")
    )
    same = Window.partitionBy("bucket", "hash").orderBy("text_sha256")
    chained = owned.withColumn("chain", F.row_number().over(same)).withColumn("_last", F.lag("text_sha256").over(same))
    checked = F.when(F.col("_last") == F.col("text_sha256"), F.raise_error(F.lit("two texts share their SHA-256"))).otherwise(F.col("text_sha256"))
    return stored(chained.withColumn("text_sha256", checked).select("bucket", "hash", "chain", "text_sha256", "keep_id", "group_size").sortWithinPartitions("bucket", "hash", "chain"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, bucket, chain) for every row of docs.

    Null text counts as empty. Of equal texts the largest id stays; rows that share that id are
    ties and all stay. A null id stays only where the whole group has none. Very long texts are hashed
    and compared whole. An empty table gives an empty result; other columns are not read.
    """
    options.setdefault("hash_bits", 64)
    index = build_index(docs, id_col, text_col, **options)
    t = ascii_lower(F.col(text_col))
    probes = docs.select(F.col(id_col).alias("doc_id"), text_hash(t, options["hash_bits"]).alias("hash"), F.sha2(t.cast("binary"), 256).alias("text_sha256"))
    return probes.join(index, ["hash", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "chain")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with all their columns (see exact_duplicates for ties and nulls)."""
    options.setdefault("hash_bits", 64)
    index = build_index(docs, id_col, text_col, **options)
    t = ascii_lower(F.col(f"d.`{text_col}`"))
    rows = docs.alias("d").select(F.struct("d.*").alias("row"), F.col(f"d.`{id_col}`").alias("id"), text_hash(t, options["hash_bits"]).alias("hash"), F.sha2(t.cast("binary"), 256).alias("text_sha256")).alias("r")
    i = index.alias("i")
    same = (F.col("r.hash") == F.col("i.hash")) & (F.col("r.text_sha256") == F.col("i.text_sha256")) & F.col("r.id").eqNullSafe(F.col("i.keep_id"))
    return rows.join(i, same, "left_semi").select("row.*")
