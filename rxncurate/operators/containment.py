"""Evaluation items that occur inside training texts, as word sequences.

An item is looked for by one of its word n-grams, the one that the fewest texts hold. Items with an n-gram
that no text holds are done then. What an anchor finds is verified word by word."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxncurate.sources.shared import stored

#: Words of an anchor; shorter items are their own.
ANCHOR_WORDS = 6
#: Rows (of two numbers at most) that are sent with the tasks; more meet the texts by a shuffle.
SENT = 1_000_000


def words_text(text: Column) -> Column:
    """The words of a text, runs of letters and digits in small letters, with a space around each; null is empty."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.concat(F.lit(" "), plain, F.lit(" "))


def _grams(words: Column, length: int) -> Column:
    last = F.size(words) - length
    each = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(length))))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<long>"))


def _words(padded: Column) -> Column:
    return F.filter(F.split(padded, " "), lambda w: w != "")


def contained_items(train: DataFrame, evaluation: DataFrame, keys: Sequence[str], n: int = ANCHOR_WORDS) -> DataFrame:
    """(item_id, keys, word_at): rows of train (keys, text) whose words hold all words of an item of evaluation
    (item_id, text) in order and without a gap; word_at is the number of words before the first place.

    Items without words are nowhere, repeated rows of either side are found as often as they stand there, null
    texts are empty, and texts of any length are looked through whole. train is read three times: for the
    number of texts that hold each n-gram of the items, for the texts that hold anchors, and to verify those.
    What it meets each time (n-grams, anchors, named texts: two 64-bit numbers a row) is broadcast if it was
    counted to be at most SENT rows; beyond that both are shuffled, and AQE splits common keys. Equal hashes of
    different texts only add to what is verified."""
    items = evaluation.select("item_id", words_text(F.col("text")).alias("_item")).where("_item <> '  '").withColumn("_id", F.xxhash64("_item"))
    parts = items.select("_item", "_id").distinct().withColumn("_w", _words(F.col("_item")))
    parts = parts.withColumn("_n", F.least(F.size("_w"), F.lit(n)))
    lengths = sorted(r[0] for r in parts.select("_n").distinct().collect())  # at most n numbers
    if not lengths:
        none = F.lit(None).cast(evaluation.schema["item_id"].dataType).alias("item_id")
        return train.select(none, *keys, F.lit(0).alias("word_at")).limit(0)
    own = F.coalesce(*[F.when(F.col("_n") == k, _grams(F.col("_w"), k)) for k in lengths])
    grams = parts.select("_id", F.explode(F.array_distinct(own)).alias("_gram"))

    texts = train.select(*keys, words_text(F.col("text")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    split = texts.select("_hash", _words(F.col("_text")).alias("_w"))
    held = split.select("_hash", F.explode(F.array_distinct(F.concat(*[_grams(F.col("_w"), k) for k in lengths]))).alias("_gram"))

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= SENT else df

    counts = held.join(sent(grams.select("_gram").distinct()), "_gram").groupBy("_gram").agg(F.count(F.lit(1)).alias("_texts"))
    rarest = F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("n"), F.col("_gram").alias("g")))
    anchors = stored(grams.join(counts, "_gram", "left").groupBy("_id").agg(rarest.alias("a")).where("a.n > 0").select("_id", F.col("a.g").alias("_gram")))
    named = stored(held.join(sent(anchors), "_gram").select("_hash", "_id").distinct())

    found = texts.join(sent(named), "_hash").join(items, "_id").withColumn("_place", F.expr("locate(_item, _text)")).where("_place > 0")
    before = F.size(_words(F.substring(F.col("_text"), F.lit(1), F.col("_place"))))
    return found.select("item_id", *keys, before.alias("word_at"))


def containment(found: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(item_id, rows_with_item) of every item of evaluation, out of what contained_items found; 0 for those that are nowhere."""
    n = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return evaluation.select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("rows_with_item"))
