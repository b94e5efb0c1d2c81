"""Mixing sources to target weights.

Every document gets a hash-random key; within each source the documents are dealt to key ranges,
sorted, and given the prefix sum of their sizes. Each source is then cut at its budget, also between rows of one key, after as
many whole epochs as the budget holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxncurate.llm.common import stored, words

#: Fixed values of the contract: weights by order of the sources, and the most epochs of a source.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Each source is sorted in 2**RANGE_BITS key ranges, so that a source with most rows is spread.
RANGE_BITS = 12


def random_key(id_col: Column, text_col: Column, seed: str) -> Column:
    """Hash-random sort key of a row: from its id, or from its text where the id is null."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), text_col, F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources from (source, size): each its weight's share of the total, at most
    max_epochs times its size; what is above goes to the others by weight until none is above.

    With sources sorted by the level at which each meets its limit, the level that uses the whole
    total follows from prefix sums. One row per source in and out. An all-empty input has targets 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("limit_level", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("weight", w)
        .withColumn("limit_level", F.lit(float(max_epochs)) * F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("full_before", F.coalesce(F.sum(F.col("source_size") * max_epochs).over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
        .withColumn("level", F.min_by(F.when(F.col("level") <= F.col("limit_level"), F.col("level")), F.when(F.col("level") <= F.col("limit_level"), F.col("limit_level"))).over(Window.partitionBy()))
    )
    limit = F.col("source_size") * F.lit(float(max_epochs))
    return ranked.select("source", "source_size", F.coalesce(F.least(limit, F.col("level") * F.col("weight")), limit).alias("target"))


def plan_mix(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, range_bits: int = RANGE_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, source, mix_key, size) and, for each source, (source, source_size, target,
    epochs, last_key, last_size, last_n, last_of): the mix takes a row `epochs` times, and once more if
    it comes before last_key and last_size, or is one of the first last_n of the last_of rows there.

    size is the number of words of the whole text. The last document of a source is taken when the
    budget holds at least half of it, so a source misses its target by at most half a document. Rows
    of one key (an id's rows, a text's rows of null id) go by size; those of one size weigh the same,
    so they are counted and not sorted. Null and empty texts have size 0; null sources are one source.
    An empty table gives empty results. Other columns are not read.
    """
    rows = stored(
        docs.select(
            "doc_id", "source", random_key(F.col("doc_id"), F.col("text"), seed).alias("mix_key"),
            F.size(words(F.col("text"))).cast("long").alias("size"),
        ).withColumn("key_range", F.shiftright(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long"), 32 - range_bits).cast("int"))
    )
    sums = rows.groupBy("source", "key_range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = stored(targets.withColumn("epochs", epochs))
    in_source = Window.partitionBy("source").orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "key_range", F.coalesce(F.sum("range_size").over(in_source), F.lit(0)).alias("range_start")).alias("o")
    in_range = Window.partitionBy("source", "key_range").orderBy("mix_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.groupBy("source", "key_range", "mix_key", "size").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("size")).over(in_range), F.lit(0))).alias("r")
        .join(offsets, F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.key_range") == F.col("o.key_range")))
        .select("r.source", "r.mix_key", "r.size", "r.n", (F.col("r.before") + F.col("o.range_start")).alias("start")).alias("p")
    )
    t = targets.alias("t")
    rest = F.col("t.target") - F.col("t.epochs") * F.col("t.source_size")
    # Of the n rows of one size, those whose middle lies within the rest.
    fit = F.least(F.floor((rest - F.col("p.start") - F.col("p.size") / 2) / F.col("p.size")) + 1, F.col("p.n")).cast("long")
    last = (
        placed.join(t, F.col("p.source").eqNullSafe(F.col("t.source")))
        .where((F.col("p.size") > 0) & (F.col("p.start") + F.col("p.size") / 2 <= rest))
        .groupBy("p.source").agg(F.max(F.struct(F.col("p.mix_key").alias("last_key"), F.col("p.size").alias("last_size"), fit.alias("last_n"), F.col("p.n").alias("last_of"))).alias("last")).alias("l")
    )
    cuts = t.join(last, F.col("t.source").eqNullSafe(F.col("l.source")), "left").select("t.*", "l.last.*")
    return rows.drop("key_range"), stored(cuts)


def _with_times(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (source, mix_key, size, row) with source_size, target and how many times the mix takes each.

    Rows among which a source's cut falls are all alike for the budget: they are written down once and
    numbered part by part, with sums over the parts, so that no task holds them all."""
    r, c = rows.alias("r"), cuts.alias("c")
    joined = r.join(c, F.col("r.source").eqNullSafe(F.col("c.source"))).select("r.*", "c.source_size", "c.target", "c.epochs", "c.last_key", "c.last_size", "c.last_n", "c.last_of")
    at_last = (F.col("mix_key") == F.col("last_key")) & (F.col("size") == F.col("last_size"))
    before = (F.col("mix_key") < F.col("last_key")) | (F.col("mix_key") == F.col("last_key")) & (F.col("size") < F.col("last_size"))
    times = lambda more: F.when(F.col("size") > 0, F.col("epochs") + F.coalesce(more, F.lit(False)).cast("long")).otherwise(F.lit(0)).cast("long")
    out = ["source", "size", "row", "source_size", "target", "times"]
    if cuts.where("last_n < last_of").isEmpty():
        return joined.withColumn("times", times(before | at_last)).select(out)
    split = F.coalesce(at_last & (F.col("last_n") < F.col("last_of")), F.lit(False))
    tied = stored(joined.where(split).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    to_part = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = tied.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n")).select("source", "part", F.coalesce(F.sum("n").over(to_part), F.lit(0)).alias("ahead")).alias("q")
    number = tied.withColumn("number", F.row_number().over(Window.partitionBy("source", "part").orderBy("at"))).alias("n")
    ranked = number.join(parts, F.col("n.source").eqNullSafe(F.col("q.source")) & (F.col("n.part") == F.col("q.part"))).select("n.*", "q.ahead")
    whole = joined.where(~split).withColumn("times", times(before | at_last)).select(out)
    return whole.unionByName(ranked.withColumn("times", times(F.col("number") + F.col("ahead") <= F.col("last_n"))).select(out))


def mixed_sizes(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken) of every row of docs. Null and empty texts have
    size 0 and are not taken; null sources are one source; rows of one id, or of null id and one text, may be
    taken a different number of times. Very long texts are counted whole. An empty table gives an empty
    result; other columns are not read."""
    rows, cuts = plan_mix(docs, seed, **options)
    timed = _with_times(rows.select("source", "mix_key", "size", F.col("doc_id").alias("row")), cuts)
    return timed.select(F.col("row").alias("doc_id"), "source", "size", "source_size", "target", "times").withColumn("taken", F.col("times") * F.col("size"))


def mix(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mixed corpus: rows of docs with all their columns, each as often as the mix takes it.

    Only one row for each source goes back to the texts, so texts are not shuffled by the operator
    where the sources fit a broadcast, but for those of equal key and size that a cut parts. Rows without words add to no budget and are not taken.
    Columns of docs keep their names, whatever they are.
    """
    _, cuts = plan_mix(docs, seed, **options)
    d = docs.alias("d")
    size, key = F.size(words(F.col("d.text"))).cast("long"), random_key(F.col("d.doc_id"), F.col("d.text"), seed)
    timed = _with_times(d.select(F.col("d.source").alias("source"), key.alias("mix_key"), size.alias("size"), F.struct("d.*").alias("row")), cuts)
    return timed.where("times > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select("row.*")
