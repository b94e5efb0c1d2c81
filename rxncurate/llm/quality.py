"""Quality rules: plain counts of a text, and the log-likelihood ratio of its hashed n-grams.

Words and word pairs are hashed to a fixed number of buckets. Two multinomials are counted over
them, one on trusted documents and one on the whole corpus; a document's score is the mean log
ratio of its n-grams, and documents whose mean is under a fixed threshold are rejected.
All of it is built-in expressions on one row at a time, and one aggregation by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxncurate.llm.common import let, words

#: Fixed values of the contract.
SYMBOLS = "[#*$%&|<>]"
NOT_BLANK = r"[^\x20\x09-\x0D]"
REPEAT_WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20

#: Buckets of hashed n-grams; the log ratios of all buckets (8 bytes each) are broadcast.
BUCKETS = 2**16
#: The trusted multinomial is fitted on at most this many labelled documents (those of lowest hash).
MAX_TRUSTED = 200_000
#: Mean log ratio under which a document is rejected.
THRESHOLD = -0.2


def rule_counts(text: Column, w: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines of a text with words w, all long."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit(NOT_BLANK)))
    counts = {
        "n_words": F.size(w),
        "word_chars": F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
    }
    return {k: v.cast("long") for k, v in counts.items()}


def hashes(w: Column) -> Column:
    """(one, two): 64-bit hashes of the words, and of the pairs of neighbours."""
    pairs = lambda h: F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.struct(h.alias("one"), pairs(h).alias("two")))


def windows(h: Column) -> Column:
    """64-bit hashes of the five-word windows, in order, out of hashes(); none for shorter texts."""
    n = F.size(h["one"]) - REPEAT_WINDOW + 1
    at = lambda x, i: F.xxhash64(x, F.get(h["two"], i + 2), F.get(h["one"], i + 4))
    return F.transform(F.slice(h["two"], 1, F.greatest(n, F.lit(0))), at)


def repeated_words(h: Column) -> Column:
    """Words inside five-word windows that occur more than once. Hashed windows are sorted, so that
    equal ones are neighbours; each repeated window then adds the words that the one before lacks."""
    n = REPEAT_WINDOW
    ordered = lambda g: F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    twice = lambda s: F.filter(
        F.transform(s, lambda x, k: F.when(F.coalesce(F.get(s, k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False)), x["i"])), lambda p: p.isNotNull())
    zero = F.struct(F.lit(0).alias("n"), F.lit(-(10**9)).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(n), p - a["last"])).alias("n"), p.alias("last"))
    covered = lambda g: F.aggregate(F.array_sort(let(ordered(g), twice)), zero, step, lambda a: a["n"])
    return let(windows(h), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0)))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row (one, ratios): log of trusted over corpus probability for each bucket. The trusted counts
    are smoothed by one, those of the corpus by as much at their own scale, so that buckets which hold
    little evidence tend to 0, whatever the sizes of both. Without trusted documents all are 0.

    docs (doc_id, text) is counted whole; trusted (doc_id) marks documents of it, MAX_TRUSTED at most.
    """
    ids = F.broadcast(trusted.where("doc_id is not null").select(F.col("doc_id").alias("_trusted")).distinct().orderBy(F.md5(F.col("_trusted").cast("string").cast("binary")), "_trusted").limit(MAX_TRUSTED))
    marked = docs.select("doc_id", let(hashes(words(F.col("text"))), lambda h: F.concat(h["one"], h["two"])).alias("f")).join(ids, F.col("doc_id") == F.col("_trusted"), "left")
    seen = marked.select(F.explode("f").alias("f"), F.col("_trusted").isNotNull().cast("long").alias("t")).groupBy(_bucket(F.col("f"), buckets).alias("bucket")).agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n"))
    every = docs.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(seen, "bucket", "left").select("bucket", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("n", F.lit(0)).alias("n"))
    rows = F.array_sort(F.collect_list(F.struct("bucket", "t", "n")))
    whole = filled.agg(rows.alias("rows"), F.sum("t").alias("T"), F.sum("n").alias("N"))
    ratio = lambda x: F.when(F.col("T") > 0, F.log((x["t"] + 1) / (x["n"] * F.col("T") / F.col("N") + 1))).otherwise(F.lit(0.0))
    return whole.select(F.lit(1).alias("one"), F.transform("rows", ratio).alias("ratios"))


def apply_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept)
    for every row of docs.

    score is the mean log ratio over the n-grams of the whole text, null for texts without words.
    kept is false where base_failed, and else whether score is at least threshold. Null and empty
    texts have no words and fail the base rules. Without trusted documents all scores are 0. Very long texts are
    counted whole; repeated rows, and rows of null id, are judged each for itself. Only doc_id and text are read; an empty table gives an empty result.
    """
    ratios = F.broadcast(log_ratios(docs, trusted, buckets))
    base = docs.select("doc_id", F.col("text").alias("t"), words(F.col("text")).alias("w"), F.lit(1).alias("one"))
    counted = base.select("doc_id", "one", *[v.alias(k) for k, v in rule_counts(F.col("t"), F.col("w")).items()], hashes(F.col("w")).alias("h"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + F.get(F.col("ratios"), _bucket(b, buckets)))
    scored = counted.join(ratios, "one").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", let(F.col("h"), repeated_words).cast("long").alias("n_repeat_words"),
        F.when(F.col("n_words") > 0, (total(F.col("h.one")) + total(F.col("h.two"))) / (2 * F.col("n_words") - 1)).alias("score"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)))
