"""Integrity checks of input tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df itself; raises ValueError that lists the missing columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def duplicate_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Key values that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def key_mismatches(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with the side: left_only or right_only."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left_only")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right_only")))


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with a check that runs with it: a repeated key fails the job. One aggregation by key."""
    bad = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    checked = bad.select(*keys, F.when(F.col("_n") > 1, F.raise_error(F.lit("a key is repeated"))).otherwise(F.lit(True)).cast("boolean").alias("_ok"))
    return df.join(checked, keys).where("_ok").drop("_ok")


class Watched:
    """Checks that ride on the job that writes a table, and fail it afterwards.

    rows: the table to write. Counts are made while it is written, by one observed aggregate without a
    shuffle or a second reading; verify raises ValueError with all broken rules and their counts. Rules hold
    for rows; null, where a rule is neither true nor false, breaks it. An empty table breaks none. A job
    that stops early (limit, show) has seen only some rows and proves nothing."""

    def __init__(self, df: DataFrame, rules: dict[str, Column]):
        self._rules = list(rules)
        self._seen = Observation()
        broken = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"r{k}") for k, rule in enumerate(rules.values())]
        self.rows = df.observe(self._seen, F.count(F.lit(1)).alias("n"), *broken)

    def counts(self) -> dict[str, int]:
        """Rows that break each rule, once the table was written; and the number of rows, as `rows`."""
        got = self._seen.get
        return {"rows": got["n"]} | {name: got[f"r{k}"] for k, name in enumerate(self._rules)}

    def verify(self, rows: int | None = None) -> int:
        """The number of rows; raises where a rule is broken, or where they are not as many as asked."""
        counts = self.counts()
        n = counts.pop("rows")
        wrong = [f"{name}: {k} rows" for name, k in counts.items() if k]
        if rows is not None and n != rows:
            wrong.append(f"{n} rows instead of {rows}")
        if wrong:
            raise ValueError("checks failed: " + "; ".join(wrong))
        return n


def complementary(a: Column, b: Column) -> Column:
    """Whether of two flags (0 and 1, or booleans) one is set and the other is not."""
    return a.cast("int") + b.cast("int") == 1


def sums_to(cells: Iterable[Column], total: Column) -> Column:
    """Whether the cells of a table add up to its total."""
    out = F.lit(0)
    for c in cells:
        out = out + c
    return out == total


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of two tables by keys, which both have, each key once and null never; else the job fails when it
    runs. One full join: each side counts its own rows of a key while it is dealt by the keys."""
    once = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n), *[F.first(c).alias(c) for c in df.columns if c not in keys])
    both = once(left, "_left").join(once(right, "_right"), keys, "full")
    missing = F.col("_left").isNull() | F.col("_right").isNull()
    null = F.coalesce(*[F.when(F.col(k).isNull(), True) for k in keys], F.lit(False))
    problem = F.when(null, "a key is null").when(missing, "a key is on one side only").when((F.col("_left") > 1) | (F.col("_right") > 1), "a key is repeated")
    fine = F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(problem).cast("boolean"))
    return both.where(fine).drop("_left", "_right")
