"""Work on texts that repeat, done once for each distinct text and looked up on the rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct texts, and characters of their results, that a plan holds as a literal; beyond either rows are worked on one by one.
FEW, FEW_CHARS = 256, 1_000_000


def once_each(texts: DataFrame, work: Callable[[Column], Column], most: int = FEW) -> Callable[[Column], Column]:
    """work, an expression of a text, for rows whose texts all occur in texts (column text). If these have at most so
    many distinct values, Spark works on each of them once and rows look its result up in a literal map; if they
    have more, it is work itself. Results are the same both ways. A null text is not looked at and gives null; a
    text that texts lacks fails the job. texts is read when this is called."""
    distinct = texts.select("text").where("text IS NOT NULL").distinct().limit(most + 1)
    if distinct.count() > most:
        return lambda t: F.when(t.isNotNull(), work(t))
    done = distinct.repartition(1).select("text", F.struct(work(F.col("text")).alias("v")).alias("r"))
    kind = done.schema["r"].dataType
    rows = done.select("text", F.to_json("r", {"ignoreNullFields": "false"}).alias("r")).collect()  # at most so many rows
    if sum(len(x["text"]) + len(x["r"]) for x in rows) > FEW_CHARS:
        return lambda t: F.when(t.isNotNull(), work(t))
    # One JSON literal, which the optimizer turns into a map before any row is read.
    pairs = ", ".join(f"{json.dumps(x['text'])}: {x['r']}" for x in rows)
    table = F.from_json(F.lit("{" + pairs + "}"), f"map<string,{kind.simpleString()}>")
    lost = F.raise_error(F.lit("a text that was not among those given"))
    return lambda t: F.when(t.isNotNull(), F.coalesce(F.try_element_at(table, t), lost)["v"])
