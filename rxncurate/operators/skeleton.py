"""Reaction skeletons out of ordered step lists.

A row holds its products' codes and its steps (step_key, equation) in order; all of the work is on
the arrays of one row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxncurate.functions.jsonfix import bound
from rxncurate.functions.reactions import substitute_codes
from rxncurate.sources.shared import stored


def parsed_steps(steps: Column) -> Column:
    """Steps as struct(number, kind, left, right); null if an equation has not exactly one arrow or a
    key no number. number is the key's minus 1; kind is reaction, involve or work-up."""
    kind = lambda k: F.when(F.contains(F.lower(k), F.lit("reaction")), "reaction").when(F.contains(F.lower(k), F.lit("work-up-involve")), "involve").otherwise("work-up")
    number = lambda s: F.substring_index(s["step_key"], " ", 1).try_cast("int") - 1
    # A key is read, and its equation's arrow found, once for each step, and without patterns.
    read = F.transform(steps, lambda s: F.struct(number(s).alias("number"), kind(s["step_key"]).alias("kind"), F.instr(s["equation"], F.lit("->")).alias("at"), s["equation"].alias("equation")))
    before, behind = (lambda s: F.substring(s["equation"], F.lit(1), s["at"] - 1)), (lambda s: F.substring(s["equation"], s["at"] + 2, F.length(s["equation"])))
    one = lambda s: F.struct(
        s["number"].alias("number"), s["kind"].alias("kind"), F.array_distinct(F.split(before(s), r"\+", -1)).alias("left"), F.split(behind(s), r"\+", -1).alias("right"))
    ok = lambda r: F.forall(r, lambda s: (s["at"] > 0) & ~F.contains(behind(s), F.lit("->")) & s["number"].isNotNull())
    return bound(read, lambda r: F.when(ok(r), F.transform(r, one)))


def step_rows(df: DataFrame, keys: list[str], steps: str = "steps") -> DataFrame:
    """One row for each step: pos, number, kind, left, right."""
    return df.select(*keys, F.posexplode(parsed_steps(F.col(steps))).alias("pos", "s")).select(*keys, "pos", "s.*")


def with_groups(df: DataFrame, steps: str = "steps") -> DataFrame:
    """df with `_parsed`, and `_groups`: struct(name, inputs) of intermediates made from equal inputs.

    A product's inputs are the left side less itself, if any is left; a product made again keeps its
    first place and takes the last inputs. Groups are in order of their first product.
    """
    # A left side holds a code once, so that one removal takes its product out.
    pairs = F.filter(F.flatten(F.transform("_parsed", lambda s: F.transform(s["right"], lambda p: F.struct(p.alias("name"), F.sort_array(F.array_remove(s["left"], p)).alias("inputs"))))), lambda x: F.size(x["inputs"]) > 0)
    # Products made once and inputs used once, the usual case, need no search for others like them.
    last = lambda n: F.element_at(F.filter("_pairs", lambda x: x["name"] == n), -1)
    named = F.array_distinct(F.col("_pairs")["name"])
    made = F.when(F.size(named) == F.size("_pairs"), F.col("_pairs")).otherwise(F.transform(named, last))
    raw = lambda k: F.filter(k, lambda i: ~F.contains(i, F.lit("mixture"))).alias("inputs")
    group = lambda k: F.struct(F.array_join(F.sort_array(F.filter("_made", lambda x: x["inputs"] == k)["name"]), ".").alias("name"), raw(k))
    alone = F.transform("_made", lambda x: F.struct(x["name"].alias("name"), raw(x["inputs"])))
    groups = bound(F.array_distinct(F.col("_made")["inputs"]), lambda sets: F.when(F.size(sets) == F.size("_made"), alone).otherwise(F.transform(sets, group)))
    return df.withColumn("_parsed", parsed_steps(F.col(steps))).withColumn("_pairs", pairs).withColumn("_made", made).withColumn("_groups", groups).drop("_pairs", "_made")


def with_skeletons(df: DataFrame, products: str = "products", steps: str = "steps", out: str = "skeletons") -> DataFrame:
    """df with the array of skeletons of each row; null where a step is malformed or products are missing.

    Groups are cut into segments that end at a group whose name contains a product's code; the rest
    is dropped. Inputs of groups whose place is a reaction step's number are joined, those of
    work-up-involve numbers are set apart; a later segment of one product replaces an earlier.
    """
    labels = lambda kind: F.filter("_parsed", lambda s: s["kind"] == kind)["number"]
    joined = lambda x: F.array_join(x["inputs"], ".")
    piece = lambda x, i, reaction, involve: F.when(F.size(x["inputs"]) == 0, "").when(F.array_contains(reaction, i), F.concat(joined(x), F.lit(">"))).when(F.array_contains(involve, i), F.concat(F.lit(">"), joined(x), F.lit(">"))).otherwise("")
    # Bound: what a lambda reads is worked out once for a row, not for each group.
    pieces = bound(labels("reaction"), lambda r: bound(labels("involve"), lambda v: F.transform("_groups", lambda x, i: piece(x, i, r, v))))
    ends = F.filter(F.transform("_groups", lambda x, i: F.when(F.exists(F.col(products), lambda p: F.contains(x["name"], p)), i)), lambda i: i.isNotNull())
    g = with_groups(df, steps).withColumn("_pieces", pieces).withColumn("_ends", ends)
    # A segment begins behind the end before it.
    begin = lambda k: F.coalesce(F.get("_ends", k - 1) + 1, F.lit(0))
    text = lambda e, k: F.array_join(F.slice("_pieces", begin(k) + 1, e - begin(k) + 1), "")
    g = g.withColumn("_closed", F.transform("_ends", lambda e, k: F.struct(F.get("_groups", e)["name"].alias("name"), text(e, k).alias("text"))))
    last = lambda n: F.element_at(F.filter("_closed", lambda x: x["name"] == n), -1)["text"]
    formula = lambda n: F.replace(F.concat(F.ltrim(last(n), F.lit(">")), F.lit(">"), n), F.lit(">>"), F.lit(">"))
    formulas = F.filter(F.transform(F.array_distinct(F.col("_closed")["name"]), formula), lambda s: ~F.startswith(s, F.lit(">")))
    return g.withColumn(out, F.when(F.col(products).isNotNull(), formulas)).drop("_parsed", "_groups", "_ends", "_pieces", "_closed")


#: Fixed value: what stands for the reactions of an answer without skeletons.
NO_SKELETON = "Error: empty rxn_codes"


def with_reactions(df: DataFrame, skeletons: str = "skeletons", smiles: str = "smiles", out: str = "reactions") -> DataFrame:
    """df with structures in place of codes; an error text where there is no skeleton."""
    s = F.col(skeletons)
    made = F.transform(s, lambda x: substitute_codes(x, F.col(smiles)))
    return df.withColumn(out, F.when(s.isNull() | (F.size(s) == 0), F.array(F.lit(NO_SKELETON))).otherwise(made))


def assemble_reactions(answers: DataFrame, dictionaries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, skeletons, reactions, error) of answers (keys, products, steps), with the dictionary
    (keys, smiles: a map) of equal keys; keys begin with idx. Where the answer did not decode (null
    steps) or there is no dictionary, error names the row, and there are no reactions."""
    joined = with_skeletons(answers.join(dictionaries.select(*keys, "smiles"), keys, "left"))
    out = with_reactions(joined)
    bad = F.col("steps").isNull() | F.col("smiles").isNull()
    error = F.when(bad, F.concat(F.col(keys[0]).cast("string"), F.lit(" " + NO_SKELETON)))
    return out.select(*keys, "skeletons", F.when(~bad, F.col("reactions")).alias("reactions"), error.alias("error"))


def expand_inputs(edges: DataFrame) -> DataFrame:
    """(idx, node, base): the inputs of each intermediate that are made from nothing, over edges
    (idx, node, input), however long the chain is. Each round doubles the levels that are reached, is
    written to the shared folder, and the last one adds nothing, so that cycles end too. A node that
    leads only into cycles has no base (see cyclic_nodes)."""
    reached = _reached(edges)
    made = edges.select("idx", F.col("node").alias("base")).distinct()
    return reached.join(made, ["idx", "base"], "left_anti").select("idx", "node", "base")


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(idx, node) of the intermediates that are, through others, their own inputs."""
    return _reached(edges).where("node = base").select("idx", "node")


def _reached(edges: DataFrame) -> DataFrame:
    """(idx, node, base) of every input that a node needs, directly or through others."""
    reached = stored(edges.select("idx", "node", F.col("input").alias("base")).distinct())
    n = reached.count()
    while True:
        further = reached.select("idx", F.col("node").alias("base"), F.col("base").alias("below"))
        longer = reached.join(further, ["idx", "base"]).select("idx", "node", F.col("below").alias("base"))
        reached = stored(reached.unionByName(longer).distinct())
        more = reached.count()
        if more == n:
            return reached
        n = more


def work_up_only(steps: Column, products: Column) -> Column:
    """Chemicals of work-up steps, of parsed steps, that are neither made nor used in a reaction step."""
    of = lambda kind: F.array_distinct(F.flatten(F.transform(F.filter(steps, lambda s: s["kind"] == kind), lambda s: s["left"])))
    made = F.flatten(F.transform(steps, lambda s: s["right"]))
    return F.array_except(F.array_except(F.array_except(of("work-up"), made), products), of("reaction"))
