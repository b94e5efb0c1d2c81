"""Extracted components against accepted ground truths."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxncurate.functions.checks import assert_unique
from rxncurate.functions.jsonfix import bound, parse_bool
from rxncurate.functions.stats import interval_text, one_decimal, percent_text, rate, wilson

#: Roles; reactants are multisets, the others sets.
ROLES = ("reactants", "reagents", "products")
MULTISET = "reactants"

#: The configurations of each model family, families in order of publication.
FAMILIES = {
    "qwen-3.5-9B": ("qwen-3.5-9b-off", "qwen-3.5-9b-low", "qwen-3.5-9b-high"),
    "fine-tuned qwen-3.5-9B": ("qwen-3.5-9b-ft-off", "qwen-3.5-9b-ft-low", "qwen-3.5-9b-ft-high"),
    "gpt-4.1-mini": ("gpt-4.1-mini-nonreasoning-shared",),
    "fine-tuned gpt-4.1-mini": ("gpt-4.1-mini-ft-nonreasoning-shared",),
    "gpt-5.4": ("gpt-5.4-none", "gpt-5.4-low", "gpt-5.4-high"),
    "gpt-5.6-sol": ("gpt-5.6-sol-none", "gpt-5.6-sol-low", "gpt-5.6-sol-high"),
    "gemini-2.5-flash": ("gemini-2.5-flash-none",),
    "gemini-3.1-pro-preview": ("gemini-3.1-pro-preview-low", "gemini-3.1-pro-preview-high"),
    "gemini-3.6-flash": ("gemini-3.6-flash-low", "gemini-3.6-flash-high"),
}
#: Effort labels in a configuration's name, and their ranks.
EFFORTS = {"off": 0, "none": 0, "nonreasoning": 0, "low": 1, "high": 2}


COUNTS = tuple(f"{r}_{c}" for r in ROLES for c in ("tp", "fp", "fn"))


def _numbered(parts: Column) -> Column:
    """A multiset as a set: each element with its number among equal ones."""
    return bound(F.sort_array(parts), lambda s: F.transform(s, lambda x, i: F.struct(x.alias("x"), (i - F.array_position(s, x)).alias("i"))))


def array_sets(arrays: Sequence[Column]) -> Column:
    """struct of the roles of their arrays, in the order of ROLES: sets that compare as the roles do."""
    return F.struct(*[(bound(a, _numbered) if r == MULTISET else F.array_distinct(a)).alias(r) for r, a in zip(ROLES, arrays)])


def role_sets(parts: Column) -> Column:
    """array_sets of the roles of parts, an array of struct(role, comp)."""
    return array_sets([F.transform(F.filter(parts, lambda x: x["role"] == r), lambda x: x["comp"]) for r in ROLES])


def compare_sets(pred: Column, truth: Column) -> Column:
    """struct(exact, covered, tp, errors and each role's tp, fp, fn) of two array_sets, on one row."""
    cells = {r: F.size(F.array_intersect(pred[r], truth[r])) for r in ROLES}
    own = F.struct(*[c.alias(r) for r, c in cells.items()], *[F.size(pred[r]).alias(f"p_{r}") for r in ROLES], *[F.size(truth[r]).alias(f"g_{r}") for r in ROLES])

    def judge(x: Column) -> Column:
        tp, made, asked = (reduce(Column.__add__, [x[f"{k}{r}"] for r in ROLES]) for k in ("", "p_", "g_"))
        errors = made + asked - tp - tp
        long = lambda c: c.cast("long")
        counts = [long(v).alias(f"{r}_{n}") for r in ROLES for n, v in (("tp", x[r]), ("fp", x[f"p_{r}"] - x[r]), ("fn", x[f"g_{r}"] - x[r]))]
        return F.struct((errors == 0).cast("int").alias("exact"), (asked == tp).cast("int").alias("covered"), long(tp).alias("tp"), long(errors).alias("errors"), *counts)

    return bound(own, judge)


def compare_alternatives(pred: DataFrame, truth: DataFrame, methods: Sequence, dealt: bool = False) -> DataFrame:
    """One row for each (rxn_id, method) of the reactions of truth: alternatives, an array of struct(slot,
    and compare_sets against it), and has_unresolved.

    pred: (rxn_id, method, role, comp, unresolved: boolean); truth: (rxn_id, slot, role, comp). Predictions are
    dealt by reaction once (unless dealt says that they are), folded by method and then into a map, so that each method's sets are made once;
    truths are folded by the same key and meet them there. All else is work on a row.
    """
    t = truth.groupBy("rxn_id").agg(F.collect_list(F.struct("slot", "role", "comp")).alias("_t"))
    own = (pred if dealt else pred.repartition("rxn_id")).groupBy("rxn_id", "method").agg(F.collect_list(F.struct("role", "comp")).alias("_c"), F.max(F.coalesce(F.col("unresolved"), F.lit(False)).cast("int")).alias("u"))
    slots = F.array_sort(F.array_distinct(F.transform("_t", lambda x: x["slot"])))
    accepted = F.transform(slots, lambda s: F.struct(s.alias("slot"), bound(F.filter("_t", lambda x: x["slot"] == s), role_sets).alias("sets")))
    return _compared(own.select("rxn_id", "method", role_sets(F.col("_c")).alias("sets"), "u"), t.select("rxn_id", accepted.alias("_a")), methods)


def compare_arrays(pred: DataFrame, truth: DataFrame, methods: Sequence) -> DataFrame:
    """compare_alternatives of rows whose components are in arrays already, named by their roles: pred (rxn_id,
    method, arrays), a row for each method, truth (rxn_id, slot, arrays), a row for each slot, both dealt by reaction.
    No name is unresolved. Arrays become sets as they are, not rows that are folded again."""
    sets = array_sets([F.col(r) for r in ROLES]).alias("sets")
    t = truth.select("rxn_id", F.struct("slot", sets).alias("_s")).groupBy("rxn_id").agg(F.sort_array(F.collect_list("_s")).alias("_a"))
    return _compared(pred.select("rxn_id", "method", sets, F.lit(0).alias("u")), t, methods)


def _compared(own: DataFrame, accepted: DataFrame, methods: Sequence) -> DataFrame:
    """compare_alternatives' rows of (rxn_id, method, sets, u) and (rxn_id, _a: array of struct(slot, sets) in order)."""
    p = own.groupBy("rxn_id").agg(F.map_from_entries(F.collect_list(F.struct("method", F.struct("sets", "u")))).alias("_p"))
    joined = accepted.join(p, "rxn_id", "left")
    kind = own.schema["method"].dataType
    # Each method's row takes its own sets along, not the map of all.
    of = lambda m: F.struct(m.alias("method"), F.try_element_at("_p", m).alias("own"))
    each = joined.select("rxn_id", "_a", F.explode(F.array(*[of(F.lit(m).cast(kind)) for m in methods])).alias("_e"))
    none = array_sets([F.array().cast(own.schema["sets"].dataType["products"].dataType)] * len(ROLES))
    sets = each.select("rxn_id", "_e.method", "_a", F.coalesce("_e.own.sets", none).alias("_sets"), F.coalesce("_e.own.u", F.lit(0)).alias("has_unresolved"))
    compared = F.transform("_a", lambda a: F.struct(a["slot"].alias("slot"), compare_sets(F.col("_sets"), a["sets"]).alias("c")))
    return sets.select("rxn_id", "method", "has_unresolved", compared.alias("alternatives"))


def section_counts(compared: DataFrame) -> DataFrame:
    """(rxn_id, method, slot, role, tp, fp, fn, exact, covered) of compare_alternatives' rows."""
    rows = compared.select("rxn_id", "method", F.explode("alternatives").alias("a")).select("rxn_id", "method", "a.slot", "a.c")
    roles = F.array(*[F.struct(F.lit(r).alias("role"), *[F.col(f"c.{r}_{n}").alias(n) for n in ("tp", "fp", "fn")]) for r in ROLES])
    out = rows.select("rxn_id", "method", "slot", F.inline(roles))
    return out.withColumn("exact", ((F.col("fp") == 0) & (F.col("fn") == 0)).cast("int")).withColumn("covered", (F.col("fn") == 0).cast("int"))


def best_ground_truth(compared: DataFrame, prefer_coverage: bool = False) -> DataFrame:
    """The best alternative of each row of compare_alternatives, with its counts: [covered,] exact, more tp,
    fewer errors, lower slot; and reaction_correct: exact without an unresolved name, or, if coverage is
    preferred, covered whatever is unresolved."""
    order = lambda a: F.struct(*([a["c"]["covered"].alias("o")] if prefer_coverage else []), a["c"]["exact"].alias("e"), a["c"]["tp"].alias("t"), (-a["c"]["errors"]).alias("r"), (-a["slot"]).alias("s"))
    best = F.array_max(F.transform("alternatives", lambda a: F.struct(order(a).alias("o"), a.alias("a"))))["a"]
    out = compared.select("rxn_id", "method", "has_unresolved", best.alias("b")).select("rxn_id", "method", "b.slot", "b.c.*", "has_unresolved")
    right = F.col("covered") == 1 if prefer_coverage else (F.col("exact") == 1) & (F.col("has_unresolved") == 0)
    return out.withColumn("reaction_correct", right.cast("int"))


def with_excluded(flags: DataFrame, manifest: DataFrame, methods: Sequence) -> DataFrame:
    """flags of best_ground_truth's rows with evaluation_included 1, and a row for each method and each row of
    manifest (idx, ground_truth_valid, review_note) without a valid ground truth: evaluation_included 0, its
    note as exclusion_reason, counts and flags null."""
    kind = flags.schema["method"].dataType
    out = manifest.where(~F.col("ground_truth_valid")).select(
        F.col("idx").cast(flags.schema["rxn_id"].dataType).alias("rxn_id"), F.explode(F.array(*[F.lit(m).cast(kind) for m in methods])).alias("method"),
        F.lit(0).alias("evaluation_included"), F.coalesce("review_note", F.lit("")).alias("exclusion_reason"))
    return flags.withColumns({"evaluation_included": F.lit(1), "exclusion_reason": F.lit("")}).unionByName(out, allowMissingColumns=True)


def extraction_metrics(flags: DataFrame) -> DataFrame:
    """For each method and role: sums, precision and recall (null on an empty denominator); and the
    method's correct reactions, accuracy and Wilson interval. One aggregation of best_ground_truth's rows. Rows
    that with_excluded added count as excluded and for nothing else."""
    out = F.count_if(F.col("evaluation_included") == 0) if "evaluation_included" in flags.columns else F.lit(0).cast("long")
    sums = flags.groupBy("method").agg(F.count("reaction_correct").alias("evaluated"), out.alias("excluded"), F.sum("reaction_correct").alias("correct"), *[F.sum(c).alias(c) for c in COUNTS])
    roles = F.array(*[F.struct(F.lit(r).alias("role"), *[F.col(f"{r}_{c}").alias(c) for c in ("tp", "fp", "fn")]) for r in ROLES])
    low, high = wilson(F.col("correct"), F.col("evaluated"))
    rows = sums.select("method", "evaluated", "excluded", "correct", F.inline(roles))
    rows = rows.withColumn("precision", rate(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", rate(F.col("tp"), F.col("tp") + F.col("fn")))
    return rows.withColumn("incorrect", F.col("evaluated") - F.col("correct")).withColumn("accuracy", rate(F.col("correct"), F.col("evaluated"))).withColumn("ci_lower", low).withColumn("ci_upper", high)


def best_configuration(metrics: DataFrame, family: Column, effort: Column) -> DataFrame:
    """One method of each family: highest accuracy, then lowest effort, then name."""
    w = Window.partitionBy("family").orderBy(F.col("accuracy").desc_nulls_last(), "effort", "method")
    return metrics.withColumn("family", family).withColumn("effort", effort).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def publication_table(metrics: DataFrame) -> DataFrame:
    """One row for each method with percent texts, from extraction_metrics' rows."""
    m = metrics.groupBy("method").agg(
        *[F.max(F.when(F.col("role") == r, percent_text(F.col(k)))).alias(f"{r}_{k}_pct") for r in ROLES for k in ("precision", "recall")],
        F.first("accuracy").alias("accuracy"), F.first("ci_lower").alias("ci_lower"), F.first("ci_upper").alias("ci_upper"))
    return m.withColumn("accuracy_ci", interval_text(F.col("accuracy"), F.col("ci_lower"), F.col("ci_upper"))).drop("accuracy", "ci_lower", "ci_upper")


def effort_rank(method: Column, labels: dict[str, int], default: int = 99) -> Column:
    """Rank of the first label that the method's text contains."""
    out = F.lit(default)
    for label, rank in reversed(labels.items()):
        out = F.when(F.contains(method, F.lit(label)), F.lit(rank)).otherwise(out)
    return out


def family_of(method: Column) -> Column:
    """struct(name, place) of a configuration's family; null for other methods."""
    out = None
    for k, (name, members) in enumerate(FAMILIES.items()):
        value = F.struct(F.lit(name).alias("name"), F.lit(k).alias("place"))
        out = F.when(method.isin(*members), value) if out is None else out.when(method.isin(*members), value)
    return out


def best_of_families(metrics: DataFrame, baseline: str) -> DataFrame:
    """The baseline's row, then the best configuration of each family, with their place in the table."""
    known = metrics.withColumn("_family", family_of(F.col("method"))).where("_family IS NOT NULL")
    best = best_configuration(known, F.col("_family.name"), effort_rank(F.col("method"), EFFORTS)).withColumn("place", F.col("_family.place") + 1).drop("_family")
    first = metrics.where(F.col("method") == baseline).withColumn("family", F.lit(baseline)).withColumn("effort", F.lit(None).cast("int")).withColumn("place", F.lit(0))
    return first.unionByName(best).orderBy("place")


def signature(keys: Column, multiset: bool) -> Column:
    """Canonical order of component keys; null if any is null."""
    whole = F.array_sort(keys if multiset else F.array_distinct(keys))
    return F.when(F.forall(keys, lambda k: k.isNotNull()), whole)


def signature_text(reactants: Column, reagents: Column, products: Column) -> Column:
    """Signature of a reaction as JSON with keys in order; null without products or with invalid parts."""
    sig = F.struct(signature(products, False).alias("products"), signature(reactants, True).alias("reactants"), signature(reagents, False).alias("reagents"))
    ok = (F.size(products) > 0) & sig["products"].isNotNull() & sig["reactants"].isNotNull() & sig["reagents"].isNotNull()
    return F.when(ok, F.to_json(sig))


def prediction_keys(keys: Column, texts: Column) -> Column:
    """Structure keys, with invalid components kept as text so that they count as wrong."""
    return F.zip_with(keys, texts, lambda k, t: F.coalesce(k, F.concat(F.lit("__invalid__:"), F.trim(t))))


#: Where a row's ground truth comes from.
VALIDATED, NO_TRUTH = "human_validated", "no_valid_ground_truth"


def ground_truth_manifest(review: DataFrame) -> DataFrame:
    """(idx, ground_truth_valid, ground_truth_source, alternatives, ground_truth_count, review_note) from (idx,
    ground_truth_valid: a boolean or its text, signature_1, signature_2, review_note if there is one). A row
    that is not valid has no alternatives. A valid row without its first signature, a repeated idx, and a
    label that is no boolean fail the job."""
    kind = review.schema["ground_truth_valid"].dataType.simpleString()
    valid = F.col("ground_truth_valid") if kind == "boolean" else parse_bool(F.col("ground_truth_valid"), strict=True)
    rows = assert_unique(review, ["idx"]).withColumn("ground_truth_valid", F.coalesce(valid, F.raise_error(F.lit("a row has no label")).cast("boolean")))
    alts = F.filter(F.array("signature_1", "signature_2"), lambda s: s.isNotNull())
    lost = F.raise_error(F.concat(F.lit("a valid row has no signature: "), F.col("idx").cast("string"))).cast("array<string>")
    held = F.when(~F.col("ground_truth_valid"), F.array().cast("array<string>")).when(F.col("signature_1").isNull(), lost).otherwise(alts)
    note = F.coalesce(F.col("review_note").cast("string"), F.lit("")) if "review_note" in review.columns else F.lit("")
    out = rows.select("idx", "ground_truth_valid", F.when(F.col("ground_truth_valid"), VALIDATED).otherwise(NO_TRUTH).alias("ground_truth_source"), held.alias("alternatives"), note.alias("review_note"))
    return out.withColumn("ground_truth_count", F.size("alternatives"))


def matched_slot(alternatives: Column, sig: Column) -> Column:
    """1-based slot of the first alternative equal to a signature; 0 if none is."""
    return F.coalesce(F.array_position(alternatives, sig), F.lit(0)).cast("int")


def metrics_of(metrics: DataFrame, model: str) -> DataFrame:
    """A model's rows, most accurate first, with the rates as percent to one decimal: a chart's input."""
    percent = {c: one_decimal(F.col(c) * 100) for c in ("noise_free_saved", "noisy_filtered", "accuracy")}
    return metrics.where(F.col("model") == model).orderBy(F.col("accuracy").desc(), "heuristic").withColumns({f"{c}_percent": v for c, v in percent.items()})
