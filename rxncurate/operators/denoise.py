"""Noise heuristics of mapped reactions, template frequency, confusion tables and funnels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxncurate.functions.answers import structured_output
from rxncurate.functions.jsonfix import bound
from rxncurate.functions.reactions import BAD_SECTIONS, components, step_roles, valid_reaction, valid_skeleton
from rxncurate.functions.stats import rate, wilson
from rxncurate.functions.structure import looks_valid, same_structures, structure_key
from rxncurate.operators.once import once_each

#: Label, exact frequency or None, frequency that must be above the template's or None.
THRESHOLDS = (("N=1", 1, None), ("N<5", None, 5), ("N<10", None, 10))
#: More components than these are noise.
MOST_REACTANTS, MOST_PRODUCTS, MOST_REAGENTS = 2, 1, 5


def template_frequency(df: DataFrame, template: str = "template") -> DataFrame:
    """df with the template's frequency in it and whether it is a singleton. Counts are joined back,
    so a frequent template's rows stay spread; a null template has frequency 0."""
    counts = df.where(F.col(template).isNotNull()).groupBy(template).agg(F.count(F.lit(1)).alias("template_frequency"))
    return df.join(counts, template, "left").withColumn("template_frequency", F.coalesce("template_frequency", F.lit(0))).withColumn("singleton", (F.col("template_frequency") == 1).cast("int"))


def frequency_flag(frequency: Column, exact: Column, below: Column) -> Column:
    """Whether a template is rare: of exactly that frequency, or of one from 1 to under the limit."""
    return F.coalesce(frequency == exact, F.lit(False)) | F.coalesce((frequency > 0) & (frequency < below), F.lit(False))


def threshold_sensitivity(df: DataFrame, thresholds: Sequence[tuple] = THRESHOLDS) -> DataFrame:
    """Confusion cells and rates for each threshold. df: noise_free, template_frequency,
    template_failure, identical_structures. One row in df gives one for each threshold, which are
    few literals, aggregated at once."""
    rows = F.array(*[F.struct(F.lit(n).alias("threshold"), F.lit(e).cast("long").alias("exact"), F.lit(b).cast("long").alias("below")) for n, e, b in thresholds])
    flagged = frequency_flag(F.col("template_frequency"), F.col("t.exact"), F.col("t.below")) | (F.col("template_failure") == 1) | (F.col("identical_structures") == 1)
    cells = df.select("noise_free", "template_frequency", "template_failure", "identical_structures", F.explode(rows).alias("t")).select(F.col("t.threshold").alias("threshold"), "noise_free", flagged.cast("int").alias("filtered"))
    return with_rates(confusion(cells, ["threshold"]))


def confusion(df: DataFrame, keys: list[str]) -> DataFrame:
    """passed_tp, filtered_fn, passed_fp, filtered_tn by keys, of noise_free and filtered (0 or 1)."""
    cell = lambda free, out: F.sum(F.when((F.col("noise_free") == free) & (F.col("filtered") == out), 1).otherwise(0))
    return df.groupBy(*keys).agg(cell(1, 0).alias("passed_tp"), cell(1, 1).alias("filtered_fn"), cell(0, 0).alias("passed_fp"), cell(0, 1).alias("filtered_tn"))


def with_rates(cells: DataFrame) -> DataFrame:
    """Adds noise_free_saved, noisy_filtered and accuracy; 0.0 on an empty denominator."""
    tp, fn, fp, tn = (F.col(c) for c in ("passed_tp", "filtered_fn", "passed_fp", "filtered_tn"))
    return cells.withColumn("noise_free_saved", rate(tp, tp + fn, 0.0)).withColumn("noisy_filtered", rate(tn, fp + tn, 0.0)).withColumn("accuracy", rate(tp + tn, tp + fn + fp + tn, 0.0))


def confusion_by_heuristic(flags: DataFrame, heuristics: Sequence[str], keys: Sequence[str] = ("model",)) -> DataFrame:
    """Cells and rates for each key and heuristic; flags holds a column of 0 or 1 for each heuristic."""
    long = flags.unpivot([*keys, "noise_free"], list(heuristics), "heuristic", "filtered")
    return with_rates(confusion(long, [*keys, "heuristic"]))


#: The flags of a step and of a row.
STEP_FLAGS = ("many_reactants", "many_products", "many_reagents", "no_reagent", "template_failure", "missing_product_atom_maps", "identical_structures")
#: The heuristics of the denoising table.
HEURISTICS = ("many_products", "many_reactants", "many_reagents", "no_reagent", "rare_template")
#: What is wrong with a mapped step, and with one without mapping.
NO_LEFT, NO_PRODUCTS, NO_MAPS = "missing left-side components", "missing products", "product atom mapping is incomplete"
NO_TEMPLATE, UNREADABLE, NO_REACTANTS = "template extraction failed", "invalid SMILES", "mapped reactants unavailable"
NO_MAPPING = "mapped reaction is unavailable"
#: Fixed value: what stands between error texts.
ERROR_MARK = " | "


def _int(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def _step(n: dict[str, Column], flags: dict[str, Column], error: Column) -> Column:
    counts = [n[k].cast("int").alias(f"{k}_count") for k in ("reactant", "reagent", "product")]
    return F.struct(*counts, *[_int(flags[k]).alias(k) for k in STEP_FLAGS], error.alias("error"))


def step_facts(reaction: Column, key=structure_key, valid=looks_valid) -> Column:
    """struct(ok, reactant, reagent, product: numbers, n_left, maps_missing, readable, same) of a mapped reaction:
    what mapped_step takes from its text alone. same: reactants and products are equal as multisets of their
    keys, however they are written; key is an expression of a readable component, looked at only where both
    sides have as many components and the same atoms."""
    return bound(step_roles(reaction, valid), lambda r: F.struct(
        r["ok"].alias("ok"), F.size(r["reactants"]).alias("reactant"), F.size(r["reagents"]).alias("reagent"), F.size(r["products"]).alias("product"), r["n_left"].alias("n_left"),
        r["maps_missing"].alias("maps_missing"), r["readable"].alias("readable"), same_structures(r["reactants"], r["known_products"], key).alias("same")))


def mapped_step(reaction: Column, template_missing: Column, mapping_error: Column, key=structure_key, valid=looks_valid, facts=None) -> Column:
    """Counts, flags and error text of a mapped step. Whatever is wrong with it makes it a template
    failure. facts: an expression of the reaction that gives its step_facts, if not step_facts itself."""

    def judge(r: Column) -> Column:
        n = {k: r[k] for k in ("reactant", "reagent", "product")}
        told = F.nullif(F.trim(mapping_error), F.lit(""))
        errors = F.array(
            F.when(r["n_left"] == 0, F.lit(NO_LEFT)), F.when(n["product"] == 0, F.lit(NO_PRODUCTS)), F.when(r["maps_missing"], F.lit(NO_MAPS)), F.when(template_missing, F.lit(NO_TEMPLATE)),
            told, F.when(~r["readable"], F.lit(UNREADABLE)), F.when(n["reactant"] == 0, F.lit(NO_REACTANTS)))
        text = F.array_join(F.array_distinct(F.array_compact(errors)), ERROR_MARK)
        flags = lambda error: {
            "many_reactants": n["reactant"] > MOST_REACTANTS, "many_products": n["product"] > MOST_PRODUCTS, "many_reagents": n["reagent"] > MOST_REAGENTS,
            "no_reagent": (n["reactant"] > 0) & (n["product"] > 0) & (n["reagent"] == 0), "template_failure": error != "", "missing_product_atom_maps": r["maps_missing"],
            "identical_structures": (n["reactant"] > 0) & r["same"]}
        zero = {k: F.lit(0) for k in n}
        none = {k: F.lit(k in ("template_failure", "missing_product_atom_maps")) for k in STEP_FLAGS}
        return F.when(r["ok"], bound(text, lambda error: _step(n, flags(error), error))).otherwise(_step(zero, none, F.lit(BAD_SECTIONS)))

    return bound(facts(reaction) if facts else step_facts(reaction, key, valid), judge)


def unmapped_step(reaction: Column, error: Column) -> Column:
    """The same of a step without mapping: only its products count, and it is a failure."""
    s = F.split(F.trim(reaction), ">", -1)
    products = F.coalesce(F.when(F.size(s).isin(2, 3), F.size(components(F.element_at(s, -1)))), F.lit(0))
    flags = {k: F.lit(k in ("template_failure", "missing_product_atom_maps")) for k in STEP_FLAGS} | {"many_products": products > MOST_PRODUCTS}
    return _step({"reactant": F.lit(0), "reagent": F.lit(0), "product": products}, flags, F.coalesce(F.nullif(error, F.lit("")), F.lit(NO_MAPPING)))


def step_heuristics(df: DataFrame) -> DataFrame:
    """df (reaction, template_missing, mapping_error) with the counts, flags and error of mapped_step."""
    step = mapped_step(F.col("reaction"), F.col("template_missing"), F.coalesce("mapping_error", F.lit("")))
    return df.withColumn("_s", step).select(*df.columns, "_s.*")


def row_heuristics(df: DataFrame, issue_rare: str = "issue_rare", unresolved: str = "unresolved", texts: DataFrame | None = None) -> DataFrame:
    """df with the flags of its row, over steps aligned by place in the arrays reactions, mapped, templates
    and mapping_errors, as many as the longest has, one at least: any step's flag, the largest counts
    and the distinct errors. An unresolved name is a failure; a rare input, a failure or identical
    structures make it a rare template. All of it is work on one row; mapped reactions that are few (see
    once_each) are read once each. texts: a table of them (text), cheaper to read than df."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    lists = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("reactions", "mapped", "templates", "mapping_errors")]
    least = F.array(F.lit(None).cast("string"))
    padded = F.arrays_zip(F.concat(lists[0], F.when(F.greatest(*[F.size(x) for x in lists]) == 0, least).otherwise(F.array().cast("array<string>"))).alias("r"), *[x.alias(n) for x, n in zip(lists[1:], "mte")])

    if texts is None:
        texts = df.select(F.explode("mapped").alias("text"))
    facts = once_each(texts, step_facts)

    def step(x: Column) -> Column:
        error = F.when(blank(x["e"]), F.lit("")).otherwise(x["e"])
        return F.when(~blank(x["m"]), mapped_step(x["m"], blank(x["t"]), error, facts=facts)).otherwise(unmapped_step(x["r"], error))

    out = df.withColumn("_steps", F.transform(padded, step))
    most = lambda c: F.array_max(F.transform("_steps", lambda s: s[c]))
    errors = F.array_distinct(F.filter(F.transform("_steps", lambda s: s["error"]), lambda e: e != ""))
    counts = [most(f"{k}_count").alias(f"max_{k}_count") for k in ("reactant", "reagent", "product")]
    flags = {k: most(k) for k in STEP_FLAGS}
    flags["template_failure"] = F.greatest(flags["template_failure"], F.col(unresolved).cast("int"))
    rare = F.greatest(F.col(issue_rare).cast("int"), flags["template_failure"], flags["identical_structures"])
    return out.select(*df.columns, F.size("_steps").alias("reaction_count"), *counts, *[v.alias(k) for k, v in flags.items()], rare.alias("rare_template"), F.array_join(errors, ERROR_MARK).alias("evaluation_error"))


def row_rollup(steps: DataFrame, keys: list[str], rare: str = "issue_rare", unresolved: str = "unresolved") -> DataFrame:
    """The same flags where steps are rows: one aggregation by keys."""
    flags = {k: F.max(k) for k in STEP_FLAGS} | {"template_failure": F.greatest(F.max("template_failure"), F.max(unresolved))}
    out = steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("reaction_count"), *[v.alias(k) for k, v in flags.items()], F.max(rare).alias("issue_rare"))
    return out.withColumn("rare_template", F.greatest("issue_rare", "template_failure", "identical_structures"))


#: The issues of a model's output, in order of weight.
ISSUES = ("not_applicable_no_valid_ground_truth", "NoSmi_in_skeleton", "mapping_or_template_failure", "invalid_model_components", "ground_truth_mismatch")


def model_output_issue(ground_truth_valid: Column, unresolved: Column, failure: Column, signature: Column, matched: Column) -> Column:
    """The first issue that holds; the empty text where none does."""
    held = (~ground_truth_valid, unresolved, failure, signature.isNull(), ~matched)
    out = F
    for condition, issue in zip(held, ISSUES):
        out = out.when(F.coalesce(condition, F.lit(False)), F.lit(issue))
    return out.otherwise(F.lit(""))


def flag_table(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row for each (idx, model) of rows (idx, model, signature, unresolved and what row_heuristics
    adds), with the label of manifest (idx, ground_truth_valid, alternatives) of equal idx: the matched
    slot (0: none), the label, the issue of the output, and for each heuristic passed and filtered."""
    joined = rows.join(manifest.select("idx", "ground_truth_valid", "alternatives"), "idx")
    valid, unresolved, failure = F.col("ground_truth_valid"), F.col("unresolved").cast("boolean"), F.col("template_failure") == 1
    fits = valid & F.col("signature").isNotNull() & ~unresolved & ~failure
    slot = F.when(fits, F.coalesce(F.array_position("alternatives", F.col("signature")), F.lit(0))).otherwise(F.lit(0)).cast("int")
    out = joined.withColumn("matched_ground_truth", slot).withColumn("noise_free", valid.cast("int")).withColumn("noise_label", F.when(valid, "noise-free").otherwise("noisy"))
    out = out.withColumn("model_output_issue", model_output_issue(valid, unresolved, failure, F.col("signature"), F.col("matched_ground_truth") > 0))
    return out.withColumns({f"{h}_filtered": F.col(h) for h in HEURISTICS} | {f"{h}_passed": 1 - F.col(h) for h in HEURISTICS})


#: Texts (small letters) that stand for no value.
NO_VALUE = ("", "none", "null", "nan", "nosmi", "not found", "not_found")
#: The stages of a row, in order.
STAGES = ("generation_success", "structured_output_success", "reaction_processing_success", "name_to_smiles_success", "atom_mapping_success", "template_processing_success")


def has_value(c: Column) -> Column:
    """Whether a text stands for a value."""
    return ~F.lower(F.coalesce(F.trim(c), F.lit(""))).isin(*NO_VALUE)


def pipeline_flags(rows: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """rows with the success (0 or 1) of each stage, from what the pipeline left of a row: prediction,
    error, the arrays skeletons, reactions, mapper_reactions, mapped, templates, mapping_errors and the
    map smiles; and, with table-wide labels ground_truth_valid, extraction_exact and
    rare_template (0 or 1), whether denoising was right and the row succeeded from end to end. From
    processing on a stage needs the one before. predictions: a table of them (text), where few are known to
    occur over and over, so that each is read once (see once_each)."""
    full = lambda c: (F.size(c) > 0) & F.forall(c, has_value)
    as_many = lambda c: F.size(c) == F.size("reactions")
    said = F.coalesce("prediction", F.lit(""))
    made = once_each(predictions.select(F.coalesce("text", F.lit("")).alias("text")), structured_output)(said) if predictions is not None else structured_output(said)
    generation = has_value(F.col("prediction")) & ~has_value(F.col("error"))
    out = rows.withColumn("_made", made).withColumns({"_generation": generation, "_processing": generation & F.col("_made.ok") & full("skeletons") & F.forall("skeletons", valid_skeleton)})
    conversion = F.col("_processing") & (F.size("smiles") > 0) & F.forall(F.map_values("smiles"), has_value) & full("reactions") & as_many("skeletons") & F.forall("reactions", lambda r: valid_reaction(r))
    out = out.withColumn("_conversion", F.coalesce(conversion, F.lit(False)))
    told = F.exists("mapping_errors", lambda e: F.coalesce(F.trim(e), F.lit("")) != "")
    mapping = F.col("_conversion") & as_many("mapper_reactions") & as_many("mapped") & full("mapper_reactions") & F.forall("mapped", lambda m: valid_reaction(m, mapped=True)) & ~told
    out = out.withColumn("_mapping", F.coalesce(mapping, F.lit(False)))
    out = out.withColumn("_template", F.coalesce(F.col("_mapping") & as_many("templates") & full("templates"), F.lit(False)))
    free, exact, filtered = F.col("ground_truth_valid"), F.col("extraction_exact") == 1, F.col("rare_template") == 1
    stages = dict(zip(STAGES, ("_generation", "_made.ok", "_processing", "_conversion", "_mapping", "_template")))
    return out.withColumns({name: _int(F.col(c)) for name, c in stages.items()} | {
        "json_reaction_step_count": F.col("_made.steps"), "reaction_step_count": F.size("reactions"), "noise_free": _int(free),
        "denoising_correct": _int(F.when(free, ~filtered).otherwise(filtered)),
        "strict_end_to_end_success": _int(F.when(free, exact & F.col("_mapping") & F.col("_template") & ~filtered).otherwise(filtered)),
    }).drop("_made", "_generation", "_processing", "_conversion", "_mapping", "_template")


def extraction_exact(ground_truth_valid: Column, alternatives: Column, signature: Column, unresolved: Column) -> Column:
    """Whether a signature is one of those accepted, and nothing in it is unresolved."""
    return _int(ground_truth_valid & F.array_contains(alternatives, signature) & ~unresolved)


def issue_is_rare(issue: Column) -> Column:
    """Whether an issue text tells of a rare template."""
    return F.coalesce(F.contains(F.replace(F.lower(issue), F.lit("_"), F.lit("-")), F.lit("rare-template")), F.lit(False))


def stratified_sample(df: DataFrame, category: str, n: int, order: Sequence[Column]) -> DataFrame:
    """n rows of each category, the first in a fixed pseudo-random order."""
    w = Window.partitionBy(category).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def exclusive_category(flags: Sequence[str]) -> Column:
    """The single flag that is set; null where none or several are."""
    total = sum((F.col(f) for f in flags[1:]), F.col(flags[0]))
    return F.when(total == 1, F.coalesce(*[F.when(F.col(f) == 1, F.lit(f)) for f in flags]))


def weighted_extrapolation(cells: DataFrame, category: str = "category") -> DataFrame:
    """Sample cells (sample_tp, sample_fn, sample_fp, sample_tn, sample_n) scaled to population_n, and
    a row TOTAL of the sums, whose weight is null."""
    w = F.col("population_n").cast("double") / F.col("sample_n")
    names = ("tp", "fn", "fp", "tn")
    rows = cells.select(category, "population_n", "sample_n", w.alias("weight"), *[(F.col(f"sample_{c}") * w).alias(f"weighted_{c}") for c in names])
    total = rows.agg(F.sum("population_n").alias("population_n"), F.sum("sample_n").alias("sample_n"), *[F.sum(f"weighted_{c}").alias(f"weighted_{c}") for c in names])
    return rows.unionByName(total.select(F.lit("TOTAL").alias(category), "*", F.lit(None).cast("double").alias("weight")))


def stage_summary(flags: DataFrame, stages: Sequence[str], alone: str | None = None) -> DataFrame:
    """For each stage (a 0/1 column, in order): rows that passed all before (reached), successes among
    them, failures, successes over all rows, rates and Wilson interval of the conditional rate. alone: a
    further 0/1 column that is counted over all rows, with no conditional figures. One aggregation."""
    passed = F.lit(1)
    aggs = [F.count(F.lit(1)).alias("total"), *([F.sum(F.col(alone)).alias("alone")] if alone else [])]
    for k, s in enumerate(stages):
        reached, passed = passed, passed * F.col(s)
        aggs += [F.sum(reached).alias(f"r{k}"), F.sum(passed).alias(f"p{k}")]
    row = lambda k, s, r, p: F.struct(F.lit(k).alias("stage_order"), F.lit(s).alias("stage"), r.alias("reached"), p.alias("passed"))
    rows = [row(k, s, F.col(f"r{k}"), F.col(f"p{k}")) for k, s in enumerate(stages)]
    if alone:
        rows.append(row(len(stages), alone, F.lit(None).cast("long"), F.col("alone")))
    out = flags.agg(*aggs).select("total", F.inline(F.array(*rows)))
    low, high = wilson(F.col("passed"), F.col("reached"))
    out = out.withColumn("failed", F.col("reached") - F.col("passed")).withColumn("conditional_rate", rate(F.col("passed"), F.col("reached")))
    return out.withColumn("overall_rate", rate(F.col("passed"), F.col("total"))).withColumn("ci_lower", low).withColumn("ci_upper", high)


def noise_free_funnel(flags: DataFrame, stages: Sequence[str], exact: str) -> DataFrame:
    """Running conjunction of stages over the noise-free rows, as n/total, and the rows that are exact
    whatever the stages say, whose conditional figures are null."""
    steps = stage_summary(flags.where("noise_free = 1"), stages, exact)
    share = F.concat(F.col("passed").cast("string"), F.lit("/"), F.col("total").cast("string")).alias("share")
    return steps.select("stage_order", "stage", "reached", "passed", "total", "conditional_rate", share)
