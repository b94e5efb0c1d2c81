"""Registered queries: answers, skeletons, reactions, names, review, resume, consensus, audit, chat records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxncurate.functions import answers, jsonfix, names, reactions
from rxncurate.operators import audit, consensus, denoise, finetune, review, skeleton
from rxncurate.operators import names as resolving
from rxncurate.plans.standins import reactions_of, standin
from rxncurate.sources.shared import stored
from rxncurate.sources.tables import table

TITLE = 40


def json_decode_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = standin(spark, sf_dir, "answers").withColumn("o", jsonfix.parse_answer(F.col("answer")))
    return a.select("k", jsonfix.is_valid_json(F.col("answer")).alias("valid"), F.get_json_object("o", "$.Products.C").alias("product"), F.get_json_object("o", "$['Reactants, Solvents, Catalysts'].B").alias("b"))


def structured_output_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin(spark, sf_dir, "answers").select("k", answers.structured_output(F.col("answer")).alias("s")).select("k", "s.ok", "s.steps")


def _steps(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", F.row_number().over(w).alias("n"), F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).alias("m"))
    kind = F.when(F.col("l_returnflag") == "R", "Reaction").when(F.col("l_returnflag") == "A", "Work-up-involve").otherwise("Work-up")
    number = F.col("n").cast("string")
    before = F.when(F.col("n") > 1, F.concat(F.lit("+mixture"), (F.col("n") - 1).cast("string"))).otherwise("")
    made = F.when(F.col("n") == F.col("m"), "P").otherwise(F.concat(F.lit("mixture"), number))
    step = F.struct("n", F.concat(number, F.lit(" ("), kind, F.lit(", stir)")).alias("step_key"), F.concat(F.lit("C"), (F.col("l_partkey") % 9).cast("string"), before, F.lit("->"), made).alias("equation"))
    grouped = rows.select("l_orderkey", step.alias("s")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("s")).alias("steps"))
    return grouped.select(F.col("l_orderkey").alias("idx"), F.array(F.lit("P")).alias("products"), "steps")


def step_explode_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.step_rows(_steps(spark, sf_dir), ["idx"]).select("idx", "pos", "number", "kind", F.array_join("left", "+").alias("left"), F.array_join("right", "+").alias("right"))


def skeleton_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.with_skeletons(_steps(spark, sf_dir)).select("idx", F.array_join("skeletons", "|").alias("skeletons"))


def _smiles():
    return F.create_map(*[x for k in range(0, 9, 2) for x in (F.lit(f"C{k}"), F.lit("C" * (k + 1)))])


def substitute_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = skeleton.with_skeletons(_steps(spark, sf_dir)).withColumn("smiles", _smiles())
    return skeleton.with_reactions(s).select("idx", F.array_join("reactions", "|").alias("reactions"))


def _reactions(spark, sf_dir):
    return reactions_of(standin(spark, sf_dir, "mapped_component"))


def split_reaction_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reactions(spark, sf_dir).withColumn("s", reactions.split_reaction(F.col("reaction")))
    return r.select("rxn_id", *[F.size(f"s.{c}").alias(f"n_{c}") for c in ("reactants", "reagents", "products")], reactions.reaction_text(*[F.col(f"s.{c}") for c in ("reactants", "reagents", "products")]).alias("text"))


def role_by_map_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reactions(spark, sf_dir)
    out = r.select("rxn_id", reactions.roles_of_source(F.col("reaction")).alias("a"), reactions.roles_of_mapped(F.col("reaction")).alias("b"), reactions.roles_of_step(F.col("reaction")).alias("c"))
    size = lambda s, r: F.size(F.col(f"{s}.{r}")).alias(f"{s}_{r}")
    return out.select("rxn_id", *[size(s, r) for s in "abc" for r in ("reactants", "reagents")])


def mapper_input_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, error = reactions.mapper_input(F.col("reaction"))
    return _reactions(spark, sf_dir).select("rxn_id", value.alias("value"), error.alias("error"))


def _step_flags(spark, sf_dir):
    r = reactions_of(standin(spark, sf_dir, "mapped_steps"))
    error = F.when(F.col("rxn_id") % 17 == 0, " mapper failed ").when(F.col("rxn_id") % 34 == 1, "invalid SMILES")
    return denoise.step_heuristics(r.select("rxn_id", "reaction", (F.col("rxn_id") % 13 == 0).alias("template_missing"), error.alias("mapping_error")))


def step_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _step_flags(spark, sf_dir).drop("reaction", "template_missing", "mapping_error")


def row_heuristics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rare, unresolved = (F.col("rxn_id") % 19 == 0).cast("int").alias("issue_rare"), (F.col("rxn_id") % 23 == 0).cast("int").alias("unresolved")
    s = _step_flags(spark, sf_dir).select((F.col("rxn_id") / 4).cast("bigint").alias("idx"), *denoise.STEP_FLAGS, rare, unresolved)
    return denoise.row_rollup(s, ["idx"])


def name_clean_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin(spark, sf_dir, "names").select("id", names.clean_name(F.col("name")).alias("clean"), names.fix_name(F.col("name")).alias("fixed"))


def name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.with_name_key(standin(spark, sf_dir, "names"), "name").select("id", "name_key")


def ambiguous_name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin(spark, sf_dir, "names").select("id", names.is_ambiguous(F.col("name")).alias("ambiguous"))


def resolve_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolving.resolve_names(standin(spark, sf_dir, "names"), standin(spark, sf_dir, "dictionary"))


def resolve_once_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolving.resolve_once(standin(spark, sf_dir, "names"), standin(spark, sf_dir, "dictionary"))
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("smiles").alias("structures"))


def name_structure_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("name_key"), F.col("p_type").alias("name"), (F.col("p_size") % 3).cast("string").alias("smiles"))
    return resolving.structure_conflicts(p)


def _spelt_codes(spark, sf_dir):
    """Codes whose names are written in two ways, some of them ambiguous."""
    number = F.nullif(F.regexp_extract("value", r"(\d+)", 1), F.lit("")).cast("int")
    other = F.when(F.col("code").isin("c2", "c5"), F.replace("value", F.lit("[part "), F.lit("[Part-"))).otherwise(F.col("value"))
    return standin(spark, sf_dir, "codes").withColumn("value", F.when(number % 15 == 0, F.concat(F.lit("[compound "), number.cast("string"), F.lit(" (NoSmi)]"))).otherwise(other))


def unresolved_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolving.unresolved_usage(_spelt_codes(spark, sf_dir))


def unresolved_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolving.unresolved_percentage(standin(spark, sf_dir, "codes"), ["model"]).withColumn("unresolved_pct", F.round("unresolved_pct", 6))


def _recovery(spark, sf_dir):
    before = stored(resolving.unresolved_usage(_spelt_codes(spark, sf_dir)))  # read three times below
    number = F.regexp_extract("name_key", r"(\d+)", 1).cast("int")
    after = before.where(number % 10 != 0).withColumn("occurrences", F.when(number % 3 == 0, F.col("occurrences")).otherwise(F.floor(F.col("occurrences") / 2)))
    overrides = before.where(number % 9 == 0).select("name_key", F.lit("alias").alias("kind"))
    audited = resolving.recovery_audit(before, after, overrides)
    return audited.select("name_key", "name", "before", "after", "recovered", "status", "models", "sides", "n_rows", "override_kind")


def recovery_status_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recovery(spark, sf_dir)


def recovery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolving.recovery_summary(_recovery(spark, sf_dir))


def _uses(spark, sf_dir):
    side = F.when(F.col("pos") == 0, "left").when(F.col("pos") == 2, "product").otherwise("middle")
    c = standin(spark, sf_dir, "codes").withColumn("name", names.unresolved_name(F.col("value"))).where("name IS NOT NULL")
    return c.select("idx", F.col("name").alias("name_key"), "name", F.concat(F.lit("m"), F.col("model").cast("string")).alias("model"), "code", side.alias("side"), "pos")


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.build_queue(_uses(spark, sf_dir)).select("review_id", "display_name", "occurrences", "models", "sides", "model_codes")


def review_queue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = review.build_queue(_uses(spark, sf_dir)).select("review_id", "idx", "display_name", "occurrences", "sides")
    return review.merge_queue(queue, standin(spark, sf_dir, "decisions").withColumn("display_name", F.upper("name_key")))


def review_decision_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.decision_problems(standin(spark, sf_dir, "decisions"))


def review_apply_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = standin(spark, sf_dir, "codes").withColumn("name_key", names.unresolved_name(F.col("value")))
    d = standin(spark, sf_dir, "decisions").select("name_key", "review_decision", "reviewed_smiles", F.col("idx"))
    return review.review_summary(review.apply_decisions(entries, d))


def unmatched_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.unmatched_decisions(standin(spark, sf_dir, "decisions"), _uses(spark, sf_dir)).select("review_id", "review_decision")


def _checkpoint(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 3")
    key = F.col("o_orderkey")
    return o.select(key.alias("idx"), F.when(key % 10 == 4, "other").otherwise(F.col("o_orderpriority")).alias("title"), F.col("o_orderstatus").alias("paragraph"), F.when(key % 10 == 5, " ").otherwise("{}").alias("prediction"), F.when(key % 10 == 6, "timeout").alias("error"))


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("paragraph"))
    return review.pending_rows(rows, _checkpoint(spark, sf_dir))


def checkpoint_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _checkpoint(spark, sf_dir).select("idx", "prediction")
    new = table(spark, sf_dir, "orders").where("o_orderkey % 10 IN (3, 4, 5, 6)").select(F.col("o_orderkey").alias("idx"), F.lit("new").alias("prediction"))
    return review.upsert(old, new)


def eval_disjointness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.disjointness(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def finetune_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finetune.convert(finetune.assemble(table(spark, sf_dir, "conversations")))


def finetune_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finetune.summary(finetune.convert(finetune.assemble(table(spark, sf_dir, "conversations"))))


def finetune_role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finetune.role_counts(finetune.assemble(table(spark, sf_dir, "conversations")))


def _signature_of(parts, keys):
    """A reaction's signature over all roles, as consensus takes it; null without products."""
    of = lambda r, distinct: F.array_sort((F.collect_set if distinct else F.collect_list)(F.when(F.col("role") == r, F.col("comp"))))
    joined = parts.groupBy(*keys).agg(of("reactants", False).alias("a"), of("reagents", True).alias("b"), of("products", True).alias("c"))
    text = F.concat_ws(">", *[F.array_join(F.col(x).cast("array<string>"), ".") for x in "abc"])
    loose = F.array_join(F.col("c").cast("array<string>"), ".")
    some = F.size("c") > 0
    return joined.select(*keys, F.when(some, text).alias("signature"), F.when(some, loose).alias("relaxed"))


def _signatures(spark, sf_dir):
    sig = _signature_of(standin(spark, sf_dir, "pred_components", dealt=True), ["rxn_id", "method"])
    return sig.select(F.col("rxn_id").alias("idx"), F.col("method").alias("model_pos"), F.concat(F.lit("m"), F.col("method").cast("string")).alias("model"), "signature", "relaxed")


def _text(groups):
    return F.array_join(F.transform(groups, lambda g: F.array_join(g, ";")), "|")


def consensus_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = consensus.consensus(_signatures(spark, sf_dir), dealt=True)
    return c.select("idx", "signature", "agreement", F.array_join("members", ";").alias("members"), F.array_join("disagreeing", ";").alias("disagreeing"), _text("groups").alias("groups"))


def consensus_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigs = _signatures(spark, sf_dir)
    source = _signature_of(standin(spark, sf_dir, "gt_components", dealt=True), ["rxn_id"]).select(F.col("rxn_id").alias("idx"), F.when(F.col("rxn_id") % 6 != 0, F.col("signature")).alias("signature"))
    c = consensus.with_source(consensus.consensus(sigs, dealt=True), sigs, source)
    return c.select("idx", "agreement", _text("comparison_groups").alias("comparison_groups"), F.array_join("comparison_disagreeing", ";").alias("comparison_disagreeing"))


def manual_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigs = _signatures(spark, sf_dir)
    mapped = sigs.select("idx", "model", ((F.col("idx") + F.col("model_pos")) % 5 != 0).cast("int").alias("complete"))
    rare = table(spark, sf_dir, "orders").where(denoise.issue_is_rare(F.concat(F.lit("Rare_"), F.when(F.col("o_orderstatus") == "P", "Template").otherwise("none")))).select(F.col("o_orderkey").alias("idx"))
    return consensus.manual_review(consensus.consensus(sigs, dealt=True), mapped, rare).select("idx", "agreement", "mapping_complete", "rare_input", "manual_review")


def model_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = _signature_of(standin(spark, sf_dir, "alternatives", dealt=True), ["rxn_id", "slot"]).withColumnRenamed("rxn_id", "idx")
    sigs = _signatures(spark, sf_dir)
    return consensus.model_support(truth, sigs, sigs.select("idx", "model", ((F.col("idx") + F.col("model_pos")) % 3).alias("steps")))


def element_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    atom = F.concat(F.lit("["), F.element_at(F.array(F.lit("C"), F.lit("N"), F.lit("O"), F.lit("Cl")), (F.col("l_suppkey") % 4 + 1).cast("int")), F.lit(":"), F.col("l_linenumber").cast("string"), F.lit("]CC"))
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rxn_id"), F.when(F.col("l_returnflag") == "N", "product").otherwise("input").alias("side"), atom.alias("smiles"))
    return audit.element_deficit(audit.element_counts(c))


def role_multiset_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.role_overlap(standin(spark, sf_dir, "gt_components").withColumn("comp", F.col("comp") % 5))


def _assigned(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    left = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rxn_id"), F.row_number().over(w).alias("pos"), (F.col("l_partkey") % 5).cast("int").alias("comp"))
    labels = standin(spark, sf_dir, "gt_components").withColumn("comp", F.col("comp") % 5)
    return audit.assign_left_roles(left, labels), labels


def assign_left_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)[0].groupBy("rxn_id", "comp", "role").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def unmatched_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.unmatched_labels(*_assigned(spark, sf_dir))


def map_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.map_audit(standin(spark, sf_dir, "atoms"))


def bond_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.bond_changes(standin(spark, sf_dir, "bonds"))


QUERIES = {f.__name__: f for f in (
    json_decode_repair, structured_output_check, step_explode_classify, skeleton_assemble, substitute_codes, split_reaction_roles, role_by_map_overlap, mapper_input_form, step_heuristics,
    row_heuristics_rollup, name_clean_fix, name_key, ambiguous_name_filter, resolve_cascade, resolve_once_fanout, name_structure_conflicts, unresolved_usage, unresolved_percentage,
    recovery_status_audit, recovery_summary, review_queue, review_queue_merge, review_decision_validation, review_apply_summary, unmatched_decisions, resume_pending, checkpoint_upsert,
    eval_disjointness, finetune_validate, finetune_summary, finetune_role_counts, consensus_groups, consensus_with_source, manual_review_queue, model_support, element_deficit, role_multiset_overlap, assign_left_roles,
    unmatched_labels, map_audit, bond_changes)}

from rxncurate.plans.curation_sql import ORACLE  # noqa: E402, F401

