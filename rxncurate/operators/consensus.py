"""Agreement of models on a reaction, and the manual review it calls for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxncurate.functions.jsonfix import bound
from rxncurate.functions.names import unresolved_codes
from rxncurate.functions.reactions import first_by_key, mapped_components, mapped_roles, skeleton_codes, source_parts
from rxncurate.operators.once import once_each
from rxncurate.operators.score import ROLES
from rxncurate.operators.structures import mapped_key, readable_keys, structure_table, with_key_map

#: Fixed value: fewer agreeing models than this call for review.
LEAST_AGREEMENT = 4
#: Fixed value: the name of the source's own reaction among the models.
SOURCE = "Lowe_smiles"
#: Columns of a review that a person fills in, and those that stay once they have decided.
REVIEW_COLUMNS = (
    "ground_truth_valid", "ground_truth_reactants_smiles", "ground_truth_reagents_smiles", "ground_truth_products_smiles", "ground_truth_reaction_smiles",
    "ground_truth_2_reactants_smiles", "ground_truth_2_reagents_smiles", "ground_truth_2_products_smiles", "ground_truth_2_reaction_smiles", "review_note",
)
FINALIZED_COLUMNS = (
    "candidate_reactants_smiles", "candidate_reagents_smiles", "candidate_products_smiles", "candidate_reaction_smiles", "product_mapping_complete", "rare_template_input",
)
#: Texts (small letters) of a decided label.
DECIDED = {"true": "True", "1": "True", "false": "False", "0": "False"}


def signature_groups(sigs: DataFrame) -> DataFrame:
    """(idx, signature, members, size, first_pos): models of (idx, model, model_pos, signature) by equal
    signature, members in order of position. Models without signature are in no group."""
    ordered = F.array_sort(F.collect_list(F.struct("model_pos", "model")))
    groups = sigs.where("signature IS NOT NULL").groupBy("idx", "signature").agg(ordered.alias("m"))
    return groups.select("idx", "signature", F.transform("m", lambda x: x["model"]).alias("members"), F.size("m").alias("size"), F.element_at("m", 1)["model_pos"].alias("first_pos"))


def _by_size(groups: Column) -> Column:
    """Groups in order: larger ones first, then by their members."""
    return F.array_sort(groups, lambda a, b: F.when(a["size"] != b["size"], b["size"] - a["size"]).when(a["members"] < b["members"], -1).when(a["members"] == b["members"], 0).otherwise(1))


def consensus(sigs: DataFrame, dealt: bool = False) -> DataFrame:
    """For every idx of (idx, model, model_pos, signature) the largest group (of equal ones that of the
    earliest model): signature, agreement, members, the other models in order of position, and all groups'
    members, larger ones first, with their signatures (group_signatures). Where no model has a signature nobody
    agrees: agreement 0, all disagree.

    Rows are dealt by idx once, unless dealt says that they are; models are folded by idx on that dealing, and
    what is left is work on a row."""
    every = F.array_sort(F.collect_list(F.struct("model_pos", "model", "signature"))).alias("m")
    folded = (sigs if dealt else sigs.repartition("idx")).groupBy("idx").agg(every)
    names = lambda m: F.transform(m, lambda x: x["model"])
    kinds = F.array_distinct(F.array_compact(F.transform("m", lambda x: x["signature"])))
    group = lambda s: bound(F.filter("m", lambda x: x["signature"] == s), lambda g: F.struct(
        F.size(g).alias("size"), (-F.get(g, F.lit(0))["model_pos"]).alias("first"), s.alias("signature"), names(g).alias("members")))
    none = F.array().cast("array<string>")
    best = folded.select("idx", names(F.col("m")).alias("models"), F.transform(kinds, group).alias("g")).withColumn("b", F.array_max("g"))
    ordered = best.withColumn("_g", _by_size(F.transform("g", lambda x: F.struct(x["size"].alias("size"), x["members"].alias("members"), x["signature"].alias("signature")))))
    members = F.coalesce("b.members", none)
    return ordered.select(
        "idx", F.col("b.signature").alias("signature"), F.size(members).alias("agreement"), members.alias("members"), F.array_except("models", members).alias("disagreeing"), _field("members").alias("groups"),
        _field("signature").alias("group_signatures"))


def _field(field: str) -> Column:
    """A field of the groups in order."""
    return F.transform("_g", lambda x: x[field])


def with_source(agreed: DataFrame, sigs: DataFrame, source: DataFrame) -> DataFrame:
    """agreed (rows of consensus, of sigs, whose groups come with their signatures, so sigs is not read again) with the source's own reaction (idx, signature) added: to the group of equal
    signature, else as a group of its own; groups in order of size, then members, and the others' members."""
    own = source.where("signature IS NOT NULL").select("idx", F.col("signature").alias("_source"))
    joined = agreed.join(own, "idx", "left").withColumn("_met", F.array_position("group_signatures", F.col("_source")))
    name = F.array(F.lit(SOURCE))
    added = F.transform("groups", lambda g, i: F.when(i + 1 == F.col("_met"), F.concat(g, name)).otherwise(g))
    groups = F.when(F.col("_source").isNull(), F.col("groups")).when(F.col("_met") > 0, added).otherwise(F.concat("groups", F.array(name)))
    sized = _by_size(F.transform(groups, lambda g: F.struct(F.size(g).alias("size"), g.alias("members"))))
    out = joined.withColumn("comparison_groups", F.transform(sized, lambda x: x["members"]))
    rest = F.flatten(F.slice("comparison_groups", F.lit(2), F.greatest(F.size("comparison_groups") - 1, F.lit(0))))
    return out.withColumn("comparison_disagreeing", rest).drop("_source", "_met")


def manual_review(agreed: DataFrame, mapped: DataFrame, rare: DataFrame, least: int = LEAST_AGREEMENT) -> DataFrame:
    """agreed with mapping_complete, rare_input and manual_review: too few agree (none among them), an
    agreeing model is not fully mapped ((idx, model, complete) of mapped), or the input is of a rare
    template (idx of rare). mapped is folded by idx and meets agreed by it, so nothing is shuffled that is
    dealt by idx already."""
    own = mapped.groupBy("idx").agg(F.collect_list(F.struct("model", F.coalesce("complete", F.lit(0)).alias("complete"))).alias("_mapped"))
    of = lambda m: F.array_min(F.transform(F.filter("_mapped", lambda x: x["model"] == m), lambda x: x["complete"]))
    complete = F.array_min(F.transform("members", lambda m: F.coalesce(of(m), F.lit(0))))
    r = rare.select("idx").distinct().withColumn("rare_input", F.lit(1))
    out = agreed.join(own, "idx", "left").withColumn("mapping_complete", complete).drop("_mapped")
    out = out.join(r, "idx", "left").fillna(0, ["mapping_complete", "rare_input"])
    return out.withColumn("manual_review", ((F.col("agreement") < least) | (F.col("mapping_complete") == 0) | (F.col("rare_input") == 1)).cast("int"))


def review_order(queue: DataFrame) -> DataFrame:
    """Manual ones first, then incomplete mapping, less agreement, idx; a global sort, for the sink alone."""
    return queue.orderBy(F.col("manual_review").desc(), "mapping_complete", "agreement", "idx")


def signature_of(reactants: Column, reagents: Column, products: Column, identity) -> Column:
    """Signature of a reaction as text, by the identity (an expression) of its components: reactants as a multiset,
    the others as sets; null without products."""
    part = lambda role, distinct: bound(F.transform(role, identity), lambda k: F.array_join(F.array_sort(F.array_distinct(k) if distinct else k), "."))
    return F.when(F.size(products) > 0, F.concat_ws(">", part(reactants, False), part(reagents, True), part(products, True)))


def _identity(c: Column) -> Column:
    """A structure's key; the text of what is none."""
    return F.coalesce(mapped_key(c), c)


def model_rows(outputs: DataFrame, ids: Sequence[str] = ("idx", "model"), dimension: DataFrame | None = None, texts: DataFrame | None = None, readable: bool = False) -> DataFrame:
    """What a model made of a row: outputs (ids, smiles: a map, and the arrays skeletons, reactions, mapped,
    mapping_errors) with unresolved (codes of the skeletons), the roles of its mapped reactions, products once
    for each structure, complete, and signature (null with an unresolved code or without products). Mapping is
    complete if all reactions are, with products, without unresolved codes and errors. Structures are told by
    their keys, so that models that write a molecule differently agree; dimension: see with_key_map. readable:
    the signature has readable_keys. texts: a table of the mapped reactions (text), cheaper to read than outputs;
    reactions and structures that are few are read once each (see once_each)."""
    if texts is None:
        texts = outputs.select(F.explode("mapped").alias("text"))
    roles = once_each(texts, mapped_roles)
    if dimension is None:
        found = texts.where("text IS NOT NULL").distinct().select(mapped_components(F.array("text"), roles=roles).alias("r"))
        parts = found.select(F.explode(F.concat(*[F.col(f"r.{r}") for r in ROLES])).alias("text"))
        dimension = structure_table(parts)
    if readable:
        dimension = readable_keys(dimension)
    unresolved = F.array_sort(unresolved_codes(F.col("smiles"), skeleton_codes(F.col("skeletons"))))
    out = outputs.withColumn("unresolved", F.coalesce(unresolved, F.array().cast("array<string>"))).withColumn("_r", mapped_components(F.col("mapped"), roles=roles))
    out = out.withColumns({r: F.col(f"_r.{r}") for r in ROLES} | {"_complete": F.col("_r.complete")}).drop("_r")
    out = with_key_map(out, ids, ROLES, dimension, whole=True)
    out = out.withColumn("products", first_by_key(F.col("products"), F.transform("products", _identity)))
    told = F.coalesce(F.exists("mapping_errors", lambda e: F.coalesce(F.trim(e), F.lit("")) != ""), F.lit(False))
    whole = F.col("_complete") & (F.size("mapped") == F.size("reactions")) & (F.size("products") > 0) & (F.size("unresolved") == 0) & ~told
    signature = F.when(F.size("unresolved") == 0, signature_of(*[F.col(r) for r in ROLES], _identity))
    return out.withColumns({"complete": F.coalesce(whole, F.lit(False)).cast("int"), "signature": signature}).drop("_complete", "structure_keys")


def source_signatures(rows: DataFrame, reaction: str, dimension: DataFrame | None = None) -> DataFrame:
    """(idx, signature) of the source's own mapped reaction of rows (idx, reaction), as model_rows makes it of a
    model's; null unless source_parts can read it."""
    parts = rows.select("idx", source_parts(F.col(reaction)).alias("_p")).select("idx", *[F.col(f"_p.{r}").alias(r) for r in ROLES])
    keyed = with_key_map(parts, ["idx"], ROLES, dimension, whole=True)
    return keyed.select("idx", signature_of(*[F.col(r) for r in ROLES], _identity).alias("signature"))


def carry_review(queue: DataFrame, previous: DataFrame, finalized: Sequence[str] = FINALIZED_COLUMNS, review: Sequence[str] = REVIEW_COLUMNS) -> DataFrame:
    """queue (idx, finalized columns) with the columns of a previous review (idx, any of both): what a
    person fills in is always taken over, empty where there is none; the finalized ones only where the
    previous label is decided."""
    there = [c for c in (*finalized, *review) if c in previous.columns]
    p = previous.select("idx", *[F.col(c).alias(f"_{c}") for c in there], F.lit(True).alias("_there"))
    joined = queue.drop(*review).join(p, "idx", "left")
    label = F.lower(F.trim(F.col("_ground_truth_valid").cast("string"))) if "ground_truth_valid" in there else F.lit(None)
    decided = F.coalesce(label.isin(*DECIDED), F.lit(False))
    kept = {c: F.when(decided, F.col(f"_{c}")).otherwise(F.col(c)) for c in finalized if c in there and c in queue.columns}
    filled = {c: F.coalesce(F.col(f"_{c}").cast("string"), F.lit("")) if c in there else F.lit("") for c in review}
    return joined.withColumns(kept | filled).drop("_there", *[f"_{c}" for c in there])


def model_support(truth: DataFrame, sigs: DataFrame, reactions: DataFrame | None = None) -> DataFrame:
    """(idx, slot, support, supporting, relaxed_support, relaxed_supporting) of truth (idx, slot, signature,
    relaxed): models of sigs (idx, model, signature, relaxed) whose signature, and whose relaxed one, equals
    it. With reactions (idx, model, steps) also multistep, the models of idx with several mapped steps."""
    models = sigs.select("idx", "model", F.col("signature").alias("_s"), F.col("relaxed").alias("_r"))
    joined = truth.join(models, "idx", "left").groupBy("idx", "slot").agg(
        *[F.array_sort(F.collect_list(F.when(F.col(a) == F.col(b), F.col("model")))).alias(n) for a, b, n in (("signature", "_s", "strict"), ("relaxed", "_r", "loose"))])
    out = joined.select(
        "idx", "slot", F.size("strict").alias("support"), F.array_join("strict", "; ").alias("supporting"), F.size("loose").alias("relaxed_support"), F.array_join("loose", "; ").alias("relaxed_supporting"))
    if reactions is None:
        return out
    several = reactions.where("steps > 1").groupBy("idx").agg(F.count_distinct("model").alias("multistep"))
    return out.join(several, "idx", "left").fillna(0, ["multistep"])


def label_status(label: Column) -> Column:
    """True, False or unreviewed, of a label's text."""
    v, out = F.lower(F.trim(label.cast("string"))), F
    for text, status in DECIDED.items():
        out = out.when(v == text, F.lit(status))
    return out.otherwise(F.lit("unreviewed"))


def worklist(rows: DataFrame, statuses: list[str], manual_only: bool = False) -> DataFrame:
    """Rows whose label (ground_truth_valid) has a status among those given, as status, in order of review."""
    out = rows.withColumn("status", label_status(F.col("ground_truth_valid"))).where(F.col("status").isin(*statuses))
    return review_order(out.where("manual_review = 1") if manual_only else out)


def attach_findings(audited: DataFrame, findings: DataFrame) -> DataFrame:
    """findings (idx, slot, ...) with the audit's columns of equal (idx, slot); one without a match fails
    the job."""
    columns = [c for c in audited.columns if c not in ("idx", "slot")]
    a = audited.select("idx", "slot", F.lit(True).alias("_there"), *columns)
    joined = findings.join(a, ["idx", "slot"], "left")
    fault = F.raise_error(F.concat(F.lit("no audited row for "), F.concat_ws("/", F.col("idx").cast("string"), F.col("slot").cast("string")))).cast("boolean")
    return joined.where(F.when(F.col("_there"), F.lit(True)).otherwise(fault)).drop("_there")
