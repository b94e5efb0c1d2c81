"""Human review of unresolved names, and resuming of interrupted runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxncurate.functions.reactions import remove_codes, restore_codes, substitute_codes
from rxncurate.functions.structure import looks_valid, structure_key

#: Decisions a reviewer may take; blank means pending.
DECISIONS = ("pending", "use_smiles", "keep_unresolved", "exclude_from_mapping")
PENDING = DECISIONS[0]
EDITABLE = ("review_decision", "reviewed_smiles", "evidence", "review_note")
#: Fixed value: the mapping error of a reaction that a review has changed.
STALE = "Human-reviewed SMILES applied; rerun atom mapping."


def _joined(pairs: Column) -> Column:
    """key:n texts in order of the keys, out of an array of struct(k, n)."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: F.concat_ws(":", x["k"], x["n"].cast("string"))), "; ")


def build_queue(uses: DataFrame) -> DataFrame:
    """One row for each (idx, name_key) of uses (idx, name_key, name, model, code, side, pos): the most
    frequent spelling (the first seen of equal ones), occurrences, and lists by model, code and side.
    Uses are counted by all they have, with partial sums before the shuffle; what is left of one key
    is a row for each spelling, model, code and side, and is folded in one more aggregation."""
    keys = ["idx", "name_key"]
    counted = uses.groupBy(*keys, "name", "model", "code", "side").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    item = F.struct("name", "model", "code", "side", "n", "first")
    folded = counted.groupBy(*keys).agg(F.sum("n").alias("occurrences"), F.collect_list(item).alias("u"))
    kinds = lambda c: F.array_distinct(F.transform("u", lambda x: x[c]))
    total = lambda c, k: F.aggregate(F.filter("u", lambda x: x[c] == k), F.lit(0).cast("long"), lambda t, x: t + x["n"])
    counts = lambda c: F.transform(kinds(c), lambda k: F.struct(k.alias("k"), total(c, k).alias("n")))
    first = lambda k: F.array_min(F.transform(F.filter("u", lambda x: x["name"] == k), lambda x: x["first"]))
    spelt = F.array_max(F.transform(kinds("name"), lambda k: F.struct(total("name", k).alias("n"), (-first(k)).alias("f"), k.alias("k"))))["k"]
    codes = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("u", lambda x: x["model"] == m), lambda x: x["code"]))), "|")
    model_codes = F.array_join(F.transform(F.array_sort(kinds("model")), lambda m: F.concat_ws(":", m, codes(m))), "; ")
    out = folded.select(*keys, spelt.alias("display_name"), "occurrences", _joined(counts("model")).alias("models"), model_codes.alias("model_codes"), _joined(counts("side")).alias("sides"))
    return out.withColumn("review_id", F.concat(F.lit("row-"), F.col("idx").cast("string"), F.lit("__"), F.col("name_key")))


def attach_audit(queue: DataFrame, audit: DataFrame) -> DataFrame:
    """queue with automatic_status, candidate_smiles and resolver_source of the audit (name_key, position,
    status, resolved_smiles, resolver_source) of equal name key, the last of repeated ones; else empty."""
    named = audit.where(F.coalesce(F.trim("name_key"), F.lit("")) != "")
    fields = {"automatic_status": "status", "candidate_smiles": "resolved_smiles", "resolver_source": "resolver_source"}
    last = named.groupBy("name_key").agg(F.max_by(F.struct(*[F.col(v).alias(k) for k, v in fields.items()]), "position").alias("a"))
    joined = queue.join(last, "name_key", "left")
    return joined.withColumns({k: F.coalesce(F.col(f"a.{k}"), F.lit("")) for k in fields}).drop("a")


def decision_of(c: Column) -> Column:
    """A decision's text in small letters; blank ones are pending."""
    return F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("pending"))


def merge_queue(queue: DataFrame, previous: DataFrame) -> DataFrame:
    """The queue (review_id and any columns) with the editable columns of a previous one, as they were written;
    a row that is new is pending. Rows that have vanished are kept, with their previous columns, 0 occurrences
    and currently_unresolved false, unless their decision reads pending; columns that the previous one lacks
    are null in them."""
    columns = [c for c in queue.columns if c not in (*EDITABLE, "currently_unresolved")]
    shared = [c for c in columns if c in previous.columns and c not in ("review_id", "occurrences")]
    there = [c for c in EDITABLE if c in previous.columns]
    p = previous.select("review_id", *[F.col(c).alias(f"_{c}") for c in (*shared, *there)], F.lit(True).alias("_old"))
    joined = queue.select(*columns, F.lit(True).alias("_now")).join(p, "review_id", "full")
    now = F.coalesce("_now", F.lit(False))
    kept = {c: F.when(now, F.col(c)).otherwise(F.col(f"_{c}")) for c in shared}
    filled = {c: F.coalesce(F.col(f"_{c}"), F.lit("")) if c in there else F.lit("") for c in EDITABLE}
    filled["review_decision"] = F.when(F.col("_old"), filled["review_decision"]).otherwise(F.lit(PENDING))
    out = joined.withColumns(kept | filled | {"occurrences": F.coalesce("occurrences", F.lit(0).cast("long")), "currently_unresolved": now})
    return out.where(F.col("currently_unresolved") | (F.lower(F.trim("review_decision")) != PENDING)).select(*columns, "currently_unresolved", *EDITABLE)


def ordered_queue(queue: DataFrame) -> DataFrame:
    """Unresolved first, then more occurrences, row, name; a global sort, for the sink alone."""
    return queue.orderBy(F.col("currently_unresolved").desc(), F.col("occurrences").desc(), "idx", "display_name")


def decision_problems(review: DataFrame, valid=looks_valid, key=lambda text: structure_key(text, strict=True)) -> DataFrame:
    """(review_id, problem) of unknown decisions, approvals without a valid structure, and approvals of one (idx,
    name_key) that disagree: of different structures, however they are written. valid and key are expressions
    of a structure's text."""
    d = decision_of(F.col("review_decision"))
    text = F.coalesce(F.trim("reviewed_smiles"), F.lit(""))
    good = F.coalesce(valid(text), F.lit(False))
    approved = review.where((d == "use_smiles") & good)
    # Equal texts need no key: only rows whose texts differ are read.
    texts = approved.groupBy("idx", "name_key").agg(F.collect_set(text).alias("texts")).where(F.size("texts") > 1)
    conflict = texts.where(F.size(F.array_distinct(F.transform("texts", key))) > 1).select("idx", "name_key", F.lit(True).alias("_conflict"))
    joined = review.join(conflict, ["idx", "name_key"], "left")
    problem = (
        F.when(~d.isin(*DECISIONS), "unknown decision").when((d == "use_smiles") & ~good, "reviewed_smiles is not valid SMILES")
        .when((d == "use_smiles") & F.coalesce("_conflict", F.lit(False)), "conflicting approved SMILES")
    )
    return joined.select("review_id", problem.alias("problem")).where("problem IS NOT NULL")


def decision_counts(review: DataFrame) -> DataFrame:
    """Rows by known decision."""
    d = decision_of(F.col("review_decision"))
    return review.where(d.isin(*DECISIONS)).groupBy(d.alias("decision")).agg(F.count(F.lit(1)).alias("rows"))


def approved_codes(review: DataFrame) -> DataFrame:
    """(idx, model, code) out of model_codes texts of rows that use a structure and have a left side."""
    d, left = decision_of(F.col("review_decision")), F.contains(F.lower("sides"), F.lit("left"))
    model = F.explode(F.filter(F.split("model_codes", ";"), lambda x: F.contains(x, F.lit(":")))).alias("m")
    rows = review.where((d == "use_smiles") & left).select("idx", model).withColumn("m", F.trim("m"))
    name, codes = F.substring_index("m", ":", 1), F.regexp_extract("m", "^[^:]*:(.*)$", 1)
    return rows.select("idx", name.alias("model"), F.explode(F.filter(F.split(codes, r"\|"), lambda c: c != "")).alias("code"))


def apply_decisions(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """Dictionary entries (idx, model, code, name_key, value) with approved structures in place and
    excluded ones marked: value, changed, excluded. name_key is null for resolved entries."""
    d = decisions.select("idx", "name_key", decision_of(F.col("review_decision")).alias("_d"), F.trim("reviewed_smiles").alias("_s")).where(F.col("_d").isin("use_smiles", "exclude_from_mapping"))
    d = d.groupBy("idx", "name_key").agg(F.max_by("_s", F.col("_d") == "use_smiles").alias("_s"), F.bool_or(F.col("_d") == "use_smiles").alias("_use"), F.bool_or(F.col("_d") == "exclude_from_mapping").alias("_out"))
    joined = entries.join(d, ["idx", "name_key"], "left")
    use, out = F.coalesce("_use", F.lit(False)), F.coalesce("_out", F.lit(False))
    return joined.select("idx", "model", "code", "name_key", F.when(use, F.col("_s")).otherwise(F.col("value")).alias("value"), (use | out).alias("changed"), out.alias("excluded"))


def rebuild_reactions(rows: DataFrame, applied: DataFrame, approved: DataFrame) -> DataFrame:
    """rows (idx, model, skeletons, reactions) of a review's changed ones rebuilt: excluded codes go,
    approved left ones (idx, model, code) that are missing come to the first section, and structures
    take the place of codes again; with changed. Other rows stay as they are."""
    keys = ["idx", "model"]
    entry = F.map_from_entries(F.collect_list(F.struct("code", "value"))).alias("_smiles")
    excluded = F.collect_set(F.when(F.col("excluded"), F.col("code"))).alias("_excluded")
    touched = applied.groupBy(*keys).agg(F.bool_or("changed").alias("changed"), entry, excluded).where("changed")
    left = approved.groupBy(*keys).agg(F.collect_set("code").alias("_left"))
    joined = rows.join(touched.join(left, keys, "left"), keys, "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    none = F.array().cast("array<string>")
    one = lambda s: restore_codes(remove_codes(s, F.coalesce("_excluded", none)), F.coalesce("_left", none))
    out = joined.withColumn("skeletons", F.when(F.col("changed"), F.transform("skeletons", one)).otherwise(F.col("skeletons")))
    made = F.transform("skeletons", lambda s: substitute_codes(s, F.col("_smiles")))
    return out.withColumn("reactions", F.when(F.col("changed"), made).otherwise(F.col("reactions"))).drop("_smiles", "_excluded", "_left")


def review_summary(applied: DataFrame) -> DataFrame:
    """Replacements, excluded components and changed rows of each model."""
    return applied.groupBy("model").agg(F.count_if(F.col("changed") & ~F.col("excluded")).alias("replacements"), F.count_if("excluded").alias("excluded"), F.count_distinct(F.when(F.col("changed"), F.col("idx"))).alias("changed_rows"))


def unmatched_decisions(decisions: DataFrame, entries: DataFrame) -> DataFrame:
    """Decisions that use a structure or exclude, and whose (idx, name_key) no entry has."""
    acting = decisions.where(decision_of(F.col("review_decision")).isin("use_smiles", "exclude_from_mapping"))
    return acting.join(entries.select("idx", "name_key").distinct(), ["idx", "name_key"], "left_anti")


def clear_stale(mapped: DataFrame, changed: DataFrame, columns: list[str], message: str = STALE) -> DataFrame:
    """Mapping columns set to null, and the message, for rows of (idx, model) that changed."""
    c = changed.select("idx", "model").distinct().withColumn("_stale", F.lit(True))
    joined = mapped.join(c, ["idx", "model"], "left")
    stale = F.coalesce("_stale", F.lit(False))
    out = joined.withColumns({x: F.when(~stale, F.col(x)) for x in columns})
    return out.withColumn("mapping_error", F.when(stale, F.lit(message)).otherwise(F.col("mapping_error"))).drop("_stale")


def pending_rows(rows: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Rows (idx, title, paragraph) that a checkpoint (idx, title, paragraph, prediction, error) lacks,
    or holds with an error, without prediction, or for another text; with the reason."""
    c = checkpoint.select("idx", *[F.col(x).alias(f"_{x}") for x in ("title", "paragraph", "prediction", "error")], F.lit(True).alias("_there"))
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    reason = F.when(F.col("_there").isNull(), "missing").when(~F.col("title").eqNullSafe(F.col("_title")) | ~F.col("paragraph").eqNullSafe(F.col("_paragraph")), "other text").when(~blank("_error"), "error").when(blank("_prediction"), "no prediction")
    return rows.join(c, "idx", "left").select("idx", reason.alias("reason")).where("reason IS NOT NULL")


def upsert(old: DataFrame, new: DataFrame, key: str = "idx", version: str | None = None) -> DataFrame:
    """Rows of old replaced by those of new with equal key; both have the same columns. Of several new
    rows of a key that of the highest version stays, and without version the greatest by its columns."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    order = [version] if version else [c for c in old.columns if c != key]
    w = Window.partitionBy(key).orderBy(F.col("_v").desc(), *[F.col(c).desc_nulls_last() for c in order])
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_v")


def normalised(text: Column) -> Column:
    """A text in small letters with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def disjointness(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(item_id, overlaps): rows of train (text) whose normalised text equals an evaluation item's."""
    norm = lambda c: F.sha2(normalised(c).cast("binary"), 256)
    t = train.select(norm(F.col("text")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return evaluation.select("item_id", norm(F.col("text")).alias("h")).join(t, "h", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("overlaps"))


def overlapping_rows(train: DataFrame, evaluation: DataFrame, keys: list[str]) -> DataFrame:
    """keys of the rows of train whose normalised text equals some evaluation item's."""
    items = evaluation.select(F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("_h")).distinct()
    return train.withColumn("_h", F.sha2(normalised(F.col("text")).cast("binary"), 256)).join(items, "_h", "left_semi").select(*keys)


def attach_baseline(review: DataFrame, baseline: DataFrame, prefix: str) -> DataFrame:
    """review (idx, title, paragraph) with the columns of an external baseline that begin with prefix. Ids
    must be the same on both sides and occur once, with equal texts; else the job fails."""
    wanted = [c for c in baseline.columns if c.startswith(prefix)]
    once = baseline.groupBy("idx").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(f"_{c}") for c in ("title", "paragraph")], *[F.first(c).alias(c) for c in wanted])
    joined = review.withColumn("_here", F.lit(True)).join(once, "idx", "full")
    same = F.col("title").eqNullSafe(F.col("_title")) & F.col("paragraph").eqNullSafe(F.col("_paragraph"))
    problem = (
        F.when(F.col("_n") > 1, "the baseline repeats an idx").when(F.col("_n").isNull() | F.col("_here").isNull(), "idx values of the baseline do not match")
        .when(~same, "title or paragraph of the baseline does not match")
    )
    checked = F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(problem).cast("boolean"))
    return joined.where(checked).select(*review.columns, *wanted)
