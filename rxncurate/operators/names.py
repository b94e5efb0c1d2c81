"""Resolution of compound names against dictionary tables, and the audits of what stays unresolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxncurate.functions import names as fn
from rxncurate.functions.structure import looks_valid


def known_names(df: DataFrame) -> DataFrame:
    """(lower_name, known_smiles) of the fixed names: a few rows. A value that is no structure is left out."""
    rows = F.array(*[F.struct(F.lit(k.casefold()).alias("lower_name"), F.lit(v).alias("known_smiles")) for k, v in fn.KNOWN_SMILES.items()])
    return df.sparkSession.range(1).select(F.inline(rows)).where(F.forall(F.split("known_smiles", r"\."), looks_valid))


def best_entry(dictionary: DataFrame) -> DataFrame:
    """(entry_name, entry_smiles, entry_source): of each name in (lower_name, smiles, source, priority)
    the entry of lowest priority number, then source."""
    best = F.min_by(F.struct("smiles", "source"), F.struct("priority", "source", "smiles"))
    return dictionary.groupBy(F.col("lower_name").alias("entry_name")).agg(best.alias("b")).select("entry_name", F.col("b.smiles").alias("entry_smiles"), F.col("b.source").alias("entry_source"))


#: Where an answer came from, and the sources of a dictionary in order of priority.
CURATED, KNOWN_ALIAS, CACHED = "Curated", "KnownAlias", "Cache"
SOURCE_ORDER = ("PubChem", "OPSIN", "CIR", "ChEBI", "ChemSpider")


def _cached(cache: DataFrame | None, like: DataFrame) -> DataFrame:
    """(cache_name, cache_smiles) of the structures of a cache (name, smiles); of a repeated name the least."""
    if cache is None:
        return like.sparkSession.range(0).select(F.lit("").alias("cache_name"), F.lit("").alias("cache_smiles"))
    good = cache.where(F.forall(F.split("smiles", r"\."), looks_valid))
    return good.groupBy(F.col("name").alias("cache_name")).agg(F.min("smiles").alias("cache_smiles"))


def resolve_names(names: DataFrame, dictionary: DataFrame, cache: DataFrame | None = None, fix: bool = False) -> DataFrame:
    """(name, smiles, source) for the distinct names of a table with a column name, in a first pass. Each name
    is tried as it is given (without its qualifiers too, if fix), then without its qualifiers. A try asks, in
    this order: the known names by the cleaned name; those by the alias, where qualifiers are taken off; the
    cache (name, smiles) by the cleaned name and by the alias; the dictionary (lower_name, smiles, source,
    priority) by the alias. Ambiguous names are not left out here: only the second pass does that. What is
    found nowhere reads [name (NoSmi)], with the name as given, and has no source.

    All forms of a name are looked up in one join with each table, and meet again by the name."""
    lower = lambda c: F.lower(c)
    distinct = names.select("name").distinct().where("name IS NOT NULL")
    clean, bare = fn.clean_name(F.col("name")), fn.clean_name(fn.fix_name(F.col("name")))
    alias = lambda c: fn.resolve_alias(c)
    stripped = lambda c: alias(fn.fix_name(alias(c)))
    tries = ((clean, stripped(clean) if fix else alias(clean), fix), (bare, stripped(bare), True))
    asks = []
    for k, (own, other, taken_off) in enumerate(tries):
        asks += [(4 * k, "known", lower(own)), *([(4 * k + 1, "known", lower(other))] if taken_off else []), (4 * k + 2, "cache", own), (4 * k + 2.5, "cache", other), (4 * k + 3, "entry", lower(other))]
    ask = F.inline(F.array(*[F.struct(F.lit(float(place)).alias("place"), F.lit(kind).alias("kind"), text.alias("text")) for place, kind, text in asks]))
    asked = distinct.select("name", ask)
    known, entry = F.broadcast(known_names(names)), best_entry(dictionary)
    of = lambda kind: asked.where(F.col("kind") == kind)
    found = of("known").join(known, F.col("text") == F.col("lower_name")).select("name", "place", F.col("known_smiles").alias("smiles"), F.lit(KNOWN_ALIAS).alias("source"))
    if cache is not None:
        hits = of("cache").join(_cached(cache, names), F.col("text") == F.col("cache_name"))
        found = found.unionByName(hits.select("name", "place", F.col("cache_smiles").alias("smiles"), F.lit(CACHED).alias("source")))
    hits = of("entry").join(entry, F.col("text") == F.col("entry_name"))
    found = found.unionByName(hits.select("name", "place", F.col("entry_smiles").alias("smiles"), F.col("entry_source").alias("source")))
    best = found.groupBy("name").agg(F.min_by(F.struct("smiles", "source"), F.struct("place", "source", "smiles")).alias("b"))
    mark = F.concat(F.lit("["), F.col("name"), F.lit(" (NoSmi)]"))
    return distinct.join(best, "name", "left").select("name", F.coalesce("b.smiles", mark).alias("smiles"), F.col("b.source").alias("source"))


def resolve_once(occurrences: DataFrame, dictionary: DataFrame) -> DataFrame:
    """occurrences with smiles and source: each distinct name is resolved once and fanned out."""
    r = resolve_names(occurrences, dictionary).withColumnRenamed("name", "_name")
    return occurrences.join(r, F.col("name").eqNullSafe(F.col("_name")), "left").drop("_name")


def source_priority(source: Column) -> Column:
    """Place of a source among SOURCE_ORDER; unknown ones come last."""
    place = F.array_position(F.array(*[F.lit(x) for x in SOURCE_ORDER]), source)
    return F.when(place > 0, place).otherwise(len(SOURCE_ORDER) + 1).cast("int")


def resolve_missing(names: DataFrame, dictionary: DataFrame, overrides: DataFrame | None = None, cache: DataFrame | None = None) -> DataFrame:
    """(name, smiles, source) for the distinct unresolved names of a table with a column name, in a
    second pass: an override's structure; a known name; nothing for an ambiguous name without override;
    else the cache, by the name and then by the lookup name (the override's, else the alias); else the
    dictionary (lower_name, smiles, source, priority) by the lookup name. What an override helped to
    find says so in its source. smiles and source are null where nothing is found.

    overrides: (name, lookup_name, smiles, kind), one for each name key; cache: (name, smiles).
    """
    distinct = names.select("name").distinct().withColumn("clean", fn.clean_name(F.col("name")))
    if overrides is None:
        d = distinct.withColumns({c: F.lit(None).cast("string") for c in ("o_lookup", "o_smiles", "o_kind")}).withColumn("o", F.lit(False))
    else:
        blank = lambda c: F.nullif(F.trim(c), F.lit(""))
        o = fn.with_name_key(overrides, "name").select("name_key", blank("lookup_name").alias("o_lookup"), blank("smiles").alias("o_smiles"), blank("kind").alias("o_kind"), F.lit(True).alias("o"))
        d = fn.with_name_key(distinct, "clean").join(o.where("name_key <> ''"), "name_key", "left").drop("name_key").fillna(False, ["o"])
    known = F.broadcast(known_names(names))
    d = d.withColumn("lower", F.lower("clean")).join(known.withColumnRenamed("lower_name", "lower"), "lower", "left")
    lookup = F.coalesce(F.when(F.col("o_lookup").isNotNull(), fn.clean_name(F.col("o_lookup"))), fn.resolve_alias(F.col("clean")))
    d = d.withColumn("lookup", lookup).withColumn("key", F.lower("lookup")).withColumn("skip", ~F.col("o") & fn.is_ambiguous(F.col("clean")))
    if cache is None:
        d = d.withColumn("cached", F.lit(None).cast("string"))
    else:
        c = _cached(cache, names)
        by = lambda k: c.select(F.col("cache_name").alias(k), F.col("cache_smiles").alias(f"c_{k}"))
        d = d.join(by("clean"), "clean", "left").join(by("lookup"), "lookup", "left").withColumn("cached", F.coalesce("c_clean", "c_lookup"))
    entry = best_entry(dictionary).select(F.col("entry_name").alias("key"), "entry_smiles", "entry_source")
    d = d.join(entry, "key", "left")
    curated = lambda default: F.concat(F.lit(f"{CURATED}:"), F.coalesce("o_kind", F.lit(default)))
    via = lambda source: F.when(F.col("o"), F.concat(curated("alias"), F.lit("+"), source)).otherwise(source)
    steps = (
        (F.col("o_smiles").isNotNull(), F.col("o_smiles"), curated("override")), (F.col("known_smiles").isNotNull(), F.col("known_smiles"), F.lit(KNOWN_ALIAS)),
        (F.col("skip"), F.lit(None).cast("string"), F.lit(None).cast("string")), (F.col("cached").isNotNull(), F.col("cached"), via(F.lit(CACHED))),
        (F.col("entry_smiles").isNotNull(), F.col("entry_smiles"), via(F.col("entry_source"))))
    smiles = source = F
    for held, s, label in steps:
        smiles, source = smiles.when(held, s), source.when(held, label)
    return d.select("name", smiles.alias("smiles"), source.alias("source"))


def override_errors(overrides: DataFrame) -> DataFrame:
    """(name, problem) of override entries (name, lookup_name, smiles) that cannot be used."""
    keyed = fn.with_name_key(overrides, "name")
    repeated = Window.partitionBy("name_key")
    problem = (
        F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name").when(F.coalesce("lookup_name", "smiles").isNull(), "neither lookup_name nor smiles")
        .when(F.coalesce("name_key", F.lit("")) == "", "name has no key").when(F.count(F.lit(1)).over(repeated) > 1, "name is repeated")
    )
    return keyed.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def structure_conflicts(entries: DataFrame) -> DataFrame:
    """(name_key, smiles, names) of names (name_key, name, smiles) that have several structures."""
    several = entries.groupBy("name_key").agg(F.count_distinct("smiles").alias("n")).where("n > 1").select("name_key")
    return entries.join(several, "name_key", "left_semi").groupBy("name_key", "smiles").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("names"))


def skeleton_uses(rows: DataFrame) -> DataFrame:
    """One row (idx, model, reaction, pos, n_sections, code, value, side) for each code of the skeletons of
    rows (idx, model, skeletons, smiles: a map of code to structure) whose entry is unresolved. Entries are
    looked at before anything is exploded, so rows without unresolved ones cost nothing."""
    left = F.map_filter("smiles", lambda k, v: F.contains(v, F.lit("(NoSmi)")))
    some = rows.select("idx", "model", "skeletons", left.alias("_left")).where(F.size("_left") > 0)
    reaction = some.select("idx", "model", "_left", F.posexplode("skeletons").alias("reaction", "s")).withColumn("s", F.split("s", ">", -1))
    section = reaction.select("idx", "model", "_left", "reaction", F.size("s").alias("n_sections"), F.posexplode("s").alias("pos", "t"))
    code = section.select("idx", "model", "_left", "reaction", "pos", "n_sections", F.explode(F.split("t", r"\.")).alias("code"))
    used = code.withColumn("value", F.element_at("_left", F.col("code"))).where("value IS NOT NULL").drop("_left")
    return used.withColumn("side", section_side(F.col("pos"), F.col("n_sections")))


def section_side(pos: Column, n_sections: Column) -> Column:
    """left for the first section (also where it is the only one), product for the last, else middle."""
    return F.when(pos == 0, "left").when(pos == n_sections - 1, "product").otherwise("middle")


#: Sides of a skeleton, in the order of their texts.
SIDES = ("left", "middle", "product")


def unresolved_usage(codes: DataFrame) -> DataFrame:
    """Usage of unresolved names out of (idx, model, pos, n_sections, value), by name key: name (the most
    frequent spelling; of equal ones the first by idx and pos), occurrences, those by side, n_rows, and the
    texts models and sides (each of k:n, in order of k).

    Names are keyed once for each distinct spelling. Uses are counted by all they have, with partial sums before
    the shuffle; grouping sets over those few rows then give spellings, models and sides at once. The rows
    themselves are in usage_rows, as a common name has more of them than a cell should hold."""
    name, side = fn.unresolved_name(F.col("value")), section_side(F.col("pos"), F.col("n_sections"))
    used = codes.select("idx", F.col("model").cast("string").alias("model"), name.alias("name"), side.alias("side"), "pos").where("name IS NOT NULL")
    counted = used.groupBy("name", "model", "side").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("idx", "pos")).alias("first"))
    keyed = fn.with_name_key(counted, "name")
    key, parts = F.col("name_key"), [F.col(c) for c in ("name", "model", "side")]
    sets = keyed.groupingSets([[key, p] for p in parts], key, *parts).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    some = lambda c: F.col(c).isNotNull()
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(some(c), F.struct(F.col(c).alias("k"), "n")))), lambda x: F.concat_ws(":", x["k"], x["n"].cast("string"))), "; ")
    per_side = [F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0).cast("long")).alias(s) for s in SIDES]
    spelt = F.max(F.when(some("name"), F.struct("n", (-F.col("first.idx").cast("long")).alias("i"), (-F.col("first.pos")).alias("p"), F.col("name").alias("name"))))
    sums = sets.groupBy("name_key").agg(spelt.alias("s"), F.sum(F.when(some("model"), F.col("n"))).alias("occurrences"), *per_side, text("model").alias("models"), text("side").alias("sides"))
    rows = usage_rows(used.select("idx", "name")).groupBy("name_key").agg(F.count(F.lit(1)).alias("n_rows"))
    return sums.join(rows, "name_key").select("name_key", F.col("s.name").alias("name"), "occurrences", *SIDES, "n_rows", "models", "sides")


def usage_rows(names: DataFrame) -> DataFrame:
    """(name_key, idx), each once, of unresolved names (idx, name)."""
    return fn.with_name_key(names.select("idx", "name").distinct(), "name").select("name_key", "idx").distinct()


def structures_by_name(entries: DataFrame) -> DataFrame:
    """(name_key, smiles, n) of the resolved entries (name_key, value): how often a name has a structure."""
    resolved = entries.where(~F.contains("value", F.lit("(NoSmi)")) & F.col("name_key").isNotNull())
    return resolved.groupBy("name_key", F.col("value").alias("smiles")).agg(F.count(F.lit(1)).alias("n"))


#: Texts of a mapped step that is none.
NO_STEP = ("None", "", "nan")


def mapping_counts(rows: DataFrame) -> DataFrame:
    """(model, mapped_steps, total_steps) of rows (model, reactions, mapped), both arrays."""
    mapped = F.size(F.filter("mapped", lambda m: ~F.coalesce(m, F.lit("")).isin(*NO_STEP)))
    none = F.lit(0)
    return rows.groupBy("model").agg(F.sum(F.when(F.col("mapped").isNotNull(), mapped).otherwise(none)).alias("mapped_steps"), F.sum(F.when(F.col("reactions").isNotNull(), F.size("reactions")).otherwise(none)).alias("total_steps"))


def recovery_by_model(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names and occurrences of unresolved uses (model, name_key) before and after a recovery, for each
    model and over all (model null)."""
    both = before.select("model", "name_key", F.lit(1).alias("b")).unionByName(after.select("model", "name_key", F.lit(0).alias("b")))
    n = lambda b: F.count_if(F.col("b") == b)
    names = lambda b: F.count_distinct(F.when(F.col("b") == b, F.col("name_key")))
    out = both.rollup("model").agg(names(1).alias("names_before"), n(1).alias("before"), names(0).alias("names_after"), n(0).alias("after"))
    return out.withColumn("recovered", F.col("before") - F.col("after"))


def unresolved_percentage(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Percent of entries (keys, value) that are unresolved; 0 where there are none."""
    return entries.groupBy(*keys).agg(F.coalesce(F.avg(F.contains("value", F.lit("(NoSmi)")).cast("double")) * 100, F.lit(0.0)).alias("unresolved_pct"))


#: What became of a name; the last two part the names by whether they are ambiguous.
RESOLVED, PARTLY, RETAINED, NOT_FOUND = "resolved", "partially_resolved", "retained_ambiguous_or_nonmolecular", "not_found"


def recovery_audit(before: DataFrame, after: DataFrame, overrides: DataFrame | None = None, structures: DataFrame | None = None) -> DataFrame:
    """Names of unresolved_usage's rows before and after a recovery (name_key, name, occurrences; other columns
    of before stay) with their status, and the override's kind, lookup_name, evidence_url and note (columns of
    overrides (name_key, ...) that are there) and resolved_smiles, the distinct structures (name_key, smiles, n)
    that the name has now. An unresolved name is retained where its spelling is ambiguous and it has no
    override."""
    a = after.select("name_key", F.col("occurrences").alias("after"))
    joined = before.withColumnRenamed("occurrences", "before").join(a, "name_key", "left")
    fields = [c for c in ("kind", "lookup_name", "evidence_url", "note") if overrides is not None and c in overrides.columns]
    if overrides is not None:
        one = overrides.groupBy("name_key").agg(F.lit(True).alias("_o"), *[F.first(F.coalesce(F.col(c), F.lit(""))).alias(f"override_{c}") for c in fields])
        joined = joined.join(one, "name_key", "left").fillna("", [f"override_{c}" for c in fields])
    else:
        joined = joined.withColumn("_o", F.lit(None).cast("boolean"))
    if structures is not None:
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "smiles")))
        found = structures.groupBy("name_key").agg(F.array_join(F.transform(ranked, lambda x: x["smiles"]), " | ").alias("resolved_smiles"))
        joined = joined.join(found, "name_key", "left").fillna("", ["resolved_smiles"])
    left = F.coalesce("after", F.lit(0))
    kept = fn.is_ambiguous(F.col("name")) & F.col("_o").isNull()
    status = F.when(left == 0, RESOLVED).when(left < F.col("before"), PARTLY).when(kept, RETAINED).otherwise(NOT_FOUND)
    return joined.withColumn("after", left.cast("long")).withColumn("recovered", (F.col("before") - F.col("after")).cast("long")).withColumn("status", status).drop("_o")


def recovery_order(audit: DataFrame) -> DataFrame:
    """More occurrences first, then the name's key; a global sort, for the sink alone."""
    return audit.orderBy(F.col("before").desc(), "name_key")


def recovery_summary(audit: DataFrame) -> DataFrame:
    """Totals by status and over all (status null)."""
    return audit.rollup("status").agg(F.count(F.lit(1)).alias("names"), F.sum("before").alias("before"), F.sum("after").alias("after"), F.sum("recovered").alias("recovered"))


def synonym_matches(names: DataFrame, records: DataFrame, least_key: int = 5) -> DataFrame:
    """(name_key, smiles): the record of equal primary key, else, for keys of least_key letters and
    more, of an equal synonym's. records: (primary_key, synonym_keys, smiles)."""
    primary = records.select(F.col("primary_key").alias("name_key"), "smiles", F.lit(0).alias("kind"))
    synonyms = records.select(F.explode("synonym_keys").alias("name_key"), "smiles", F.lit(1).alias("kind")).where(F.length("name_key") >= least_key)
    found = names.select("name_key").distinct().join(primary.unionByName(synonyms), "name_key")
    return found.groupBy("name_key").agg(F.min_by("smiles", F.struct("kind", "smiles")).alias("smiles"))
