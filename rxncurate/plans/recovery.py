"""Registered queries: second-pass names, usage out of skeletons, applied reviews, joins of the audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxncurate.functions import names
from rxncurate.operators import audit, consensus, denoise, review, skeleton
from rxncurate.operators import names as resolving
from rxncurate.plans.standins import standin, with_sql
from rxncurate.sources.tables import table


def resolve_second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    overrides, dictionary = standin(spark, sf_dir, "overrides"), standin(spark, sf_dir, "dictionary")
    cache = table(spark, sf_dir, "part").where("p_partkey % 9 = 4").select(F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "C1CC").otherwise(F.repeat(F.lit("C"), (F.col("p_size") % 3).cast("int"))).alias("smiles"))
    return resolving.resolve_missing(standin(spark, sf_dir, "names"), dictionary, overrides, cache)


def _rows(spark, sf_dir):
    steps = standin(spark, sf_dir, "model_steps").groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("pos", "skeletons", "reactions", "mapped"))).alias("s"))
    field = lambda c: F.transform("s", lambda x: x[c]).alias(c)
    name = F.concat(F.lit("[compound "), (F.col("idx") % 40).cast("string"), F.lit(" (NoSmi)]"))
    smiles = F.create_map(F.lit("A"), F.lit("C"), F.lit("B"), F.when(F.col("idx") % 7 == 0, name).otherwise(F.lit("CO")))
    return steps.select("idx", F.concat(F.lit("m"), (F.col("idx") % 3).cast("string")).alias("model"), field("skeletons"), field("reactions"), field("mapped"), smiles.alias("smiles"))


def skeleton_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolving.unresolved_usage(resolving.skeleton_uses(_rows(spark, sf_dir)))


def mapping_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("mapped", F.transform("mapped", lambda m: F.when(m == " ", F.lit("None")).otherwise(m)))
    return resolving.mapping_counts(rows)


def structures_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("l_suppkey") % 4 == 0, F.lit("[x (NoSmi)]")).otherwise(F.concat(F.lit("C"), (F.col("l_linenumber") % 3).cast("string")))
    return resolving.structures_by_name(table(spark, sf_dir, "lineitem").select(F.concat(F.lit("part"), (F.col("l_partkey") % 50).cast("string")).alias("name_key"), value.alias("value")))


def recovery_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = standin(spark, sf_dir, "codes").select("idx", F.concat(F.lit("m"), F.col("model").cast("string")).alias("model"), names.unresolved_name(F.col("value")).alias("name_key")).where("name_key IS NOT NULL")
    return resolving.recovery_by_model(used, used.where("idx % 3 <> 0"))


def review_audit_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = standin(spark, sf_dir, "decisions").select("review_id", "idx", "name_key")
    found = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("part "), (F.col("s_suppkey") % 40).cast("string")).alias("name_key"), F.col("s_suppkey").alias("position"),
        F.when(F.col("s_suppkey") % 2 == 0, "resolved").otherwise("not_found").alias("status"), F.concat(F.lit("C"), F.col("s_suppkey").cast("string")).alias("resolved_smiles"), F.lit("OPSIN").alias("resolver_source"))
    return review.attach_audit(queue, found).drop("idx")


def review_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    entries = rows.select("idx", "model", F.explode("smiles").alias("code", "value")).withColumn("name_key", names.unresolved_name(F.col("value")))
    n = F.col("idx") % 40
    decided = rows.select("idx", F.concat(F.lit("compound "), n.cast("string")).alias("name_key"), F.when(n % 3 == 0, "use_smiles").when(n % 3 == 1, "exclude_from_mapping").otherwise("pending").alias("review_decision"), F.lit("CCO").alias("reviewed_smiles"))
    approved = rows.where((n % 6 == 0) & (F.col("idx") % 7 == 0)).select("idx", "model", F.lit("D").alias("code"))
    out = review.rebuild_reactions(rows, review.apply_decisions(entries, decided), approved)
    return out.select("idx", "model", "changed", F.array_join("skeletons", "|").alias("skeletons"), F.array_join("reactions", "|").alias("reactions"))


def review_decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.decision_counts(standin(spark, sf_dir, "decisions"))


def external_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = [F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("paragraph")]
    baseline = o.select(*text, (F.col("o_custkey") % 5).alias("ai_products"), F.lit(1).alias("other"))
    return review.attach_baseline(o.select(*text), baseline, "ai_")


def carried_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    queue = o.select(key.alias("idx"), F.lit("new").alias("candidate_reaction_smiles"), (key % 2).cast("int").alias("product_mapping_complete"))
    label = F.element_at(F.array(F.lit("True "), F.lit("0"), F.lit(""), F.lit("unsure")), (key % 4 + 1).cast("int"))
    previous = o.where("o_orderkey % 3 <> 0").select(key.alias("idx"), label.alias("ground_truth_valid"), F.lit("old").alias("candidate_reaction_smiles"), F.lit(7).alias("product_mapping_complete"), F.lit("seen").alias("review_note"))
    kept = ["idx", "candidate_reaction_smiles", "product_mapping_complete", "ground_truth_valid", "ground_truth_2_reaction_smiles", "review_note"]
    return consensus.carry_review(queue, previous).select(*kept)


def review_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    label = F.element_at(F.array(F.lit("TRUE"), F.lit("0"), F.lit(""), F.lit("unsure")), (key % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(key.alias("idx"), label.alias("ground_truth_valid"), (key % 3 == 0).cast("int").alias("manual_review"), (key % 2).cast("int").alias("mapping_complete"), (key % 5).cast("int").alias("agreement"))
    return consensus.worklist(rows, ["unreviewed", "False"], manual_only=True)


def expert_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.lit(1).alias("slot"), F.col("o_orderstatus").alias("product_mapping_complete"))
    findings = table(spark, sf_dir, "orders").where("o_custkey % 20 = 1").select(F.col("o_orderkey").alias("idx"), F.lit(1).alias("slot"), F.lit("flattened sequence").alias("finding"))
    return consensus.attach_findings(o, findings)


def reaction_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = standin(spark, sf_dir, "atoms").withColumn("charge", F.when((F.col("side") == "product") & (F.col("map") % 4 == 1), 1).otherwise(0))
    bonds = standin(spark, sf_dir, "bonds").select("rxn_id", "side", F.col("a").alias("map_a"), (F.col("b") % 8).alias("map_b"), "bond_order")
    return audit.reaction_centre(atoms, bonds)


def invalid_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("rxn_id").orderBy("section", "map", "smiles")
    return audit.invalid_components(standin(spark, sf_dir, "mapped_steps").withColumn("pos", F.row_number().over(w)))


def role_map_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = standin(spark, sf_dir, "mapped_steps")
    product = parts.where("section = 2").select("rxn_id", "map").distinct().withColumn("shares", F.lit(True))
    left = parts.where("section < 2").select("rxn_id", "map", F.when(F.col("section") == 0, "reactants").otherwise("reagents").alias("role"))
    return audit.role_contradictions(left.join(product, ["rxn_id", "map"], "left").fillna(False, ["shares"]))


def work_up_chemicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rxncurate.plans.curation import _steps

    parsed = _steps(spark, sf_dir).withColumn("p", skeleton.parsed_steps(F.col("steps")))
    return parsed.select("idx", F.array_join(F.array_sort(skeleton.work_up_only(F.col("p"), F.col("products"))), ".").alias("work_up_only"))


def eval_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    evaluation = table(spark, sf_dir, "conversations").where("conv_id % 10 = 0 AND role = 'user'").select(F.concat("text", F.lit("  ")).alias("text"))
    return review.overlapping_rows(train, evaluation, ["conv_id", "turn"])


def sample_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin(spark, sf_dir, "template_rows").withColumn("category", denoise.exclusive_category(["many_products", "many_reactants", "many_reagents", "no_reagent"]))
    return denoise.stratified_sample(rows.where("category IS NOT NULL"), "category", 100, [(F.col("source_row") * 7919) % 10007, F.col("source_row")]).select("source_row", "category")


QUERIES = {f.__name__: f for f in (
    resolve_second_pass, skeleton_usage, mapping_counts, structures_by_name, recovery_by_model, review_audit_info, review_rebuild, review_decision_counts, external_baseline, carried_review, review_worklist,
    expert_findings, reaction_centre, invalid_components, role_map_contradictions, work_up_chemicals, eval_offenders, sample_categories)}

_q = lambda s: "'" + s.replace("'", "''") + "'"
_VALUES = lambda t: ", ".join(f"({_q(a)}, {_q(b)})" for a, b in t)
_CLEAN = "trim(regexp_replace(replace({0}, '′', ''''), '\\s+', ' ', 'g'))"
_KEY = "regexp_replace(lower(strip_accents(replace(regexp_replace({0}, '<[^>]*>', '', 'g'), 'α', 'alpha'))), '[^a-z0-9]', '', 'g')"
_AMBIGUOUS = lambda v: "(lower({0}) IN ({1}) OR {2})".format(v, ", ".join(map(_q, names.AMBIGUOUS)), " OR ".join(f"regexp_matches({v}, {_q(p)})" for p in names.AMBIGUOUS_PATTERNS))
_ROWS = """, ro AS (SELECT idx, 'm' || (idx % 3) AS model, pos, skeletons, reactions, mapped, idx % 7 = 0 AS bad FROM model_steps)"""

ORACLE = {
    "resolve_second_pass": with_sql(["names", "dictionary", "overrides"], f""", known AS (SELECT * FROM (VALUES {_VALUES((k.casefold(), v) for k, v in names.KNOWN_SMILES.items())}) t(k, v)), al AS (SELECT * FROM (VALUES {_VALUES(names.ALIASES.items())}) t(k, v)),
      e AS (SELECT lower_name, smiles, source FROM dictionary QUALIFY row_number() OVER (PARTITION BY lower_name ORDER BY priority, source, smiles) = 1),
      ca AS (SELECT p_name AS name, min(repeat('C', CAST(p_size % 3 AS INT))) AS smiles FROM part WHERE p_partkey % 9 = 4 AND p_size % 3 > 0 GROUP BY p_name),
      n0 AS (SELECT DISTINCT name, {_CLEAN.format('name')} AS clean FROM names),
      n1 AS (SELECT n0.*, o.name IS NOT NULL AS has, nullif(trim(o.smiles), '') AS os, nullif(trim(o.lookup_name), '') AS ol, nullif(trim(o.kind), '') AS ok FROM n0 LEFT JOIN overrides o ON {_KEY.format('o.name')} = {_KEY.format('clean')} AND {_KEY.format('clean')} <> ''),
      n2 AS (SELECT *, coalesce(ol, (SELECT v FROM al WHERE k = lower(clean)), clean) AS lookup FROM n1),
      n3 AS (SELECT n2.*, kn.v AS ks, coalesce(c1.smiles, c2.smiles) AS cs, e.smiles AS es, e.source AS ec FROM n2 LEFT JOIN known kn ON kn.k = lower(clean) LEFT JOIN ca c1 ON c1.name = clean LEFT JOIN ca c2 ON c2.name = lookup LEFT JOIN e ON e.lower_name = lower(lookup))
      SELECT name, CASE WHEN os IS NOT NULL THEN os WHEN ks IS NOT NULL THEN ks WHEN NOT has AND {_AMBIGUOUS('clean')} THEN NULL WHEN cs IS NOT NULL THEN cs ELSE es END AS smiles,
        CASE WHEN os IS NOT NULL THEN 'Curated:' || coalesce(ok, 'override') WHEN ks IS NOT NULL THEN 'KnownAlias' WHEN NOT has AND {_AMBIGUOUS('clean')} THEN NULL
          WHEN cs IS NOT NULL THEN CASE WHEN has THEN 'Curated:' || coalesce(ok, 'alias') || '+' ELSE '' END || 'Cache' WHEN es IS NOT NULL THEN CASE WHEN has THEN 'Curated:' || coalesce(ok, 'alias') || '+' ELSE '' END || ec END AS source FROM n3"""),
    "skeleton_usage": with_sql(["model_steps"], _ROWS + """, us AS (SELECT idx, model, 'compound ' || (idx % 40) AS name FROM ro WHERE bad)
      SELECT replace(name, ' ', '') AS name_key, name, count(*) AS occurrences, CAST(0 AS BIGINT) AS "left", CAST(0 AS BIGINT) AS middle, count(*) AS product, count(DISTINCT idx) AS n_rows,
        (SELECT string_agg(model || ':' || n, '; ' ORDER BY model) FROM (SELECT model, count(*) AS n FROM us u WHERE u.name = us.name GROUP BY model)) AS models, 'product:' || count(*) AS sides FROM us GROUP BY name"""),
    "mapping_counts": with_sql(["model_steps"], _ROWS + " SELECT model, count(*) FILTER (mapped <> ' ') AS mapped_steps, count(*) AS total_steps FROM ro GROUP BY model"),
    "structures_by_name": "SELECT 'part' || (l_partkey % 50) AS name_key, 'C' || (l_linenumber % 3) AS smiles, count(*) AS n FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY 1, 2",
    "recovery_by_model": with_sql(["codes"], """, us AS (SELECT idx, 'm' || model AS model, regexp_extract(value, '^\\[(.*) \\(NoSmi\\)\\]$', 1) AS name FROM codes WHERE value LIKE '[%(NoSmi)]')
      SELECT model, count(DISTINCT name) AS names_before, count(*) AS before, count(DISTINCT name) FILTER (idx % 3 <> 0) AS names_after, count(*) FILTER (idx % 3 <> 0) AS after, count(*) FILTER (idx % 3 = 0) AS recovered FROM us GROUP BY ROLLUP (model)"""),
    "review_audit_info": with_sql(["decisions"], """, a AS (SELECT 'part ' || (s_suppkey % 40) AS name_key, max(s_suppkey) AS k FROM supplier GROUP BY 1)
      SELECT review_id, d.name_key, CASE WHEN k IS NULL THEN '' WHEN k % 2 = 0 THEN 'resolved' ELSE 'not_found' END AS automatic_status, CASE WHEN k IS NULL THEN '' ELSE 'C' || k END AS candidate_smiles, CASE WHEN k IS NULL THEN '' ELSE 'OPSIN' END AS resolver_source
      FROM decisions d LEFT JOIN a ON a.name_key = d.name_key"""),
    "review_rebuild": with_sql(["model_steps"], _ROWS + """, ch AS (SELECT *, bad AND (idx % 40) % 3 < 2 AS changed, (idx % 40) % 3 AS d, (idx % 40) % 6 = 0 AS restored FROM ro),
      sk AS (SELECT *, CASE WHEN NOT changed THEN skeletons ELSE CASE WHEN skeletons = '>B' THEN CASE WHEN d = 0 AND restored THEN 'D>' ELSE '>' END ELSE CASE WHEN d = 0 AND restored THEN 'A.D>' ELSE 'A>' END END || CASE WHEN d = 1 THEN '' ELSE 'B' END END AS s FROM ch)
      SELECT idx, model, any_value(changed) AS changed, string_agg(s, '|' ORDER BY pos) AS skeletons, string_agg(CASE WHEN changed THEN replace(replace(s, 'A', 'C'), 'B', 'CCO') ELSE reactions END, '|' ORDER BY pos) AS reactions FROM sk GROUP BY idx, model"""),
    "review_decision_counts": with_sql(["decisions"], " SELECT decision, count(*) AS rows FROM (SELECT coalesce(nullif(lower(trim(review_decision)), ''), 'pending') AS decision FROM decisions) WHERE decision <> 'maybe' GROUP BY 1"),
    "external_baseline": "SELECT o_orderkey AS idx, o_orderpriority AS title, o_orderstatus AS paragraph, o_custkey % 5 AS ai_products FROM orders",
    "carried_review": """SELECT o_orderkey AS idx, CASE WHEN there AND o_orderkey % 4 < 2 THEN 'old' ELSE 'new' END AS candidate_reaction_smiles, CASE WHEN there AND o_orderkey % 4 < 2 THEN 7 ELSE CAST(o_orderkey % 2 AS INT) END AS product_mapping_complete,
      CASE WHEN there THEN ['True ', '0', '', 'unsure'][o_orderkey % 4 + 1] ELSE '' END AS ground_truth_valid, '' AS ground_truth_2_reaction_smiles, CASE WHEN there THEN 'seen' ELSE '' END AS review_note FROM (SELECT o_orderkey, o_orderkey % 3 <> 0 AS there FROM orders)""",
    "review_worklist": """SELECT o_orderkey AS idx, ['TRUE', '0', '', 'unsure'][o_orderkey % 4 + 1] AS ground_truth_valid, 1 AS manual_review, CAST(o_orderkey % 2 AS INT) AS mapping_complete, CAST(o_orderkey % 5 AS INT) AS agreement,
      CASE o_orderkey % 4 WHEN 1 THEN 'False' ELSE 'unreviewed' END AS status FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0""",
    "expert_findings": "SELECT o_orderkey AS idx, 1 AS slot, 'flattened sequence' AS finding, o_orderstatus AS product_mapping_complete FROM orders WHERE o_custkey % 20 = 1",
    "reaction_centre": with_sql(["atoms", "bonds"], """, ac AS (SELECT *, CASE WHEN side = 'product' AND map % 4 = 1 THEN 1 ELSE 0 END AS charge FROM atoms), bo AS (SELECT rxn_id, side, a AS map_a, b % 8 AS map_b, bond_order FROM bonds),
      pm AS (SELECT DISTINCT rxn_id, map FROM ac WHERE side = 'product' AND map > 0), bb AS (SELECT bo.*, x.map IS NOT NULL AS ia, y.map IS NOT NULL AS ib FROM bo LEFT JOIN pm x ON x.rxn_id = bo.rxn_id AND x.map = map_a LEFT JOIN pm y ON y.rxn_id = bo.rxn_id AND y.map = map_b),
      lv AS (SELECT rxn_id, count(*) AS leaving FROM bb WHERE side = 'input' AND ia <> ib GROUP BY 1),
      bd AS (SELECT rxn_id, least(map_a, map_b) AS x, greatest(map_a, map_b) AS y, max(CASE WHEN side = 'input' THEN bond_order END) AS i, max(CASE WHEN side = 'product' THEN bond_order END) AS p FROM bb WHERE map_a > 0 AND map_b > 0 AND (side = 'product' OR ia AND ib) GROUP BY ALL),
      bs AS (SELECT rxn_id, count(*) FILTER (i IS NULL) AS formed, count(*) FILTER (p IS NULL) AS broken, count(*) FILTER (i <> p) AS changed FROM bd GROUP BY 1),
      cs AS (SELECT rxn_id, count(*) FILTER (i <> p) AS charges FROM (SELECT rxn_id, map, max(CASE WHEN side = 'input' THEN charge END) AS i, max(CASE WHEN side = 'product' THEN charge END) AS p FROM ac WHERE map > 0 GROUP BY ALL) GROUP BY 1),
      al AS (SELECT r.rxn_id, coalesce(formed, 0) AS formed_bonds, coalesce(changed, 0) AS bond_order_changes, coalesce(charges, 0) AS atom_charge_changes, coalesce(leaving, 0) AS leaving_group_bonds, coalesce(broken, 0) + coalesce(leaving, 0) AS broken_bonds
        FROM (SELECT DISTINCT rxn_id FROM atoms) r LEFT JOIN bs USING (rxn_id) LEFT JOIN cs USING (rxn_id) LEFT JOIN lv USING (rxn_id))
      SELECT *, formed_bonds + broken_bonds + bond_order_changes + atom_charge_changes AS centre_size, formed_bonds + broken_bonds + bond_order_changes + atom_charge_changes = 0 AS no_detectable_transformation,
        formed_bonds + broken_bonds + bond_order_changes + atom_charge_changes > 8 AS large_reaction_center FROM al"""),
    "invalid_components": with_sql(["mapped_steps"], " SELECT rxn_id, CAST(count(*) FILTER (readable = 0) AS INT) AS invalid_smiles_count, coalesce(string_agg(smiles, ' | ' ORDER BY section, map, smiles) FILTER (readable = 0), '') AS invalid_smiles FROM mapped_steps GROUP BY rxn_id"),
    "role_map_contradictions": with_sql(["mapped_steps"], """, p AS (SELECT DISTINCT rxn_id, map FROM mapped_steps WHERE section = 2) SELECT l.rxn_id, count(*) FILTER (section = 1 AND p.map IS NOT NULL) AS reagents_contributing,
      count(*) FILTER (section = 0 AND p.map IS NULL) AS reactants_idle FROM mapped_steps l LEFT JOIN p ON p.rxn_id = l.rxn_id AND p.map = l.map WHERE section < 2 GROUP BY l.rxn_id"""),
    "work_up_chemicals": """WITH r AS (SELECT l_orderkey, l_partkey % 9 AS c, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem),
      w AS (SELECT l_orderkey, c, bool_or(l_returnflag = 'N') AS work, bool_or(l_returnflag = 'R') AS used FROM r GROUP BY ALL)
      SELECT l_orderkey AS idx, coalesce(string_agg('C' || c, '.' ORDER BY c) FILTER (work AND NOT used), '') AS work_up_only FROM w GROUP BY l_orderkey""",
    "eval_offenders": """WITH n AS (SELECT conv_id, turn, role, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM conversations)
      SELECT conv_id, turn FROM n WHERE t IN (SELECT t FROM n WHERE conv_id % 10 = 0 AND role = 'user')""",
    "sample_categories": with_sql(["template_rows"], """, c AS (SELECT source_row, CASE WHEN many_products = 1 THEN 'many_products' WHEN many_reactants = 1 THEN 'many_reactants' WHEN many_reagents = 1 THEN 'many_reagents' ELSE 'no_reagent' END AS category
      FROM template_rows WHERE many_products + many_reactants + many_reagents + no_reagent = 1)
      SELECT source_row, category FROM c QUALIFY row_number() OVER (PARTITION BY category ORDER BY (source_row * 7919) % 10007, source_row) <= 100"""),
}
