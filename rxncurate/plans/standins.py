"""Tables that stand for reaction data: derived from the given tables by Spark, and by the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxncurate.sources.tables import table

ROLE = "CASE l_returnflag WHEN 'R' THEN 'reactants' WHEN 'A' THEN 'reagents' ELSE 'products' END"

#: SQL of the stand-ins, which Spark and DuckDB read alike.
SQL = {
    "gt_components": f"SELECT l_orderkey AS rxn_id, {ROLE} AS role, CAST(l_partkey % 97 AS INT) AS comp FROM lineitem",
    "pred_components": f"""SELECT l_orderkey AS rxn_id, m.method, {ROLE} AS role,
        CAST(CASE WHEN (l_suppkey + m.method) % 13 = 0 THEN (l_partkey + 1) % 97 ELSE l_partkey % 97 END AS INT) AS comp
      FROM lineitem CROSS JOIN (SELECT 0 AS method UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) m
      WHERE (l_partkey + l_linenumber * 7 + m.method) % 11 <> 0""",
    "alternatives": f"""SELECT l_orderkey AS rxn_id, 1 AS slot, {ROLE} AS role, CAST(l_partkey % 97 AS INT) AS comp FROM lineitem
      UNION ALL SELECT l_orderkey, 2, {ROLE}, CAST((l_partkey + CASE WHEN l_suppkey % 13 = 0 THEN 1 ELSE 0 END) % 97 AS INT)
      FROM lineitem WHERE l_orderkey % 3 = 0 AND l_partkey % 11 <> 0""",
    "template_rows": """SELECT event_id AS source_row, CAST(user_id % 5 AS BIGINT) AS model,
        concat(event_type, ':', CAST(CAST(FLOOR(value) AS BIGINT) AS STRING)) AS template,
        CASE WHEN user_id % 4 <> 0 THEN 1 ELSE 0 END AS noise_free, CASE WHEN value < 1.0 THEN 1 ELSE 0 END AS template_failure,
        CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 1 ELSE 0 END AS identical_structures,
        CASE WHEN value > 50 THEN 1 ELSE 0 END AS many_products, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS many_reactants,
        CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS many_reagents, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS no_reagent
      FROM events""",
    "mapped_steps": f"""SELECT l_orderkey AS rxn_id, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS section, CAST(l_partkey % 23 + 1 AS INT) AS map,
        CASE WHEN l_suppkey % 31 = 0 THEN concat('[C:', CAST(l_partkey % 23 + 1 AS STRING), '](') WHEN l_suppkey % 13 = 0 THEN concat('[CH3:', CAST(l_partkey % 23 + 1 AS STRING), ']C')
          ELSE concat('[C:', CAST(l_partkey % 23 + 1 AS STRING), ']') END AS smiles,
        CASE WHEN l_suppkey % 31 = 0 THEN 0 ELSE 1 END AS readable, CASE WHEN l_suppkey % 31 = 0 THEN 0 WHEN l_suppkey % 13 = 0 THEN 0 ELSE 1 END AS all_mapped FROM lineitem""",
    "model_steps": """SELECT idx, pos, form, CASE WHEN l_suppkey % 67 = 0 THEN '>B' ELSE 'A>B' END AS skeletons, CASE WHEN l_partkey % 71 = 0 THEN 'C>(NoSmi)' ELSE 'C>O>CO' END AS reactions,
        CASE WHEN l_partkey % 73 = 0 THEN 'nan' ELSE 'C.O>>CO' END AS mapper_reactions, CASE form WHEN 1 THEN '[CH3:1][OH:2].CC>>[CH3:1][OH:2]' WHEN 2 THEN '[CH3:1][Br:3].[OH:2].O>>[CH3:1][OH:2]'
          WHEN 3 THEN '[CH3:1].[OH:2].[NH3:3]>>[CH3:1][OH:2][NH2:3].[CH3:1]C' ELSE ' ' END AS mapped, CASE WHEN l_partkey % 59 = 0 THEN '' ELSE 'T' END AS templates, CASE WHEN l_suppkey % 61 = 0 THEN 'boom' ELSE '' END AS mapping_errors
      FROM (SELECT l_orderkey AS idx, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INT) AS pos,
        CASE WHEN l_partkey % 53 = 0 THEN 0 WHEN l_partkey % 31 = 0 THEN 3 WHEN l_suppkey % 43 = 0 THEN 1 ELSE 2 END AS form, l_partkey, l_suppkey FROM lineitem) s""",
    "model_answers": """SELECT idx, CASE WHEN idx % 22 = 0 THEN 'null' WHEN idx % 11 = 0 THEN '{"Reactants": {}}' ELSE concat('{"Reactants": {"A": "x"}, "Products": {"B": "y"}, "Reaction Steps": {"1 (Reaction, mix)": "', CASE WHEN idx % 17 = 0 THEN 'A B' ELSE 'A->B' END, '"}}') END AS prediction,
        CASE WHEN idx % 29 = 0 THEN 'timeout' END AS error, CASE WHEN idx % 19 = 0 THEN 1 ELSE 0 END AS issue_rare, CASE WHEN idx % 31 = 0 THEN 1 ELSE 0 END AS unresolved, idx % 5 <> 0 AS ground_truth_valid,
        CASE WHEN idx % 13 <> 0 THEN concat('S', CAST(idx % 7 AS STRING)) END AS signature, concat('S', CAST(CASE WHEN idx % 3 = 0 THEN idx % 6 ELSE idx % 7 END AS STRING)) AS first_signature, CASE WHEN idx % 4 = 0 THEN concat('S', CAST(idx % 7 AS STRING)) END AS second_signature
      FROM (SELECT DISTINCT l_orderkey AS idx FROM lineitem) k""",
    "spelt_models": f"""SELECT l_orderkey AS rxn_id, m.method, {ROLE} AS role, CAST((l_partkey + CASE WHEN (l_suppkey + m.method) % 29 = 0 THEN 1 ELSE 0 END) % 6 AS INT) AS mol, CAST((l_suppkey + m.method) % 3 AS INT) AS variant, (l_suppkey + m.method) % 41 = 0 AS bad
      FROM lineitem CROSS JOIN (SELECT 0 AS method UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) m WHERE (l_partkey + l_linenumber * 7 + m.method) % 31 <> 0""",
    "spelt_truths": f"""SELECT l_orderkey AS rxn_id, 1 AS slot, {ROLE} AS role, CAST(l_partkey % 6 AS INT) AS mol, CAST(l_linenumber % 3 AS INT) AS variant, FALSE AS bad FROM lineitem
      UNION ALL SELECT l_orderkey, 2, {ROLE}, CAST((l_partkey + CASE WHEN l_suppkey % 13 = 0 THEN 1 ELSE 0 END) % 6 AS INT), CAST(l_suppkey % 3 AS INT), l_suppkey % 47 = 0 FROM lineitem WHERE l_orderkey % 3 = 0""",
    "audit_parts": f"""SELECT l_orderkey AS rxn_id, {ROLE} AS role, CAST(l_partkey % 3 AS INT) AS e, l_partkey % 4 = 0 AS two, CAST(l_suppkey % 9 AS INT) AS m, l_returnflag = 'N' AND l_suppkey % 5 = 0 AS plus,
        l_partkey % 4 = 0 AND l_linenumber % 2 = 0 AS dbl, l_suppkey % 53 = 0 AS bad, l_suppkey % 17 <> 0 AS labelled FROM lineitem""",
    "text_cells": """SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 2 = 0 THEN '["C>C", "N>N"]' ELSE '(''C>C'', ''N>N'')' END AS reactions,
        CASE WHEN o_orderkey % 11 = 0 THEN '[''broken'', ' WHEN o_orderkey % 2 = 0 THEN '[''[CH3:1]>>[CH3:1]'', ''[CH3:1][OH:2]>>[OH:2][CH3:1]'']' ELSE '["[CH3:1]>>[CH3:1]", "[CH3:1][OH:2]>>[OH:2][CH3:1]"]' END AS mapped,
        CASE WHEN o_orderkey % 3 = 0 THEN '[''T'', None]' ELSE '[''T'', ''T'',]' END AS templates, CASE WHEN o_orderkey % 7 = 0 THEN '["it''s", None]' ELSE '[None, None]' END AS mapping_errors,
        CASE WHEN o_orderkey % 2 = 0 THEN '{''A'': "4''-x", ''B'': None}' ELSE '{"A": "4''-x", "B": null}' END AS smiles FROM orders""",
    "place_steps": """SELECT l_orderkey AS idx, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INT) AS pos,
        CASE WHEN l_orderkey % 13 = 0 THEN ' ' WHEN l_partkey % 23 = 0 THEN '' WHEN l_partkey % 19 = 0 THEN 'Error: no answer' WHEN l_partkey % 17 = 0 THEN '[salt (NoSmi)]>>CC' WHEN l_suppkey % 29 = 0 THEN 'CC'
          WHEN l_suppkey % 11 = 0 THEN concat(repeat('C', CAST(l_partkey % 5 + 1 AS INT)), '>O>') ELSE concat(' ', repeat('C', CAST(l_partkey % 40 + 1 AS INT)), CASE WHEN l_suppkey % 7 = 0 THEN 'Br' ELSE '' END, CASE WHEN l_linenumber % 2 = 0 THEN '>O.N>' ELSE '>>' END, 'CO') END AS value FROM lineitem""",
    "mapped_component": f"""SELECT l_orderkey AS rxn_id, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS section,
        concat('[C:', CAST(l_partkey % 23 + 1 AS STRING), ']') AS smiles FROM lineitem""",
    "answers": """SELECT k, CASE WHEN k % 5 = 0 THEN concat('"', replace(replace(c, chr(92), concat(chr(92), chr(92))), '"', concat(chr(92), '"')), '"') ELSE c END AS answer
      FROM (SELECT k, CASE WHEN k % 7 = 0 THEN substr(b, 1, length(b) - 1) ELSE b END AS c
      FROM (SELECT o_orderkey AS k, concat('{"Reactants, Solvents, Catalysts": {"A": "', o_orderpriority, '", "B": "c', CASE WHEN o_orderkey % 11 = 0 THEN concat(chr(92), '-') ELSE '' END, CAST(o_orderkey % 13 AS STRING),
        '"}, "Products": {"C": "p', CAST(o_orderkey % 7 AS STRING), '"}, "Reaction Steps": {"1 (', CASE WHEN o_orderkey % 6 = 0 THEN 'Work-up' ELSE 'Reaction' END, ', mix)": "A+B', CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE '->' END, 'C"}}') AS b FROM orders) x) y""",
    "names": """SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN concat('Compound ', CAST(p_partkey AS STRING)) WHEN 1 THEN 'silica gel' WHEN 2 THEN concat(p_name, '  anhydrous') WHEN 3 THEN concat('5% ', p_name)
        WHEN 4 THEN concat(p_name, ' (dry)') WHEN 5 THEN 'DMSO' WHEN 6 THEN concat('α-é<b>', p_name, '</b>') ELSE p_name END AS name FROM part""",
    "dictionary": "SELECT lower(p_name) AS lower_name, concat('C', CAST(p_size AS STRING)) AS smiles, p_brand AS source, CAST(p_partkey % 5 AS INT) AS priority FROM part WHERE p_partkey % 3 <> 1",
    "overrides": """SELECT name, CASE WHEN k % 3 = 1 THEN 'dimethyl sulfoxide' ELSE '' END AS lookup_name, CASE WHEN k % 3 = 0 THEN concat('OV', CAST(k % 10 AS STRING)) END AS smiles, CASE WHEN k % 2 = 0 THEN 'synonym' END AS kind
      FROM (SELECT p_name AS name, CAST(min(p_partkey) AS BIGINT) AS k FROM part WHERE p_partkey % 7 = 2 GROUP BY p_name) o""",
    "codes": """SELECT l_orderkey AS idx, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS pos, 3 AS n_sections, CAST(l_suppkey % 4 AS BIGINT) AS model, concat('c', CAST(l_linenumber AS STRING)) AS code,
        CASE WHEN l_partkey % 5 = 0 THEN concat('[part ', CAST(l_partkey % 50 AS STRING), ' (NoSmi)]') ELSE 'CC' END AS value FROM lineitem""",
    "decisions": """SELECT p_partkey AS idx, concat('part ', CAST(p_partkey % 50 AS STRING)) AS name_key, concat('row-', CAST(p_partkey AS STRING), '__part ', CAST(p_partkey % 50 AS STRING)) AS review_id,
        CASE p_partkey % 6 WHEN 0 THEN 'Use_SMILES ' WHEN 1 THEN 'exclude_from_mapping' WHEN 2 THEN 'keep_unresolved' WHEN 3 THEN 'maybe' ELSE '' END AS review_decision,
        CASE WHEN p_partkey % 24 = 0 THEN repeat('C', CAST(p_size % 4 + 1 AS INT)) WHEN p_partkey % 12 = 0 THEN 'C1CC' ELSE '' END AS reviewed_smiles, '' AS evidence, p_brand AS review_note FROM part""",
    "atoms": """SELECT l_orderkey AS rxn_id, CASE WHEN l_returnflag = 'N' THEN 'product' ELSE 'input' END AS side, CAST(l_partkey % 11 AS INT) AS map, CASE l_suppkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'N' WHEN 2 THEN 'O' ELSE 'H' END AS element FROM lineitem""",
    "bonds": """SELECT l_orderkey AS rxn_id, CASE WHEN l_returnflag = 'N' THEN 'product' ELSE 'input' END AS side, CAST(l_partkey % 7 AS INT) AS a, CAST(7 + l_suppkey % 5 AS INT) AS b, CAST(1 + l_linenumber % 2 AS INT) AS bond_order FROM lineitem""",
}


def with_sql(names: list[str], body: str) -> str:
    """A DuckDB statement over stand-ins."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + body


def standin(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """A stand-in as a DataFrame, on the tables of a folder. dealt: its base, if that is lineitem, is dealt by order
    before it is spread to models and texts, so that what is grouped by reaction afterwards is not shuffled again."""
    base = {"template_rows": "events", "answers": "orders", "names": "part", "dictionary": "part", "decisions": "part", "overrides": "part", "text_cells": "orders"}.get(name, "lineitem")
    text = SQL[name].replace("{", "{{").replace("}", "}}").replace(f"FROM {base}", f"FROM {{{base}}}")
    rows = table(spark, sf_dir, base)
    return spark.sql(text, **{base: rows.repartition("l_orderkey") if dealt and base == "lineitem" else rows})


def reactions_of(parts: DataFrame) -> DataFrame:
    """(rxn_id, reaction): components (rxn_id, section, smiles) as reaction strings, each section in order."""
    section = lambda k: F.array_join(F.array_sort(F.collect_list(F.when(F.col("section") == k, F.col("smiles")))), ".")
    return parts.groupBy("rxn_id").agg(F.concat_ws(">", section(0), section(1), section(2)).alias("reaction"))


def noise_flags(rows: DataFrame) -> DataFrame:
    """template_rows with the anomaly flag of singleton thresholds."""
    return rows.withColumn("template_anomaly", F.greatest("singleton", "template_failure", "identical_structures"))
