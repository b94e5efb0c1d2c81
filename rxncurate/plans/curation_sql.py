"""DuckDB statements of the curation queries."""

from __future__ import annotations

from rxncurate.functions import names
from rxncurate.plans.standins import with_sql

_q = lambda s: "'" + s.replace("'", "''") + "'"
_REP = lambda v: f"replace({v}, chr(92) || '-', '-')"
_STRICT = lambda v: f"CASE WHEN json_valid({v}) THEN {v} WHEN json_valid({_REP(v)}) THEN {_REP(v)} END"
_LEVELS = f""", l1 AS (SELECT k, answer, {_STRICT('answer')} AS s1, {_STRICT("fixed")} AS f1 FROM (SELECT *, CASE WHEN answer[1] = '{{' AND answer[-1] <> '}}' THEN answer || '}}}}'
    WHEN answer[1] = '{{' AND length(replace(answer, '{{', '')) > length(replace(answer, '}}', '')) THEN NULL WHEN answer[1] = '{{' THEN answer || '}}' ELSE NULL END AS fixed FROM answers)),
  l2 AS (SELECT *, CASE WHEN s1[1] = '"' THEN json_extract_string(s1, '$') END AS u FROM l1),
  l3 AS (SELECT *, {_STRICT('u')} AS s2 FROM l2),
  d AS (SELECT k, answer, CASE WHEN s1[1] = '{{' THEN s1 WHEN s2[1] = '{{' THEN s2 END AS decoded, f1 FROM l3),
  o AS (SELECT k, decoded, coalesce(decoded, CASE WHEN f1[1] = '{{' THEN f1 END) AS obj FROM d)"""

_STEPS = """ r AS (SELECT l_orderkey, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem)"""
_RXN = """, r0 AS (SELECT rxn_id, coalesce(string_agg(CASE WHEN section = 0 THEN smiles END, '.' ORDER BY smiles), '') AS a, coalesce(string_agg(CASE WHEN section = 1 THEN smiles END, '.' ORDER BY smiles), '') AS b,
  coalesce(string_agg(CASE WHEN section = 2 THEN smiles END, '.' ORDER BY smiles), '') AS c FROM mapped_component GROUP BY rxn_id),
  c AS (SELECT rxn_id, section, smiles, CAST(regexp_extract(smiles, ':(\\d+)', 1) AS INT) AS map FROM mapped_component),
  p AS (SELECT DISTINCT rxn_id, map FROM c WHERE section = 2),
  x AS (SELECT c.*, p.map IS NOT NULL AS shares FROM c LEFT JOIN p USING (rxn_id, map)),
  k AS (SELECT rxn_id, CAST(count(*) FILTER (section < 2 AND shares) AS INT) AS ar, CAST(count(*) FILTER (section < 2 AND NOT shares) AS INT) AS ag, CAST(count(*) FILTER (section = 0 AND shares) AS INT) AS br,
    CAST(count(*) FILTER (section = 0 AND NOT shares) AS INT) AS bg, CAST(count(*) FILTER (section = 1) AS INT) AS mid, CAST(count(*) FILTER (section = 2) AS INT) AS np, CAST(count(*) FILTER (section = 0) AS INT) AS nl FROM x GROUP BY rxn_id)""".replace("\\\\", "\\")
_HEUR = """, c AS (SELECT rxn_id, section, smiles, map, readable = 1 AS readable, all_mapped = 1 AS all_mapped FROM mapped_steps),
  p AS (SELECT DISTINCT rxn_id, map FROM c WHERE section = 2 AND readable), lm AS (SELECT DISTINCT rxn_id, map FROM c WHERE section = 0 AND readable),
  x AS (SELECT c.*, p.map IS NOT NULL AS shares FROM c LEFT JOIN p USING (rxn_id, map)),
  k AS (SELECT rxn_id, count(*) FILTER (section = 0) AS nl, count(*) FILTER (section = 0 AND readable AND shares) AS a, count(*) FILTER (section = 1) + count(*) FILTER (section = 0 AND readable AND NOT shares) AS b, count(*) FILTER (section = 2) AS n,
    bool_and(readable OR section = 1) AS readable, coalesce(bool_or(NOT all_mapped) FILTER (section = 2), FALSE) AS unmapped,
    list_sort(list(replace(smiles, 'CH3', 'C')) FILTER (section = 0 AND readable AND shares)) AS rs, list_sort(list(replace(smiles, 'CH3', 'C')) FILTER (section = 2 AND readable)) AS ps FROM x GROUP BY rxn_id),
  keyed AS (SELECT k.*, list_sort(list_transform(coalesce(rs, []), lambda z: regexp_replace(z, ':[0-9]+', ''))) AS rk, list_sort(list_transform(coalesce(ps, []), lambda z: regexp_replace(z, ':[0-9]+', ''))) AS pk,
    n > 0 AND (unmapped OR NOT EXISTS (SELECT 1 FROM p WHERE p.rxn_id = k.rxn_id) OR EXISTS (SELECT 1 FROM p WHERE p.rxn_id = k.rxn_id AND NOT EXISTS (SELECT 1 FROM lm WHERE lm.rxn_id = p.rxn_id AND lm.map = p.map))) AS missing FROM k),
  h0 AS (SELECT *, list_distinct([e FOR e IN [CASE WHEN nl = 0 THEN 'missing left-side components' END, CASE WHEN n = 0 THEN 'missing products' END, CASE WHEN missing THEN 'product atom mapping is incomplete' END,
    CASE WHEN rxn_id % 13 = 0 THEN 'template extraction failed' END, CASE WHEN rxn_id % 17 = 0 THEN 'mapper failed' WHEN rxn_id % 34 = 1 AND readable THEN 'invalid SMILES' END, CASE WHEN NOT readable THEN 'invalid SMILES' END,
    CASE WHEN a = 0 THEN 'mapped reactants unavailable' END] IF e IS NOT NULL]) AS errs, [e FOR e IN [CASE WHEN nl = 0 THEN 'missing left-side components' END, CASE WHEN n = 0 THEN 'missing products' END,
    CASE WHEN missing THEN 'product atom mapping is incomplete' END, CASE WHEN rxn_id % 13 = 0 THEN 'template extraction failed' END, CASE WHEN rxn_id % 17 = 0 THEN 'mapper failed' WHEN rxn_id % 34 = 1 THEN 'invalid SMILES' END,
    CASE WHEN NOT readable AND rxn_id % 34 <> 1 THEN 'invalid SMILES' END, CASE WHEN a = 0 THEN 'mapped reactants unavailable' END] IF e IS NOT NULL] AS told FROM keyed),
  h AS (SELECT rxn_id, CAST(a AS INT) AS reactant_count, CAST(b AS INT) AS reagent_count, CAST(n AS INT) AS product_count, CAST(a > 2 AS INT) AS many_reactants, CAST(n > 1 AS INT) AS many_products, CAST(b > 5 AS INT) AS many_reagents,
    CAST(a > 0 AND n > 0 AND b = 0 AS INT) AS no_reagent, CAST(len(told) > 0 AS INT) AS template_failure, CAST(missing AS INT) AS missing_product_atom_maps, CAST(a > 0 AND rk = pk AS INT) AS identical_structures, array_to_string(told, ' | ') AS error FROM h0)"""
_CLEAN = "trim(regexp_replace(replace(name, '′', ''''), '\\s+', ' ', 'g'))"
_FIX = lambda v: f"trim(regexp_replace({v}, {_q('(' + '|'.join(names.QUALIFIERS) + ')')}, '', 'gi'))"
_SPACED = lambda v: f"trim(regexp_replace(replace({v}, '′', ''''), '\\s+', ' ', 'g'))"
_AMB = lambda v: "(lower({0}) IN ({1}) OR {2})".format(v, ", ".join(map(_q, names.AMBIGUOUS)), " OR ".join(f"regexp_matches({v}, {_q(p)})" for p in names.AMBIGUOUS_PATTERNS))
_VALUES = lambda t: ", ".join(f"({_q(a)}, {_q(b)})" for a, b in t)
_RESOLVE = f""", known AS (SELECT * FROM (VALUES {_VALUES((k.casefold(), v) for k, v in names.KNOWN_SMILES.items())}) t(k, v)), al AS (SELECT * FROM (VALUES {_VALUES(names.ALIASES.items())}) t(k, v)),
  e AS (SELECT lower_name, smiles, source FROM dictionary QUALIFY row_number() OVER (PARTITION BY lower_name ORDER BY priority, source, smiles) = 1),
  n0 AS (SELECT DISTINCT name, {_CLEAN} AS clean, {_FIX('name')} AS b0 FROM names),
  n1 AS (SELECT *, lower(coalesce((SELECT v FROM al WHERE k = lower(clean)), clean)) AS alias, {_SPACED('b0')} AS bare FROM n0),
  n2 AS (SELECT *, {_FIX("coalesce((SELECT v FROM al WHERE k = lower(bare)), bare)")} AS f0 FROM n1), n3 AS (SELECT *, {_SPACED('f0')} AS f1 FROM n2),
  n4 AS (SELECT *, lower(coalesce((SELECT v FROM al WHERE k = lower(f1)), f1)) AS fixed FROM n3),
  n5 AS (SELECT n4.*, k1.v AS v1, coalesce(k2.v, k3.v) AS v2, e1.smiles AS s1, e1.source AS c1, e2.smiles AS s2, e2.source AS c2 FROM n4 LEFT JOIN known k1 ON k1.k = lower(clean) LEFT JOIN known k2 ON k2.k = lower(bare) LEFT JOIN known k3 ON k3.k = fixed
    LEFT JOIN e e1 ON e1.lower_name = alias LEFT JOIN e e2 ON e2.lower_name = fixed),
  res AS (SELECT name, coalesce(v1, s1, v2, s2, '[' || name || ' (NoSmi)]') AS smiles, CASE WHEN v1 IS NOT NULL THEN 'KnownAlias' WHEN s1 IS NOT NULL THEN c1 WHEN v2 IS NOT NULL THEN 'KnownAlias' ELSE c2 END AS source FROM n5)"""
_USAGE = """, u AS (SELECT idx, regexp_extract(value, '^\\[(.*) \\(NoSmi\\)\\]$', 1) AS name, pos, model, code, CASE pos WHEN 0 THEN 'left' WHEN 2 THEN 'product' ELSE 'middle' END AS side FROM codes WHERE value LIKE '[%(NoSmi)]'),
  um AS (SELECT name, string_agg(model || ':' || n, '; ' ORDER BY model) AS models FROM (SELECT name, CAST(model AS VARCHAR) AS model, count(*) AS n FROM u GROUP BY ALL) GROUP BY name),
  us AS (SELECT name, count(*) AS occurrences, count(*) FILTER (side = 'left') AS "left", count(*) FILTER (side = 'middle') AS middle, count(*) FILTER (side = 'product') AS product, count(DISTINCT idx) AS n_rows FROM u GROUP BY name)"""
_SPELT = """, co AS (SELECT *, CAST(regexp_extract(value, '(\\d+)', 1) AS VARCHAR) AS x FROM codes),
  un AS (SELECT idx, model, pos, side, n, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') AS name_key FROM (SELECT idx, 'x' AS z, model, pos, CASE pos WHEN 0 THEN 'left' WHEN 2 THEN 'product' ELSE 'middle' END AS side,
    CASE WHEN CAST(x AS INT) % 15 = 0 THEN 'compound ' || x WHEN code IN ('c2', 'c5') THEN 'Part-' || x ELSE 'part ' || x END AS n FROM co WHERE value LIKE '[%(NoSmi)]')),
  nm AS (SELECT name_key, n AS name FROM un GROUP BY name_key, n QUALIFY row_number() OVER (PARTITION BY name_key ORDER BY count(*) DESC, min((idx, pos)), n DESC) = 1),
  um AS (SELECT name_key, string_agg(model || ':' || n, '; ' ORDER BY model) AS models FROM (SELECT name_key, CAST(model AS VARCHAR) AS model, count(*) AS n FROM un GROUP BY ALL) GROUP BY name_key),
  sm AS (SELECT name_key, string_agg(side || ':' || n, '; ' ORDER BY side) AS sides FROM (SELECT name_key, side, count(*) AS n FROM un GROUP BY ALL) GROUP BY name_key),
  us AS (SELECT name_key, count(*) AS occurrences, count(*) FILTER (side = 'left') AS "left", count(*) FILTER (side = 'middle') AS middle, count(*) FILTER (side = 'product') AS product, count(DISTINCT idx) AS n_rows FROM un GROUP BY name_key),
  usage AS (SELECT name_key, name, occurrences, "left", middle, product, n_rows, models, sides FROM us JOIN nm USING (name_key) JOIN um USING (name_key) JOIN sm USING (name_key))"""
_RECOVERY = _SPELT + """, nn AS (SELECT *, occurrences AS before, CAST(regexp_extract(name_key, '(\\d+)', 1) AS INT) AS x FROM usage),
  aa AS (SELECT *, CASE WHEN x % 10 = 0 THEN 0 WHEN x % 3 = 0 THEN before ELSE before // 2 END AS after FROM nn),
  ra AS (SELECT name_key, name, before, CAST(after AS BIGINT) AS after, CAST(before - after AS BIGINT) AS recovered, CASE WHEN after = 0 THEN 'resolved' WHEN after < before THEN 'partially_resolved'
    WHEN name LIKE 'compound %' AND x % 9 <> 0 THEN 'retained_ambiguous_or_nonmolecular' ELSE 'not_found' END AS status, models, sides, n_rows, CASE WHEN x % 9 = 0 THEN 'alias' ELSE '' END AS override_kind FROM aa)"""
_SIGNED = lambda t, keys: f"""SELECT {keys}, CASE WHEN c IS NOT NULL THEN coalesce(a, '') || '>' || coalesce(b, '') || '>' || c END AS signature, c AS relaxed FROM (
    SELECT {keys}, string_agg(CASE WHEN role = 'reactants' THEN CAST(comp AS VARCHAR) END, '.' ORDER BY comp) AS a, string_agg(CASE WHEN role = 'reagents' AND r = 1 THEN CAST(comp AS VARCHAR) END, '.' ORDER BY comp) AS b,
      string_agg(CASE WHEN role = 'products' AND r = 1 THEN CAST(comp AS VARCHAR) END, '.' ORDER BY comp) AS c FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, role, comp) AS r FROM {t}) GROUP BY {keys})"""  # noqa: E731
_SIG = f""", sig AS (SELECT rxn_id AS idx, method AS model_pos, 'm' || method AS model, signature, relaxed FROM ({_SIGNED('pred_components', 'rxn_id, method')})),
  grp AS (SELECT idx, signature, list(model ORDER BY model_pos) AS members, count(*) AS size, min(model_pos) AS first_pos FROM sig WHERE signature IS NOT NULL GROUP BY idx, signature),
  best AS (SELECT * FROM grp QUALIFY row_number() OVER (PARTITION BY idx ORDER BY size DESC, first_pos) = 1),
  al AS (SELECT idx, list(model ORDER BY model_pos) AS models FROM sig GROUP BY idx),
  gs AS (SELECT idx, list(members ORDER BY size DESC, members) AS groups FROM grp GROUP BY idx),
  con AS (SELECT al.idx, b.signature, coalesce(b.size, 0) AS agreement, coalesce(b.members, []) AS members, [m FOR m IN models IF NOT list_contains(coalesce(b.members, []), m)] AS disagreeing, coalesce(groups, []) AS groups
    FROM al LEFT JOIN best b USING (idx) LEFT JOIN gs USING (idx))"""
_GROUPS = lambda g: f"array_to_string([array_to_string(x, ';') FOR x IN {g}], '|')"
_CK = "SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 10 = 5 THEN ' ' ELSE '{}' END AS prediction FROM orders WHERE o_orderkey % 10 <> 3"
_CONV = """, m AS (SELECT conv_id, list(role ORDER BY turn, role, text) AS roles, list(text ORDER BY turn, role, text) AS texts, count(*) AS n FROM conversations GROUP BY conv_id),
  v AS (SELECT *, CASE WHEN n <> 3 THEN 'not three messages' WHEN roles <> ['system', 'user', 'assistant'] THEN 'roles out of order' WHEN len(list_filter(texts, lambda t: trim(coalesce(t, '')) = '')) > 0 THEN 'blank message' END AS error FROM m)"""
_LEFT = """, lf AS (SELECT l_orderkey AS rxn_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos, CAST(l_partkey % 5 AS INT) AS comp FROM lineitem),
  lb AS (SELECT rxn_id, role, comp % 5 AS comp FROM gt_components), hv AS (SELECT rxn_id, comp, count(*) FILTER (role = 'reactants') AS a, count(*) FILTER (role = 'reagents') AS b FROM lb GROUP BY ALL),
  asg AS (SELECT rxn_id, pos, comp, CASE WHEN r <= a THEN 'reactants' WHEN r <= a + b THEN 'reagents' ELSE 'unknown' END AS role FROM (SELECT lf.*, coalesce(a, 0) AS a, coalesce(b, 0) AS b, row_number() OVER (PARTITION BY rxn_id, comp ORDER BY pos) AS r FROM lf LEFT JOIN hv USING (rxn_id, comp)))"""
_MAPS = """, mm AS (SELECT rxn_id, map, count(*) FILTER (side = 'product' AND element <> 'H') AS p, count(*) FILTER (side = 'input' AND element <> 'H') AS i, min(element) FILTER (side = 'product') AS pe, min(element) FILTER (side = 'input') AS ie FROM atoms GROUP BY ALL),
  ma AS (SELECT rxn_id, CAST(coalesce(sum(p) FILTER (map = 0), 0) AS BIGINT) AS unmapped, count(*) FILTER (map > 0 AND (p > 1 OR i > 1)) AS duplicate_maps, count(*) FILTER (map > 0 AND p > 0 AND i = 0) AS missing_left,
    count(*) FILTER (map > 0 AND pe <> ie) AS element_mismatch FROM mm GROUP BY rxn_id HAVING sum(p) > 0)"""

# Every step of the stand-in makes one product from one code and the product before, so each is a group of
# its own and the last makes P: pieces in order, then the rules on leading and doubled signs.
_SKELETON = lambda code: f"""WITH {_STEPS}, g AS (SELECT l_orderkey, n, {code} AS c, l_returnflag FROM r),
  t AS (SELECT l_orderkey AS idx, replace(ltrim(string_agg(CASE l_returnflag WHEN 'R' THEN c || '>' WHEN 'A' THEN '>' || c || '>' ELSE '' END, '' ORDER BY n), '>') || '>P', '>>', '>') AS f FROM g GROUP BY l_orderkey)"""  # noqa: E731

ORACLE = {
    "skeleton_assemble": _SKELETON("'C' || (l_partkey % 9)") + " SELECT idx, CASE WHEN f[1] = '>' THEN '' ELSE f END AS skeletons FROM t",
    "substitute_codes": _SKELETON("CASE WHEN (l_partkey % 9) % 2 = 0 THEN repeat('C', CAST(l_partkey % 9 + 1 AS INT)) ELSE 'C' || (l_partkey % 9) END") + " SELECT idx, CASE WHEN f[1] = '>' THEN 'Error: empty rxn_codes' ELSE f END AS reactions FROM t",
    "json_decode_repair": with_sql(["answers"], _LEVELS + """ SELECT k, decoded IS NOT NULL AS valid, json_extract_string(obj, '$.Products.C') AS product, json_extract_string(obj, '$."Reactants, Solvents, Catalysts".B') AS b FROM o"""),
    "structured_output_check": with_sql(["answers"], """, s AS (SELECT k, replace(answer, chr(92) || '-', '-') AS a FROM answers), t AS (SELECT k, CASE WHEN json_valid(a) AND json_type(a) = 'OBJECT' THEN a END AS o FROM s)
      SELECT k, coalesce(json_type(o, '$.Products') = 'OBJECT' AND json_type(o, '$."Reactants, Solvents, Catalysts"') = 'OBJECT' AND st LIKE '%(Reaction,%' AND st LIKE '%->%', FALSE) AS ok, CASE WHEN st LIKE '%(Reaction,%' THEN 1 ELSE 0 END AS steps
      FROM (SELECT k, o, json_extract_string(o, '$."Reaction Steps"') AS st FROM t)"""),
    "step_explode_classify": f"WITH {_STEPS} SELECT l_orderkey AS idx, CAST(n - 1 AS INT) AS pos, CAST(n - 1 AS INT) AS number, CASE l_returnflag WHEN 'R' THEN 'reaction' WHEN 'A' THEN 'involve' ELSE 'work-up' END AS kind, 'C' || (l_partkey % 9) || CASE WHEN n > 1 THEN '+mixture' || (n - 1) ELSE '' END AS \"left\", CASE WHEN n = m THEN 'P' ELSE 'mixture' || n END AS \"right\" FROM r",
    "split_reaction_roles": with_sql(["mapped_component"], _RXN + " SELECT rxn_id, nl AS n_reactants, mid AS n_reagents, np AS n_products, a || '>' || b || '>' || c AS text FROM r0 JOIN k USING (rxn_id)"),
    "role_by_map_overlap": with_sql(["mapped_component"], _RXN + " SELECT rxn_id, ar AS a_reactants, ag AS a_reagents, CASE WHEN np > 0 THEN br ELSE 0 END AS b_reactants, CASE WHEN np > 0 THEN bg ELSE 0 END AS b_reagents, br AS c_reactants, bg + mid AS c_reagents FROM k"),
    "mapper_input_form": with_sql(["mapped_component"], _RXN + """ SELECT rxn_id, CASE WHEN lhs <> '' AND c <> '' THEN lhs || '>>' || c END AS value, CASE WHEN lhs = '' OR c = '' THEN 'Reaction must contain both reactants and products.' END AS error
      FROM (SELECT rxn_id, a || CASE WHEN a <> '' AND b <> '' THEN '.' ELSE '' END || b AS lhs, c FROM r0)"""),
    "step_heuristics": with_sql(["mapped_steps"], _HEUR + " SELECT * FROM h"),
    "row_heuristics_rollup": with_sql(["mapped_steps"], _HEUR + """ SELECT *, greatest(issue_rare, template_failure, identical_structures) AS rare_template FROM (SELECT rxn_id // 4 AS idx, count(*) AS reaction_count, max(many_reactants) AS many_reactants,
      max(many_products) AS many_products, max(many_reagents) AS many_reagents, max(no_reagent) AS no_reagent, greatest(max(template_failure), max(CAST(rxn_id % 23 = 0 AS INT))) AS template_failure,
      max(missing_product_atom_maps) AS missing_product_atom_maps, max(identical_structures) AS identical_structures, max(CAST(rxn_id % 19 = 0 AS INT)) AS issue_rare FROM h GROUP BY 1)"""),
    "name_clean_fix": with_sql(["names"], f" SELECT id, {_CLEAN} AS clean, {_FIX('name')} AS fixed FROM names"),
    "name_key": with_sql(["names"], " SELECT id, regexp_replace(lower(strip_accents(replace(regexp_replace(name, '<[^>]*>', '', 'g'), 'α', 'alpha'))), '[^a-z0-9]', '', 'g') AS name_key FROM names"),
    "ambiguous_name_filter": with_sql(["names"], f" SELECT id, {_AMB('c')} AS ambiguous FROM (SELECT id, {_CLEAN} AS c FROM names)"),
    "resolve_cascade": with_sql(["names", "dictionary"], _RESOLVE + " SELECT * FROM res"),
    "resolve_once_fanout": with_sql(["names", "dictionary"], _RESOLVE + " SELECT source, count(*) AS occurrences, count(DISTINCT smiles) AS structures FROM names JOIN res USING (name) GROUP BY source"),
    "name_structure_conflicts": """WITH e AS (SELECT lower(p_brand) AS name_key, p_type AS name, CAST(p_size % 3 AS VARCHAR) AS smiles FROM part) SELECT name_key, smiles, string_agg(DISTINCT name, '; ' ORDER BY name) AS names
      FROM e WHERE name_key IN (SELECT name_key FROM e GROUP BY 1 HAVING count(DISTINCT smiles) > 1) GROUP BY ALL""",
    "unresolved_usage": with_sql(["codes"], _SPELT + " SELECT * FROM usage"),
    "unresolved_percentage": with_sql(["codes"], " SELECT model, round(avg(CASE WHEN value LIKE '%(NoSmi)%' THEN 1.0 ELSE 0.0 END) * 100, 6) AS unresolved_pct FROM codes GROUP BY model"),
    "recovery_status_audit": with_sql(["codes"], _RECOVERY + " SELECT * FROM ra"),
    "recovery_summary": with_sql(["codes"], _RECOVERY + " SELECT status, count(*) AS names, CAST(sum(before) AS BIGINT) AS before, CAST(sum(after) AS BIGINT) AS after, CAST(sum(recovered) AS BIGINT) AS recovered FROM ra GROUP BY ROLLUP (status)"),
    "review_queue": with_sql(["codes"], _USAGE + """, t AS (SELECT idx, name, count(*) AS occurrences FROM u GROUP BY ALL),
      a AS (SELECT idx, name, string_agg(m || ':' || n, '; ' ORDER BY m || ':' || n) AS models FROM (SELECT idx, name, 'm' || model AS m, count(*) AS n FROM u GROUP BY ALL) GROUP BY ALL),
      b AS (SELECT idx, name, string_agg(side || ':' || n, '; ' ORDER BY side || ':' || n) AS sides FROM (SELECT idx, name, side, count(*) AS n FROM u GROUP BY ALL) GROUP BY ALL),
      c AS (SELECT idx, name, string_agg(x, '; ' ORDER BY x) AS model_codes FROM (SELECT idx, name, 'm' || model || ':' || string_agg(code, '|' ORDER BY code) AS x FROM (SELECT DISTINCT idx, name, model, code FROM u) GROUP BY idx, name, model) GROUP BY ALL)
      SELECT 'row-' || idx || '__' || name AS review_id, name AS display_name, occurrences, models, sides, model_codes FROM t JOIN a USING (idx, name) JOIN b USING (idx, name) JOIN c USING (idx, name)"""),
    "review_queue_merge": with_sql(["codes", "decisions"], _USAGE + """, t AS (SELECT idx, name, count(*) AS occurrences FROM u GROUP BY ALL),
      b AS (SELECT idx, name, string_agg(side || ':' || n, '; ' ORDER BY side) AS sides FROM (SELECT idx, name, side, count(*) AS n FROM u GROUP BY ALL) GROUP BY ALL),
      q AS (SELECT 'row-' || idx || '__' || name AS review_id, idx, name AS display_name, occurrences, sides FROM t JOIN b USING (idx, name)),
      d AS (SELECT *, coalesce(review_decision, '') AS dec FROM decisions)
      SELECT coalesce(q.review_id, d.review_id) AS review_id, coalesce(q.idx, d.idx) AS idx, coalesce(q.display_name, upper(d.name_key)) AS display_name, coalesce(occurrences, 0) AS occurrences, sides, q.review_id IS NOT NULL AS currently_unresolved,
      coalesce(dec, 'pending') AS review_decision, coalesce(reviewed_smiles, '') AS reviewed_smiles, coalesce(evidence, '') AS evidence, coalesce(review_note, '') AS review_note FROM q FULL JOIN d ON q.review_id = d.review_id
      WHERE q.review_id IS NOT NULL OR lower(trim(dec)) <> 'pending'"""),
    "review_decision_validation": with_sql(["decisions"], """ SELECT review_id, problem FROM (SELECT review_id, CASE WHEN coalesce(nullif(lower(trim(review_decision)), ''), 'pending') NOT IN ('pending', 'use_smiles', 'keep_unresolved', 'exclude_from_mapping') THEN 'unknown decision'
      WHEN lower(trim(review_decision)) = 'use_smiles' AND trim(reviewed_smiles) IN ('', 'C1CC') THEN 'reviewed_smiles is not valid SMILES' END AS problem FROM decisions) WHERE problem IS NOT NULL"""),
    "review_apply_summary": with_sql(["codes", "decisions"], """, e AS (SELECT idx, model, code, CASE WHEN value LIKE '[%(NoSmi)]' THEN regexp_extract(value, '^\\[(.*) \\(NoSmi\\)\\]$', 1) END AS name_key FROM codes),
      j AS (SELECT e.*, lower(trim(d.review_decision)) AS dec FROM e LEFT JOIN decisions d ON d.idx = e.idx AND d.name_key = e.name_key AND lower(trim(d.review_decision)) IN ('use_smiles', 'exclude_from_mapping'))
      SELECT model, count(*) FILTER (dec = 'use_smiles') AS replacements, count(*) FILTER (dec = 'exclude_from_mapping') AS excluded, count(DISTINCT CASE WHEN dec IS NOT NULL THEN idx END) AS changed_rows FROM j GROUP BY model"""),
    "unmatched_decisions": with_sql(["codes", "decisions"], _USAGE + " SELECT review_id, review_decision FROM decisions d WHERE lower(trim(review_decision)) IN ('use_smiles', 'exclude_from_mapping') AND NOT EXISTS (SELECT 1 FROM u WHERE u.idx = d.idx AND u.name = d.name_key)"),
    "resume_pending": "SELECT idx, reason FROM (SELECT o_orderkey AS idx, CASE o_orderkey % 10 WHEN 3 THEN 'missing' WHEN 4 THEN 'other text' WHEN 6 THEN 'error' WHEN 5 THEN 'no prediction' END AS reason FROM orders) WHERE reason IS NOT NULL",
    "checkpoint_upsert": f"WITH old AS ({_CK}), new AS (SELECT o_orderkey AS idx, 'new' AS prediction FROM orders WHERE o_orderkey % 10 IN (3, 4, 5, 6)) SELECT * FROM new UNION ALL SELECT * FROM old WHERE idx NOT IN (SELECT idx FROM new)",
    "eval_disjointness": """WITH t AS (SELECT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS h, count(*) AS n FROM documents GROUP BY 1) SELECT item_id, coalesce(n, 0) AS overlaps FROM benchmark LEFT JOIN t ON t.h = trim(regexp_replace(lower(benchmark.text), '\\s+', ' ', 'g'))""",
    "finetune_validate": "WITH z AS (SELECT 1)" + _CONV + """, w AS (SELECT conv_id, error, CASE WHEN error IS NULL AND json_valid(texts[3]) AND trim(texts[3])[1] = '{' THEN CAST(json(texts[3]) AS VARCHAR) END AS target FROM v)
      SELECT conv_id, coalesce(error, CASE WHEN target IS NULL THEN 'Assistant target is not a JSON object after decoding.' END) AS error, target FROM w""",
    "finetune_summary": "WITH z AS (SELECT 1)" + _CONV + """ SELECT count(*) AS records_in, count(*) FILTER (error IS NULL AND json_valid(texts[3]) AND trim(texts[3])[1] = '{') AS records_out,
      count(*) FILTER (error IS NULL AND json_valid(texts[3]) AND trim(texts[3])[1] = '{') AS valid_targets FROM v""",
    "finetune_role_counts": "SELECT role, count(*) AS messages, count(DISTINCT conv_id) AS records FROM conversations GROUP BY role",
    "consensus_groups": with_sql(["pred_components"], _SIG + f" SELECT idx, signature, CAST(agreement AS INT) AS agreement, array_to_string(members, ';') AS members, array_to_string(disagreeing, ';') AS disagreeing, {_GROUPS('groups')} AS groups FROM con"),
    "consensus_with_source": with_sql(["pred_components", "gt_components"], _SIG + f""", src AS (SELECT rxn_id AS idx, signature FROM ({_SIGNED('gt_components', 'rxn_id')}) WHERE rxn_id % 6 <> 0 AND signature IS NOT NULL),
      added AS (SELECT g.idx, CASE WHEN s.signature = g.signature THEN list_append(g.members, 'Lowe_smiles') ELSE g.members END AS members FROM grp g LEFT JOIN src s USING (idx)
        UNION ALL SELECT idx, ['Lowe_smiles'] FROM src s WHERE EXISTS (SELECT 1 FROM al WHERE al.idx = s.idx) AND NOT EXISTS (SELECT 1 FROM grp g WHERE g.idx = s.idx AND g.signature = s.signature)),
      cg AS (SELECT idx, list(members ORDER BY len(members) DESC, members) AS groups FROM added GROUP BY idx)
      SELECT con.idx, CAST(agreement AS INT) AS agreement, coalesce({_GROUPS('cg.groups')}, '') AS comparison_groups, coalesce(array_to_string(flatten(cg.groups[2:]), ';'), '') AS comparison_disagreeing FROM con LEFT JOIN cg USING (idx)"""),
    "manual_review_queue": with_sql(["pred_components"], _SIG + """, r AS (SELECT o_orderkey AS idx FROM orders WHERE o_orderstatus = 'P'),
      c AS (SELECT idx, min(CASE WHEN (idx + CAST(m[2:] AS INT)) % 5 <> 0 THEN 1 ELSE 0 END) AS mapping_complete FROM (SELECT idx, unnest(members) AS m FROM con) GROUP BY idx)
      SELECT con.idx, CAST(agreement AS INT) AS agreement, coalesce(mapping_complete, 0) AS mapping_complete, CASE WHEN r.idx IS NULL THEN 0 ELSE 1 END AS rare_input,
        CASE WHEN agreement < 4 OR coalesce(mapping_complete, 0) = 0 OR r.idx IS NOT NULL THEN 1 ELSE 0 END AS manual_review FROM con LEFT JOIN c USING (idx) LEFT JOIN r ON r.idx = con.idx"""),
    "model_support": with_sql(["pred_components", "alternatives"], _SIG + f""", g AS ({_SIGNED('alternatives', 'rxn_id, slot')}), ms AS (SELECT idx, count(*) AS multistep FROM sig WHERE (idx + model_pos) % 3 > 1 GROUP BY idx)
      SELECT g.rxn_id AS idx, g.slot, CAST(count(model) FILTER (sig.signature = g.signature) AS INT) AS support, coalesce(string_agg(model, '; ' ORDER BY model) FILTER (sig.signature = g.signature), '') AS supporting,
        CAST(count(model) FILTER (sig.relaxed = g.relaxed) AS INT) AS relaxed_support, coalesce(string_agg(model, '; ' ORDER BY model) FILTER (sig.relaxed = g.relaxed), '') AS relaxed_supporting,
        coalesce(any_value(multistep), 0) AS multistep FROM g LEFT JOIN sig ON sig.idx = g.rxn_id LEFT JOIN ms ON ms.idx = g.rxn_id GROUP BY g.rxn_id, g.slot"""),
    "element_deficit": """WITH a AS (SELECT l_orderkey AS rxn_id, CASE WHEN l_returnflag = 'N' THEN 'product' ELSE 'input' END AS side, unnest([['C', 'N', 'O', 'Cl'][l_suppkey % 4 + 1], 'C', 'C']) AS element FROM lineitem),
      b AS (SELECT rxn_id, element, count(*) FILTER (side = 'product') AS p, count(*) FILTER (side = 'input') AS i FROM a GROUP BY ALL) SELECT rxn_id, element, p - i AS deficit FROM b WHERE p > i""",
    "role_multiset_overlap": with_sql(["gt_components"], """, c AS (SELECT rxn_id, comp % 5 AS comp, count(*) FILTER (role = 'reactants') AS a, count(*) FILTER (role = 'reagents') AS b, count(*) FILTER (role = 'products') AS p FROM gt_components GROUP BY ALL)
      SELECT rxn_id, CAST(sum(least(a, b)) AS BIGINT) AS reactant_reagent, CAST(sum(least(a, p)) AS BIGINT) AS reactant_product, CAST(sum(least(b, p)) AS BIGINT) AS reagent_product, min(CAST(a = p AS INT)) AS same_sides FROM c GROUP BY rxn_id"""),
    "assign_left_roles": with_sql(["gt_components"], _LEFT + " SELECT rxn_id, comp, role, count(*) AS n, min(pos) AS first_pos FROM asg GROUP BY ALL"),
    "unmatched_labels": with_sql(["gt_components"], _LEFT + " SELECT rxn_id, CAST(sum(n) AS BIGINT) AS unmatched FROM (SELECT rxn_id, 1 AS n FROM lb WHERE role <> 'products' UNION ALL SELECT rxn_id, CASE WHEN role = 'unknown' THEN 1 ELSE -1 END FROM asg) GROUP BY rxn_id"),
    "map_audit": with_sql(["atoms"], _MAPS + " SELECT * FROM ma"),
    "bond_changes": with_sql(["bonds"], """, g AS (SELECT rxn_id, least(a, b) AS x, greatest(a, b) AS y, max(CASE WHEN side = 'input' THEN bond_order END) AS i, max(CASE WHEN side = 'product' THEN bond_order END) AS p FROM bonds GROUP BY ALL),
      h AS (SELECT rxn_id, count(*) FILTER (i IS NULL) AS formed, count(*) FILTER (p IS NULL) AS broken, count(*) FILTER (i <> p) AS changed FROM g GROUP BY rxn_id)
      SELECT *, formed + broken + changed AS centre, CASE WHEN formed + broken + changed = 0 THEN 'none' WHEN formed + broken + changed > 8 THEN 'large' ELSE 'normal' END AS centre_class FROM h"""),
}
