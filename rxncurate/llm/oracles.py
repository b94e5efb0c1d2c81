"""DuckDB statements that give the rows of the registered queries, written without their operators."""

from __future__ import annotations

import hashlib

ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
WITH d AS (SELECT doc_id, {ASCII_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), text, '')) AS mix_key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
l AS (SELECT *, 3.0::DOUBLE * source_size / weight AS limit_level FROM w),
p AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
             CAST(coalesce(sum(source_size * 3) OVER (ORDER BY limit_level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS full_before,
             CAST(sum(weight) OVER (ORDER BY limit_level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weight_left
      FROM l),
v AS (SELECT *, CAST(total - full_before AS DOUBLE) / weight_left AS level FROM p),
f AS (SELECT arg_min(level, limit_level) AS level FROM v WHERE level <= limit_level),
t AS (SELECT l.source, l.source_size, coalesce(least(l.source_size * 3.0::DOUBLE, f.level * l.weight), l.source_size * 3.0::DOUBLE) AS target FROM l CROSS JOIN f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (
  SELECT d.*, e.source_size, e.target, e.epochs,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY mix_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
c AS (SELECT *, max(CASE WHEN size > 0 AND start + size / 2 <= target - epochs * source_size THEN mix_key END) OVER (PARTITION BY source) AS last_key FROM r)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN size * (epochs + CASE WHEN mix_key <= last_key THEN 1 ELSE 0 END) ELSE 0 END AS taken
FROM c
"""


def _slots(names: list[str], size: int) -> list[str]:
    """Who owns each slot, with each shard's whole order of preference written out, shard after shard."""
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    order = [[(number(f"offset:{n}") + j * (number(f"skip:{n}") % (size - 1) + 1)) % size for j in range(size)] for n in names]
    owner: dict[int, str] = {}
    at = [0] * len(names)
    while len(owner) < size:
        for k, n in enumerate(names):
            while at[k] < size and order[k][at[k]] in owner:
                at[k] += 1
            if at[k] < size:
                owner[order[k][at[k]]] = n
    return [owner[i] for i in range(size)]


def sharding_sql(names: list[str], size: int) -> str:
    owners = ",".join(str(names.index(n)) for n in _slots(names, size))
    labels = ",".join(f"'{n}'" for n in names)
    return f"""
WITH k AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {size} AS INT) AS slot FROM documents),
o AS (SELECT [{owners}] AS owners, [{labels}] AS labels)
SELECT doc_id, slot, labels[owners[slot + 1] + 1] AS shard FROM k CROSS JOIN o
"""


OP11 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) AS docs, coalesce(CAST(sum(len(t)) AS BIGINT), 0) AS length FROM d WHERE len(t) > 0),
o AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM o GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf CROSS JOIN s GROUP BY term, docs),
b AS (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item, item_id, term, count(*) AS repeats FROM b GROUP BY ALL),
m AS (
  SELECT item, item_id, r, doc_id,
         CAST(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) CROSS JOIN s GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INT) AS rank FROM m WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""

OP12 = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({ASCII_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
e AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
x AS (SELECT lang, w, i, k FROM e, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, w[i:i + k - 1] AS g, count(*) AS f FROM x GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1),
h AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM c WHERE len(g) > 2),
b AS (SELECT lang, g, a, k, unnest(range(1, len(g) - k + 2)) AS i FROM (SELECT * FROM h WHERE k > 1)),
y AS (SELECT lang, g[i:i + k - 1] AS g, max(a) AS longer FROM b GROUP BY ALL),
v AS (SELECT c.* FROM c LEFT JOIN y USING (lang, g) WHERE longer IS NULL OR 100 * longer < 100 * a),
u AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM v),
z AS (
  SELECT u.lang, u.g, u.a, u.k, l.f AS l, r.f AS r, t.n, CAST((1000::HUGEINT * u.a * t.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM u JOIN t USING (lang) JOIN f l ON l.lang = u.lang AND l.g = u.g[1:u.k] JOIN f r ON r.lang = u.lang AND r.g = u.g[u.k + 1:len(u.g)]),
o AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
q AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM o),
s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q)
SELECT lang, rank, phrase, a, l, r, n, score FROM s WHERE rank <= 2000
"""


ORACLE = {
    "op3_exact_dedup": OP3,
    "op8_source_mixing": OP8,
    "op11_dual_tree_search": OP11,
    "op12_phrase_automata": OP12,
    "op10_lookup_sharding": sharding_sql([f"shard-{k:03d}" for k in range(64)], 65_537),
}
