"""DuckDB SQL for those queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(nl_query, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"

P2_FOUND = rf"""
WITH e AS (SELECT ex_id, nullif(regexp_extract(upper(technique_id), '^\s*(T\d{{4}})(?:\D|$)', 1), '') AS f, array_to_string({_WORDS}, ' ') AS q FROM examples)
SELECT a.ex_id AS ex_id_a, b.ex_id AS ex_id_b FROM e a JOIN e b ON a.q = b.q AND a.ex_id < b.ex_id AND a.f <> b.f WHERE a.q <> ''
"""

_LONG = "(SELECT entry_id, 'description' AS field, description AS t FROM technique_entries UNION ALL SELECT entry_id, 'detection', detection FROM technique_entries)"
_END = r"(?:\r\n|\r|\n)"
_MOST = "list_max(list_transform({}, lambda s: length(s)))"
P3_FOUND = rf"""
WITH l AS (SELECT entry_id, field, t FROM {_LONG} WHERE length(t) > 1500),
p AS (SELECT *, regexp_split_to_array(t, '{_END}[ \t]*(?:{_END}[ \t]*)+') AS p FROM l),
s AS (SELECT *, flatten(list_transform(p, lambda x: string_split(regexp_replace(x, '([.!?])[ \t\r\n]+', e'\\1\x01', 'g'), e'\x01'))) AS s FROM p),
w AS (SELECT *, flatten(list_transform(s, lambda x: regexp_split_to_array(x, '[ \t\r\n]+'))) AS w FROM s)
SELECT entry_id, field, CASE WHEN {_MOST.format('p')} <= 1500 THEN 'paragraph' WHEN {_MOST.format('s')} <= 1500 THEN 'sentence' WHEN {_MOST.format('w')} <= 1500 THEN 'word' ELSE 'none' END AS boundary FROM w
"""

P5_FOUND = r"""
WITH k AS (SELECT regexp_replace(upper(x), '[^0-9A-Z]', '', 'g') AS k, replace(shortname, '-', '_') AS v FROM (SELECT unnest([tactic_id, name, shortname]) AS x, shortname FROM tactics)),
j0 AS (SELECT ex_id, tactic, complexity, trim(ir, e' \t\r\n\ufeff') AS t FROM examples),
j1 AS (SELECT *, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) = 'VARCHAR' THEN trim(t ->> '$', e' \t\r\n\ufeff') ELSE t END END AS u FROM j0),
j2 AS (SELECT *, CASE WHEN json_valid(u) THEN CASE WHEN json_type(u) = 'VARCHAR' THEN trim(u ->> '$', e' \t\r\n\ufeff') ELSE u END END AS d FROM j1),
j3 AS (SELECT *, CASE WHEN json_valid(d) AND json_type(d) = 'OBJECT' THEN list_filter(json_keys(d), lambda x: lower(replace(x, '_', '')) = 'action')[1] END AS key FROM j2),
e AS (SELECT ex_id, (SELECT min(v) FROM k WHERE k.k = regexp_replace(upper(tactic), '[^0-9A-Z]', '', 'g')) AS tactic, lower(trim(complexity, e' \t\r\n')) AS complexity,
  CASE WHEN key IS NOT NULL AND json_type(d, '$."' || key || '"') = 'VARCHAR' THEN regexp_replace(lower(json_extract_string(d, '$."' || key || '"')), '\s+', '', 'g') END AS action FROM j3),
n AS (SELECT 'tactic' AS dim, tactic AS category, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'complexity', complexity, count(*) FROM e GROUP BY ALL UNION ALL SELECT 'action', action, count(*) FROM e GROUP BY ALL)
SELECT t.dim, t.category FROM sample_targets t LEFT JOIN n USING (dim, category) WHERE coalesce(n, 0) < min_rows OR coalesce(n, 0) < target_share * (SELECT count(*) // 5 FROM examples)
"""

#: Every pair that reaches the threshold shares one of the rarer words of both (prefix filter), so nothing is left out.
P7_FOUND = rf"""
WITH d AS (SELECT ex_id, list_distinct({_WORDS}) AS w FROM examples),
u AS (SELECT ex_id, len(w) AS n, unnest(w) AS t FROM d WHERE len(w) > 0),
f AS (SELECT t, count(*) AS df FROM u GROUP BY 1),
r AS (SELECT ex_id, n, t, row_number() OVER (PARTITION BY ex_id ORDER BY df, t) AS pos FROM u JOIN f USING (t)),
p AS (SELECT ex_id, n, t FROM r WHERE pos <= n - CAST(ceil(0.6 * n - 1e-9) AS INT) + 1),
c AS (SELECT DISTINCT a.ex_id AS a, b.ex_id AS b FROM p a JOIN p b ON a.t = b.t AND a.ex_id < b.ex_id AND a.n >= 0.6 * b.n - 1e-9 AND b.n >= 0.6 * a.n - 1e-9)
SELECT a AS ex_id_a, b AS ex_id_b FROM c JOIN d x ON x.ex_id = a JOIN d y ON y.ex_id = b WHERE len(list_intersect(x.w, y.w)) >= 0.6 * (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) - 1e-9
"""
