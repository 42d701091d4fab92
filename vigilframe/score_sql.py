"""DuckDB SQL for the scores of query texts: n-grams, longest common subsequence and edit distance by folding rows of lists, fields by name lists."""

from __future__ import annotations

from vigilframe.functions.scores import CANONICAL, KEYWORDS, KNOWN

_TOKENS = r"regexp_extract_all(replace(replace(replace(replace(regexp_replace(regexp_replace(lower(coalesce({}, '')), '\bcount\s*\(\s*\*?\s*\)', 'count', 'g'), '\bcount\s*\(\s*distinct\b', 'count_distinct', 'g'), '>=', 'gte'), '<=', 'lte'), '!=', 'neq'), '==', 'eq'), '([^\s|=><!()\[\]{{}},;]+|[|=><!()\[\]{{}},;])')"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_KEYWORDS = "CASE platform " + " ".join(f"WHEN '{p}' THEN {_list(w.split())}" for p, w in KEYWORDS.items()) + " ELSE CAST([] AS VARCHAR[]) END"
_NAMES = f"map({_list(CANONICAL)}, {_list(CANONICAL.values())})"
_NONE = "CAST([] AS VARCHAR[])"


def _fields(low: str) -> str:
    known = f"list_intersect(regexp_extract_all({low}, '(\\w+)', 1), {_list(KNOWN)})"
    # letters beyond a to z are part of a word, too: a capital stands for them, as the text has none
    dotted = f"regexp_extract_all(regexp_replace({low}, '[^\\x00-\\x7F]', 'Q', 'g'), '\\b([a-z_][a-z0-9_]*(?:\\.[a-z_][a-z0-9_]*)+)\\b', 1)"
    assigned = f"CASE WHEN platform = 'splunk' THEN regexp_extract_all({low}, '\\b([a-z_][a-z0-9_]*)=', 1) ELSE {_NONE} END"
    selected = f"CASE WHEN platform = 'qradar' THEN list_filter(regexp_split_to_array(regexp_replace(regexp_extract({low}, '(?s)select\\s+(.+?)\\s+from', 1), '\\([^()]*\\)', '', 'g'), '[\\s,]+'), lambda w: w <> '') ELSE {_NONE} END"
    named = f"CASE WHEN platform = 'wazuh' THEN regexp_extract_all({low}, 'name=\"([^\"]+)\"', 1) ELSE {_NONE} END"
    found = f"list_concat({known}, list_filter(list_concat({dotted}, {assigned}, {selected}), lambda w: NOT list_contains(kw, w)), {named})"
    return f"list_filter(list_distinct(list_transform({found}, lambda w: coalesce(map_extract(names, w)[1], w))), lambda w: NOT list_contains(kw, w) AND length(w) > 1)"


SEMANTIC_SCORES = rf"""
WITH p AS (SELECT DISTINCT coalesce(hypothesis, '') AS h, coalesce(reference, '') AS r FROM ablation),
t AS (SELECT h, r, {_TOKENS.format("h")} AS a, {_TOKENS.format("r")} AS b, row_number() OVER () AS k FROM p),
g AS (SELECT k, n, s, g, count(*) AS c FROM (
  SELECT k, n, 0 AS s, unnest(list_transform(generate_series(1, len(a) - n + 1), lambda i: array_to_string(a[i:i + n - 1], chr(1)))) AS g FROM t, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(a) >= n
  UNION ALL SELECT k, n, 1, unnest(list_transform(generate_series(1, len(b) - n + 1), lambda i: array_to_string(b[i:i + n - 1], chr(1)))) FROM t, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(b) >= n) GROUP BY ALL),
m AS (SELECT x.k, x.n, sum(x.c) AS every, sum(least(x.c, coalesce(y.c, 0))) AS shared FROM (SELECT * FROM g WHERE s = 0) x LEFT JOIN (SELECT * FROM g WHERE s = 1) y ON x.k = y.k AND x.n = y.n AND x.g = y.g GROUP BY ALL),
u AS (SELECT k, CASE WHEN min(shared) = 0 THEN NULL ELSE sum(ln(shared / every) / 4) END AS l FROM m GROUP BY 1),
s AS (SELECT t.*, u.l, list_transform(b, lambda w: list_transform(a, lambda x: CAST(x = w AS INT))) AS match FROM t LEFT JOIN u USING (k)),
d AS (SELECT *,
  CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE list_reduce(match, lambda row, hit: list_transform(generate_series(1, len(a)), lambda j: CAST(greatest(row[j], list_max(list_transform(generate_series(1, j), lambda i: CASE WHEN hit[i] = 1 THEN CASE WHEN i = 1 THEN 0 ELSE row[i - 1] END + 1 ELSE 0 END))) AS INT)), list_transform(a, lambda x: 0))[-1] END AS lcs,
  CASE WHEN len(a) = 0 OR len(b) = 0 THEN greatest(len(a), len(b)) ELSE list_reduce(match, lambda row, hit: list_transform(generate_series(0, len(a)), lambda j: CAST(list_min(list_transform(generate_series(0, j), lambda i: CASE WHEN i = 0 THEN row[1] + 1 ELSE least(row[i + 1] + 1, row[i] + 1 - hit[i]) END + j - i)) AS INT)), list_transform(generate_series(0, len(a)), lambda x: CAST(x AS INT)))[-1] END AS dist FROM s),
f0 AS (SELECT record_id, platform, coalesce(hypothesis, '') AS h, coalesce(reference, '') AS r, {_KEYWORDS} AS kw, {_NAMES} AS names FROM ablation),
f1 AS (SELECT record_id, h, r, {_fields('lower(h)')} AS mine, {_fields('lower(r)')} AS theirs FROM f0),
f2 AS (SELECT record_id, h, r, len(theirs) AS k, CASE WHEN len(mine) > 0 THEN len(list_intersect(mine, theirs)) / len(mine) ELSE 0.0 END AS p, CASE WHEN len(theirs) > 0 THEN len(list_intersect(mine, theirs)) / len(theirs) END AS c FROM f1),
f3 AS (SELECT record_id, h, r, CASE WHEN k = 0 THEN 1.0 WHEN p + c > 0 THEN round(2 * p * c / (p + c), 6) ELSE 0.0 END AS field_f1 FROM f2),
z AS (SELECT record_id, field_f1, CASE WHEN len(a) = 0 OR len(b) = 0 OR l IS NULL THEN 0.0 ELSE round(least(1.0, exp(l + least(0.0, 1 - len(b) / len(a)))), 6) END AS bleu,
  CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(2 * lcs / (len(a) + len(b)), 6) END AS rouge_l,
  CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE round(1 - dist / greatest(len(a), len(b)), 6) END AS token_edit_sim
  FROM f3 JOIN d USING (h, r)),
y AS (SELECT *, CAST(least(1, greatest(0, round(0.25 * CAST(bleu AS DECIMAL(9, 6)) + 0.15 * CAST(rouge_l AS DECIMAL(9, 6)) + 0.50 * CAST(field_f1 AS DECIMAL(9, 6)) + 0.10 * CAST(token_edit_sim AS DECIMAL(9, 6)), 6))) AS DOUBLE) AS semantic_score FROM z)
SELECT *, CASE WHEN semantic_score >= 0.85 THEN 'EXCELLENT' WHEN semantic_score >= 0.70 THEN 'GOOD' WHEN semantic_score >= 0.50 THEN 'PARTIAL' WHEN semantic_score >= 0.25 THEN 'POOR' ELSE 'FAIL' END AS grade FROM y
"""
