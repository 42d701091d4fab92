"""Registered queries given as texts of the four languages that ``dialects.running`` runs."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.core_queries import query, table
from vigilframe.dialects import gates
from vigilframe.dialects.running import Tables, run

TEXTS = {
    "run_search": ("splunk", 'index=main event_type=purchase OR event_type=err* value>5 | eval big=if(value > 50, 1, 0) | stats count as n, sum(big) as large, dc(user_id) as users by event_type | where n > 10 | sort - n | head 5'),
    "run_search_texts": ("splunk", r'index=customer c_mktsegment!="machinery" | rex field=c_name "(?<kind>[A-Za-z]+)#0*(?<number>\d+)" | rename c_nationkey as nation | fields - c_acctbal | dedup nation sortby -c_custkey | table nation kind number'),
    "run_search_timechart": ("splunk", "index=main | timechart span=1d count as n, dc(user_id) as users by event_type | search users>20"),
    "run_search_top": ("splunk", "index=main value>10 | top limit=3 event_type"),
    "run_search_lookup": ("splunk", "index=customer | lookup nations c_nationkey OUTPUT n_name | fillnull value=none n_name | stats count as n by n_name"),
    "run_esql": ("esql", 'FROM events | WHERE event_type IN ("purchase", "error") AND value > 20 | EVAL half = value / 2 | STATS n = COUNT(*), users = COUNT_DISTINCT(user_id), most = MAX(half) BY event_type | RENAME n AS total | SORT total DESC | LIMIT 5 | KEEP event_type, total, users, most'),
    "run_esql_dissect": ("esql", 'FROM customer | WHERE c_mktsegment LIKE "*U*" | DISSECT c_name "%{kind}#%{number}" | GROK c_name "%{WORD:first}#%{INT:digits}" | KEEP c_custkey, kind, number, first, digits'),
    "run_esql_enrich": ("esql", 'FROM customer | ENRICH nations ON c_nationkey WITH n_name | DROP c_acctbal | STATS n = COUNT(*), segments = VALUES(c_mktsegment) BY n_name | MV_EXPAND segments'),
    "run_kusto": ("kusto", 'let least = 20; events | where event_type == "purchase" and value between (least .. 80) | extend half = value / 2 | summarize n = count(), users = dcount(user_id) by event_type, bin(ts, 1d) | where n > 1 | project-rename day = ts | order by n desc, day asc'),
    "run_kusto_join": ("kusto", 'orders | join kind=inner (customer | where c_mktsegment has "building" or c_mktsegment startswith "auto" | project o_custkey = c_custkey, segment = c_mktsegment) on o_custkey | summarize n = count() by segment, o_orderpriority | top 4 by n desc, segment asc, o_orderpriority asc'),
    "run_kusto_parse": ("kusto", 'customer | parse c_name with kind "#" number | project c_custkey, kind, number, upper = toupper(c_mktsegment) | union (nation | project c_custkey = n_nationkey, kind = n_name) | project-away upper | distinct *'),
    "run_eql": ("eql", 'any where event_type : "Purchase" and value > 30 and not user_id in (1, 2, 3) | stats n = count(), most = max(value) by user_id | where n >= 2 | sort n desc, user_id | head 15'),
    "run_eql_sequence": ("eql", 'sequence by user_id with maxspan=1d [any where event_type == "error"] [any where event_type == "purchase" and value > 10] until [any where event_type == "signup"]'),
    "run_eql_sample": ("eql", 'sample by user_id [any where event_type == "error" and value > 90] [any where event_type == "purchase" and value > 90]'),
    "run_aql": ("aql", "SELECT user_id, COUNT(*) AS n FROM events WHERE event_type ILIKE 'PURCH%' AND value BETWEEN 20 AND 80 GROUP BY user_id HAVING n >= 2 ORDER BY n DESC, user_id LIMIT 20 LAST 10 DAYS"),
    "run_aql_span": ("aql", "SELECT DATEFORMAT(ts, 'yyyy-MM-dd') AS day, UNIQUECOUNT(user_id) AS users FROM events WHERE value > 5 GROUP BY DATEFORMAT(ts, 'yyyy-MM-dd') START '2024-01-03 00:00:00' STOP '2024-01-12 12:00:00'"),
}

SQL = {
    "run_search": "SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS large, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'purchase' OR (event_type ILIKE 'err%' AND value > 5) GROUP BY 1 HAVING n > 10 ORDER BY n DESC LIMIT 5",
    "run_search_texts": r"SELECT c_nationkey AS nation, regexp_extract(c_name, '([A-Za-z]+)#0*(\d+)', 1) AS kind, regexp_extract(c_name, '([A-Za-z]+)#0*(\d+)', 2) AS number FROM customer WHERE lower(c_mktsegment) <> 'machinery' QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) = 1",
    "run_search_timechart": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS ts, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL HAVING users > 20",
    "run_search_top": "SELECT event_type, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM events WHERE value > 10), 6) AS percent FROM events WHERE value > 10 GROUP BY 1 ORDER BY count DESC, event_type LIMIT 3",
    "run_search_lookup": "SELECT coalesce(n_name, 'none') AS n_name, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "run_esql": "SELECT event_type, count(*) AS total, count(DISTINCT user_id) AS users, max(value / 2) AS most FROM events WHERE event_type IN ('purchase', 'error') AND value > 20 GROUP BY 1 ORDER BY total DESC LIMIT 5",
    "run_esql_dissect": r"SELECT c_custkey, split_part(c_name, '#', 1) AS kind, split_part(c_name, '#', 2) AS number, regexp_extract(c_name, '(\w+)#(-?\d+)', 1) AS first, regexp_extract(c_name, '(\w+)#(-?\d+)', 2) AS digits FROM customer WHERE c_mktsegment ILIKE '%U%'",
    "run_esql_enrich": "SELECT n_name, n, unnest(segments) AS segments FROM (SELECT n_name, count(*) AS n, list_sort(list_distinct(list(c_mktsegment))) AS segments FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)",
    "run_kusto": "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'purchase' AND value BETWEEN 20 AND 80 GROUP BY ALL HAVING n > 1",
    "run_kusto_join": "SELECT c_mktsegment AS segment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE regexp_matches(c_mktsegment, '(?i)\\bbuilding\\b') OR lower(c_mktsegment) LIKE 'auto%' GROUP BY ALL ORDER BY n DESC, segment, o_orderpriority LIMIT 4",
    "run_kusto_parse": "SELECT DISTINCT * FROM (SELECT CAST(c_custkey AS BIGINT) AS c_custkey, split_part(c_name, '#', 1) AS kind, split_part(c_name, '#', 2) AS number FROM customer UNION ALL SELECT n_nationkey, n_name, NULL FROM nation)",
    "run_eql": "SELECT user_id, count(*) AS n, max(value) AS most FROM events WHERE event_type = 'purchase' AND value > 30 AND user_id NOT IN (1, 2, 3) GROUP BY 1 HAVING n >= 2 ORDER BY n DESC, user_id LIMIT 15",
    "run_eql_sequence": "SELECT a.user_id AS key, a.ts AS step_1_time, b.ts AS step_2_time FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 DAY WHERE a.event_type = 'error' AND b.event_type = 'purchase' AND b.value > 10 AND NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = a.user_id AND s.event_type = 'signup' AND s.ts > a.ts AND s.ts < b.ts)",
    "run_eql_sample": "SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 90 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)",
    "run_aql": "SELECT user_id, count(*) AS n FROM events WHERE event_type ILIKE 'purch%' AND value BETWEEN 20 AND 80 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY 1 HAVING n >= 2 ORDER BY n DESC, user_id LIMIT 20",
    "run_aql_span": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS users FROM events WHERE value > 5 AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-12 12:00:00' GROUP BY 1",
}


def tables(spark: SparkSession, d: str) -> Tables:
    named = {n: table(spark, d, n) for n in ("events", "customer", "orders", "nation")}
    nations = named["nation"].withColumnRenamed("n_nationkey", "c_nationkey").select("c_nationkey", "n_name")
    return Tables(named | {"main": named["events"], "*": named["events"]}, {"nations": nations}, time="ts")


def _register(name: str) -> None:
    language, text = TEXTS[name]

    @query(name, SQL[name])
    def _(spark: SparkSession, d: str) -> DataFrame:
        return run(text, tables(spark, d), language)


for _name in TEXTS:
    _register(_name)


def _heads(q: str) -> str:
    return f"list_transform(string_split(lower({q}), '|')[2:], lambda s: regexp_extract(s, '^\\s*(\\S+)', 1))"


def _words(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _strange(words: list[str], blank: bool) -> str:
    return f"len(list_filter({_heads('q')}, lambda h: NOT list_contains({_words(words)}, h){' AND h <> ' + repr('') if blank else ''})) > 0"


_AQL_SQL = [("missing_keyword", "NOT starts_with(upper(q), 'SELECT')"), ("missing_keyword", "NOT (contains(upper(q), 'FROM EVENTS') OR contains(upper(q), 'FROM FLOWS') OR contains(upper(q), 'FROM ASSETS'))"), ("missing_aggregate", "contains(upper(q), 'GROUP BY') AND NOT regexp_matches(upper(q), '(COUNT|SUM|AVG|MIN|MAX)\\(')")]
_WORD = "regexp_extract(lower(q), '^(\\S+)', 1)"
_NO_KIND = f"NOT list_contains({_words([*gates.CATEGORIES, 'sequence'])}, {_WORD}) AND NOT contains(q, ':') AND q <> '*'"
_SEQUENCE = ("malformed_syntax", f"{_WORD} = 'sequence' AND NOT (contains(q, '[') AND contains(q, ']'))")
GATE_SQL = {
    "splunk": [("missing_keyword", "NOT regexp_matches(lower(q), '^(index=|search|\\*)')"), ("unknown_command", _strange(gates.GATE_COMMANDS, True))],
    "qradar": [*_AQL_SQL, ("malformed_syntax", "contains(upper(q), 'HAVING') AND NOT contains(upper(q), 'GROUP BY')")],
    "elastic": [("missing_keyword", f"list_contains({_words(gates.CATEGORIES[:-1])}, {_WORD}) AND NOT contains(lower(q), 'where')"), _SEQUENCE, ("malformed_syntax", _NO_KIND + " AND NOT regexp_matches(lower(q), '\\b\\w+\\s*(>|>=|<|<=)\\s*\\d+')")],
    "sentinel": [("malformed_syntax", "NOT contains(q, '|')"), ("unknown_command", _strange(gates.GATE_OPERATORS, True))],
}
OWN_SQL = {
    "splunk": [GATE_SQL["splunk"][0], ("unknown_command", _strange(gates.OWN_COMMANDS, False))],
    "qradar": [_AQL_SQL[0], ("missing_keyword", "NOT (contains(upper(q), 'FROM EVENTS') OR contains(upper(q), 'FROM FLOWS'))"), _AQL_SQL[2]],
    "elastic": [_SEQUENCE, ("missing_keyword", f"list_contains({_words(gates.CATEGORIES)}, {_WORD}) AND NOT contains(lower(q), 'where')"), ("unknown_command", f"list_contains({_words(gates.CATEGORIES)}, {_WORD}) AND {_strange(gates.OWN_PIPES, True)}"), ("malformed_syntax", _NO_KIND + " AND NOT regexp_matches(lower(q), '\\b\\w[\\w.]+\\s*(>=|<=|>|<)\\s*\\d')")],
    "sentinel": [GATE_SQL["sentinel"][0], ("unknown_command", _strange(gates.OWN_OPERATORS, False))],
}
_TRIMMED = "regexp_replace(coalesce({}, ''), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"


def _case(findings: list[tuple[str, str]]) -> str:
    return "CASE WHEN q = '' THEN 'empty_query' " + " ".join(f"WHEN {holds} THEN '{error}'" for error, holds in findings) + " END"


_GATE = "WITH t AS (SELECT record_id, platform, " + _TRIMMED.format("hypothesis") + " AS q FROM ablation) SELECT record_id, CASE platform " + " ".join(f"WHEN '{p}' THEN {_case(f)}" for p, f in GATE_SQL.items()) + " END AS error_type FROM t WHERE platform IN ('splunk', 'qradar', 'elastic', 'sentinel')"
_OWN = "WITH t AS (SELECT record_id, platform, " + _TRIMMED.format("CASE WHEN platform = 'elastic' THEN array_to_string(list_filter(string_split(hypothesis, chr(10)), lambda s: NOT starts_with(ltrim(s), '//')), chr(10)) ELSE hypothesis END") + " AS q FROM ablation) SELECT record_id, CASE platform " + " ".join(f"WHEN '{p}' THEN {_case(f)} IS NULL" for p, f in OWN_SQL.items()) + " END AS valid FROM t WHERE platform IN ('splunk', 'qradar', 'elastic', 'sentinel')"


def _by_platform(spark: SparkSession, d: str, make, platforms=tuple(GATE_SQL)) -> DataFrame:
    rows = table(spark, d, "ablation").select("record_id", "platform", "hypothesis")
    parts = [rows.filter(F.col("platform") == p).select("record_id", make(p)) for p in platforms]
    return functools.reduce(DataFrame.union, parts)


@query("gate_checks", _GATE)
def gate_checks(spark: SparkSession, d: str) -> DataFrame:
    return _by_platform(spark, d, lambda p: gates.gate(p, F.col("hypothesis"))["error_type"].alias("error_type"))


@query("own_checks", _OWN)
def own_checks(spark: SparkSession, d: str) -> DataFrame:
    return _by_platform(spark, d, lambda p: gates.own_check(p, F.col("hypothesis")).alias("valid"))


@query("gate_check_rules")
def gate_check_rules(spark: SparkSession, d: str) -> DataFrame:
    return _by_platform(spark, d, lambda p: gates.gate(p, F.col("hypothesis")).alias("g"), ("wazuh",)).select("record_id", "g.*")
