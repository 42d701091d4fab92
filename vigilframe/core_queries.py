"""Registered queries of the core operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.durable import spread
from vigilframe.score_sql import SEMANTIC_SCORES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.shred import shred

    return shred(table(spark, d, "examples"), "ex_id", "ir")


@query("p1_conditions")
def p1_conditions(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.shred import node_table, shred

    nodes = shred(table(spark, d, "examples"), "ex_id", "ir", values=True)
    return node_table(nodes, "condition", {"field": "string", "op": "string", "value": "string", "negate": "boolean"})


# Detection queries: a document, compiled and run on the events; SQL says what it must give.


def _source(spark: SparkSession, d: str):
    from vigilframe.plans.compile import Source
    from vigilframe.plans.fields import Binding

    events = table(spark, d, "events")
    binding = Binding({"user": "user_id", "category": "event_type", "bytes_out": "value", "_time": "ts", "timestamp": "ts"})
    return Source({"any": events}, binding=binding, time_column="ts")


def _detect(name: str, document: dict, sql: str, rounded: str | None = None, **options) -> None:
    from vigilframe.plans.compile import Options, compile_query
    from vigilframe.plans.query import parse

    def run(spark: SparkSession, d: str) -> DataFrame:
        look = {"customers": (table(spark, d, "customer"), "c_custkey"), "buildings": (table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'"), "c_custkey")}
        df = compile_query(parse(document), _source(spark, d), look, Options(**options))
        return df.withColumn(rounded, F.round(rounded, 4)) if rounded else df

    query(name, sql)(run)


def _leaf(field: str, op: str, value, **more) -> dict:
    return {"field": field, "op": op, "value": value, **more}


def _filter(*conditions: dict, operator: str = "and") -> dict:
    return {"operator": operator, "conditions": list(conditions)}


_SHOWN = ["event_id", "user_id", "event_type", "value"]
_COLUMNS = "event_id, user_id, event_type, value"


def _where(name: str, condition: str, *leaves: dict, operator: str = "and", **options) -> None:
    _detect(name, {"action": "filter", "filter": _filter(*leaves, operator=operator), "fields": _SHOWN}, f"SELECT {_COLUMNS} FROM events WHERE {condition}", **options)


_where("filter_eq", "event_type = 'error'", _leaf("category", "eq", "error"))
_where("filter_eq_ci", "lower(event_type) = 'error'", _leaf("category", "eq", "ERROR"), ci_equality=True)
_where("filter_neq", "event_type <> 'error'", _leaf("category", "neq", "error"))
_where("filter_range", "value >= 10 AND value < 20.5 AND event_id > 100 AND event_id <= 9000", _leaf("bytes_out", "gte", 10), _leaf("bytes_out", "lt", 20.5), _leaf("event_id", "gt", 100), _leaf("event_id", "lte", 9000))
_where("filter_in", "event_type IN ('error', 'click')", _leaf("category", "in", ["error", "click"]))
_where("filter_in_scalar", "event_type = 'error'", _leaf("category", "in", "error"))
_where("filter_not_in", "event_type NOT IN ('error', 'click')", _leaf("category", "not_in", ["error", "click"]))
_where("filter_contains", "contains(lower(event_type), 'ur')", _leaf("category", "contains", "UR"))
_where("filter_contains_literal", "contains(lower(props), '\"k\": 3')", _leaf("props", "contains", '"K": 3'))
_where("filter_term", "regexp_matches(props, '(?i)\\bk\\b')", _leaf("props", "contains", "k"), contains="term")
_where("filter_regex", "regexp_matches(event_type, '^(si|er)')", _leaf("category", "regex", "^(si|er)"))
_where("filter_negate", "NOT (event_type = 'error') AND NOT (value > 50)", _leaf("category", "eq", "error", negate=True), _leaf("bytes_out", "gt", 50, negate=True))
_where("filter_or", "event_type = 'error' OR value > 150", _leaf("category", "eq", "error"), _leaf("bytes_out", "gt", 150), operator="or")
_where("filter_nested", "event_type = 'error' AND (value > 100 OR (user_id < 10 AND value < 5))", _leaf("category", "eq", "error"), _filter(_leaf("bytes_out", "gt", 100), _filter(_leaf("user", "lt", 10), _leaf("bytes_out", "lt", 5)), operator="or"))
_where("filter_not_group", "NOT (event_type = 'error' AND value > 10)", _leaf("category", "eq", "error"), _leaf("bytes_out", "gt", 10), operator="not")
_where("filter_exists", "props IS NOT NULL", _leaf("props", "neq", None), _leaf("props", "eq", "*"))
_where("filter_empty_group", "true")
_detect("time_window", {"action": "filter", "time_window": {"duration": "24h"}, "fields": _SHOWN}, f"SELECT {_COLUMNS} FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
_detect("project_order", {"action": "filter", "fields": ["value", "event_id", "value", "nothing"]}, "SELECT value, event_id FROM events")
_detect("sort_limit", {"action": "filter", "filter": _filter(_leaf("category", "eq", "purchase")), "sort_by": "event_id", "sort_order": "asc", "limit": 50, "fields": _SHOWN}, f"SELECT {_COLUMNS} FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 50")
for _name, _function, _expression in (("count", "count", "count(*)"), ("sum", "sum", "round(sum(value), 4)"), ("avg", "avg", "round(avg(value), 4)"), ("min", "min", "min(value)"), ("max", "max", "max(value)"), ("distinct", "distinct_count", "count(DISTINCT value)")):
    _detect(f"aggregate_{_name}", {"action": "aggregate", "aggregation": {"function": _function, "field": "bytes_out", "group_by": ["user"], "alias": "measure"}}, f"SELECT user_id AS \"user\", {_expression} AS measure FROM events GROUP BY user_id", rounded="measure" if _name in ("sum", "avg") else None)
_detect("aggregate_global", {"action": "aggregate", "aggregation": {"function": "count"}}, "SELECT count(*) AS count FROM events")
_detect("aggregate_two_keys", {"action": "filter+aggregate", "filter": _filter(_leaf("bytes_out", "gt", 20)), "aggregation": {"function": "count", "group_by": ["user", "category"], "alias": "n"}, "threshold": "> 3"}, "SELECT user_id AS \"user\", event_type AS category, count(*) AS n FROM events WHERE value > 20 GROUP BY ALL HAVING count(*) > 3")
_detect("brute_force", {"action": "filter+aggregate", "filter": _filter(_leaf("category", "eq", "error")), "time_window": {"duration": "14d"}, "aggregation": {"function": "count", "group_by": ["user"], "alias": "attempt_count"}, "threshold": {"field": "count", "op": "gte", "value": 4}}, "SELECT user_id AS \"user\", count(*) AS attempt_count FROM events WHERE event_type = 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY GROUP BY 1 HAVING count(*) >= 4")
_detect("spraying", {"action": "aggregate", "aggregation": {"function": "distinct_count", "field": "user", "group_by": ["category"], "alias": "unique_targets"}, "threshold": 20}, "SELECT event_type AS category, count(DISTINCT user_id) AS unique_targets FROM events GROUP BY 1 HAVING count(DISTINCT user_id) > 20")
_detect("large_transfer", {"action": "aggregate", "aggregation": {"function": "sum", "field": "bytes_out", "group_by": ["user", "category"], "alias": "total_bytes"}, "threshold": 500}, "SELECT user_id AS \"user\", event_type AS category, round(sum(value), 4) AS total_bytes FROM events GROUP BY ALL HAVING sum(value) > 500", rounded="total_bytes")
_look = {"lookup_table": "buildings", "match_field": "user"}
_detect("lookup_semi", {"action": "lookup", "lookup": _look, "fields": _SHOWN}, f"SELECT {_COLUMNS} FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
_detect("lookup_inner", {"action": "lookup", "lookup": {**_look, "output_field": "c_name"}, "fields": [*_SHOWN, "c_name"]}, f"SELECT {_COLUMNS}, c_name FROM events JOIN customer ON user_id = c_custkey WHERE c_mktsegment = 'BUILDING'")
_detect("lookup_enrich", {"action": "lookup", "lookup": {**_look, "output_field": "c_name", "filter_on_match": False}, "fields": [*_SHOWN, "c_name"]}, f"SELECT {_COLUMNS}, c_name FROM events LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON user_id = c_custkey")
_detect("lookup_then_count", {"action": "filter+aggregate", "filter": _filter(_leaf("category", "eq", "error")), "lookup": _look, "aggregation": {"function": "count", "group_by": ["user"], "alias": "n"}}, "SELECT user_id AS \"user\", count(*) AS n FROM events WHERE event_type = 'error' AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
_steps = [{"filter": _filter(_leaf("category", "eq", "error"), _leaf("user", "gt", 0))}, {"filter": _filter(_leaf("category", "eq", "purchase")), "within": "6h"}]
_detect("sequence_two", {"action": "sequence", "sequence": _steps}, "SELECT a.user_id AS key, a.ts AS step_1_time, b.ts AS step_2_time FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'error' AND b.event_type = 'purchase'")
_detect("sequence_three", {"action": "sequence", "sequence": [*_steps, {"filter": _filter(_leaf("category", "eq", "click")), "within": "12h"}]}, "SELECT a.user_id AS key, a.ts AS step_1_time, b.ts AS step_2_time, c.ts AS step_3_time FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR JOIN events c ON c.user_id = b.user_id AND c.ts > b.ts AND c.ts <= b.ts + INTERVAL 12 HOUR WHERE a.event_type = 'error' AND b.event_type = 'purchase' AND c.event_type = 'click'")
_detect("sequence_previous", {"action": "sequence", "sequence": [{"filter": _filter(_leaf("category", "eq", "view"), _leaf("user", "gt", 0))}, {"filter": _filter(_leaf("category", "eq", "view"), _leaf("bytes_out", "gt", "$prev.bytes_out")), "within": "2h"}]}, "SELECT a.user_id AS key, a.ts AS step_1_time, b.ts AS step_2_time FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR WHERE a.event_type = 'view' AND b.event_type = 'view' AND b.value > a.value")


# Windowed operators


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


@query("frequency_rule", "SELECT event_id, user_id, in_span FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS in_span FROM events WHERE event_type = 'error') WHERE in_span >= 2")
def frequency_rule(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.windows import frequency

    return frequency(_events(spark, d).filter("event_type = 'error'"), ["user_id"], "ts", 6 * 3600, 2).select("event_id", "user_id", "in_span")


@query("transactions", "WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS INT) AS session FROM m) SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM n GROUP BY ALL")
def transactions(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.windows import sessions

    return sessions(_events(spark, d), ["user_id"], "ts", 1800)


@query("transactions_unkeyed", "WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) > INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS new FROM events), n AS (SELECT *, CAST(sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS INT) AS session FROM m) SELECT session, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM n GROUP BY ALL")
def transactions_unkeyed(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.windows import sessions

    return sessions(_events(spark, d), [], "ts", 600)


@query("eventstats", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS per_user, max(value) OVER (PARTITION BY user_id) AS most FROM events")
def eventstats_(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.windows import eventstats

    return eventstats(_events(spark, d).select("event_id", "user_id", "value"), ["user_id"], per_user=F.count(F.lit(1)), most=F.max("value")).select("event_id", "user_id", "per_user", "most")


@query("streamstats", "SELECT event_id, count(*) OVER w AS so_far, max(value) OVER w AS most FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def streamstats_(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.windows import streamstats

    return streamstats(_events(spark, d), ["user_id"], ["ts", "event_id"], so_far=("count", F.lit(1)), most=("max", F.col("value"))).select("event_id", "so_far", "most")


@query("timechart", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def timechart_(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.windows import timechart

    return timechart(_events(spark, d), "ts", "1 hour", ["event_type"], n=F.count(F.lit(1)))


@query("make_series", "WITH axis AS (SELECT event_type, unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-05 23:00:00', INTERVAL 1 HOUR)) AS bucket FROM (SELECT DISTINCT event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06')) SELECT a.event_type, a.bucket, count(e.event_id) AS n FROM axis a LEFT JOIN events e ON e.event_type = a.event_type AND date_trunc('hour', e.ts) = a.bucket GROUP BY ALL")
def make_series_(spark: SparkSession, d: str) -> DataFrame:
    import datetime as dt

    from vigilframe.operators.windows import make_series

    return make_series(_events(spark, d), "ts", 3600, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6), ["event_type"]).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("risk_score", "SELECT user_id, CAST(sum(CASE event_type WHEN 'error' THEN 20 WHEN 'signup' THEN 5 ELSE 1 END) AS BIGINT) AS risk FROM events GROUP BY 1 HAVING risk >= 100")
def risk_score(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.windows import risk

    return risk(_events(spark, d), "user_id", F.when(F.col("event_type") == "error", 20).when(F.col("event_type") == "signup", 5).otherwise(1), 100)


# Commands of search languages


@query("dedup_first", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.commands import dedup

    return dedup(_events(spark, d), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "event_type")


@query("top_values", "SELECT user_id, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM events), 6) AS percent FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_values(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.commands import top

    return top(_events(spark, d), ["user_id"])


@query("rare_values", "SELECT user_id, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM events), 6) AS percent FROM events GROUP BY 1 ORDER BY 2, 1 LIMIT 10")
def rare_values(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.commands import top

    return top(_events(spark, d), ["user_id"], rare=True)


@query("tail_rows", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def tail_rows(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.commands import tail

    return tail(_events(spark, d), ["ts", "event_id"], 20).select("event_id")


@query("fillnull", "SELECT entry_id, coalesce(description, '-') AS description, coalesce(parent_id, '-') AS parent_id FROM technique_entries")
def fillnull_(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.commands import fillnull

    return fillnull(table(spark, d, "technique_entries").select("entry_id", "description", "parent_id"), "-")


@query("filldown", "SELECT record_id, last_value(bleu IGNORE NULLS) OVER (PARTITION BY query_id ORDER BY record_id ROWS UNBOUNDED PRECEDING) AS bleu FROM ablation")
def filldown_(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.commands import filldown

    return filldown(table(spark, d, "ablation").select("record_id", "query_id", "bleu"), ["query_id"], ["record_id"], ["bleu"]).select("record_id", "bleu")


@query("chart_pivot", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error FROM events WHERE event_type IN ('click', 'error') GROUP BY 1")
def chart_pivot(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.commands import chart

    return chart(_events(spark, d).filter("event_type in ('click', 'error')"), "user_id", "event_type", ["click", "error"], F.count(F.lit(1))).fillna(0)


@query("mv_expand", "SELECT entry_id, unnest(platforms) AS platforms FROM technique_entries")
def mv_expand_(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.commands import mv_expand

    return mv_expand(table(spark, d, "technique_entries").select("entry_id", "platforms"), "platforms")


@query("foreach_columns", "SELECT l_orderkey, l_linenumber, upper(l_returnflag) || '!' AS l_returnflag, upper(l_linestatus) || '!' AS l_linestatus FROM lineitem")
def foreach_columns(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.commands import foreach

    return foreach(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), ["l_returnflag", "l_linestatus"], lambda c: F.concat(F.upper(c), F.lit("!")))


@query("rex_extract", "SELECT event_id, CASE WHEN regexp_matches(props, '\"(\\w+)\":\\s*(\\d+)') THEN regexp_extract(props, '\"(\\w+)\":\\s*(\\d+)', 1) END AS name, CASE WHEN regexp_matches(props, '\"(\\w+)\":\\s*(\\d+)') THEN regexp_extract(props, '\"(\\w+)\":\\s*(\\d+)', 2) END AS number FROM events")
def rex_extract(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.commands import extract

    return extract(_events(spark, d), "props", r'"(\w+)":\s*(\d+)', ["name", "number"]).select("event_id", "name", "number")


@query("append_rows", "SELECT n_name AS name, n_nationkey, NULL AS r_regionkey FROM nation UNION ALL SELECT r_name, NULL, r_regionkey FROM region")
def append_rows(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.commands import append

    return append(table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_nationkey"), table(spark, d, "region").select(F.col("r_name").alias("name"), "r_regionkey"))


@query("appendcols", "SELECT a.n_name, b.r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS n FROM nation) a LEFT JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS n FROM region) b USING (n)")
def appendcols_(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.commands import appendcols

    return appendcols(table(spark, d, "nation").select("n_nationkey", "n_name"), table(spark, d, "region").select("r_regionkey", "r_name"), ["n_nationkey"], ["r_regionkey"]).select("n_name", "r_name")


@query("sample_unordered", "SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def sample_unordered(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.commands import sample_sequence

    e = _events(spark, d)
    return sample_sequence([e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'")], "user_id")


@query("sequence_until", "SELECT a.user_id AS key, a.ts AS step_1_time, b.ts AS step_2_time FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 DAY WHERE a.event_type = 'error' AND b.event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = a.user_id AND s.event_type = 'signup' AND s.ts > a.ts AND s.ts < b.ts)")
def sequence_until_(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.commands import sequence_until
    from vigilframe.plans.compile import Options, sequence
    from vigilframe.plans.fields import Binding

    e = _events(spark, d)
    chains = sequence([(e.filter("event_type = 'error'"), None, None), (e.filter("event_type = 'purchase'"), None, "1d")], "user_id", "ts", Binding(), Options())
    return sequence_until(chains, e.filter("event_type = 'signup'"), "user_id", "ts", "step_1_time", "step_2_time")


@query("cidr_match", "SELECT event_id FROM events WHERE user_id % 256 < 64")
def cidr_match(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.commands import in_cidr

    ip = F.concat(F.lit("10.1.2."), (F.col("user_id") % 256).cast("string"))
    return _events(spark, d).filter(in_cidr(ip, "10.1.2.0/26")).select("event_id")


# Retrieval


@query("vector_top_k", "WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, list_sum(list_transform(generate_series(1, len(embedding)), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE))) AS score FROM embeddings, q WHERE label < 5) SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10")
def vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.vectors import top_k

    v = table(spark, d, "embeddings")
    return top_k(v, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10, where=F.col("label") < 5).select("query_id", "vec_id", "rank")


@query("vector_nearest", "WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, list_sum(list_transform(generate_series(1, len(embedding)), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE))) AS score FROM embeddings, q) SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10")
def vector_nearest(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.vectors import top_k

    v = table(spark, d, "embeddings")
    return top_k(v, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10).select("query_id", "vec_id", "rank")


@query("vector_mmr")
def vector_mmr(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.vectors import mmr

    v = table(spark, d, "embeddings")
    return mmr(v, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 5)


@query("vector_top_k_per_label", "WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, label, vec_id, round(list_sum(list_transform(generate_series(1, len(embedding)), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE))), 9) AS score FROM embeddings, q) SELECT query_id, label, vec_id, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 3")
def vector_top_k_per_label(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.vectors import top_k_per

    v = table(spark, d, "embeddings")
    return top_k_per(v, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 3, "label").select("query_id", "label", "vec_id", "rank")


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^0-9A-Za-z_]+'), lambda w: w <> ''))"


@query("keyword_search", f"WITH s AS (SELECT entry_id, technique_id, CASE WHEN contains(lower(name), 'print queue') THEN 10 ELSE 0 END + 3 * len(list_intersect({_WORDS.format('name')}, ['print', 'queue'])) + len(list_intersect({_WORDS.format('description')}, ['print', 'queue'])) AS score FROM technique_entries) SELECT technique_id, score FROM s WHERE score > 0 ORDER BY score DESC, technique_id NULLS FIRST LIMIT 10")
def keyword_search_(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.functions.text import keyword_search

    return keyword_search(table(spark, d, "technique_entries"), "print queue").select("technique_id", F.col("score").cast("long").alias("score"))


# Texts

_NORMAL = "lower(trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g')))"


@query("text_normal", f"SELECT seed_id, {_NORMAL.format('nl_query')} AS text, substr(sha256({_NORMAL.format('nl_query')} || '|' || category), 1, 12) AS hash FROM seed_queries")
def text_normal(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.functions.text import normal_text
    from vigilframe.operators.benchmark import content_hash

    text = normal_text(F.col("nl_query"))
    return table(spark, d, "seed_queries").select("seed_id", text.alias("text"), content_hash(text, F.col("category")).alias("hash"))


@query("text_complexity", "SELECT seed_id, CASE WHEN regexp_matches(lower(nl_query), 'sequence|then|followed by|correlate|across|from one|to a different') THEN 'complex' WHEN regexp_matches(lower(nl_query), 'more than|exceeding|threshold|aggregate|group by|count|distinct') THEN 'intermediate' ELSE 'simple' END AS complexity, CASE WHEN length(nl_query) = 0 THEN 0 ELSE greatest(1, length(nl_query) // 3) END AS tokens FROM seed_queries")
def text_complexity(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.functions.text import complexity, estimate_tokens

    return table(spark, d, "seed_queries").select("seed_id", complexity(F.col("nl_query")).alias("complexity"), estimate_tokens(F.col("nl_query")).cast("long").alias("tokens"))


@query("word_chunks", "WITH u AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS u FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, i AS chunk_idx, u[i * 448 + 1 : i * 448 + 512] AS w FROM (SELECT doc_id, u, CAST(unnest(generate_series(0, (len(u) - 1) // 448)) AS INT) AS i FROM u WHERE len(u) > 0)) SELECT doc_id, chunk_idx, CAST(len(w) AS INT) AS n_units, md5(array_to_string(w, ' ')) AS digest FROM w WHERE len(w) >= 20")
def word_chunks(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.functions.text import unit_chunks

    return unit_chunks(spread(table(spark, d, "documents").select("doc_id", "text")), "text").select("doc_id", "chunk_idx", "n_units", F.md5("chunk").alias("digest"))


@query("query_ngrams", "WITH t AS (SELECT seed_id, list_filter(regexp_split_to_array(lower(regexp_replace(nl_query, '([|=><!()\\[\\]{},;])', ' \\1 ', 'g')), '\\s+'), lambda w: w <> '') AS t FROM seed_queries), g AS (SELECT unnest(list_transform(generate_series(1, greatest(len(t) - 1, 0)), lambda i: t[i] || ' ' || t[i + 1])) AS gram FROM t) SELECT gram, count(*) AS n FROM g GROUP BY 1")
def query_ngrams(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.functions.text import ngrams, query_tokens

    grams = table(spark, d, "seed_queries").select(F.explode(ngrams(query_tokens(F.col("nl_query")), 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


# Evaluation of generated queries


@query("semantic_scores", SEMANTIC_SCORES)
def semantic_scores(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.functions.scores import score_pairs

    return score_pairs(table(spark, d, "ablation").select("record_id", "platform", "hypothesis", "reference"), "hypothesis", "reference", platform="platform").select("record_id", "bleu", "rouge_l", "token_edit_sim", "field_f1", "semantic_score", "grade")


@query("static_checks")
def static_checks(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.dialects.checking import check

    checked = spread(table(spark, d, "ablation").select("record_id", "platform", "hypothesis")).select("record_id", "platform", check(F.col("platform"), F.col("hypothesis")).alias("c"))
    return checked.select("record_id", "platform", "c.*")


@query("static_check_aql", "WITH u AS (SELECT record_id, trim(coalesce(hypothesis, '')) AS q, upper(trim(coalesce(hypothesis, ''))) AS u FROM ablation WHERE platform = 'qradar') SELECT record_id, CASE WHEN q = '' THEN 'empty_query' WHEN NOT regexp_matches(u, '^SELECT\\b') THEN 'missing_keyword' WHEN NOT regexp_matches(u, '\\bFROM\\s+(EVENTS|FLOWS|ASSETS)\\b') THEN 'missing_keyword' WHEN regexp_matches(u, '\\bGROUP BY\\b') AND NOT regexp_matches(u, '\\b(COUNT|SUM|AVG|MIN|MAX)\\(') THEN 'missing_aggregate' WHEN regexp_matches(u, '\\bHAVING\\b') AND NOT regexp_matches(u, '\\bGROUP BY\\b') THEN 'malformed_syntax' END AS error_type FROM u")
def static_check_aql(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.dialects.checking import check_aql

    rows = table(spark, d, "ablation").filter("platform = 'qradar'")
    return rows.select("record_id", check_aql(F.col("hypothesis"))["error_type"].alias("error_type"))


@query("error_classes")
def error_classes(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.dialects.checking import check, classify
    from vigilframe.operators.evaluation import histogram

    rows = spread(table(spark, d, "ablation").select("platform", "hypothesis", "field_f1", "semantic_score")).withColumn("c", check(F.col("platform"), F.col("hypothesis")))
    rows = rows.withColumn("e", classify(F.col("platform"), F.coalesce("hypothesis", F.lit("")), F.col("c"), F.coalesce("field_f1", F.lit(1.0)), F.coalesce("semantic_score", F.lit(0.0))))
    return histogram(rows, F.col("e.category"), F.col("e.leaf")).select("category", "leaf", "n", "rank")


@query("rendered_queries")
def rendered_queries(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.dialects import render_column

    rendered = spread(table(spark, d, "examples").select("ex_id", "ir")).select("ex_id", render_column(F.col("ir")).alias("q")).filter("q is not null")
    return rendered.select("ex_id", F.explode("q").alias("platform", "text"))


@query("ablation_table", "WITH c AS (SELECT condition, platform, count(*) AS n, round(avg(CAST(is_valid AS INT)), 4) AS valid_rate, round(avg(semantic_score), 4) AS mean_score FROM ablation GROUP BY ALL) SELECT a.condition, a.platform, a.n, a.valid_rate, a.mean_score, round(a.mean_score - b.mean_score, 4) AS delta FROM c a JOIN c b ON b.platform = a.platform AND b.condition = 'A'")
def ablation_table_(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.evaluation import ablation_table

    return ablation_table(table(spark, d, "ablation"), "condition", "platform", F.col("is_valid"), F.col("semantic_score"), ["A", "B", "C"])


@query("macro_average", "WITH c AS (SELECT platform, count(*) AS n, round(avg(CAST(is_valid AS INT)), 4) AS valid FROM ablation GROUP BY 1) SELECT * FROM c UNION ALL SELECT 'MACRO', CAST(sum(n) AS BIGINT), round(avg(valid), 4) FROM c")
def macro_average_(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.evaluation import macro_average, rates

    return macro_average(rates(table(spark, d, "ablation"), ["platform"], valid=F.col("is_valid")), "platform", ["n"], ["valid"])


@query("latency_percentiles", "WITH r AS (SELECT platform, elapsed_s, row_number() OVER (PARTITION BY platform ORDER BY elapsed_s) - 1 AS i, count(*) OVER (PARTITION BY platform) AS n FROM ablation WHERE elapsed_s IS NOT NULL) SELECT platform, round(max(CASE WHEN i = round_even(0.5 * (n - 1), 0) THEN elapsed_s END), 2) AS p50, round(max(CASE WHEN i = round_even(0.95 * (n - 1), 0) THEN elapsed_s END), 2) AS p95 FROM r GROUP BY 1")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.evaluation import nearest_rank

    return nearest_rank(table(spark, d, "ablation"), "elapsed_s", {"p50": 50, "p95": 95}, ["platform"])


_RULES = "(SELECT CAST(ex_id AS VARCHAR) AS id, ['splunk', 'qradar', 'elastic', 'sentinel', 'wazuh', 'other'][ex_id % 6 + 1] AS platform, upper(trim(technique_id, e' \\t\\n\\r')) AS t FROM examples)"
_TAXONOMY = "(SELECT technique_id, min(parent_id) AS parent_id, bool_or(coalesce(is_subtechnique, false)) AS sub FROM technique_entries GROUP BY 1)"


def _coverage_inputs(spark: SparkSession, d: str, where: str = "true") -> tuple[DataFrame, DataFrame]:
    platforms = F.array(*map(F.lit, ("splunk", "qradar", "elastic", "sentinel", "wazuh", "other")))
    rules = table(spark, d, "examples").filter(where).select(F.col("ex_id").cast("string").alias("id"), F.get(platforms, (F.col("ex_id") % 6).cast("int")).alias("platform"), F.regexp_replace("technique_id", r"^\s+|\s+$", "").alias("technique"), F.lit(None).cast("string").alias("sub_technique"))
    taxonomy = table(spark, d, "technique_entries").groupBy("technique_id").agg(F.min("parent_id").alias("parent_id"), F.bool_or(F.coalesce("is_subtechnique", F.lit(False))).alias("is_subtechnique"))
    return rules, taxonomy


@query("coverage", f"WITH x AS (SELECT r.id, r.platform, k.technique_id AS covered, k.sub, k.parent_id FROM {_RULES} r JOIN {_TAXONOMY} k ON r.t = k.technique_id), y AS (SELECT DISTINCT id, platform, covered FROM x UNION SELECT id, platform, parent_id FROM x WHERE sub AND parent_id IS NOT NULL), z AS (SELECT * FROM y WHERE platform <> 'other' UNION ALL SELECT id, 'all', covered FROM y), p AS (SELECT DISTINCT technique_id FROM {_TAXONOMY} WHERE NOT sub), f AS (SELECT platform, count(DISTINCT covered) AS covered, count(DISTINCT id) AS rules, count(DISTINCT CASE WHEN covered IN (SELECT technique_id FROM p) THEN covered END) AS covered_parents FROM z GROUP BY 1) SELECT n.platform, coalesce(covered, 0) AS covered, coalesce(rules, 0) AS rules, coalesce(covered_parents, 0) AS covered_parents, round(coalesce(covered_parents, 0) * 100.0 / (SELECT count(*) FROM p), 2) AS percent FROM (SELECT unnest(['splunk', 'qradar', 'elastic', 'sentinel', 'wazuh', 'all']) AS platform) n LEFT JOIN f USING (platform)")
def coverage_(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.evaluation import coverage

    return coverage(*_coverage_inputs(spark, d))


@query("coverage_gaps", f"SELECT technique_id FROM {_TAXONOMY} WHERE NOT sub AND technique_id NOT IN (SELECT t FROM {_RULES} WHERE t IS NOT NULL) AND technique_id NOT IN (SELECT k.parent_id FROM {_RULES} r JOIN {_TAXONOMY} k ON r.t = k.technique_id WHERE k.sub AND k.parent_id IS NOT NULL)")
def coverage_gaps_(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.evaluation import coverage_gaps

    return coverage_gaps(*_coverage_inputs(spark, d))


@query("label_fidelity", "WITH c AS (SELECT query_id, condition, count(*) AS n FROM ablation WHERE condition IS NOT NULL GROUP BY ALL) SELECT query_id, CAST(sum(n) AS BIGINT) AS labels, max(n) AS agreeing, count(*) = 1 AS consistent FROM c GROUP BY 1")
def label_fidelity(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.evaluation import fidelity

    return fidelity(table(spark, d, "ablation"), "query_id", "condition")


@query("aligned_results", "WITH b AS (SELECT seed_id, nl_query, category, coalesce(nullif(seed_id, ''), substr(nl_query, 1, 40)) AS k FROM seed_queries) SELECT a.record_id, b.category FROM ablation a JOIN b ON coalesce(nullif(a.query_id, ''), substr(a.nl_query, 1, 40)) = b.k")
def aligned_results(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.evaluation import align

    results = table(spark, d, "ablation").select("record_id", F.col("query_id").alias("seed_id"), "nl_query")
    return align(results, table(spark, d, "seed_queries"), "seed_id", "nl_query", [F.col("seed_id")]).select("record_id", F.col("benchmark.category").alias("category"))


@query("result_set_match", "WITH m AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), t AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), n AS (SELECT (SELECT count(*) FROM m) AS mine, (SELECT count(*) FROM t) AS theirs, (SELECT count(*) FROM m JOIN t USING (user_id)) AS shared) SELECT mine, theirs, shared, round(shared / theirs, 4) AS recall, round(shared / mine, 4) AS precision, mine = shared AND theirs = shared AS exact, round(shared / theirs, 4) >= 0.9 AS match FROM n")
def result_set_match(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.evaluation import set_match

    e = _events(spark, d)
    return set_match(e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'"), "user_id")


# Building an evaluation set


@query("benchmark_dedup", f"SELECT min(ex_id) AS ex_id FROM examples WHERE {_NORMAL.format('nl_query')} <> '' GROUP BY {_NORMAL.format('nl_query')}")
def benchmark_dedup(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.benchmark import first_of_each_text

    return first_of_each_text(table(spark, d, "examples").select("ex_id", "nl_query"), "nl_query", ["ex_id"]).select("ex_id")


@query("benchmark_resume", f"SELECT ex_id FROM examples WHERE {_NORMAL.format('nl_query')} NOT IN (SELECT {_NORMAL.format('nl_query')} FROM examples WHERE tactic = 'execution')")
def benchmark_resume(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.benchmark import not_done

    e = table(spark, d, "examples").select("ex_id", "nl_query", "tactic")
    return not_done(e, e.filter("tactic = 'execution'"), "nl_query").select("ex_id")


@query("benchmark_split", "WITH g AS (SELECT technique_id AS g, min(complexity) AS t FROM seed_queries WHERE technique_id IS NOT NULL GROUP BY 1), p AS (SELECT g, row_number() OVER (PARTITION BY t ORDER BY md5('42|' || g), g) AS n, count(*) OVER (PARTITION BY t) AS k FROM g), c AS (SELECT g, n, round_even(k * 0.7::DOUBLE, 0) AS a, round_even(k * 0.7::DOUBLE, 0) + round_even(k * 0.15::DOUBLE, 0) AS b FROM p) SELECT seed_id, technique_id, CASE WHEN n <= a THEN 'train' WHEN n <= b THEN 'validation' ELSE 'test' END AS split FROM seed_queries JOIN c ON technique_id = g")
def benchmark_split(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.benchmark import stratified_split

    return stratified_split(table(spark, d, "seed_queries"), "technique_id", "complexity").select("seed_id", "technique_id", "split")


@query("benchmark_ids", "SELECT seed_id, 'SB-' || lpad(CAST(row_number() OVER (ORDER BY substr(sha256(nl_query), 1, 12), seed_id) AS VARCHAR), 4, '0') AS seq_id FROM seed_queries")
def benchmark_ids(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.benchmark import content_hash, sequential_ids

    return sequential_ids(table(spark, d, "seed_queries").withColumn("h", content_hash(F.col("nl_query"))), ["h", "seed_id"]).select("seed_id", "seq_id")


@query("benchmark_distributions", "SELECT 'category' AS dim, category AS value, count(*) AS n FROM seed_queries GROUP BY ALL UNION ALL SELECT 'complexity', complexity, count(*) FROM seed_queries GROUP BY ALL")
def benchmark_distributions(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.benchmark import distributions

    return distributions(table(spark, d, "seed_queries"), ["category", "complexity"])


# Large tables of the star schema


@query("volume_by_source", "SELECT l_suppkey, l_partkey, count(*) AS n, round(sum(l_extendedprice), 2) AS volume FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL HAVING count(*) > 1")
def volume_by_source(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    return rows.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("volume")).filter("n > 1")


@query("orders_by_region", "SELECT r_name, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def orders_by_region(spark: SparkSession, d: str) -> DataFrame:
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


# Taxonomy, replies, parsing


@query("classified_questions")
def classified_questions(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.taxonomy import classify, starter_rules

    seeds = table(spark, d, "seed_queries").select("seed_id", "nl_query", "category")
    return classify(seeds, "nl_query", starter_rules(spark)).select("seed_id", "tactic", "technique", "sub_technique", "confidence")


@query("classified_by_rule", "SELECT seed_id, CASE WHEN regexp_matches(lower(nl_query), 'autostart') THEN 'T1547' END AS technique FROM seed_queries")
def classified_by_rule(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.taxonomy import RULE_SCHEMA, classify

    rules = spark.createDataFrame([(0, "persistence", "T1547", None, 0.85, False, 0.9, "autostart")], RULE_SCHEMA)
    return classify(table(spark, d, "seed_queries").select("seed_id", "nl_query"), "nl_query", rules).select("seed_id", "technique")


@query("label_problems", "WITH k AS (SELECT technique_id FROM technique_entries GROUP BY 1), x AS (SELECT ex_id, technique_id AS t FROM examples) SELECT ex_id, list_filter([CASE WHEN t IS NULL THEN 'no technique' END, CASE WHEN NOT regexp_matches(t, '^T\\d{4}$') THEN 'malformed technique' END, CASE WHEN regexp_matches(t, '^T\\d{4}$') AND t NOT IN (SELECT technique_id FROM k WHERE technique_id IS NOT NULL) THEN 'unknown technique' END], lambda p: p IS NOT NULL)::VARCHAR AS problems FROM x")
def label_problems_(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.taxonomy import label_problems

    rows = table(spark, d, "examples").select("ex_id", "technique_id", F.lit(None).cast("string").alias("sub_technique"), F.lit(None).cast("string").alias("tactic"))
    found = label_problems(rows.withColumnRenamed("technique_id", "technique"), table(spark, d, "technique_entries"), "technique", "sub_technique", "tactic")
    return found.select("ex_id", F.concat(F.lit("["), F.array_join("problems", ", "), F.lit("]")).alias("problems"))


@query("taxonomy_children", "WITH c AS (SELECT DISTINCT parent_id, technique_id FROM technique_entries WHERE parent_id IS NOT NULL) SELECT parent_id, technique_id, row_number() OVER (PARTITION BY parent_id ORDER BY technique_id) AS n FROM c QUALIFY n <= 4")
def taxonomy_children(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.taxonomy import first_children

    return first_children(table(spark, d, "technique_entries"))


@query("techniques_of_tactic", "SELECT entry_id, technique_id FROM technique_entries WHERE list_contains(list_transform(tactic_names, lambda t: replace(replace(lower(trim(t)), ' ', '-'), '_', '-')), 'persistence')")
def techniques_of_tactic(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.taxonomy import techniques_of

    return techniques_of(table(spark, d, "technique_entries"), "Persistence").select("entry_id", "technique_id")


@query("rule_levels", "SELECT record_id, CASE WHEN regexp_matches(hypothesis, '<mitre>') THEN regexp_extract(hypothesis, '<id>\\s*(T\\d{4})', 1) END AS technique FROM ablation WHERE platform = 'wazuh'")
def rule_levels(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.taxonomy import rule_technique

    return table(spark, d, "ablation").filter("platform = 'wazuh'").select("record_id", rule_technique(F.col("hypothesis")).alias("technique"))


@query("validated_documents")
def validated_documents(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.replies import validated

    return validated(spread(table(spark, d, "examples").select("ex_id", "ir")), "ir").select("ex_id", "error", "summary")


@query("message_usage", "SELECT platform, count(*) AS messages, CAST(sum(4 + CASE WHEN length(coalesce(hypothesis, '')) = 0 THEN 0 ELSE greatest(1, length(hypothesis) // 3) END) AS BIGINT) AS tokens FROM ablation GROUP BY 1")
def message_usage(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.replies import usage

    return usage(table(spark, d, "ablation"), ["platform"], "hypothesis").select("platform", "messages", "tokens")


@query("parsed_questions")
def parsed_questions(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.plans.parser import rule_parser

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(rule_parser(t)))

    return table(spark, d, "seed_queries").select("seed_id", run("nl_query").alias("document"))


# Documented recipes


@query("recipe_port_scan", "SELECT l_suppkey, l_returnflag, count(DISTINCT l_partkey) AS targets FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) > 50")
def recipe_port_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count_distinct("l_partkey").alias("targets"))
    return rows.filter("targets > 50")


@query("recipe_beaconing", "SELECT l_suppkey, l_shipmode_like, count(*) AS n FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS l_shipmode_like FROM lineitem) GROUP BY ALL HAVING count(*) > 100")
def recipe_beaconing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("l_shipmode_like"))
    return rows.groupBy("l_suppkey", "l_shipmode_like").agg(F.count(F.lit(1)).alias("n")).filter("n > 100")


@query("recipe_long_names", "SELECT p_partkey, length(p_name) AS n FROM part WHERE length(p_name) > 10")
def recipe_long_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.length("p_name").alias("n")).filter("n > 10")


@query("recipe_rare_customers", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) <= 2")
def recipe_rare_customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n <= 2")


@query("reference_set_membership", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def reference_set_membership(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(c, "o_custkey", "left_semi").select("o_orderkey")


# Pipeline and nested values


@query("translated_questions")
def translated_questions(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.plans.pipeline import translations

    return translations(table(spark, d, "seed_queries"), "seed_id", "nl_query")


@query("accepted_questions")
def accepted_questions(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.plans.pipeline import accepted, translations

    return accepted(translations(table(spark, d, "seed_queries"), "seed_id", "nl_query"), "seed_id")


@query("structural_match", "WITH n AS (SELECT record_id, lower(trim(regexp_replace(regexp_replace(coalesce(hypothesis, ''), '#[^\\n\\r]*', '', 'g'), '\\s+', ' ', 'g'))) AS a, lower(trim(regexp_replace(regexp_replace(coalesce(reference, ''), '#[^\\n\\r]*', '', 'g'), '\\s+', ' ', 'g'))) AS b FROM ablation), f AS (SELECT record_id, a = b AS exact, list_distinct(regexp_extract_all(a, '\\b([a-z_\\.]+)\\s*[:=]', 1)) AS fa, list_distinct(regexp_extract_all(b, '\\b([a-z_\\.]+)\\s*[:=]', 1)) AS fb FROM n) SELECT record_id, exact, round(CASE WHEN len(fb) > 0 THEN len(list_intersect(fa, fb)) / len(fb) ELSE 1 END, 6) AS field_coverage FROM f")
def structural_match_(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.functions.scores import structural_match

    rows = table(spark, d, "ablation").select("record_id", structural_match(F.coalesce("hypothesis", F.lit("")), F.coalesce("reference", F.lit(""))).alias("m"))
    return rows.select("record_id", "m.exact", F.round("m.field_coverage", 6).alias("field_coverage"))


@query("document_keys", "WITH k AS (SELECT unnest(json_keys(props)) AS key FROM events) SELECT key, count(*) AS n FROM k GROUP BY 1")
def document_keys(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.functions.nested import json_keys

    return spread(_events(spark, d).select("props")).select(F.explode(json_keys(F.col("props"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("wildcard_like", "SELECT p_partkey FROM part WHERE p_name LIKE '_e%'")
def wildcard_like(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.functions.nested import like

    return table(spark, d, "part").filter(like(F.col("p_name"), "?e*")).select("p_partkey")


@query("score_spread", "SELECT platform, count(*) AS n, round(avg(semantic_score), 4) AS mean, round(coalesce(stddev_samp(semantic_score), 0), 4) AS deviation, round(avg(CAST(semantic_score >= 0.85 AS INT)), 4) AS excellent FROM ablation GROUP BY 1")
def score_spread(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("semantic_score")
    rows = table(spark, d, "ablation").groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(s), F.lit(0.0)), 4).alias("deviation"), F.round(F.avg((s >= 0.85).cast("int")), 4).alias("excellent"))
    return rows


@query("unit_offsets", "SELECT seed_id, strpos(nl_query, ' ') AS second FROM seed_queries")
def unit_offsets_(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.functions.nested import unit_offsets

    rows = table(spark, d, "seed_queries").select("seed_id", unit_offsets(F.col("nl_query"), F.split("nl_query", " ")).alias("o"))
    return rows.select("seed_id", F.get("o", F.lit(1)).cast("long").alias("second"))
