import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from vigilframe.dialects import render_column, translate
from vigilframe.plans.compile import Options, Source, compile_query
from vigilframe.plans.fields import FIELDS, PLATFORMS, Binding, canonical_fields, field_table, platform_field
from vigilframe.plans.query import QueryError, coerce, parse, say, seconds, warnings

DOCUMENT = {"action": "filter+aggregate", "event_type": "authentication", "filter": {"operator": "and", "conditions": [{"field": "status", "op": "eq", "value": "failed"}]}, "time_window": {"duration": "24h"}, "aggregation": {"function": "count", "group_by": ["src_ip"], "alias": "attempt_count"}, "threshold": {"field": "attempt_count", "op": "gt", "value": 50}}
LOOKUP = {"action": "lookup", "event_type": "network", "filter": {"conditions": [{"field": "direction", "op": "eq", "value": "outbound"}]}, "lookup": {"lookup_table": "intel", "match_field": "dest_ip", "output_field": "is_malicious"}}
SEQUENCE = {"action": "sequence", "sequence": [{"event_type": "authentication", "filter": {"conditions": [{"field": "user", "op": "neq", "value": "root"}]}}, {"event_type": "authentication", "filter": {"conditions": [{"field": "country", "op": "neq", "value": "$prev.country"}]}, "within": "30m"}]}


def test_coercion():
    d = coerce({"action": " Detect", "event_type": "LOGON", "time_window": "last 24 hours", "threshold": ">= 5", "aggregation": {"function": "Average"}, "filter": {"operator": "OR", "conditions": [{"field": "a", "op": "EQUALS", "value": 1}, {"conditions": [{"field": "b", "op": "like", "value": "x"}]}]}, "sequence": [{"event_type": "web", "filter": {"conditions": [{"field": "a", "op": "==", "value": 1}]}}], "attack": {}})
    assert (d["action"], d["event_type"], d["time_window"], d["threshold"]) == ("filter+aggregate", "authentication", {"duration": "24h"}, {"field": "count", "op": "gte", "value": 5})
    assert d["filter"]["operator"] == "or" and d["filter"]["conditions"][0]["op"] == "eq" and d["filter"]["conditions"][1]["conditions"][0]["op"] == "contains"
    assert d["sequence"][0]["event_type"] == "http" and d["sequence"][0]["filter"]["conditions"][0]["op"] == "eq" and d["aggregation"]["function"] == "avg" and "attack" not in d
    assert coerce({"action": "filter", "event_type": "??", "time_window": 6})["event_type"] == "any"
    assert coerce({"action": "filter", "time_window": 6})["time_window"] == {"duration": "6h"}


@pytest.mark.parametrize(
    "bad",
    [
        {}, {"action": "dance"}, {"action": "aggregate"}, {"action": "lookup"}, {"action": "sequence", "sequence": []}, {"action": "filter", "threshold": 5}, {"action": "filter", "limit": 0}, {"action": "filter", "time_window": {"duration": "5 years"}},
        {"action": "filter", "filter": {"conditions": [{"field": "a", "op": "near", "value": 1}]}}, {"action": "filter", "filter": {"operator": "xor", "conditions": []}}, {"action": "aggregate", "aggregation": {"function": "median"}},
    ],
)
def test_bad_documents(bad):
    with pytest.raises(QueryError):
        parse(bad)


def test_words():
    q = parse(DOCUMENT)
    assert q.summary() == "count by src_ip over authentication within 24h, attempt_count gt 50"
    assert say(q) == "Find authentication events where status is failed, with the number of events per src ip that is greater than 50, in the last 24 hours"
    assert parse(q.to_dict()) == q and seconds("3m") == 180 and warnings({"action": "filter"})
    assert len({say(q, k) for k in range(3)}) == 3


def test_fields(spark):
    assert len(FIELDS) == 37 and field_table(spark).count() == 37 * len(PLATFORMS)
    assert platform_field("src_ip", "elastic") == "source.ip" and platform_field("nothing", "elastic") == "nothing" and set(canonical_fields("host", "splunk")) == {"host", "hostname"}


def test_renderings():
    t = translate(parse(DOCUMENT))
    assert t["splunk"] == 'index=* earliest=-24h latest=now status="failed"\n| stats count as attempt_count by src_ip\n| where attempt_count > 50\n| sort -attempt_count'
    assert t["qradar"] == "SELECT sourceip, COUNT(*) AS attempt_count\nFROM events\nWHERE eventdirection = 'failed'\nGROUP BY sourceip\nHAVING attempt_count > 50\nORDER BY attempt_count DESC\nLAST 24 HOURS"
    assert t["elastic"].startswith('authentication where event.outcome == "failure"') and "| stats count(*) as attempt_count by source.ip\n| where attempt_count > 50" in t["elastic"]
    assert t["sentinel"] == 'SecurityEvent\n| where TimeGenerated > ago(24h)\n| where Status == "failed"\n| summarize attempt_count = count() by IpAddress\n| where attempt_count > 50\n| order by attempt_count desc'
    assert "<frequency>50</frequency>" in t["wazuh"] and "<timeframe>86400</timeframe>" in t["wazuh"] and "<same_source_ip/>" in t["wazuh"]
    assert "lookup intel dest_ip OUTPUT is_malicious\n| where isnotnull(is_malicious)" in translate(parse(LOOKUP))["splunk"]
    assert translate(parse(SEQUENCE))["elastic"].startswith("sequence by user.name with maxspan=30m\n  [authentication where user.name !=")
    neg = parse({"action": "filter", "filter": {"operator": "not", "conditions": [{"field": "user", "op": "in", "value": ["a", "b"]}, {"field": "action", "op": "regex", "value": "x<y", "negate": True}]}})
    assert translate(neg)["splunk"] == 'index=* NOT (user IN ("a" "b") NOT (action=~"x<y"))'
    assert "x&lt;y" in translate(neg)["wazuh"]


def test_rendering_of_tables(spark):
    rows = [(1, json.dumps(DOCUMENT)), (2, None), (3, "{"), (4, json.dumps({"Action": "filter", "timeWindow": {"duration": "5m"}})), (5, "[]")]
    got = {r.i: r.q for r in spark.createDataFrame(rows, "i long, d string").select("i", render_column(F.col("d")).alias("q")).collect()}
    assert set(got[1]) == set(PLATFORMS) and got[2] is got[3] is got[5] is None and "earliest=-5m" in got[4]["splunk"]


T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rows = [("u1", "PL", 0, "a%b"), ("u1", "DE", 10, "ab"), ("u1", "DE", 50, None), ("u2", "PL", 5, "A%B"), ("u2", "PL", 90, "x"), (None, "FR", 91, "ab")]
    return spark.createDataFrame([(u, c, T0 + dt.timedelta(minutes=m), x) for u, c, m, x in rows], "user string, country string, _time timestamp_ntz, text string")


def run(events, document, **options):
    return compile_query(parse(document), Source({"any": events}), {"intel": (events.sparkSession.createDataFrame([("PL", "x"), ("PL", "a"), (None, "z")], "k string, risk string"), "k")}, Options(**options)).collect()


def find(events, *conditions, operator="and", **options):
    return len(run(events, {"action": "filter", "filter": {"operator": operator, "conditions": list(conditions)}}, **options))


def test_predicates(events):
    leaf = lambda f, o, v, **k: {"field": f, "op": o, "value": v, **k}
    assert find(events, leaf("text", "contains", "%")) == 2
    assert find(events, leaf("text", "neq", "ab")) == 3
    assert find(events, leaf("text", "neq", "ab"), nulls="search") == 4
    assert find(events, leaf("text", "eq", "AB"), ci_equality=True) == 2
    assert find(events, leaf("text", "eq", "ab", negate=True)) == 3
    assert find(events, leaf("country", "eq", "PL"), leaf("user", "eq", "u1"), operator="not") == 5
    assert find(events, leaf("user", "eq", None)) == 1 and find(events, leaf("user", "eq", "*")) == 5
    assert find(events, {"operator": "or", "conditions": []}) == 6
    assert find(events, leaf("text", "contains", "a%b"), contains="term") == 2


def test_window_and_lookup(events):
    assert len(run(events, {"action": "filter", "time_window": "41m"})) == 3
    assert len(run(events, {"action": "filter", "time_window": "10m"}, as_of=T0 + dt.timedelta(minutes=10))) == 3
    look = {"lookup_table": "intel", "match_field": "country", "output_field": "risk"}
    rows = run(events, {"action": "lookup", "lookup": look})
    assert len(rows) == 3 and {r.risk for r in rows} == {"a"}
    assert len(run(events, {"action": "lookup", "lookup": {**look, "filter_on_match": False}})) == 6
    with pytest.raises(QueryError):
        run(events, {"action": "lookup", "lookup": {"lookup_table": "none", "match_field": "country"}})


def test_sequence(events):
    rows = run(events, SEQUENCE)
    assert [(r.key, r.step_1_time, r.step_2_time) for r in rows] == [("u1", T0, T0 + dt.timedelta(minutes=10))]
    with pytest.raises(QueryError):
        run(events, {"action": "sequence", "sequence": [{}, {}]})
    long = {"action": "sequence", "sequence": [{}, {"within": "2h"}, {"within": "2h"}]}
    assert len(run(events, long, sequence_key="user")) == 1 and len(run(events, long, sequence_key="user", max_span="20m")) == 0


def test_thresholds(events):
    rows = run(events, {"action": "aggregate", "aggregation": {"function": "count", "group_by": ["user"]}, "threshold": {"field": "elsewhere", "op": "lte", "value": 2}})
    assert {(r.user, r["count"]) for r in rows} == {("u2", 2), (None, 1)}
    with pytest.raises(QueryError):
        run(events, {"action": "aggregate", "aggregation": {"function": "count"}, "threshold": {"op": "contains", "value": 2}})


def test_plan_pushes_filters(spark, small):
    source = Source({"any": spark.read.parquet(f"{small}/events.parquet")}, binding=Binding({"category": "event_type"}), time_column="ts")
    df = compile_query(parse({"action": "filter", "filter": {"conditions": [{"field": "category", "op": "eq", "value": "error"}]}, "fields": ["event_id"]}), source)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan and "props" not in plan
