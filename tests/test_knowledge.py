import json

import pytest
from pyspark.sql import functions as F

from vigilframe.operators.replies import context_block, extract, rename_fields, usage, validated
from vigilframe.operators.taxonomy import classify, first_children, label_problems, rule_technique, starter_rules, techniques_of
from vigilframe.plans.parser import rule_parser
from vigilframe.plans.query import parse
from vigilframe.sources.ingest import ingest


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1}', {"a": 1}), ('Sure:\n```json\n{"a": [1, 2]}\n```', {"a": [1, 2]}), ("<json>[1]</json>", [1]), ('so {"a": {"b": "}"}} then', {"a": {"b": "}"}}), ("{'a': True, 'b': None,}", {"a": True, "b": None}),
        ('{"a": 1, // note\n "b": 2}', {"a": 1, "b": 2}), ('{"a": [1, 2', {"a": [1, 2]}), ('{"a": 1, "b": {"c": "x', {"a": 1, "b": {"c": "x"}}), ('{"a": 1, "b"', {"a": 1}), ('{"a": 1, "b":', {"a": 1}), ("no json", None), ("", None), (None, None), ("{]", None),
    ],
)
def test_extract(text, want):
    assert extract(text) == want


def test_field_names():
    assert rename_fields({"filter": {"conditions": [{"field": "username", "value": "x"}]}, "aggregation": {"group_by": ["source_ip", "host"]}}) == {"filter": {"conditions": [{"field": "user", "value": "x"}]}, "aggregation": {"group_by": ["src_ip", "host"]}}


def test_validated(spark):
    rows = [(1, '{"action": "filter"}'), (2, '{"Action": "aggregate"}'), (3, None), (4, "{"), (5, '{"action": "filter", "timeWindow": {"duration": "5m"}}')]
    got = {r.i: r for r in validated(spark.createDataFrame(rows, "i long, d string"), "d").collect()}
    assert got[1].error is None and got[1].warnings and "requires an aggregation" in got[2].error and got[3].error == got[4].error == "unreadable" and "within 5m" in got[5].summary


def test_usage_and_context(spark):
    df = spark.createDataFrame([("a", "x" * 30), ("a", None), ("b", "")], "k string, t string")
    assert {r.k: (r.messages, r.tokens) for r in usage(df, ["k"], "t", 2.0).collect()} == {"a": (2, 18), "b": (1, 4)}
    hits = spark.createDataFrame([(1, 2, "s2", "world"), (1, 1, "s1", "hello" * 400)], "q long, r int, s string, t string")
    text = context_block(hits, "q", "r", "s", "t").first().context
    assert text.startswith("[1] s1\nhello") and text.endswith("[2] s2\nworld") and len(text) < 900


def test_classification(spark):
    rows = [(1, "Failed SSH login, brute force"), (2, "PowerShell was started"), (3, "SSH alone"), (4, None), (5, "password spraying over many accounts"), (6, "password guesses and a memory dump")]
    got = {r.i: r for r in classify(spark.createDataFrame(rows, "i long, t string"), "t", starter_rules(spark)).collect()}
    assert got[1].sub_technique == "T1110.001" and got[2].technique == "T1059" and got[3].technique is None and got[4].technique is None and got[5].sub_technique == "T1110.003"
    assert got[6].technique == "T1110" and got[6].confidence == 0.9
    assert classify(spark.createDataFrame(rows, "i long, t string"), "t", starter_rules(spark).filter("rule < 0")).filter("technique is not null").count() == 0


def test_labels(spark):
    taxonomy = spark.createDataFrame([("T1110", ["credential-access"], None), ("T1110.001", ["credential-access"], "T1110"), ("T1110.002", None, "T1110"), ("T1059", [], None)], "technique_id string, tactic_names array<string>, parent_id string")
    rows = [(1, "T1110", "T1110.001", "Credential Access"), (2, "T1110", "T1059.001", "impact"), (3, None, None, None), (4, "T9", None, None), (5, "T9999", None, None)]
    got = {r.i: r.problems for r in label_problems(spark.createDataFrame(rows, "i long, t string, s string, ta string"), taxonomy, "t", "s", "ta").collect()}
    assert got == {1: [], 2: ["sub-technique of another technique", "tactic of another technique"], 3: ["no technique"], 4: ["malformed technique"], 5: ["unknown technique"]}
    assert techniques_of(taxonomy, "credential_access").count() == 2 and [r.technique_id for r in first_children(taxonomy, 1).collect()] == ["T1110.001"]
    one = spark.range(1).select(rule_technique(F.lit("<rule><mitre>\n<id>T1110.001</id></mitre></rule>")), rule_technique(F.lit("<rule/>"))).first()
    assert list(one) == ["T1110.001", None]


def test_rule_parser():
    d = rule_parser("Alert on more than 40 failed logons per src ip within 10 minutes when category contains abc")
    q = parse(d)
    assert q.event_type == "authentication" and q.aggregation.group_by == ("src_ip",) and q.threshold.value == 40 and q.threshold.op == "gt" and q.time_window.seconds == 600
    assert [c.op for c in q.filter.conditions] == ["contains", "eq"] and parse(rule_parser("")).action == "filter" and json.dumps(d)
    assert parse(rule_parser("Which host values had 5 or more uploads in 2 weeks")).threshold.op == "gte"


def test_ingest(spark, tmp_path):
    for platform in ("splunk", "wazuh"):
        folder = tmp_path / "knowledge_base" / platform
        folder.mkdir(parents=True)
        (folder / "docs.txt").write_text(f"{platform} words " * 40)
    index = str(tmp_path / "index")
    ingest(spark, str(tmp_path / "knowledge_base"), index, size=32, overlap=8)
    n = spark.read.parquet(index).count()
    ingest(spark, str(tmp_path / "knowledge_base" / "splunk"), index, size=16, overlap=0, least=1)
    after = {r.platform: r["count"] for r in spark.read.parquet(index).groupBy("platform").count().collect()}
    assert n == 2 * after["wazuh"] and after["splunk"] == 5
