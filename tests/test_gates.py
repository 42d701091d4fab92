import pytest
from pyspark.sql import functions as F

from vigilframe.dialects.gates import gate, own_check

RULE = '<rule id="100001" level="5"><description>x</description></rule>'


@pytest.mark.parametrize(
    ("platform", "rows"),
    [
        ("splunk", [(None, "empty_query", False), ("index=a | stats count by b", None, True), ("index=a | tstats count", None, False), ("user=1", "missing_keyword", False), ("index=a | nosuch", "unknown_command", False), ("index=a | ", None, False)]),
        ("qradar", [("SELECT a FROM events", None, True), ("SELECT a FROM assets LAST 1 HOURS", None, False), ("select a from events group by a", "missing_aggregate", False), ("SELECT COUNT(*) FROM flows HAVING x", "malformed_syntax", True), ("FROM events", "missing_keyword", False)]),
        ("elastic", [("process where a == 1 | head 5", None, True), ("process where a | nosuch", None, False), ("process a", "missing_keyword", False), ("any x", None, False), ("sequence by a", "malformed_syntax", False), ("// note\na : b", None, True), ("nothing", "malformed_syntax", False), ("a > 5", None, False), ("abc >= 5", None, True)]),
        ("sentinel", [("Syslog | where a", None, True), ("Syslog | take 5", None, False), ("Syslog", "malformed_syntax", False), ("Syslog | nosuch", "unknown_command", False)]),
        ("wazuh", [(RULE, None, True), (RULE.replace("100001", "7"), None, True), (RULE.replace("100001", "x"), "field_error", False), (RULE.replace(' level="5"', ""), "field_error", False), (RULE.replace(' level="5"', ' level="a"'), "field_error", True), ("<rule", "invalid_xml", False), (RULE.replace("rule", "group"), "malformed_syntax", False), ('<rule id="1" level="2"/>', "missing_keyword", False)]),
    ],
)
def test_levels(spark, platform, rows):
    df = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(rows)], "i int, q string")
    got = df.select("i", gate(platform, F.col("q")).alias("g"), own_check(platform, F.col("q")).alias("o")).orderBy("i").collect()
    assert [(r.g.error_type, r.o) for r in got] == [(e, o) for _, e, o in rows]
    assert all(r.g.is_valid == (r.g.error_type is None) for r in got)


def test_warnings(spark):
    df = spark.createDataFrame([(RULE.replace("100001", "7").replace('"5"', '"99"'),)], "q string")
    assert sorted(df.select(gate("wazuh", F.col("q")).alias("g")).first().g.warnings) == ["level out of range", "reserved rule id"]
    assert df.select(gate("none", F.col("q")).alias("g")).first().g.warnings == ["no check for this platform"]
    assert spark.createDataFrame([("a=1",)], "q string").select(gate("splunk", F.col("q")).alias("g")).first().g.corrected == "index=* a=1"
