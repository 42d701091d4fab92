import datetime as dt

import pytest

from vigilframe.dialects.running import Tables, expression, run, search_terms, split_outside
from vigilframe.plans.query import QueryError


@pytest.fixture(scope="module")
def tables(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(at(0), "ann", "login failed | now", 1, "10.0.0.5"), (at(1), "Bob", "it's a \"quote\"", 5, "10.1.0.5"), (at(2), "ann", None, 9, "192.168.1.1"), (at(30), None, "login ok", None, None)]
    df = spark.createDataFrame(rows, "_time timestamp_ntz, user string, text string, n int, ip string")
    return Tables({"*": df, "events": df}, {"people": spark.createDataFrame([("ann", "red"), ("ann", "red")], "user string, team string")})


def values(df, column="n"):
    return sorted(r[column] for r in df.collect() if r[column] is not None)


def test_literals_are_left_alone(tables):
    assert split_outside('a "x | y" | b (c | d) | e', "|") == ['a "x | y"', "b (c | d)", "e"]
    assert values(run('index=* "failed | now" | where n < 5', tables, "splunk")) == [1]
    assert values(run("FROM events | WHERE text == \"it's a \\\"quote\\\"\"", tables, "esql")) == [5]
    assert expression('a == "b == c"') == "a = 'b == c'"


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("splunk", "index=main user=bob", [5]),
        ("splunk", "index=main NOT user=ann n>0", [5]),
        ("splunk", "(user=ann OR user=b*) n>=5", [5, 9]),
        ("splunk", "index=main user!=a*", [5]),
        ("splunk", 'index=* | where cidrmatch("10.0.0.0/8", ip) AND match(text, "log.n")', [1]),
        ("splunk", "index=* | lookup people user OUTPUT team | search team=RED | fields n", [1, 9]),
        ("splunk", "index=main earliest=-10m", []),
        ("splunk", "index=main | append [search index=main n=9]", [1, 5, 9, 9]),
        ("esql", 'FROM events | WHERE user LIKE "a*" | DROP ip', [1, 9]),
        ("esql", "FROM events | WHERE text IS NULL", [9]),
        ("kusto", "events | where user =~ 'BOB' or text !contains 'LOGIN'", [5]),
        ("kusto", "events | where text has 'fail'", []),
        ("kusto", "events | where text has 'failed' | extend n = n + 1", [2]),
        ("eql", 'any where user : "ANN" | unique user', [1]),
        ("aql", "SELECT n FROM events WHERE INCIDR('10.0.0.0/16', ip)", [1]),
    ],
)
def test_filters(tables, language, text, want):
    assert values(run(text, tables, language)) == want


def test_as_of_and_errors(tables):
    later = Tables(tables.events, as_of=dt.datetime(2024, 1, 1, 0, 3))
    assert values(run("events | where _time > ago(90s)", later, "kusto")) == [9]
    for language, text in (("splunk", "index=* | nosuch x"), ("esql", "WHERE x"), ("esql", "FROM events | nosuch"), ("kusto", "events | nosuch"), ("aql", "SELECT 1"), ("eql", "any | head"), ("none", ""), ("splunk", "index=* | lookup nosuch user"), ("splunk", "index=* | stats nosuch(n)")):
        with pytest.raises(QueryError):
            run(text, tables, language)
    assert search_terms(tables.events["*"], "", tables).count() == 4
