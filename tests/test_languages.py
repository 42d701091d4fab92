import pytest
from pyspark.sql import functions as F

from vigilframe.dialects import Dialect, register, translate
from vigilframe.dialects.piped import to_piped
from vigilframe.dialects.rendering import esql
from vigilframe.functions.nested import flat_columns, json_keys, like, unit_offsets
from vigilframe.plans.pipeline import accepted, translations
from vigilframe.plans.query import parse


def test_event_queries():
    p = to_piped('authentication where event.outcome == "failure and x"\n  and source.ip != null or not user.name in ("a", "b")  // from now-24h\n| stats count(*) as n, unique_count(user.name) as u by source.ip\n| where n > 50\n| sort n desc\n| head 100', "logs")
    assert p.text == 'FROM logs\n| WHERE event.category == "authentication" AND (event.outcome == "failure and x" AND source.ip IS NOT NULL OR NOT user.name IN ("a", "b"))\n| STATS n = COUNT(*), u = COUNT_DISTINCT(user.name) BY source.ip\n| WHERE n > 50\n| SORT n DESC\n| LIMIT 100'
    assert p.warnings == ["comment left out: from now-24h"]
    assert to_piped("any where true").text == "FROM events"
    assert to_piped('process where match(a, "x//y") and b like~ "*z*"').text.endswith('AND a RLIKE "x//y" AND b LIKE "*z*"')
    assert to_piped("process where true | dance 3 | tail 2").warnings == ["command not known: dance", "tail takes the first rows of the order in force: sort before it"]
    with pytest.raises(ValueError):
        to_piped("sequence by a [any where true] [any where true]")


def test_field_queries():
    assert to_piped('event.category: "web" AND user.name: ("a or b" or "c") AND NOT host.name: *srv* AND source.ip: * AND bytes: 5').text == 'FROM events\n| WHERE event.category == "web" AND user.name IN ("a or b", "c") AND NOT host.name LIKE "*srv*" AND source.ip IS NOT NULL AND bytes == 5'
    assert to_piped("*").text == to_piped("").text == "FROM events"


def test_direct_rendering():
    q = parse({"action": "filter+aggregate", "event_type": "http", "filter": {"operator": "or", "conditions": [{"field": "user", "op": "contains", "value": "x"}, {"field": "host", "op": "in", "value": ["a"]}]}, "aggregation": {"function": "distinct_count", "field": "src_ip", "group_by": ["user"], "alias": "n"}, "threshold": "> 3"})
    assert esql(q) == 'FROM events\n| WHERE event.category == "web" AND (user.name LIKE "*x*" OR host.name IN ("a"))\n| STATS n = COUNT_DISTINCT(source.ip) BY user.name\n| WHERE n > 3\n| SORT n DESC'


def test_new_language():
    from vigilframe import dialects as module

    register(Dialect("plain", lambda q: q.action))
    try:
        assert translate(parse({"action": "filter"}))["plain"] == "filter"
    finally:
        module._REGISTRY.pop("plain")


def test_pipeline(spark):
    rows = [(1, "Alert on more than 5 failed logons per user within 10 minutes"), (2, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    found = translations(df, "id", "t")
    assert found.count() == 5 and found.filter("is_valid").count() == 5
    assert [(r.id, r.n_valid, r.accepted) for r in accepted(found, "id").collect()] == [(1, 5, True)]

    def broken(text):
        raise ValueError(text)

    assert translations(df, "id", "t", broken).count() == 0


def test_nested(spark):
    df = spark.createDataFrame([(1, (2, ("x",)))], "a int, b struct<c:int,d:struct<e:string>>")
    assert flat_columns(df).columns == ["a", "b.c", "b.d.e"] and list(flat_columns(df).first()) == [1, 2, "x"]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(json_keys(F.lit('{"a":{"b":1},"c":[{"d":1}]}'))) == ["a", "a.b", "c"] and one(json_keys(F.lit("x"))) == []
    assert one(unit_offsets(F.lit("ab ab c"), F.array(*map(F.lit, ("ab", "ab", "c", "zz"))))) == [0, 3, 6, 7]
    assert [one(like(F.lit(v), "a?c*.e[x]")) for v in ("abcd.e[x]", "abcd-e[x]", "Abc.e[x]")] == [True, False, False]


def test_stateful_stream(spark, tmp_path):
    import datetime as dt

    from vigilframe.streaming import stateful_sequence

    t0 = dt.datetime(2024, 1, 1)
    rows = [("u1", 1, 0), ("u1", 2, 5), ("u1", 3, 9), ("u2", 1, 0), ("u2", 2, 180), ("u2", 3, 181), ("u3", 2, 1), ("u3", 1, 2)]
    spark.createDataFrame([(k, s, t0 + dt.timedelta(minutes=m)) for k, s, m in rows], "key string, step int, at timestamp").coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("key string, step int, at timestamp").parquet(str(tmp_path / "s"))
    setting = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stateful_sequence(stream, ["10m", "10m"]).writeStream.format("memory").queryName("chains").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset(setting)
    assert [(r.key, r.started, r.ended) for r in spark.table("chains").collect()] == [("u1", t0, t0 + dt.timedelta(minutes=9))]
