import datetime as dt
import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from vigilframe import core_queries
from vigilframe.dialects.checking import check, clean_reply, suggestion
from vigilframe.functions.scores import bleu, combined, common_subsequence, edit_distance, edit_similarity, field_match, grade, query_fields, rouge_l, score_pairs
from vigilframe.functions.text import chunk_id, duration_literal, duration_seconds, normal_query, platform_of_path, sub_technique_ok, technique_ok, unit_chunks
from vigilframe.operators.commands import in_cidr
from vigilframe.operators import vectors
from vigilframe.operators.vectors import hashing_embedding, mmr
from vigilframe.sources import files
from vigilframe.sources.connector import connect


@pytest.mark.parametrize("name", ["filter_nested", "brute_force", "sequence_three", "frequency_rule", "transactions_unkeyed", "coverage", "word_chunks", "latency_percentiles"])
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("events", "customer", "examples", "technique_entries", "documents", "ablation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    mine = __spark_entry__.queries()[name](spark, small).toPandas()
    theirs = con.execute(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    plain = lambda df: sorted(map(str, df[columns].astype(str).to_numpy().tolist()))
    assert plain(mine) == plain(theirs)


def test_every_core_query_is_registered():
    assert set(core_queries.SQL) <= set(core_queries.QUERIES) <= set(__spark_entry__.queries())


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def brute_edits(a, b):
    t = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = min(t[i][j + 1] + 1, t[i + 1][j] + 1, t[i][j] + (a[i] != b[j]))
    return t[-1][-1]


def test_scores():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randint(0, 14)) for _ in "ab")
        assert common_subsequence(a, b) == brute_lcs(a, b)
        assert edit_distance(a, b) == brute_edits(a, b)
    assert bleu("a b c d e".split(), "a b c d e".split()) == 1 and bleu(["a"], ["b"]) == 0 and bleu([], ["a"]) == 0
    assert bleu("a b c d".split(), "a b c d e".split()) == round(math.exp(1 - 5 / 4), 6)
    assert rouge_l(["a", "x"], ["a", "y"]) == 0.5 and edit_similarity(["a", "x"], ["a", "y", "z"]) == round(1 / 3, 6) and edit_similarity([], []) == 1


def test_score_pairs(spark):
    rows = [("index=a src_ip=1 | stats count by user", "index=a src_ip=1 | stats count by user"), (None, "index=a src_ip=1"), ('x where source.ip == "1"', "SELECT sourceip FROM events WHERE sourceip = 1")]
    got = score_pairs(spark.createDataFrame(rows, "m string, r string").withColumn("p", F.lit("qradar")), "m", "r", platform="p").collect()
    assert got[0].semantic_score == 1 and got[0].grade == "EXCELLENT" and got[1].bleu == 0 and got[2].field_f1 == 1
    with pytest.raises(ValueError):
        combined({"bleu": 0.5})
    f = spark.createDataFrame([(["a", "b"], ["b", "c"])], "m array<string>, r array<string>").select(field_match(F.col("m"), F.col("r")).alias("f"), grade(F.lit(0.7)).alias("g"), query_fields(F.lit('<field name="srcip">'), "wazuh").alias("q")).first()
    assert (f.f.f1, f.f.missing, f.f.extra, f.g, f.q) == (0.5, ["c"], ["a"], "GOOD", ["src_ip"])


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_text_functions(spark):
    assert one(spark, duration_seconds(F.lit("3h")), duration_seconds(F.lit("x")), duration_literal(F.lit("3h"), "qradar"), duration_literal(F.lit("3h"), "splunk")) == [10800, None, "LAST 3 HOURS", "-3h"]
    assert one(spark, normal_query(F.lit("A  # note\n b")), platform_of_path(F.lit("x/knowledge_base/wazuh/a.txt")), platform_of_path(F.lit("a")), chunk_id(F.lit("a/b.txt"), F.lit(3))) == ["a b", "wazuh", "unknown", "a_b.txt__chunk_0003"]
    assert one(spark, technique_ok(F.lit("T1110")), technique_ok(F.lit("T11")), sub_technique_ok(F.lit("T1110.001"), F.lit("T1110")), sub_technique_ok(F.lit("T1110.001"), F.lit("T1111"))) == [True, False, True, False]


def test_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(str(k) for k in range(512))), (2, "few words"), (3, None), (4, "One. Two! Three?")], "id long, t string")
    assert [r.n_units for r in unit_chunks(df, "t").orderBy("id", "chunk_idx").collect()] == [512, 64]
    assert [r.chunk for r in unit_chunks(df.filter("id = 4"), "t", 2, 1, 1, "sentence").orderBy("chunk_idx").collect()] == ["One. Two!", "Two! Three?", "Three?"]
    assert unit_chunks(df.filter("id = 2"), "t", 4, 0, 1, "char").count() == 3


def test_cidr(spark):
    rows = [("10.0.0.1", True), ("10.0.1.0", False), ("10.0.0", None), (None, None), ("10.0.0.300", None)]
    got = spark.createDataFrame(rows, "ip string, want boolean").select("want", in_cidr(F.col("ip"), "10.0.0.0/24").alias("got")).collect()
    assert all(r.want == r.got for r in got)


QUERIES = [
    ("splunk", "index=a x=1 | stats count by user", None), ("splunk", "user=1", "missing_keyword"), ("splunk", "index=a | dance", "unknown_command"), ("splunk", 'index=a x="p|q" | head 3', None), ("splunk", "", "empty_query"), ("splunk", None, "empty_query"),
    ("qradar", "SELECT a FROM events LAST 1 HOURS", None), ("qradar", "GET a", "missing_keyword"), ("qradar", "SELECT a FROM t", "missing_keyword"), ("qradar", "SELECT a FROM events GROUP BY a", "missing_aggregate"), ("qradar", "SELECT a FROM events HAVING a > 1", "malformed_syntax"),
    ("elastic", 'process where a == "b"', None), ("elastic", "process a", "missing_keyword"), ("elastic", "sequence by a", "malformed_syntax"), ("elastic", "user.name: x", None), ("elastic", "hello there", "malformed_syntax"),
    ("sentinel", "SecurityEvent\n| where a == 1", None), ("sentinel", "SecurityEvent", "malformed_syntax"), ("sentinel", "T | dance x", "unknown_command"),
    ("wazuh", '<rule id="100002" level="3"><description>d</description></rule>', None), ("wazuh", "<rule", "invalid_xml"), ("wazuh", "<a></a>", "malformed_syntax"), ("wazuh", '<rule level="1"></rule>', "field_error"), ("wazuh", '<rule id="1" level="2"></rule>', "missing_keyword"),
    ("other", "x", None), ("other", " ", "empty_query"),
]


def test_static_checks(spark):
    df = spark.createDataFrame([(i, *q) for i, q in enumerate(QUERIES)], "i long, p string, q string, want string")
    got = df.select("q", "p", "want", check(F.col("p"), F.col("q")).alias("c")).collect()
    assert [(r.p, r.q, r.c.error_type) for r in got] == [(r.p, r.q, r.want) for r in got]
    assert all(r.c.is_valid == (r.want is None) for r in got)
    fixed = df.filter("q = 'user=1'").withColumn("c", check(F.col("p"), F.col("q"))).select(suggestion(F.col("p"), F.col("q"), F.col("c"))).first()[0]
    assert fixed == "index=* user=1"
    assert one(spark, clean_reply(F.lit("Here:\n```spl\nindex=a\n```")), clean_reply(F.lit("so: <rule id='1'></rule> ok"))) == ["index=a", "<rule id='1'></rule>"]


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    v = [base / np.linalg.norm(base), base / np.linalg.norm(base), rng.normal(size=8)]
    v[2] /= np.linalg.norm(v[2])
    df = spark.createDataFrame([(i, [float(y) for y in x], 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    q = spark.createDataFrame([(1, [float(y) for y in v[0]])], "query_id long, query array<double>")
    assert [r.vec_id for r in mmr(df, q, 2, balance=0.3).orderBy("rank").collect()] == [0, 2]
    many = spark.createDataFrame([(i, [float(y) for y in rng.normal(size=4)]) for i in range(300)], "vec_id long, embedding array<double>")
    asked = many.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    whole = {(r.query_id, r.rank): r.vec_id for r in vectors.top_k(many, asked, 3).collect()}
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 50)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 70)
    assert {(r.query_id, r.rank): r.vec_id for r in vectors.top_k(many, asked, 3).collect()} == whole and len(whole) == 900
    e = spark.createDataFrame([(["a", "b"],), ([],)], "w array<string>").select(hashing_embedding(F.col("w"), 16).alias("e")).collect()
    assert abs(sum(x * x for x in e[0].e) - 1) < 1e-9 and len(e[1].e) == 16


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\""), (2, None)], "i long, s string")
    files.write_json(df, str(tmp_path / "j"))
    files.append_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl_strict(spark, str(tmp_path / "j"), "i long, s string").count() == 4
    (tmp_path / "bad.jsonl").write_text('{"i": 1, "s": "x"}\nnot json\n\n{"i": 2}\n')
    good, bad = files.read_jsonl_lenient(spark, str(tmp_path / "bad.jsonl"), "i long, s string")
    assert sorted(r.i for r in good.collect()) == [1, 2] and [r.line for r in bad.collect()] == ["not json"]
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ"):
        files.read_jsonl_strict(spark, str(tmp_path / "bad.jsonl"), "i long, s string").collect()
    files.write_csv(df, str(tmp_path / "c"), ["s", "i"])
    back = files.read_csv(spark, str(tmp_path / "c"))
    assert back.columns == ["s", "i"] and {r.s for r in back.collect()} == {'a,"b"', None}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes("é".encode())
    (tmp_path / "t" / "b.txt").write_bytes("é".encode("latin-1"))
    assert [r.text for r in files.read_texts(spark, str(tmp_path / "t"), "*.txt").collect()] == ["é", "é"]
    assert {r.bytes for r in files.manifest(spark, str(tmp_path / "t")).collect()} == {1, 2}
    assert files.latest_file(spark, str(tmp_path / "t"), "*.txt").endswith("b.txt")
    assert files.markdown(df).splitlines()[1] == "|---|---|" and r"\begin{tabular}" in files.latex(df)
    bundle = {"objects": [{"type": "x-mitre-tactic", "name": "N", "x_mitre_shortname": "n", "external_references": [{"external_id": "TA0001"}]}, {"type": "attack-pattern", "name": "P", "x_mitre_is_subtechnique": True, "external_references": [{"external_id": "T1000.001"}], "kill_chain_phases": [{"phase_name": "n"}]}, {"type": "attack-pattern", "name": "Old", "revoked": True, "external_references": [{"external_id": "T1"}]}]}
    (tmp_path / "stix.json").write_text(json.dumps(bundle, indent=1))
    tactics, techniques = files.read_stix(spark, str(tmp_path / "stix.json"))
    assert tactics.count() == 1 and [(r.technique_id, r.parent_id, r.tactic_names) for r in techniques.collect()] == [("T1000.001", "T1000", ["n"])]
    files.save_index(df.withColumn("p", F.lit("x")), str(tmp_path / "i"), "p")
    files.save_index(df.limit(1).withColumn("p", F.lit("y")), str(tmp_path / "i"), "p")
    assert files.load_index(spark, str(tmp_path / "i")).count() == 3
    assert connect(spark, "json_folder", path=str(tmp_path / "bad.jsonl")).count() == 3
    with pytest.raises(ValueError):
        connect(spark, "nowhere")


def test_streams(spark, tmp_path):
    from vigilframe.plans.fields import Binding
    from vigilframe.plans.query import parse
    from vigilframe.streaming import session_counts, two_step_sequence, windowed_query

    t0 = dt.datetime(2024, 1, 1)
    rows = [("u1", "error", t0 + dt.timedelta(minutes=m)) for m in (0, 1, 2, 65)] + [("u1", "purchase", t0 + dt.timedelta(minutes=5)), ("u2", "error", t0 + dt.timedelta(days=2))]
    spark.createDataFrame(rows, "user string, kind string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = lambda: spark.readStream.schema("user string, kind string, at timestamp").parquet(str(tmp_path / "s"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    q = parse({"action": "filter+aggregate", "filter": {"conditions": [{"field": "kind", "op": "eq", "value": "error"}]}, "time_window": "1h", "aggregation": {"function": "count", "group_by": ["user"], "alias": "n"}, "threshold": ">= 3"})
    assert [(r.user, r.n) for r in run(windowed_query(stream(), q, Binding(), "at"), "w1")] == [("u1", 3)]
    assert {(r.user, r.events) for r in run(session_counts(stream(), "user", "at", "30 minutes"), "w2")} == {("u1", 4), ("u1", 1)}
    pairs = run(two_step_sequence(stream().filter("kind = 'error'"), stream().filter("kind = 'purchase'"), "user", "at", "30m"), "w3")
    assert len(pairs) == 3 and {r.key for r in pairs} == {"u1"}


def test_released_checkpoints_are_gone(spark):
    from vigilframe.durable import cut, release

    kept, gone = cut(spark.range(10)), cut(spark.range(20))
    file = lambda df: df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
    at = [file(df).removeprefix("file:") for df in (kept, gone)]
    import os

    assert all(map(os.path.isdir, at))
    release(gone)
    assert os.path.isdir(at[0]) and not os.path.exists(at[1]) and kept.count() == 10


def test_nearest_of_every_part(spark, monkeypatch):
    import numpy as np

    from vigilframe.operators import vectors as V

    rng = np.random.default_rng(1)
    rows = [(i, None if i % 5 == 0 else f"p{i % 3}", None if i == 7 else [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, part string, embedding array<double>")
    queries = df.filter("vec_id % 10 = 0").selectExpr("vec_id query_id", "embedding query")
    of = {i: np.array(v) for i, _, v in rows if v}
    want = set()
    for q in range(0, 60, 10):
        for p in (None, "p0", "p1", "p2"):
            own = sorted((i for i, g, v in rows if g == p and v), key=lambda i: (-float(of[i] @ of[q]), i))
            want |= {(q, p, i, k + 1) for k, i in enumerate(own[:2])}
    got = lambda: {(r.query_id, r.part, r.vec_id, r["rank"]) for r in V.top_k_per(df, queries, 2, "part").collect()}
    assert got() == want
    monkeypatch.setattr(V, "QUERY_BLOCK", 2)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 13)
    assert got() == want
    assert V.top_k_per(df, queries.filter("query_id < 0"), 2, "part").count() == 0
