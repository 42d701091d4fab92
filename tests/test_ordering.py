import random

from pyspark.sql import functions as F

from vigilframe.operators.commands import sequence_until
from vigilframe.operators.evaluation import nearest_rank
from vigilframe.operators.benchmark import stratified_split
from vigilframe.operators.ordering import number_rows, number_within, running


def test_number_rows(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3).repartition(7)
    got = number_rows(df, [F.asc("k"), F.desc("id")], "n").orderBy("n").collect()
    assert [(r.k, -r.id) for r in got] == sorted((r.k, -r.id) for r in got) and [r.n for r in got] == list(range(1, 1001))
    assert number_rows(df.filter("id < 0"), [F.asc("id")], "n").count() == 0
    within = number_within(df.withColumn("n", F.lit("x")).withColumn("k", F.nullif("k", F.lit(1))), ["k"], [F.desc("id")], "at").collect()
    for k in (0, None, 2):
        own = sorted((r for r in within if r.k == k), key=lambda r: r.at)
        assert [r.id for r in own] == sorted((r.id for r in own), reverse=True) and [r.at for r in own] == list(range(1, len(own) + 1))


def test_running_over_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, 1, 2, 7]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "t long, k string, v int, w long").repartition(9)
    got = {r.t: r for r in running(df, ["k"], ["t"], {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "v": ("last", F.col("v"))}).collect()}
    seen = {}
    for t, k, v, _ in rows:
        own = seen.setdefault(k, [])
        own.append(v)
        known = [x for x in own if x is not None]
        want = (len(own), sum(known) if known else None, min(known, default=None), max(known, default=None), known[-1] if known else None)
        r = got[t]
        assert (r.n, r.s, r.lo, r.hi, r.v) == want and r.k == k and r.w == t
    assert running(df.filter("t < 0"), ["k"], ["t"], {"n": ("count", F.lit(1))}).count() == 0


def test_ranks_and_splits(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.choice([None, rng.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, g string, v double")
    got = {r.g: r.p for r in nearest_rank(df, "v", {"p": 95}, ["g"]).collect()}
    for g in "ab":
        own = sorted(v for _, h, v in rows if h == g and v is not None)
        assert got[g] == round(own[round(0.95 * (len(own) - 1))], 2)
    split = stratified_split(df.withColumn("t", F.col("i") % 100), "t", "g").groupBy("split").agg(F.count_distinct("t").alias("n")).collect()
    assert {r.split: r.n for r in split} == {"train": 70, "validation": 15, "test": 15}


def test_stops_between(spark):
    rng = random.Random(6)
    at = lambda s: f"timestamp_seconds({s})"
    chains = [(rng.choice("hhab"), a, a + rng.choice([0, 1, 50, 9000])) for a in (rng.randrange(40_000) for _ in range(200))]
    stops = [(rng.choice("hab"), rng.randrange(50_000)) for _ in range(60)] + [(None, 5), ("h", None)]
    c = spark.createDataFrame(chains, "key string, a long, b long").selectExpr("key", f"{at('a')} a", f"{at('b')} b")
    s = spark.createDataFrame(stops, "key string, t long").selectExpr("key", f"{at('t')} t")
    got = sorted((r.key, int(r.a.timestamp()), int(r.b.timestamp())) for r in sequence_until(c, s, "key", "t", "a", "b").collect())
    assert got == sorted(x for x in chains if not any(k == x[0] and t is not None and x[1] < t < x[2] for k, t in stops))
