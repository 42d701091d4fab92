import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.llm.mixing import mixture, short_sources, source_sizes, water_fill
from vigilframe.llm.ranking import Score, ideal_point_ranking, order_statistics
from vigilframe.llm.sampling import OTHER, categorised, json_field, proportional_sample, quotas, round_table

TARGETS = "dim string, category string, target_share double, min_rows int"


@pytest.mark.parametrize("seed", range(30))
def test_controlled_rounding(seed):
    rng = np.random.default_rng(seed)
    table = rng.uniform(0, 5, (rng.integers(1, 7), rng.integers(1, 7)))
    table *= rng.integers(1, 60) / table.sum()
    out = round_table(table)
    assert out.sum() == round(table.sum())
    assert (np.abs(out - table) < 1).all()
    assert (np.abs(out.sum(0) - table.sum(0)) < 1).all() and (np.abs(out.sum(1) - table.sum(1)) < 1).all()


def test_quotas_follow_margins():
    counts = np.full((4, 3, 2), 1000)
    wanted = [np.array([40.0, 30, 20, 10]), np.array([50.0, 30, 20]), np.array([60.0, 40])]
    q = quotas(counts, wanted, 100)
    assert q.sum() == 100 and all(np.abs(q.sum(tuple(a for a in range(3) if a != k)) - w).max() <= 1 for k, w in enumerate(wanted))
    assert quotas(np.zeros((2, 2), int), [np.zeros(2), np.zeros(2)], 0).sum() == 0


@pytest.mark.parametrize("seed", range(12))
def test_margins_are_met_where_they_can_be(seed):
    # margins of a table within the counts: so one exists, however tight the counts are
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 40, (5, 3, 4))
    held = rng.binomial(counts, rng.choice([0.3, 0.9]))
    others = [(1, 2), (0, 2), (0, 1)]
    wanted = [held.sum(o).astype(float) for o in others]
    q = quotas(counts, wanted, int(held.sum()))
    assert (q >= 0).all() and (q <= counts).all() and q.sum() == held.sum()
    assert all((q.sum(o) == w).all() for o, w in zip(others, wanted))


def test_report_of_what_is_drawn(spark):
    # all rows of x are in a: 60 of a and 60 of y can't be had together
    rows = [(i, "a", "x") for i in range(60)] + [(i, "b", "y") for i in range(60, 120)]
    targets = spark.createDataFrame([("u", "a", 0.9, 0), ("u", "b", 0.1, 0), ("v", "x", 0.1, 0), ("v", "y", 0.9, 0)], TARGETS)
    df = categorised(spark.createDataFrame(rows, "id long, u string, v string"), targets, {"u": F.col("u"), "v": F.col("v")}, ["id"])
    report = {r.category: r for r in proportional_sample(df, targets, "id", ["u", "v"], 0.5)[1].collect()}
    assert not any(r.scarce for r in report.values())
    assert report["a"].unmet or report["y"].unmet
    assert all(r.unmet == (r.drawn < r.target_share * 60) for r in report.values())


def test_sample(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b"]), rng.choice(["x", "y", None])) for i in range(4000)] + [(5000, "c", "x"), (5000, "c", "x")]
    targets = spark.createDataFrame([("u", "a", 0.5, 1), ("u", "b", 0.4, 1), ("u", "c", 0.1, 3), ("v", "x", 0.5, 0), ("v", "y", 0.5, None), (None, "a", 0.5, 1), ("u", None, 0.5, 1)], TARGETS)
    df = categorised(spark.createDataFrame(rows, "id long, u string, v string").withColumn("quota", F.lit(1)), targets, {"u": F.col("u"), "v": F.col("v")}, ["id"])
    sample, report = proportional_sample(df, targets, "id", ["u", "v"])
    got = sample.collect()
    assert len(got) == 800 and len({r.id for r in got if r.id < 5000}) == sum(r.id < 5000 for r in got)
    assert sum(r.u == "c" for r in got) == 2 and not any(r.v == OTHER for r in got)
    assert abs(sum(r.v == "x" for r in got) - 400) <= 1
    assert {(r.dim, r.category) for r in report.filter("unmet").collect()} == {("u", "c")}
    assert sorted(r.id for r in sample.collect()) == sorted(r.id for r in got)
    empty, report = proportional_sample(df.filter("id < 0"), targets, "id", ["u", "v"])
    assert empty.count() == 0 and report.count() == 5


def test_json_field(spark):
    rows = [(1, '{"Action": " Filter + Aggregate "}'), (2, None), (3, "{"), (4, '"{\\"action\\": \\"lookup\\"}"'), (5, '{"action": 3}'), (6, "[]")]
    got = {r.id: r.action for r in json_field(spark.createDataFrame(rows, "id long, ir string"), "ir", "action", "action").collect()}
    assert got == {1: "filter+aggregate", 2: None, 3: None, 4: "lookup", 5: None, 6: None}


def brute_rank(rows, tail):
    scaled = [[x / h if x is not None and not math.isnan(x) and 0 <= x <= h else None for x, h in zip(r[1:], (100, 1))] for r in rows]
    near, far = [0.0] * len(rows), [0.0] * len(rows)
    for k in range(2):
        own = sorted(s[k] for s in scaled if s[k] is not None)
        at = lambda p: own[max(1, math.ceil(p * len(own))) - 1]  # noqa: B023, E731
        low, mid, high = at(tail), at(0.5), at(1 - tail)
        x = [min(max(mid if s[k] is None else s[k], low), high) for s in scaled]
        length = math.sqrt(sum(v * v for v in x)) or 1
        near = [a + ((v - high) / length) ** 2 for a, v in zip(near, x)]
        far = [a + ((v - low) / length) ** 2 for a, v in zip(far, x)]
    c = [math.sqrt(b) / (math.sqrt(a) + math.sqrt(b)) if a + b else 0.5 for a, b in zip(near, far)]
    order = sorted(range(len(rows)), key=lambda i: (-round(c[i], 14), rows[i][0]))
    return [(rows[i][0], c[i]) for i in order]


def test_ranking(spark):
    rng = random.Random(2)
    odd = [None, float("nan"), -1.0, 5000.0]
    rows = [(i, rng.choice([round(rng.uniform(0, 100), 2)] * 3 + [rng.uniform(40, 40.0001)] * 3 + odd), rng.choice([rng.random()] * 6 + odd)) for i in range(300)] + [(400 + i, 50.0, 0.5) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, s double, t double").withColumn("rank", F.lit("x")).withColumn("closeness", F.lit(1))
    scores = [Score("s", 0, 100), Score("t")]
    got = ideal_point_ranking(df, "id", scores).orderBy("rank").collect()
    want = brute_rank(rows, 0.01)
    assert [r["rank"] for r in got] == list(range(1, len(rows) + 1))
    assert [(r.id, pytest.approx(r.closeness, abs=2e-9)) for r in got] == want
    assert ideal_point_ranking(df.filter("id < 0"), "id", scores).count() == 0
    assert {r.closeness for r in ideal_point_ranking(spark.createDataFrame([(1, None, None), (None, None, None)], "id long, s double, t double"), "id", scores).collect()} == {0.5}


def test_no_score_outweighs_by_its_scale(spark):
    rows = [(i, float(i % 10), (9 - i % 10) / 10) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, s double, t double")
    a = [r.id for r in ideal_point_ranking(df, "id", [Score("s", 0, 10), Score("t")]).orderBy("rank").collect()]
    b = [r.id for r in ideal_point_ranking(df.withColumn("s", F.col("s") * 1000), "id", [Score("s", 0, 10_000), Score("t")]).orderBy("rank").collect()]
    assert a == b


def test_order_statistics_are_exact(spark):
    rng = random.Random(9)
    # most values lie so near to each other that several passes are needed to tell them apart
    rows = [(0.3 + rng.random() * 1e-12, None if i % 7 else 0.25, None) for i in range(3000)] + [(rng.random(), 1.0, None) for _ in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = order_statistics(df, ["a", "b", "c"], [0.01, 0.5, 0.99, 1.0])
    for k, c in enumerate("ab"):
        own = sorted(r[k] for r in rows if r[k] is not None)
        assert got[c] == [own[max(1, math.ceil(p * len(own))) - 1] for p in (0.01, 0.5, 0.99, 1.0)]
    assert got["c"] == [None] * 4


def test_finer_scores_are_told_apart(spark):
    df = spark.createDataFrame([(i, 0.5 + i * 1e-9) for i in range(50)] + [(100, 0.0), (101, 1.0)], "id long, s double")
    got = [r.id for r in ideal_point_ranking(df, "id", [Score("s")], tail=0.0).orderBy("rank").collect()]
    assert got == [101, *range(49, -1, -1), 100]


def test_water_fill():
    given, clamped = water_fill({"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, {"a": 10, "b": 1000, "c": 1000, "d": 5}, {"a": 2, "b": 1, "c": 1, "d": 9}, 200)
    assert given == {"a": 20, "b": pytest.approx(108), "c": pytest.approx(72), "d": 0} and clamped == {"a": 1}
    # what a can't give takes b over its cap, too, but only in the second pass; e holds exactly its weight
    given, clamped = water_fill({"a": 0.4, "b": 0.3, "c": 0.2, "e": 0.1}, {"a": 10, "b": 70, "c": 1000, "e": 20}, {"a": 1, "b": 1, "c": 1, "e": 1}, 200)
    assert clamped == {"a": 1, "b": 2, "e": 2} and sum(given.values()) == pytest.approx(200)
    assert water_fill({"x": 0.5, "y": 0.5}, {"x": 0, "y": 80}, {"x": 3, "y": 1}, 50) == ({"x": 0.0, "y": 50.0}, {"x": 1})
    assert sum(water_fill({"a": 1.0}, {"a": 10}, {"a": 3}, 100)[0].values()) == 30 and water_fill({}, {}, {}, 5) == ({}, {})


def test_mixture(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, rng.choice(["a", "b", "b", "b", None]), rng.randint(0, 40)) for i in range(4000)] + [(9000, "tiny", 7), (9001, "unlisted", 50)], "id long, source string, tokens long").withColumn("times", F.lit(0))
    targets = spark.createDataFrame([("a", 0.6, 3), ("b", 0.3, 1), ("tiny", 0.1, 2), ("absent", 0.0, 4), ("absent", None, None), (None, 0.5, 1)], "source string, weight double, max_repeats int")
    mixed, shares = mixture(docs, targets, "id")
    of = {r.source: r for r in shares.collect()}
    assert abs(of["a"].actual_tokens - of["a"].wanted_tokens) <= 41 and of["tiny"].actual_tokens == 14 and of["tiny"].capped and of["absent"].actual_tokens == 0
    times = {}
    for r in mixed.collect():
        times.setdefault((r.source, r.id), []).append(r.repeat)
    assert all(sorted(v) == list(range(len(v))) and len(v) <= {"a": 3, "b": 1, "tiny": 2}[k[0]] for k, v in times.items())
    assert sum(r.actual_share for r in of.values()) == pytest.approx(1)
    sizes, total = source_sizes(docs, targets)
    short = {r.source for r in short_sources(sizes, total).collect()}
    assert "tiny" in short and "absent" not in short
    nothing, shares = mixture(docs.filter("id < 0"), targets, "id")
    assert nothing.count() == 0 and shares.count() == 4
