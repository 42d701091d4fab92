import datetime as dt
import random

from pyspark.sql import functions as F

from vigilframe.operators.windows import eventstats, frequency, sessions

T0 = dt.datetime(2024, 1, 1)


def some(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", None]), T0 + dt.timedelta(seconds=rng.randrange(20_000)), i) for i in range(n)]


def test_frequency_as_brute_force(spark):
    rows = some(1)
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i long")
    got = {(r.i, r.in_span) for r in frequency(df, ["k"], "t", 300, 3).collect()}
    count = lambda r: sum(x[0] == r[0] and r[1] - dt.timedelta(seconds=300) <= x[1] <= r[1] for x in rows)
    assert got == {(r[2], count(r)) for r in rows if count(r) >= 3}


def test_sessions_as_brute_force(spark):
    for keys in (["k"], []):
        rows = some(2) + [("a", None, 999)]
        want = set()
        for key in {r[0] for r in rows} if keys else {None}:
            own = sorted(r[1] for r in rows if r[1] and (not keys or r[0] == key))
            groups = [[own[0]]]
            for x in own[1:]:
                if x - groups[-1][-1] > dt.timedelta(seconds=120):
                    groups.append([])
                groups[-1].append(x)
            want |= {(*([key] if keys else []), n, g[0], g[-1], len(g)) for n, g in enumerate(groups)}
        got = {tuple(r) for r in sessions(spark.createDataFrame(rows, "k string, t timestamp_ntz, i long"), keys, "t", 120).collect()}
        assert got == want


def test_eventstats_keeps_null_groups(spark):
    df = spark.createDataFrame(some(3), "k string, t timestamp_ntz, i long")
    got = eventstats(df, ["k"], n=F.count(F.lit(1)))
    assert got.count() == 400 and got.columns == ["k", "t", "i", "n"]
    assert got.filter("k is null").select("n").distinct().first().n == df.filter("k is null").count()


def test_clock_changes_move_nothing(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        times = [dt.datetime(2024, 3, 10, 1, 30), dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 3, 10, 3, 30), dt.datetime(2024, 11, 3, 0, 50), dt.datetime(2024, 11, 3, 2, 10)]
        df = spark.createDataFrame([("a", t, i) for i, t in enumerate(times)], "k string, t timestamp_ntz, i long")
        assert sorted((r.started, r.events) for r in sessions(df, ["k"], "t", 3600).collect()) == [(times[0], 3), (times[3], 1), (times[4], 1)]
        assert {(r.i, r.in_span) for r in frequency(df, ["k"], "t", 3600, 2).collect()} == {(1, 2), (2, 2)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
