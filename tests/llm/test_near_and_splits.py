import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.llm.neardup import document_pairs, near_duplicate_groups, near_duplicates, prefix_keys, signatures
from vigilframe.llm.splits import assign_splits, connected_components, entity_components, linking_pairs


def brute(rows, threshold):
    sets = {i: frozenset(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in rows}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def texts(seed=1, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for i in range(n):
        base = ["find", "all", "events", "of", "the", "host", *(word() for _ in range(14))]
        for _ in range(rng.choice([1, 1, 3])):
            edited = [w for w in base if rng.random() > 0.05]
            rng.shuffle(edited)
            rows.append((len(rows), "  ".join(edited).upper() if rng.random() < 0.2 else ", ".join(edited)))
    return rows


@pytest.mark.parametrize("block", [20_000, 2])
def test_pairs_as_brute_force(spark, block):
    rows = texts() + [(10_001, None), (10_002, ""), (10_003, " -- "), (10_004, "one"), (10_005, "One!"), (10_006, "w " * 50_000)]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("words", F.lit(1)).withColumn("class", F.lit(2))
    members, links = near_duplicates(df, "id", F.col("t"), 0.6, block=block)
    got = [tuple(r) for r in document_pairs(members, links).collect()]
    want = brute(rows, 0.6)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(want - set(got)) <= 0.01 * len(want)
    assert (10_004, 10_005) in got


def test_groups_and_hot_copies(spark):
    rows = [(i, "the very same text for all of these rows") for i in range(400)] + [(900, "the very same text for all of these lines"), (901, "quite another thing here now")]
    members, links = near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t"), 0.6)
    assert links.count() == 1
    groups = {r.id: (r["class"], r.group, r.links) for r in near_duplicate_groups(members, links).collect()}
    assert groups[399] == (0, 0, 1) and groups[900] == (900, 0, 1) and groups[901] == (901, 901, 0)


def test_alike_by_common_words_only(spark):
    rng = random.Random(5)
    common = [f"common{k}" for k in range(60)]
    rare = lambda n: [f"r{rng.getrandbits(60):x}" for _ in range(n)]
    rows = [" ".join(rng.sample(common, 9) + rare(12)) for _ in range(800)]
    for _ in range(40):
        own = rng.sample(common, 9)
        rows += [" ".join(own + rare(3)), " ".join(own + rare(3))]  # rare words on both sides
        own = rng.sample(common, 9)
        rows += [" ".join(own), " ".join(own + rare(6))]  # inserted in one text
    rows = list(enumerate(rows))
    want = brute(rows, 0.6)
    got = {tuple(r) for r in document_pairs(*near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t"), 0.6)).collect()}
    assert len(want) >= 80 and got <= want and len(want - got) <= 0.03 * len(want)


def _edit(rng, common, kind):
    """Two texts of similarity 0.6 or more: (common words alike, of them different, rare alike, rare of the first, rare of the second)."""
    alike, apart, same, first, second = kind
    rare = lambda n: [f"r{rng.getrandbits(60):x}" for _ in range(n)]
    own, both = rng.sample(common, alike + 2 * apart), rare(same)
    return own[: alike + apart] + both + rare(first), own[:alike] + own[alike + apart :] + both + rare(second)


EDITS = {
    "5 rare inserted beside 12 common": (12, 0, 0, 0, 5),
    "4 rare inserted beside 6 common": (6, 0, 0, 0, 4),
    "2 rare of 8 replaced": (6, 0, 0, 2, 2),
    "3 rare of 12 replaced": (9, 0, 0, 3, 3),
    "common words only, at the threshold": (12, 4, 0, 0, 0),
    "common and rare replaced, some rare alike": (20, 2, 2, 2, 2),
    "mostly rare, 3 replaced": (4, 0, 8, 3, 3),
}


@pytest.fixture(scope="module")
def edited(spark):
    rng = random.Random(5)
    common = [f"common{k}" for k in range(60)]
    rows = [" ".join(_edit(rng, common, (9, 0, 0, 12, 0))[0]) for _ in range(1500)]
    pairs = {}
    for name, kind in EDITS.items():
        pairs[name] = []
        for _ in range(60):
            pairs[name].append((len(rows), len(rows) + 1))
            rows += [" ".join(t) for t in _edit(rng, common, kind)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, t string")
    return pairs, {tuple(r) for r in document_pairs(*near_duplicates(df, "id", F.col("t"), 0.6)).collect()}


@pytest.mark.parametrize("name", EDITS)
def test_recall_by_edit(edited, name):
    pairs, got = edited
    assert sum(p in got for p in pairs[name]) >= 0.95 * len(pairs[name])


def test_hot_band_values(spark):
    # a third of the texts has the same common words, and other rare ones: their bands are hot, though few of them are alike
    rng = random.Random(3)
    common = [f"common{k}" for k in range(60)]
    rare = lambda n: [f"r{rng.getrandbits(60):x}" for _ in range(n)]
    rows = [" ".join(common[:10] + rare(9)) for _ in range(500)] + [" ".join(rng.sample(common, 10) + rare(9)) for _ in range(700)]
    rows += [" ".join(t.split()[:12] + t.split()[14:]) for t in rows[:60] + rows[600:650]] + [" ".join(common[:10] + rare(2)) for _ in range(12)]
    rows = list(enumerate(rows))
    want = brute(rows, 0.6)
    df = spark.createDataFrame(rows, "id long, t string")
    got = {tuple(r) for r in document_pairs(*near_duplicates(df, "id", F.col("t"), 0.6, block=40)).collect()}
    assert len(want) >= 150 and got <= want and len(want - got) <= 0.01 * len(want)


def test_prefix_keys():
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(60), rng.randint(1, 40))) for _ in range(60)] + [sorted(rng.sample(range(40), 30)) for _ in range(40)]
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    tokens = np.concatenate([np.array(s) for s in sets])
    for t in (0.6, 0.8):
        keys = [set() for _ in sets]
        for i, k in zip(*prefix_keys(offsets, tokens, 1 / (1 + tokens % 7), t)):
            keys[i].add(int(k))
        for a, b in combinations(range(len(sets)), 2):
            if len(set(sets[a]) & set(sets[b])) >= t * len(set(sets[a]) | set(sets[b])):
                assert keys[a] & keys[b]


def test_empty_table(spark):
    members, links = near_duplicates(spark.createDataFrame([], "id long, t string"), "id", F.col("t"))
    assert document_pairs(members, links).count() == 0 and near_duplicate_groups(members, links).count() == 0


def test_collision_rate_is_the_weighted_similarity():
    rng = np.random.default_rng(2)
    a, b = np.arange(0, 40), np.arange(10, 50)
    weight = rng.uniform(0.05, 1, 50)
    tokens = np.concatenate((a, b)).astype(np.int64)
    s = signatures(np.array([0, 40, 80]), tokens, weight[tokens], 512)
    want = weight[10:40].sum() / weight.sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.08


def components(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(500, 500), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + edges[:5] + [(None, 3)], "src long, dst long")).collect()}
    assert got == components(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_splits(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, f"f{min(int(rng.expovariate(0.02)), 400)}"]), rng.choice([None, f"q{rng.randrange(4000)}"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, f string, q string").withColumn("component", F.lit("x"))
    members = entity_components(df, "id", {"f": F.col("f"), "q": F.col("q")})
    targets = spark.createDataFrame([("train", 0.7), ("validation", 0.15), ("test", 0.15)], "split string, share double")
    done = {r.id: r for r in assign_splits(members, targets).collect()}
    assert sorted(done) == list(range(3000))
    for column in (1, 2):
        of = {}
        for r in rows:
            if r[column] is not None:
                of.setdefault(r[column], set()).add((done[r[0]].component, done[r[0]].split))
        assert all(len(s) == 1 for s in of.values())
    lone = [r for r in rows if r[1] is None and r[2] is None]
    assert len({done[r[0]].component for r in lone}) == len(lone)


def test_shares_are_met(spark):
    members = spark.createDataFrame([(i, i // 3) for i in range(6000)], "id long, component long")
    targets = spark.createDataFrame([("train", 0.7), ("validation", 0.15), ("test", 0.15), ("none", None)], "split string, share double")
    n = {r.split: r["count"] for r in assign_splits(members, targets).groupBy("split").count().collect()}
    assert abs(n["train"] - 4200) < 30 and abs(n["test"] - 900) < 30 and "none" not in n
    assert assign_splits(members.filter("id < 0"), targets).count() == 0


def test_linking_pairs(spark):
    rows = [(1, "q", "A"), (2, "q", "B"), (3, "q", "A"), (4, "r", "A"), (5, "r", None), (6, None, "B"), (7, "s", "C"), (8, "s", "C")]
    df = spark.createDataFrame(rows, "id long, q string, f string")
    assert sorted(tuple(r) for r in linking_pairs(df, "id", F.col("q"), F.col("f")).collect()) == [(1, 2), (2, 3)]
    assert linking_pairs(df.filter("id > 9"), "id", F.col("q"), F.col("f")).count() == 0


def test_linking_pairs_of_a_hot_value(spark, monkeypatch):
    monkeypatch.setattr("vigilframe.llm.splits.PAIR_BLOCK", 10)
    rows = [(i, "hot", "AB"[i % 20 == 0]) for i in range(200)] + [(i, f"q{i}", "C") for i in range(200, 260)]
    df = spark.createDataFrame(rows + [(0, "hot", "B")], "id long, q string, f string").withColumn("_k", F.lit(1)).withColumn("node", F.lit("x"))
    got = [tuple(r) for r in linking_pairs(df, "id", F.col("q"), F.col("f")).collect()]
    want = [(a, b) for (a, p, f), (b, q, g) in combinations(rows, 2) if p == q and f != g]
    assert len(set(got)) == len(want) and set(got) == set(want)


def test_linking_pairs_come_from_components_and_splits(spark, monkeypatch):
    # a ring of families, too long for one step and without leaves; questions of one family; rows that stand at a question
    rows = [(2 * i + k, f"q{i}", f"f{(i + k) % 30}") for i in range(30) for k in range(2)] + [(100 + i, f"own{i // 2}", "f0") for i in range(20)] + [(200, "q3", None), (201, None, "f9"), (202, None, None)]
    df = spark.createDataFrame(rows, "id long, q string, f string")
    targets = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "split string, share double")
    want = {(a, b) for (a, p, f), (b, q, g) in combinations(rows, 2) if p and p == q and f and g and f != g}
    found = lambda t=None: sorted(tuple(r) for r in linking_pairs(df, "id", F.col("q"), F.col("f"), t).collect())
    assert len(want) == 30 and found() == found(targets) == found(targets.withColumn("share", -F.col("share"))) == sorted(want)
    whole = connected_components
    # the first step alone doesn't bring the ring together; without its links nothing is paired
    monkeypatch.setattr("vigilframe.llm.splits._stars", lambda pairs: pairs)
    assert len(found(targets)) < 30
    monkeypatch.undo()
    monkeypatch.setattr("vigilframe.llm.splits.connected_components", lambda edges: whole(edges.limit(0)))
    assert found(targets) == []


def test_p2_found_runs_components_and_splits(spark, small, monkeypatch):
    from vigilframe.llm import queries, splits

    ran = []
    for name in ("_stars", "connected_components", "assign_splits"):
        monkeypatch.setattr(splits, name, lambda *a, _f=getattr(splits, name), _n=name: ran.append(_n) or _f(*a))
    got = {tuple(r) for r in queries.p2_found(spark, small).collect()}
    assert ran == ["connected_components", "_stars", "assign_splits"]
    monkeypatch.undo()
    split = {r.ex_id: (r.component, r.split) for r in queries.p2_splits(spark, small).collect()}
    assert got and all(split[a] == split[b] for a, b in got)
