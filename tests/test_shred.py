import json
import random

import numpy as np

from vigilframe.operators.jsontext import _decode_deep, read
from vigilframe.operators.shred import QUERY_SCHEMA, columns, flatten, node_table, ordinal_above, ordinal_in_list, shred


def walk(doc):
    """Brute force: the nodes of a document by recursion."""
    found = []

    def get(o, key):
        value = o.get(key)
        if isinstance(value, str):
            held = read(value)
            value = held if isinstance(held, (dict, list)) else value
        return value

    def items(v):
        return [] if v is None else v if isinstance(v, list) else [v]

    def plain(x):
        held = read(x) if isinstance(x, str) else x
        return held if isinstance(held, (dict, list)) else x

    def tree(o, path, up):
        o = plain(o)
        if not isinstance(o, dict):
            return
        if "conditions" in o:
            found.append(("group", path, up))
            for k, c in enumerate(items(get(o, "conditions"))):
                tree(c, f"{path}.conditions[{k}]", path)
        elif "field" in o:
            found.append(("condition", path, up))

    def filters(o, path, up):
        v = get(o, "filter")
        if isinstance(v, list):
            for k, c in enumerate(v):
                tree(c, f"{path}[{k}]", up)
        else:
            tree(v, path, up)

    if not isinstance(doc, dict):
        return found
    filters(doc, "filter", "")
    a = get(doc, "aggregation")
    if isinstance(a, dict) and a:
        found.append(("aggregation", "aggregation", ""))
        for k, g in enumerate(items(get(a, "groupby"))):
            if g is not None:
                found.append(("group_by", f"aggregation.group_by[{k}]", "aggregation"))
    look = get(doc, "lookup")
    for k, v in enumerate(look if isinstance(look, list) else [look]):
        v = plain(v)
        if isinstance(v, dict) and v:
            found.append(("lookup", f"lookup[{k}]" if isinstance(look, list) else "lookup", ""))
    for k, s in enumerate(items(get(doc, "sequence"))):
        s = plain(s)
        if isinstance(s, dict) and s:
            found.append(("step", f"sequence[{k}]", ""))
            filters(s, f"sequence[{k}].filter", f"sequence[{k}]")
    return found


def some(rng, depth=0):
    kind = rng.random()
    if kind < 0.1:
        return None
    if kind < 0.45 or depth > 4:
        return {"field": "f", "op": "eq", "value": rng.choice([1, "x", None])}
    key = rng.choice(["conditions", "Conditions", "CONDITIONS"])
    return {"operator": "and", key: rng.choice([[some(rng, depth + 1) for _ in range(rng.randint(0, 3))], None, some(rng, depth + 1)])}


def document(rng):
    doc = {"action": "filter"}
    if rng.random() < 0.8:
        doc[rng.choice(["filter", "Filter"])] = rng.choice([some(rng), [some(rng) for _ in range(3)], json.dumps(some(rng))])
    if rng.random() < 0.6:
        doc["aggregation"] = rng.choice([{}, {"function": "count", rng.choice(["group_by", "groupBy"]): rng.choice([None, "a", ["a", None, "b"], []])}])
    if rng.random() < 0.6:
        doc["lookup"] = rng.choice([None, {}, {"lookup_table": "t"}, [{"lookupTable": "t"}, {}, {"match_field": "x"}]])
    if rng.random() < 0.6:
        doc["sequence"] = rng.choice([[{"event_type": "a", "filter": some(rng)}, {}, None, {"filter": [some(rng)]}], {"event_type": "b", "filter": some(rng)}, []])
    return doc


def test_against_recursion(spark):
    rng = random.Random(3)
    docs = [document(rng) for _ in range(400)]
    texts = [json.dumps(d) if rng.random() < 0.7 else "﻿ " + json.dumps(json.dumps(d)) + "\n" for d in docs]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = sorted(tuple(r) for r in shred(df, "i", "t").collect())
    want = sorted((i, *n) for i, t in enumerate(texts) for n in walk(read(t)))
    assert got == want


def test_edges(spark):
    deep = "{}"
    for _ in range(3000):
        deep = '{"conditions":[' + deep + "]}"
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "{"), (5, "[1]"), (6, "7"), (None, '{"filter":{"field":1}}'), (8, '{"filter":{"field":1}}'), (8, '{"filter":{"field":1}}'), (9, '{"filter":' + deep + "}")]
    df = spark.createDataFrame(rows, "i long, t string").selectExpr("i", "t", "1 as node", "2 as path", "3 as parent_path")
    found = [tuple(r) for r in shred(df, "i", "t").collect()]
    assert found.count((8, "condition", "filter", "")) == 2
    assert (None, "condition", "filter", "") in found
    assert {r[0] for r in found} == {None, 8, 9}
    assert sum(r[0] == 9 for r in found) == 3000
    assert shred(df.filter("i = 99"), "i", "t").count() == 0


def test_levels():
    # two lists of lists: [[x, y], [z]] and [[w]]; the inner lists are at level 2
    levels = np.array([0, 2, 1, 0])
    assert ordinal_in_list(levels, 2).tolist() == [0, 1, 0, 0]
    assert ordinal_above(levels, 2).tolist() == [0, 0, 1, 2]


def test_rebuilt_from_levels_alone():
    rng = random.Random(7)
    docs = [read(json.dumps(document(rng))) for _ in range(300)]
    found = list(columns(QUERY_SCHEMA, docs))
    for c in found:  # the values are gone before anything is rebuilt
        c.content = None
        if c.parent is not None:
            c.parent.content = None
    got = sorted((int(c.record[k]), node, p, up) for c, node, at, path, over in flatten(iter(found)) for k, p, up in zip(at, path.to_pylist(), over.to_pylist()))
    assert got == sorted((i, *n) for i, d in enumerate(docs) for n in walk(d))


def test_definition_levels():
    docs = [{"filter": {"conditions": [{"field": 1}, None, {"conditions": None}]}}, {"filter": {"conditions": []}}, {"filter": {}}, {"filter": None}, {}]
    of = {(c.branch.key, c.level): c for c in columns(QUERY_SCHEMA, docs)}
    top, below = of["filter", 0], of["conditions", 1]
    # key, content
    assert top.full == 2 and top.record.tolist() == [0, 1, 2] and top.definition.tolist() == [2, 2, 2]
    assert top.leaves["conditions"].tolist() == [3, 3, 2]
    # and key, element, content: an element that is null stands one below
    assert below.full == 5 and below.repetition.tolist() == [0, 1, 1] and below.definition.tolist() == [5, 4, 5]
    assert below.leaves["field"].tolist() == [6, 4, 5] and below.leaves["conditions"].tolist() == [5, 4, 6]
    # an entry that is null, beside one with elements, stands at its key
    docs = [{"sequence": [{"filter": {"conditions": None}}, {"filter": {"conditions": [{"field": 1}]}}, {"x": 1}, 3]}]
    below = [c for c in columns(QUERY_SCHEMA, docs) if c.branch.key == "conditions"][0]
    assert below.definition.tolist() == [6, 8, 3, 2] and below.repetition.tolist() == [0, 1, 1, 1] and below.full == 8


def test_tables(spark):
    df = spark.createDataFrame([(1, '{"filter":{"operator":"or","conditions":[{"field":"a","op":"eq","value":3}]},"aggregation":{"group_by":["u"]}}')], "i long, t string")
    nodes = shred(df, "i", "t", values=True)
    assert [tuple(r) for r in node_table(nodes, "condition", {"field": "string", "value": "string"}).collect()] == [(1, "filter.conditions[0]", "filter", "a", "3")]
    assert [r.value for r in node_table(nodes, "group_by", {}).collect()] == ["u"]


def test_deep_reader_agrees():
    rng = random.Random(5)
    for _ in range(200):
        text = json.dumps(document(rng))
        assert _decode_deep(text) == read(text)
    for bad in ("{", "[1,", '{"a"}', "[1 2]", "]", '{"a":1,}', ""):
        try:
            _decode_deep(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
