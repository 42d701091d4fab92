"""Nested documents into flat, linked tables by columnar shredding.

A document is cut into columns, one for each schema path (list indices left out).  A column holds, for
every slot of its path, the record number, the repetition level (which list the slot continues) and the
definition level (how much of the way to the slot is there); leaf paths below a slot have a definition
level for each of its entries.  As in column stores, a slot that is missing still has an entry, so
everything is rebuilt from the levels: the index in the list at level k is the number of entries since the
last one of a lower level, which is also where the next slot above begins; a slot is there, and is a node of
some kind, by its own definition level and those of its leaves.  ``flatten`` sees nothing but these numbers.

The schema may be recursive: a branch may have itself as child, to any depth.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import json
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vigilframe.durable import spread
from vigilframe.operators.jsontext import inner, read

#: The leaf that is defined where an object has any entry at all.
ANY = "*"


@dataclass(frozen=True)
class Node:
    """A kind of node: slots that are there, have the leaf ``has`` and don't have the leaf ``lacks``."""

    name: str
    has: str | None = None
    lacks: str | None = None


@dataclass
class Branch:
    """A place of the schema.

    key: the key in the parent object, as written in paths.
    shape: ``object``, ``list`` (a lone value counts as element 0) or ``either`` (an object, or a list in its place).
    nodes: the kinds of nodes its slots may be.
    children: the branches below.
    objects: whether the slots hold objects; else any value that isn't null.
    """

    key: str
    shape: str
    nodes: list[Node] = field(default_factory=list)
    children: list["Branch"] = field(default_factory=list)
    objects: bool = True

    def __post_init__(self) -> None:
        self.plain = self.key.replace("_", "").lower()
        self.leaves = sorted({k for n in self.nodes for k in (n.has, n.lacks) if k is not None})


@dataclass
class Column:
    """The levels of one schema path.

    level: lists on the way to a slot.  full: the definition level of a slot that is there; an entry of
    its key, an element of its list and its content count one each.  leaves: definition levels of leaf
    paths, entry by entry, ``full`` + 1 where the leaf is there.  content: the slots' values, None below
    ``full``; needed to cut further and for the values of leaves, not for ``flatten``.
    """

    branch: Branch
    listed: bool
    level: int
    full: int
    record: np.ndarray
    repetition: np.ndarray
    definition: np.ndarray
    leaves: dict[str, np.ndarray]
    content: list[Any] | None
    parent: "Column | None"


def _with_leaves(column: Column) -> Column:
    for key in column.branch.leaves:
        plain = key.replace("_", "").lower()
        there = (bool(v) if key == ANY else isinstance(v, dict) and plain in v for v in column.content)
        column.leaves[key] = column.definition + (np.fromiter(there, bool, len(column.content)) & (column.definition == column.full))
    return column


def _cut(parent: Column) -> Iterator[Column]:
    for child in parent.branch.children:
        key = child.plain
        # 1 where the key has an entry, in objects that are there
        entry = np.fromiter((isinstance(v, dict) and key in v for v in parent.content), bool, len(parent.content))
        if not entry.any():
            continue
        held = [inner(v[key]) if e else None for v, e in zip(parent.content, entry.tolist())]
        if child.shape != "list":
            yield from _objects(parent, child, entry, [v if isinstance(v, dict) else None for v in held])
        if child.shape != "object":
            lone = child.shape == "list"
            lists = [v if isinstance(v, list) else [v] if lone and v is not None else None for v in held]
            if child.objects:
                lists = [v and [inner(x) for x in v] for v in lists]
            yield from _lists(parent, child, entry, lists)


def _live(parent: Column, filled: np.ndarray) -> np.ndarray:
    """The parent's entries of the records that have anything here; records that have nothing have no entries."""
    return np.nonzero(np.isin(parent.record, parent.record[filled]))[0] if filled.any() else np.zeros(0, np.int64)


def _objects(parent: Column, child: Branch, entry: np.ndarray, own: list) -> Iterator[Column]:
    filled = np.fromiter((v is not None for v in own), bool, len(own))
    at = _live(parent, filled)
    if len(at):
        definition = parent.definition[at] + entry[at] + filled[at]
        yield _with_leaves(Column(child, False, parent.level, parent.full + 2, parent.record[at], parent.repetition[at], definition, {}, [own[k] for k in at], parent))


def _lists(parent: Column, child: Branch, entry: np.ndarray, lists: list) -> Iterator[Column]:
    count = np.fromiter((len(v) if v else 0 for v in lists), np.int64, len(lists))
    at = _live(parent, count > 0)
    if not len(at):
        return
    level = parent.level + 1
    content: list[Any] = []
    for k in at:
        content += lists[k] or (None,)
    count = count[at]
    rows = np.maximum(count, 1)
    first = np.concatenate(([0], np.cumsum(rows)[:-1]))
    repetition = np.full(int(rows.sum()), level, np.int32)
    repetition[first] = parent.repetition[at]
    there = (isinstance(v, dict) for v in content) if child.objects else (v is not None for v in content)
    there = np.fromiter(there, bool, len(content))
    if child.objects:
        content = [v if t else None for v, t in zip(content, there.tolist())]
    definition = np.repeat(parent.definition[at] + entry[at] + (count > 0), rows) + there
    yield _with_leaves(Column(child, True, level, parent.full + 3, np.repeat(parent.record[at], rows), repetition, definition, {}, content, parent))


def columns(branches: list[Branch], documents: list[Any]) -> Iterator[Column]:
    """The columns of all schema paths that occur in the documents, each after the one above it."""
    rows = [(i, d) for i, d in enumerate(documents) if isinstance(d, dict)]
    none = np.zeros(len(rows), np.int32)
    waiting = [Column(Branch("", "object", [], branches), False, 0, 0, np.array([i for i, _ in rows], np.int64), none, none, {}, [d for _, d in rows], None)]
    while waiting:
        column = waiting.pop()
        if column.parent is not None:
            yield column
        waiting.extend(_cut(column))


def ordinal_in_list(repetition: np.ndarray, level: int) -> np.ndarray:
    """The index of each entry in its list at ``level``: entries since the last one that began a list."""
    at = np.arange(len(repetition))
    return at - np.maximum.accumulate(np.where(repetition < level, at, 0))


def ordinal_above(repetition: np.ndarray, level: int) -> np.ndarray:
    """The number of the slot above, to whose list at ``level`` each entry belongs."""
    return np.cumsum(repetition < level) - 1


def _join(parent: pa.Array, *texts: Any) -> pa.Array:
    dot = pc.if_else(pc.equal(parent, ""), "", ".")
    return pc.binary_join_element_wise(parent, dot, *texts, "")


def flatten(found: Iterator[Column]) -> Iterator[tuple[Column, str, np.ndarray, pa.Array, pa.Array]]:
    """(column, node, entries, paths, paths of the slots above) for every kind of node of every column, from the levels alone."""
    paths: dict[int, tuple[Column, pa.Array]] = {}
    for c in found:
        up = c.parent
        above = np.nonzero(np.isin(up.record, c.record))[0]
        if c.listed:
            above = above[ordinal_above(c.repetition, c.level)]
        over = paths[id(up)][1] if id(up) in paths else pa.array([""] * len(up.record), pa.string())
        over = over.take(pa.array(above))
        own = _join(over, c.branch.key, *(("[", pc.cast(pa.array(ordinal_in_list(c.repetition, c.level)), pa.string()), "]") if c.listed else ()))
        if c.branch.children:
            paths[id(c)] = (c, own)  # held with its column, so that the id stays its own
        there = c.definition == c.full
        for node in c.branch.nodes:
            keep = there
            if node.has is not None:
                keep = keep & (c.leaves[node.has] > c.full)
            if node.lacks is not None:
                keep = keep & (c.leaves[node.lacks] == c.full)
            if keep.any():
                at = np.nonzero(keep)[0]
                yield c, node.name, at, own.take(pa.array(at)), over.take(pa.array(at))


def _scalars(value: Any) -> str:
    if isinstance(value, dict):
        value = {k: v for k, v in value.items() if not isinstance(v, dict) and k not in ("conditions", "groupby", "filter")}
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


# The schema of a detection query document.


def _query_schema() -> list[Branch]:
    tested = [Node("group", has="conditions"), Node("condition", has="field", lacks="conditions")]
    conditions = Branch("conditions", "list", tested)
    conditions.children.append(conditions)
    tree = Branch("filter", "either", tested, [conditions])
    group_by = Branch("group_by", "list", [Node("group_by")], objects=False)
    return [
        tree,
        Branch("aggregation", "object", [Node("aggregation", has=ANY)], [group_by]),
        Branch("lookup", "either", [Node("lookup", has=ANY)]),
        Branch("sequence", "list", [Node("step", has=ANY)], [tree]),
    ]


QUERY_SCHEMA = _query_schema()


def shred(df: DataFrame, id_col: str, json_col: str, values: bool = False, schema: list[Branch] | None = None) -> DataFrame:
    """One row per node of every document: id, node, path, parent_path and, with ``values``, attributes (JSON text).

    Flat tables are the rows of one node name; ``parent_path`` with the id links a row to its parent's.
    Works batch by batch without a shuffle, so memory is that of one batch however many rows there are.
    Null, blank or unreadable documents, and those that are no object, have no rows.  A null id is kept
    as null.  Repeated rows give repeated nodes.  Other columns of ``df``, whatever their names, aren't read.
    """
    branches = schema or QUERY_SCHEMA
    id_type = df.schema[id_col].dataType
    fields = [T.StructField(id_col, id_type), *(T.StructField(n, T.StringType()) for n in ("node", "path", "parent_path", *(["attributes"] if values else [])))]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                ids, texts = part.column(0), part.column(1)
                for c, node, at, path, parent in flatten(columns(branches, [read(t) for t in texts.to_pylist()])):
                    out = [ids.take(pa.array(c.record[at])), pa.repeat(pa.scalar(node), len(at)), path, parent]
                    if values:
                        out.append(pa.array([_scalars(c.content[k]) for k in at], pa.string()))
                    yield pa.RecordBatch.from_arrays(out, names=names)

    return spread(df.select(id_col, json_col)).mapInArrow(run, T.StructType(fields))


def node_table(nodes: DataFrame, node: str, columns: dict[str, str]) -> DataFrame:
    """The flat table of one node name out of ``shred(..., values=True)``; columns: name -> DDL type."""
    from pyspark.sql import functions as F

    ddl = ", ".join(f"`{k.replace('_', '').lower()}` {t}" for k, t in columns.items())
    id_col = nodes.columns[0]
    rows = nodes.filter(F.col("node") == node)
    if not columns:
        return rows.select(id_col, "path", "parent_path", F.get_json_object(F.concat(F.lit('{"v":'), "attributes", F.lit("}")), "$.v").alias("value"))
    parsed = F.from_json("attributes", ddl)
    return rows.select(id_col, "path", "parent_path", *(parsed[k.replace("_", "").lower()].alias(k) for k in columns))
