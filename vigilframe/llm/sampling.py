"""A sample whose shares follow target proportions in several dimensions at once.

Counts per cell (one category of each dimension) are raked to whole target margins, never beyond the
rows that are there: a category's factor is the one that meets its margin with its cells at their caps
taken into account, so the margins are met wherever that can be.  The fractional quotas become whole numbers
by controlled rounding: a maximum flow through rows and columns of a two-way table in which every cell goes
up or down by less than one and the margins stay.  Each cell then gives exactly its quota of rows, those with the least random keys.
Only the table of cells (bounded by the numbers of categories) is on the driver.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vigilframe.durable import cut
from vigilframe.operators.jsontext import read

#: Ranges of the random key in which rows of a cell are counted.
KEY_RANGES = 1024
#: What lies so near to a whole number counts as one.
WHOLE = 1e-5
OTHER = "(other)"


def label_key(label: Column) -> Column:
    """A label without case, padding and marks between its words."""
    return F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]+", "")


def json_field(df: DataFrame, json_col: str, key: str, name: str) -> DataFrame:
    """``df`` with the text of a top-level key of the JSON documents in place of the column itself.

    The documents are read as by ``shred``.  The value is lower case and without white space; null where
    the document can't be read, has no such key, or the value is no text.
    """
    plain = key.replace("_", "").lower()
    others = [c for c in df.columns if c != json_col]
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField(name, T.StringType())])

    def value(text: str | None) -> str | None:
        held = read(text)
        held = held.get(plain) if isinstance(held, dict) else None
        return "".join(held.lower().split()) if isinstance(held, str) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k) for k in range(len(others))]
            columns.append(pa.array([value(t) for t in batch.column(len(others)).to_pylist()], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(*others, json_col).mapInArrow(run, schema)


def round_table(table: np.ndarray, columns: np.ndarray | None = None, rows: np.ndarray | None = None, most: np.ndarray | None = None) -> np.ndarray:
    """Controlled rounding: whole numbers with every cell, row sum and column sum at its floor or ceiling.

    columns, rows: whole sums to be met exactly.  The grand total is that of the given sums, else rounded to the nearest.
    A maximum flow finds the table; without given sums one always exists, as the fractional table itself is
    a flow within the bounds.  Where given sums leave none, the cells get more and more room, up to
    ``most``; sums that no table has give way to the nearest table by largest remainders.
    """
    table = np.asarray(table, float)
    near = np.rint(table)
    table = np.where(np.abs(table - near) < WHOLE, near, table)
    if not table.size:
        return table.astype(int)
    r, c = table.shape
    low, high = np.floor(table).astype(int), np.ceil(table).astype(int)

    def bounds(x: np.ndarray, given: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        if given is not None:
            return np.asarray(given, int), np.asarray(given, int)
        whole = np.abs(x - np.rint(x)) < WHOLE
        return np.where(whole, np.rint(x), np.floor(x)).astype(int), np.where(whole, np.rint(x), np.ceil(x)).astype(int)

    row_low, row_high = bounds(table.sum(1), rows)
    col_low, col_high = bounds(table.sum(0), columns)
    total = int(np.sum(columns) if columns is not None else np.sum(rows) if rows is not None else np.rint(table.sum()))
    # nodes: 0 source, 1..r rows, r+1..r+c columns, r+c+1 sink, then the two ends for lower bounds
    sink, begin, end = r + c + 1, r + c + 2, r + c + 3
    most = high if most is None else np.maximum(np.asarray(most, int), high)
    room = 0
    while True:
        least, upto = np.maximum(low - room, 0), np.minimum(high + room, most)
        arcs = [(0, 1 + i, row_low[i], row_high[i]) for i in range(r)]
        arcs += [(1 + i, 1 + r + j, least[i, j], upto[i, j]) for i in range(r) for j in range(c)]
        arcs += [(1 + r + j, sink, col_low[j], col_high[j]) for j in range(c)]
        arcs.append((sink, 0, total, total))
        flow = _feasible(arcs, begin, end)
        if flow is not None:
            return np.array(flow[r : r + r * c], int).reshape(r, c)
        if (least == 0).all() and (upto == most).all():
            break
        room = 2 * room + 1
    flat = np.argsort(-(table - low), axis=None, kind="stable")
    out, free = low.copy().ravel(), (most - low).ravel()
    short = max(0, total - int(low.sum()))
    for k in flat[free[flat] > 0][:short]:
        out[k] += 1
    return out.reshape(r, c)


def _feasible(arcs: list[tuple[int, int, int, int]], begin: int, end: int) -> list[int] | None:
    """Flows within [lower, upper] on all arcs that keep every node in balance, or None."""
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    to: list[int] = []
    room: list[int] = []

    def add(u: int, v: int, capacity: int) -> int:
        graph[u].append(len(to))
        to.append(v)
        room.append(int(capacity))
        graph[v].append(len(to))
        to.append(u)
        room.append(0)
        return len(to) - 2

    excess = [0] * (end + 1)
    own = []
    for u, v, lower, upper in arcs:
        own.append((add(u, v, upper - lower), lower))
        excess[v] += lower
        excess[u] -= lower
    need = 0
    for node, x in enumerate(excess):
        if x > 0:
            add(begin, node, x)
            need += x
        elif x < 0:
            add(node, end, -x)
    moved = 0
    while True:
        via: dict[int, int] = {begin: -1}
        queue = deque([begin])
        while queue and end not in via:
            u = queue.popleft()
            for e in graph[u]:
                if room[e] > 0 and to[e] not in via:
                    via[to[e]] = e
                    queue.append(to[e])
        if end not in via:
            break
        path, v = [], end
        while via[v] >= 0:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
        moved += push
    if moved < need:
        return None
    return [lower + room[e ^ 1] for e, lower in own]


def margin(share: np.ndarray, least: np.ndarray, there: np.ndarray, size: int) -> np.ndarray:
    """Rows wanted per category: in proportion to the shares, at least ``least``, at most what is there, summing to ``size`` if that can be."""
    floor = np.minimum(least, there).astype(float)
    if floor.sum() > size > 0:
        floor *= size / floor.sum()
    size = min(size, float(there.sum()))
    low, high = 0.0, 1.0
    at = lambda t: np.clip(t * share, floor, np.maximum(floor, there))
    while at(high).sum() < size - 1e-9 and high < 1e15:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid).sum() < size else (low, mid)
    return at(high)


def _whole(wanted: np.ndarray, there: np.ndarray, size: int) -> np.ndarray:
    """Whole margins next to ``wanted``, at most what is there, with the sum ``size`` if that can be."""
    near = np.rint(wanted)
    wanted = np.where(np.abs(wanted - near) < WHOLE, near, wanted)
    out = np.minimum(np.floor(wanted), there).astype(int)
    for k in np.argsort(-(wanted - np.floor(wanted)), kind="stable"):
        if out.sum() < size and out[k] < there[k] and wanted[k] > out[k]:
            out[k] += 1
    return out


def _factor(base: np.ndarray, caps: np.ndarray, wanted: float) -> float:
    """f with sum(min(caps, f x base)) = wanted; the greatest needed where the caps don't allow it."""
    on = base > 0
    base, caps = base[on], caps[on].astype(float)
    if wanted <= 0 or not len(base):
        return 0.0
    full = caps / base
    order = np.argsort(full)
    base, caps, full = base[order], caps[order], full[order]
    capped = np.concatenate(([0.0], np.cumsum(caps)))[:-1]
    open_ = np.cumsum(base[::-1])[::-1]
    f = (wanted - capped) / open_
    k = int(np.argmax(f <= full + 1e-15)) if (f <= full + 1e-15).any() else -1
    return float(max(f[k], 0.0)) if k >= 0 else float(full[-1])


def rake(counts: np.ndarray, wanted: list[np.ndarray], size: int, rounds: int = 3000) -> np.ndarray:
    """Fractional quotas next to the shares in ``counts`` with the margins ``wanted``, no cell beyond its count.

    Each step sets a category's factor so that its margin is met by min(count, product of factors); where
    tables with these margins exist this comes as near to one as wanted.
    """
    axes = range(counts.ndim)
    start = counts * (size / max(1, counts.sum()))
    factors = [np.ones(n) for n in counts.shape]

    def spread(k: int) -> np.ndarray:
        return factors[k].reshape([-1 if a == k else 1 for a in axes])

    for _ in range(rounds):
        worst = 0.0
        for k in axes:
            base = start.copy()
            for a in axes:
                if a != k:
                    base = base * spread(a)
            base, caps = np.moveaxis(base, k, 0), np.moveaxis(counts, k, 0)
            have = np.minimum(base * factors[k].reshape([-1] + [1] * (counts.ndim - 1)), caps).reshape(len(factors[k]), -1).sum(1)
            worst = max(worst, float(np.abs(have - wanted[k]).max(initial=0)))
            factors[k] = np.clip([_factor(base[i].ravel(), caps[i].ravel(), float(w)) for i, w in enumerate(wanted[k])], 0, 1e15)
        if worst < WHOLE / 10:
            break
    x = start
    for k in axes:
        x = x * spread(k)
    return np.minimum(x, counts)


def quotas(counts: np.ndarray, wanted: list[np.ndarray], size: int) -> np.ndarray:
    """Whole quotas for the cells ``counts`` (one axis per dimension), at most the rows there, ``size`` in sum where possible.

    Margins that some table within the counts has are met exactly, but for rounding.
    """
    size = min(size, int(counts.sum()))
    axes = range(counts.ndim)
    others = [tuple(a for a in axes if a != k) for k in axes]
    wanted = [_whole(w, counts.sum(others[k]), size) for k, w in enumerate(wanted)]
    x = rake(counts, wanted, size)
    for _ in range(50):  # what no labelled cell can give comes from where rows are left
        short = size - x.sum()
        if short < WHOLE:
            break
        left = counts - x
        inside = left.copy()
        for k in axes:
            inside = inside * (wanted[k] > 0).reshape([-1 if a == k else 1 for a in axes])
        left = inside if inside.sum() > 1e-9 else left
        x = np.minimum(x + left * min(1.0, short / max(left.sum(), 1e-12)), counts)
    # sums that came out as wanted are held exactly, others may go to the next whole number
    held = [w if np.abs(x.sum(others[k]) - w).max(initial=0) < 0.5 and w.sum() == size else None for k, w in enumerate(wanted)]
    if counts.ndim < 2:
        return round_table(x.reshape(1, -1), held[0], None, counts.reshape(1, -1)).ravel() if counts.ndim else counts
    # from the last two dimensions to the first: the sums of each table are those of the next
    rounded = None
    for k in reversed(range(counts.ndim - 1)):
        table = x.sum(tuple(range(k))) if k else x
        there = counts.sum(tuple(range(k))) if k else counts
        flat = table.reshape(table.shape[0], -1)
        columns = held[-1] if rounded is None else rounded.ravel()
        rounded = round_table(flat, columns, held[k] if columns is None or held[k] is None or held[k].sum() == np.sum(columns) else None, there.reshape(flat.shape)).reshape(table.shape)
    return rounded


def cell_counts(rows: DataFrame, dims: list[str]) -> DataFrame:
    return rows.groupBy(*dims).agg(F.count("*").alias("n"))


def categorised(df: DataFrame, targets: DataFrame, dims: dict[str, Column], keep: list[str]) -> DataFrame:
    """``keep`` columns and a column per dimension, holding a category of ``targets`` or OTHER."""
    named = {d: [r.category for r in targets.filter(F.col("dim") == d).select("category").distinct().orderBy("category").collect() if r.category is not None] for d in dims}
    return df.select(*keep, *(F.when(c.isin(named[d]), c).otherwise(F.lit(OTHER)).alias(d) for d, c in dims.items()))


def category_report(counts: DataFrame, targets: DataFrame, dims: list[str], size: int, drawn: DataFrame | None = None) -> DataFrame:
    """One row per category of ``targets``: rows there, rows wanted, rows drawn (if given), and what can't be met.

    counts, drawn: cells with n.  scarce: fewer rows are there than min_rows or than share x size.  unmet: scarce,
    or fewer rows are drawn than min_rows or than share x size rounded down.  A category without rows has 0; null
    shares and minima count as 0, targets without a name not at all.
    """
    def per(cells: DataFrame, name: str) -> DataFrame:
        stacked = cells.select("n", F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("category")) for d in dims))).alias("c"))
        return stacked.groupBy("c.dim", "c.category").agg(F.sum("n").alias(name))

    wanted = targets.filter("dim is not null and category is not null").groupBy("dim", "category").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("min_rows"), F.lit(0)).alias("min_rows"))
    out = wanted.join(F.broadcast(per(counts, "available")), ["dim", "category"], "left").fillna(0, ["available"])
    goal = F.col("target_share") * F.lit(float(size))
    out = out.withColumn("scarce", (F.col("available") < F.col("min_rows")) | (F.col("available") < goal))
    if drawn is None:
        return out.withColumn("unmet", F.col("scarce"))
    out = out.join(F.broadcast(per(drawn, "drawn")), ["dim", "category"], "left").fillna(0, ["drawn"]).withColumn("drawn_share", F.col("drawn") / F.lit(float(max(size, 1))))
    return out.withColumn("unmet", F.col("scarce") | (F.col("drawn") < F.col("min_rows")) | (F.col("drawn") < F.floor(goal + F.lit(1e-6))))


def proportional_sample(rows: DataFrame, targets: DataFrame, id_col: str, dims: list[str], fraction: float = 0.2, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(sample, report): floor(fraction x rows) rows whose category shares follow ``targets`` (dim, category, target_share, min_rows).

    rows: id and one column per dimension, as from ``categorised``.  Every row counts, repeated ones too.
    The random key comes from the id and the seed, with the id to settle ties, so the same rows are drawn
    on every run.  Rows of no category serve only where the size can't be reached otherwise.  No rows give
    an empty sample and a report in which nothing is available.
    """
    rows = cut(rows.select(id_col, *dims, F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 40)).alias("_key")))
    counts = cell_counts(rows, dims)
    cells = counts.collect()  # at most one row per combination of categories
    total = sum(r.n for r in cells)
    size = int(total * fraction + 1e-9)
    goal = targets.filter("dim is not null and category is not null").groupBy("dim", "category").agg(F.max("target_share").alias("s"), F.max("min_rows").alias("m")).orderBy("dim", "category").collect()
    names = {d: [r.category for r in goal if r.dim == d] + [OTHER] for d in dims}
    table = np.zeros([len(names[d]) for d in dims], int)
    for r in cells:
        table[tuple(names[d].index(r[d]) for d in dims)] = r.n
    named = table.copy()
    for k, d in enumerate(dims):
        np.moveaxis(named, k, 0)[-1] = 0
    if named.sum() >= size:
        table = named  # rows without a category in some dimension aren't needed
    wanted = []
    for k, d in enumerate(dims):
        of = {r.category: r for r in goal if r.dim == d}
        share = np.array([float((of[c].s or 0) if c in of else 0) for c in names[d]])
        least = np.array([int((of[c].m or 0) if c in of else 0) for c in names[d]])
        wanted.append(margin(share, least, table.sum(tuple(a for a in range(len(dims)) if a != k)), size))
    q = quotas(table, wanted, size)
    spark = rows.sparkSession
    listed = [(*(names[d][i] for d, i in zip(dims, at)), int(q[at])) for at in zip(*np.nonzero(q))]
    quota = spark.createDataFrame(listed, ", ".join(f"`{d}` string" for d in dims) + ", quota long")
    ranged = rows.join(F.broadcast(quota), dims).withColumn("_range", (F.col("_key") / F.lit((1 << 40) // KEY_RANGES)).cast("int"))
    upto = Window.partitionBy(*dims).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = ranged.groupBy(*dims, "_range", "quota").agg(F.count("*").alias("n")).withColumn("_before", F.sum("n").over(upto) - F.col("n"))
    last = filled.filter("_before < quota").select(*dims, "_range", (F.col("quota") - F.col("_before")).alias("_left"), (F.col("_before") + F.col("n") > F.col("quota")).alias("_part"))
    near = ranged.drop("quota").join(F.broadcast(last), [*dims, "_range"])
    # Only the range in which a quota ends is put in order: of a cell's rows one in KEY_RANGES.
    order = Window.partitionBy(*dims, "_range").orderBy("_key", id_col)
    ordered = near.filter("_part").withColumn("_at", F.row_number().over(order)).filter("_at <= _left")
    sample = near.filter("not _part").select(id_col, *dims).unionByName(ordered.select(id_col, *dims))
    drawn = spark.createDataFrame(listed, ", ".join(f"`{d}` string" for d in dims) + ", n long")
    return sample, category_report(counts, targets, dims, size, drawn)
