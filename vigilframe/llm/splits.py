"""Splits that keep related records together.

Records that share an entity (author, source, question ...) belong to one component; a component is
never divided.  A record stands at its first entity; every other entity it has is a node between the
entities at which its records stand.  The first large-star step, at those nodes, links what they bring
together and leaves a graph of first entities only; alternating large-star and small-star steps then find
its components.  Their hashes fall into ranges proportional to the wanted shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.durable import cut, release

#: Ranges of the component hash that are told apart when shares are met.
HASH_RANGES = 1 << 16
#: A component of at least this share of all records is placed by size rather than by hash.  There are at most 1 / LARGE of them.
LARGE = 0.002


#: Rows of one shared value that are paired in one task; more are split.
PAIR_BLOCK = 10_000


def entity_key(kind: str, value: Column) -> Column:
    """An entity's 64-bit key, null where the value is null.  Should two entities ever have one key, they end up in one component, never apart."""
    return F.when(value.isNotNull(), F.xxhash64(F.lit(kind), value))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst), the component being its least node.

    Alternates large-star and small-star until the edges stay as they are; the number of rounds grows
    with the logarithm of the longest path.  Edges are cut to the checkpoint folder each round.  Before
    that, nodes with a single neighbour are set aside and attached at the end, which takes most nodes
    of a sparse graph out of the loop.  Self-loops give a component of one node; repeated edges count once.
    Null ends are left out.  No edges: no rows.
    """
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a is not null and src is not null and dst is not null").distinct()
    pairs = cut(pairs)
    loops = pairs.filter("a = b").select("a")
    pairs = pairs.filter("a < b")
    loops = loops.join(pairs.select(F.explode(F.array("a", "b")).alias("a")), "a", "left_anti")
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    leaf = both.groupBy("node").agg(F.count("*").alias("degree"), F.min("other").alias("other")).filter("degree = 1").select("node", "other")
    # A pair of two leaves is a whole component; its greater node is the leaf.
    leaves = cut(leaf.alias("l").join(leaf.select(F.col("node").alias("o"), F.col("other").alias("back")), F.col("l.other") == F.col("o"), "left").filter("o is null or l.node > o").select("l.node", "l.other"))
    gone = leaves.select("node")
    core = pairs.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
    stars = _stars(core)
    heads = stars.select(F.col("b").alias("node"), F.col("a").alias("component"))
    heads = heads.union(stars.select(F.col("a").alias("node"), F.col("a").alias("component")))
    heads = heads.union(leaves.select(F.col("other").alias("node"), F.col("other").alias("component"))).union(loops.select(F.col("a").alias("node"), F.col("a").alias("component")))
    known = heads.groupBy("node").agg(F.min("component").alias("component"))
    hung = leaves.join(known.withColumnRenamed("node", "other"), "other").select("node", "component")
    found = known.union(hung).groupBy("node").agg(F.min("component").alias("component"))
    # A leaf may be the least node of its component.
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))


def _stars(pairs: DataFrame) -> DataFrame:
    """Stars (a: centre and least node, b: other node) of the graph of ``pairs`` (a < b)."""
    now = cut(pairs)
    before = None
    while True:
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if not sign[0] or sign == before:
            return now
        before = sign
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # small-star: all lesser neighbours of a node, and the node itself, under the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b")
        last, now = now, cut(small.distinct())
        release(last)


def _standing(df: DataFrame, id_col: str, entities: dict[str, Column], *more: Column) -> DataFrame:
    """_id, node - the first entity of the row - and _others, all its other entities; then the columns ``more`` (named)."""
    keys = [entity_key(k, v) for k, v in entities.items()]
    rows = df.select(F.col(id_col).alias("_id"), F.array_compact(F.array(*keys)).alias("_e"), *more)
    return rows.select("_id", F.get("_e", F.lit(0)).alias("node"), F.slice("_e", 2, max(len(keys) - 1, 1)).alias("_others"), *rows.columns[2:])


def _met(standing: DataFrame) -> DataFrame:
    # A row without a first entity of its own kind may stand at the very entity that is another row's ``via``.
    return standing.select("node", F.explode("_others").alias("via")).union(standing.filter("node is not null").select("node", F.col("node").alias("via")))


def star_centres(met: DataFrame) -> DataFrame:
    """(via, centre): the entities that bring several nodes together and the least of these nodes."""
    return met.groupBy("via").agg(F.min("node").alias("centre"), F.max("node").alias("_last")).filter("centre <> _last").select("via", "centre")


def link_edges(standing: DataFrame) -> DataFrame:
    """(src, dst): the first large-star step - every node of an entity that has several is linked to the least of them."""
    met = _met(standing)
    return met.join(star_centres(met), "via").filter("node <> centre").select(F.col("centre").alias("src"), F.col("node").alias("dst")).distinct()


def entity_components(df: DataFrame, id_col: str, entities: dict[str, Column]) -> DataFrame:
    """(id, component) of every row: rows that share an entity of any kind, also through other rows, have one component.

    entities: kind -> value, null where a row has none.  A row without entities is alone; its component
    comes from its id (rows repeated with the same id then stay together).  Extra columns aren't read.
    """
    return _placed(cut(_standing(df, id_col, entities))).select(F.col("_id").alias(id_col), "component")


def _placed(standing: DataFrame) -> DataFrame:
    """``standing`` with the component of every row."""
    parts = connected_components(link_edges(standing))
    alone = F.xxhash64(F.lit("alone"), F.col("_id"))
    return standing.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node", alone))


def linking_pairs(df: DataFrame, id_col: str, shared: Column, family: Column, targets: DataFrame | None = None) -> DataFrame:
    """(id_a, id_b), smaller first: rows with one value of ``shared`` and different, known families - the links through which families come into one component.

    All rows get their component and, with ``targets``, their split, as ``entity_components`` and ``assign_splits``
    give them for the entities ``family`` and ``question``; rows are paired within one component and one split only.
    Values with many rows are paired in blocks of their own.  The value is compared by two hashes (96 bits).  Rows
    where either is null give no pairs.  A row repeated with the same id is not paired with itself.
    """
    standing = cut(_standing(df, id_col, {"family": family, "question": shared}, F.hash(shared).alias("_h")))
    # Of a row with both entities the family is the first.
    members = cut(_placed(standing).select("_id", "component", F.col("node").alias("_f"), F.get("_others", F.lit(0)).alias("_k"), "_h"))
    release(standing)
    members = members.withColumn("split", F.lit(None).cast("string")) if targets is None else assign_splits(members, targets)
    # Without a positive share every split is null.
    rows = members.filter("_k is not null").withColumn("split", F.coalesce("split", F.lit("")))
    links = star_centres(rows.select(F.col("_f").alias("node"), F.col("_k").alias("via")))
    meant = cut(rows.join(links.select(F.col("via").alias("_k")), "_k"))
    blocks = meant.groupBy("_k").agg(F.ceil(F.count("*") / F.lit(PAIR_BLOCK)).alias("_n"))
    dealt = meant.join(blocks, "_k")
    a = dealt.withColumn("_s", F.pmod(F.xxhash64("_id"), F.col("_n")))
    b = dealt.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    alike = ["_k", "_h", "_s", "component", "split"]
    a, b = (x.select(*alike, F.col("_id").alias(f"_id_{s}"), F.col("_f").alias(f"_f_{s}")) for x, s in ((a, "a"), (b, "b")))
    pairs = a.join(b, alike).filter("_id_a < _id_b and _f_a <> _f_b")
    return pairs.select(F.col("_id_a").alias(f"{id_col}_a"), F.col("_id_b").alias(f"{id_col}_b"))


def assign_splits(members: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """``members`` (.., component) with a split, no component divided, shares by rows met as nearly as possible.

    Large components (at least LARGE of all rows, so few) go first, the largest to the split that lacks
    most.  For the others the hash of the component falls into ranges whose widths follow what each
    split still lacks, counted in HASH_RANGES ranges; both are counts over all rows.
    targets: split, share.  Shares are taken in proportion; null or negative ones count as 0.
    An empty ``members`` gives no rows; without a positive share among the targets every split is null.
    """
    shares = {r.split: max(r.share or 0.0, 0.0) for r in targets.filter("split is not null").groupBy("split").agg(F.max("share").alias("share")).orderBy("split").collect()}
    if sum(shares.values()) <= 0:
        return members.withColumn("split", F.lit(None).cast("string"))
    slot = F.pmod(F.xxhash64(F.lit(seed), "component"), F.lit(HASH_RANGES)).cast("int")
    sizes = cut(members.groupBy("component").agg(F.count("*").alias("rows")).withColumn("slot", slot))
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    lack = {k: total * v / sum(shares.values()) for k, v in shares.items()}
    large = sizes.filter(F.col("rows") >= max(2, total * LARGE)).orderBy(F.desc("rows"), "component").collect()  # at most 1 / LARGE rows
    placed = []
    for r in large:
        best = max(lack, key=lambda k: (lack[k], k))
        lack[best] -= r.rows
        placed.append((r.component, best))
    spark = members.sparkSession
    fixed = spark.createDataFrame(placed, "component long, fixed string") if placed else spark.createDataFrame([], "component long, fixed string")
    slots = sizes.filter(F.col("rows") < max(2, total * LARGE)).groupBy("slot").agg(F.sum("rows").alias("rows")).orderBy("slot").collect()  # at most HASH_RANGES rows
    rest = {k: max(v, 0.0) for k, v in lack.items()}
    names = sorted(rest)
    whole = sum(rest.values()) or 1.0
    small = sum(r.rows for r in slots)
    ends, so_far = [], 0.0
    for k in names:
        so_far += rest[k] / whole * small
        ends.append(so_far)
    cuts, at, k = [], 0.0, 0
    for r in slots:
        while k < len(names) - 1 and at + r.rows / 2 > ends[k]:
            cuts.append((r.slot, names[k]))
            k += 1
        at += r.rows
    by_hash = F.lit(names[k])
    for upper, name in reversed(cuts):
        by_hash = F.when(slot < upper, name).otherwise(by_hash)
    # Ranges and large components are known by now: no row is moved, however large its component.
    placing = F.broadcast(fixed.withColumnRenamed("fixed", "_fixed"))
    return members.join(placing, "component", "left").withColumn("split", F.coalesce("_fixed", by_hash)).drop("_fixed")
