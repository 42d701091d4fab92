"""Mixing sources to target weights, repeating small sources a capped number of times."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilframe.durable import cut

#: Ranges of a document's random key in which sizes are counted.
KEY_RANGES = 4096


def water_fill(weight: dict[str, float], size: dict[str, int], repeats: dict[str, int], total: float) -> tuple[dict[str, float], dict[str, int]]:
    """(what each source gives, the pass in which it was clamped).

    A source gives its weight's share of ``total``, at most size x repeats.  In each pass the sources whose cap
    lies below their share of what is left are clamped at it; what they can't give goes to the others in
    proportion, until no more are clamped.  Pass 1 clamps those that can't give their own weight.
    """
    cap = {s: float(max(size[s], 0) * max(repeats[s], 0)) for s in weight}
    given = {s: 0.0 for s in weight}
    clamped: dict[str, int] = {}
    open_ = {s for s in weight if weight[s] > 0}
    left, turn = float(total), 1
    while open_ and left > 0:
        whole = math.fsum(weight[s] for s in open_)
        if abs(whole - 1) < 1e-9:
            whole = 1.0
        share = {s: left * (weight[s] / whole) for s in open_}
        full = {s for s in open_ if cap[s] < share[s]}
        if not full:
            given.update(share)
            break
        for s in full:
            given[s], clamped[s] = cap[s], turn
        left -= math.fsum(cap[s] for s in full)
        open_ -= full
        turn += 1
    return given, clamped


def source_sizes(docs: DataFrame, targets: DataFrame) -> tuple[DataFrame, int]:
    """(targets with the tokens of their source, tokens of all documents).

    docs: source, tokens.  targets: source, weight, max_repeats; a source listed twice counts once with its
    greatest values, nulls as 0, one without a name not at all.  Sources of documents that aren't listed count only in the total.
    """
    sizes = cut(docs.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    wanted = targets.filter("source is not null").groupBy("source").agg(F.coalesce(F.max("weight"), F.lit(0.0)).alias("weight"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    return wanted.join(sizes, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))), total


@dataclass(frozen=True)
class Filling:
    """One source of the mixture as water-filling leaves it."""

    source: str
    times: int
    rest: float
    wanted_tokens: float
    capped: bool
    clamped_in: int | None


def filling(sizes: DataFrame, total: float) -> list[Filling]:
    """Water-filling over the rows of ``source_sizes``, as many as there are targets."""
    rows = sizes.orderBy("source").collect()
    size = {r.source: int(r.tokens) for r in rows}
    repeats = {r.source: int(r.max_repeats) for r in rows}
    given, clamped = water_fill({r.source: max(r.weight, 0.0) for r in rows}, size, repeats, total)
    plan = []
    for s in size:
        times = min(int(given[s] / size[s] + 1e-12), repeats[s]) if size[s] else 0
        plan.append(Filling(s, times, given[s] - times * size[s] if times < repeats[s] else 0.0, given[s], given[s] >= size[s] * repeats[s], clamped.get(s)))
    return plan


def short_sources(sizes: DataFrame, total: int) -> DataFrame:
    """The sources whose tokens, repeated as often as allowed, stay below their weight of the total: those the first pass of water-filling clamps."""
    return sizes.sparkSession.createDataFrame([(f.source,) for f in filling(sizes, total) if f.clamped_in == 1], "source string")


def mixture(docs: DataFrame, targets: DataFrame, id_col: str, seed: int = 3, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    docs: id, source, tokens.  mixture: id, source, tokens, repeat (0, 1, ..), a row for every time a document
    occurs.  Each source gives whole repetitions of all its documents and, for the fraction that is
    left, documents in the order of a seeded key as long as they fit.  total: tokens wanted, by default those of all
    documents.  shares: source, weight, max_repeats, tokens, wanted_tokens, actual_tokens, actual_share, capped.
    Documents of unlisted or null sources are left out by definition.  A source without documents, or
    without a weight, gives nothing.  No documents: an empty mixture, shares of 0.
    """
    docs = cut(docs.select(id_col, "source", "tokens"))
    sizes, whole = source_sizes(docs, targets)
    plan = [(f.source, f.times, f.rest, f.wanted_tokens, f.capped) for f in filling(sizes, whole if total is None else total)]
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(plan, "source string, times int, rest double, wanted_tokens double, capped boolean"))
    keyed = docs.join(table.select("source", "times", "rest"), "source").withColumn("_key", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 40))).withColumn("_range", (F.col("_key") / F.lit((1 << 40) // KEY_RANGES)).cast("int"))
    upto = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = keyed.groupBy("source", "_range", "rest").agg(F.sum("tokens").alias("n")).withColumn("_sum", F.sum("n").over(upto))  # at most KEY_RANGES rows a source
    inside = filled.filter("_sum - n < rest").select("source", "_range", (F.col("rest") - F.col("_sum") + F.col("n")).alias("_left"), (F.col("_sum") > F.col("rest")).alias("_part"))
    near = keyed.join(F.broadcast(inside), ["source", "_range"], "left")
    # Only the range in which the fraction ends is put in order.
    order = Window.partitionBy("source", "_range").orderBy("_key", id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = near.filter("_part").withColumn("_so_far", F.sum("tokens").over(order)).withColumn("n_times", F.col("times") + (F.col("_so_far") <= F.col("_left")).cast("int"))
    clear = near.filter("_part is null or not _part").withColumn("n_times", F.col("times") + F.col("_part").isNotNull().cast("int"))
    chosen = clear.select(id_col, "source", "tokens", "n_times").unionByName(edge.select(id_col, "source", "tokens", "n_times"))
    mixed = chosen.filter("n_times > 0").select(id_col, "source", "tokens", F.explode(F.sequence(F.lit(0), F.col("n_times") - 1)).alias("repeat"))
    actual = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n_times")).alias("actual_tokens"))
    shares = sizes.join(table.select("source", "wanted_tokens", "capped"), "source").join(F.broadcast(actual), "source", "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
    # as many rows as there are targets, so one window may hold them all
    everything = F.greatest(F.sum("actual_tokens").over(Window.partitionBy(F.lit(1))), F.lit(1))
    shares = shares.select("source", "weight", "max_repeats", "tokens", "wanted_tokens", "actual_tokens", (F.col("actual_tokens") / everything).alias("actual_share"), "capped")
    return mixed, shares
