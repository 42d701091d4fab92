"""Numbering and running values in a total order, without one task for a hot key or for the whole table.

Rows are put in order by a range-partitioned sort that is written to the checkpoint folder.  Each partition
works on its own rows; what it passes on to the next ones - a number of rows, a sum, a last value - is one row a
partition (and key), so what comes between is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilframe.durable import cut

_PART_BITS = 33


def _in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` sorted, with its partition and its place in it."""
    placed = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_at", _PART_BITS)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << _PART_BITS) - 1)))


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the 1-based place of each row in a total order.  An empty table stays empty."""
    rows = _in_order(df, order)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # a row a partition
    offsets, so_far = [], 0
    for r in sizes:
        offsets.append((r._part, so_far))
        so_far += r.n
    table = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return rows.join(F.broadcast(table), "_part").select(*df.columns, (F.col("_before") + F.col("_at") + 1).alias(name))


def number_within(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with the 1-based place of each row among those with the same ``by``, in the given order."""
    numbered = number_rows(df, [*(F.asc(c) for c in by), *order], "_n")
    first = numbered.groupBy(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by))).agg(F.min("_n").alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)] or [F.lit(True)]
    return numbered.join(first, same).select(*df.columns, (F.col("_n") - F.col("_first") + 1).alias(name))


_MERGE = {
    "count": lambda before, own: F.coalesce(before, F.lit(0)) + own,
    "sum": lambda before, own: F.when(before.isNull(), own).when(own.isNull(), before).otherwise(before + own),
    "min": lambda before, own: F.least(before, own),
    "max": lambda before, own: F.greatest(before, own),
    "last": lambda before, own: F.coalesce(own, before),
}
_OWN = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
_CARRY = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def running(df: DataFrame, by: list[str], order: list[str], measures: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with running aggregates of each key, the row itself included.

    measures: name -> (count, sum, min, max or last, expression); nulls don't count, ``last`` is the last value that
    isn't null.  A name of a column replaces it.  A null key is a key like others; ties in ``order`` keep one
    order throughout a run.  A key that holds most rows is spread over the partitions of the sort.
    """
    valued = df.select("*", *(e.alias(f"_v{k}") for k, (_, e) in enumerate(measures.values())))
    rows = _in_order(valued, [F.asc(c) for c in (*by, *order)])
    ops = [op for op, _ in measures.values()]
    own = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    partial = rows.select("*", *(_OWN[op](F.col(f"_v{k}")).over(own).alias(f"_own{k}") for k, op in enumerate(ops)))
    whole = rows.groupBy(*by, "_part").agg(*(_OWN[op](F.col(f"_v{k}")).alias(f"_w{k}") if op != "last" else F.max_by(f"_v{k}", F.when(F.col(f"_v{k}").isNotNull(), F.col("_at"))).alias(f"_w{k}") for k, op in enumerate(ops)))
    # one row a key and partition: at most the keys and the partitions together
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col("_part").alias("_p"), *(_CARRY[op](F.col(f"_w{k}")).over(before).alias(f"_c{k}") for k, op in enumerate(ops)))
    same = [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]
    joined = partial.join(carried, [F.col("_part") == F.col("_p"), *same])
    found = {name: _MERGE[op](F.col(f"_c{k}"), F.col(f"_own{k}")).alias(name) for k, (name, op) in enumerate(zip(measures, ops))}
    return joined.select(*(found.pop(c) if c in found else F.col(c) for c in df.columns), *found.values())
