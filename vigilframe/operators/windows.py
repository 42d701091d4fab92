"""Windowed event operators: sliding frequency, sessions, running and per-group statistics, time charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilframe.functions.times import epoch_micros
from vigilframe.operators.ordering import running


def _micros(df: DataFrame, time: str) -> Column:
    return epoch_micros(F.col(time), df.schema[time].dataType)


def _slice(df: DataFrame, time: str, seconds: int) -> Column:
    return F.floor(_micros(df, time) / (seconds * 1_000_000))


def frequency(df: DataFrame, keys: list[str], time: str, span_seconds: int, least: int, name: str = "in_span") -> DataFrame:
    """Events at which their key has had at least ``least`` events within the closed span before them.

    Events are windowed per key and time slice as wide as the span; each is also lent to the slice after its own, as
    what came before.  So a hot key is spread over its slices instead of being one task.
    """
    lent = df.withColumn("_lent", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_slice", _slice(df, time, span_seconds) + F.col("_lent"))
    w = Window.partitionBy(*keys, "_slice").orderBy(_micros(df, time)).rangeBetween(-span_seconds * 1_000_000, 0)
    return lent.withColumn(name, F.count(F.lit(1)).over(w)).filter(f"_lent = 0 and `{name}` >= {int(least)}").drop("_lent", "_slice")


def sessions(df: DataFrame, keys: list[str], time: str, gap_seconds: int) -> DataFrame:
    """Transactions: events of a key (or, without keys, all events) that follow one another within the gap.

    Columns: keys, session (0, 1, .. in time), started, ended, events.  Events are first counted per time slice as
    wide as the gap - within one no gap can open - where they are; only the slices are ordered, at most the time
    span divided by the gap for each key, however many events there are.  Rows without a time are left out.
    """
    slices = df.filter(F.col(time).isNotNull()).groupBy(*keys, _slice(df, time, gap_seconds).alias("_slice")).agg(F.min(time).alias("_a"), F.max(time).alias("_b"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_slice")
    gap = _micros(slices, "_a") - F.lag(_micros(slices, "_b")).over(w)
    marked = slices.withColumn("_new", F.coalesce((gap > gap_seconds * 1_000_000).cast("int"), F.lit(0)))
    numbered = marked.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return numbered.groupBy(*keys, "session").agg(F.min("_a").alias("started"), F.max("_b").alias("ended"), F.sum("_n").alias("events"))


def eventstats(df: DataFrame, by: list[str], **measures: Column) -> DataFrame:
    """Aggregates of each row's group beside the row.  The groups are aggregated once and joined back, so a hot group is not one task."""
    stats = df.groupBy(*(F.col(k).alias(f"_by{n}") for n, k in enumerate(by))).agg(*(c.alias(f"_of{n}") for n, c in enumerate(measures.values())))
    joined = df.join(stats, [F.col(k).eqNullSafe(F.col(f"_by{n}")) for n, k in enumerate(by)], "left")
    return joined.select(*df.columns, *(F.col(f"_of{n}").alias(name) for n, name in enumerate(measures)))


def streamstats(df: DataFrame, by: list[str], order: list[str], **measures: tuple[str, Column]) -> DataFrame:
    """Running aggregates of each group in the given order: (count, sum, min, max or last, expression)."""
    return running(df, by, order, measures)


def timechart(df: DataFrame, time: str, width: str, by: list[str] | None = None, **measures: Column) -> DataFrame:
    """Aggregates per tumbling time bucket (``bucket`` is its start) and key."""
    return df.groupBy(F.window(time, width).getField("start").alias("bucket"), *(by or [])).agg(*(c.alias(n) for n, c in measures.items()))


def make_series(df: DataFrame, time: str, seconds: int, start, end, by: list[str], default: int = 0) -> DataFrame:
    """Counts per bucket and key on a full time axis: buckets without events have ``default``."""
    count = df.filter((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))
    kind = df.schema[time].dataType
    first = epoch_micros(F.lit(start).cast(kind), kind)
    at = F.floor((_micros(df, time) - first) / (seconds * 1_000_000)).cast("int")
    seen = count.groupBy(*by, at.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    last = F.floor((epoch_micros(F.lit(end).cast(kind), kind) - first - 1) / (seconds * 1_000_000)).cast("int")
    axis = count.select(*by).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), last)))
    return axis.join(seen, [*by, "slot"], "left").fillna({"n": default}).withColumn("bucket", F.lit(start).cast(kind) + F.make_dt_interval(secs=F.col("slot") * seconds)).drop("slot")


def risk(df: DataFrame, entity: str, score: Column, least: float) -> DataFrame:
    """Entities whose summed score reaches ``least``."""
    return df.groupBy(entity).agg(F.sum(score).alias("risk")).filter(F.col("risk") >= least)
