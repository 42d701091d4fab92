"""Pipeline commands of search languages as DataFrame transformations."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilframe.functions.times import epoch_micros
from vigilframe.operators.ordering import number_rows, running


def dedup(df: DataFrame, keys: list[str], order: list[Column | str], keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each key in the given order: columns, or names, those with a ``-`` before them falling."""
    named = all(isinstance(c, str) for c in order)
    falling = {c.startswith("-") for c in order if isinstance(c, str)}
    if keep == 1 and (not named or len(falling) < 2):
        # an aggregate combines before the shuffle, a window would not
        names = df.columns
        first = F.max_by if True in falling else F.min_by
        by = F.struct(*(c.lstrip("-") if isinstance(c, str) else c for c in order))
        rows = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(first(F.struct(*names), by).alias("_r"))
        return rows.select(*(F.col("_r")[n].alias(n) for n in names))
    sorts = [c if not isinstance(c, str) else F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*sorts))).filter(F.col("_n") <= keep).drop("_n")


def top(df: DataFrame, fields: list[str], n: int = 10, rare: bool = False) -> DataFrame:
    """The most (or least) frequent values with their count and share of the whole."""
    counts = df.groupBy(*fields).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1))).scalar()
    shared = counts.withColumn("percent", F.round(F.col("count") * 100.0 / total, 6))
    return shared.orderBy(F.asc("count") if rare else F.desc("count"), *fields).limit(n)


def tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last rows of an ascending order."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(n)


def fillnull(df: DataFrame, value, fields: list[str] | None = None) -> DataFrame:
    return df.fillna(value, fields)


def filldown(df: DataFrame, by: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Nulls take the last known value of their key."""
    return running(df, by, order, {f: ("last", F.col(f)) for f in fields})


def appendcols(left: DataFrame, right: DataFrame, order_left: list[str], order_right: list[str]) -> DataFrame:
    """Columns side by side by row number."""
    number = lambda df, by: number_rows(df, [F.asc(c) for c in by], "_n")
    return number(left, order_left).join(number(right, order_right), "_n", "left").drop("_n")


def append(*frames: DataFrame) -> DataFrame:
    """Rows of all, with the columns of any."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def chart(df: DataFrame, by: str, over: str, values: list, measure: Column) -> DataFrame:
    """A pivot over given values."""
    return df.groupBy(by).pivot(over, values).agg(measure)


def mv_expand(df: DataFrame, field: str) -> DataFrame:
    return df.withColumn(field, F.explode(field))


def foreach(df: DataFrame, fields: list[str], f) -> DataFrame:
    """The same expression on several columns."""
    return df.withColumns({c: f(F.col(c)) for c in fields})


def extract(df: DataFrame, source: str, pattern: str, names: list[str]) -> DataFrame:
    """The groups of a pattern as columns; null where the pattern isn't found."""
    hit = F.col(source).rlike(pattern)
    return df.withColumns({n: F.when(hit, F.regexp_extract(source, pattern, k)) for k, n in enumerate(names, 1)})


def sample_sequence(frames: list[DataFrame], key: str) -> DataFrame:
    """Keys that occur in every frame, in any order."""
    return functools.reduce(lambda a, b: a.join(b, key), (f.select(key).distinct() for f in frames))


def sequence_until(chains: DataFrame, stops: DataFrame, key: str, time: str, first: str, last: str, bucket_seconds: int = 3600) -> DataFrame:
    """Chains (key, step times) without an event of ``stops`` of the same key between their first and last step.

    Both sides meet by key and time bucket, so a hot key is spread over its buckets; a chain is lent to every
    bucket that it touches.
    """
    width = bucket_seconds * 1_000_000
    micros = lambda df, c: epoch_micros(F.col(c), df.schema[c].dataType)
    s = stops.filter(F.col(time).isNotNull()).select(F.col(key).alias("_k"), F.floor(micros(stops, time) / width).alias("_b"), F.col(time).alias("_t")).distinct()
    spans = chains.filter(F.col(first) < F.col(last)).distinct()
    lent = spans.withColumn("_b", F.explode(F.sequence(F.floor(micros(chains, first) / width), F.floor(micros(chains, last) / width))))
    hit = lent.join(s, (F.col("key") == F.col("_k")) & (lent["_b"] == s["_b"]) & (F.col("_t") > F.col(first)) & (F.col("_t") < F.col(last)), "left_semi").select(*(F.col(c).alias(f"_h{n}") for n, c in enumerate(chains.columns))).distinct()
    return chains.join(hit, [F.col(c).eqNullSafe(F.col(f"_h{n}")) for n, c in enumerate(chains.columns)], "left_anti")


def in_cidr(ip: Column, cidr: str) -> Column:
    """Whether a dotted address lies in a network, by integer ranges; null or unreadable addresses give null."""
    base, _, bits = cidr.partition("/")
    number = functools.reduce(lambda a, b: a * 256 + b, map(int, base.split(".")))
    size = 1 << (32 - int(bits or 32))
    low = number // size * size
    value = ip_number(ip)
    return (value >= low) & (value < low + size)


def ip_number(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    octet = lambda k: F.get(parts, F.lit(k)).try_cast("long")
    sound = (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike(r"^\d{1,3}$") & (p.try_cast("int") <= 255))
    return F.when(sound, ((octet(0) * 256 + octet(1)) * 256 + octet(2)) * 256 + octet(3))
