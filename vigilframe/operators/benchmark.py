"""Building an evaluation set: normal texts, duplicates, quality gate, stratified split without leaks, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.text import normal_text
from vigilframe.operators.ordering import number_rows, number_within


def content_hash(*parts: Column) -> Column:
    """The first twelve hexadecimal digits of the SHA-256 of the parts joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)


def first_of_each_text(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Of rows with one normalised text the first in ``order``; rows without text are left out."""
    names = df.columns
    keyed = df.withColumn("_key", normal_text(F.col(text))).filter("_key <> ''")
    return keyed.groupBy("_key").agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_r")).select(*(F.col("_r")[n].alias(n) for n in names))


def not_done(df: DataFrame, done: DataFrame, text: str) -> DataFrame:
    """Rows whose normalised text isn't among those done."""
    return df.withColumn("_key", normal_text(F.col(text))).join(done.select(normal_text(F.col(text)).alias("_key")), "_key", "left_anti").drop("_key")


def stratified_split(df: DataFrame, group: str, tier: str, seed: int = 42, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """Every row with its split; groups stay whole and each tier is cut at rounded shares (half to even).

    Groups are ordered by the MD5 of seed and group, so the split is the same under any partitioning.  A group
    of several tiers counts in the least of them.
    """
    groups = df.groupBy(group).agg(F.min(tier).alias("_tier"))
    numbered = number_within(groups, ["_tier"], [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group))), F.col(group)], "_n")
    sizes = groups.groupBy(F.col("_tier").alias("_of")).agg(F.count(F.lit(1)).alias("_all"))
    placed = numbered.join(sizes, F.col("_tier").eqNullSafe(F.col("_of")))
    a = F.bround(F.col("_all") * F.lit(train), 0)
    b = a + F.bround(F.col("_all") * F.lit(validation), 0)
    chosen = placed.select(F.col(group), F.when(F.col("_n") <= a, "train").when(F.col("_n") <= b, "validation").otherwise("test").alias("split"))
    return df.join(chosen, group)


def sequential_ids(df: DataFrame, order: list[str], prefix: str = "SB", width: int = 4) -> DataFrame:
    """Ids like SB-0001 in the given order."""
    return number_rows(df, [F.asc(c) for c in order], "_n").select("*", F.format_string(f"{prefix}-%0{width}d", F.col("_n")).alias("seq_id")).drop("_n")


def quality_gate(df: DataFrame, valid_platforms: Column, least: int = 3) -> DataFrame:
    """Rows with how many platforms are valid and whether that is enough."""
    return df.withColumn("n_valid", valid_platforms).withColumn("accepted", F.col("n_valid") >= least)


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """(dim, value, n) for several columns in one pass."""
    stacked = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("value")) for c in columns))).alias("e"))
    return stacked.groupBy("e.dim", "e.value").agg(F.count(F.lit(1)).alias("n"))
