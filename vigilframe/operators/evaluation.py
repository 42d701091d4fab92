"""Evaluation steps as joins and aggregations: alignment, coverage, fidelity, ablation tables, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilframe.operators.ordering import running
from vigilframe.plans.fields import PLATFORMS


def alignment_key(id_: Column, text: Column) -> Column:
    """The id, or where it is empty the first 40 characters of the text."""
    return F.coalesce(F.nullif(id_, F.lit("")), F.substring(text, 1, 40))


def align(results: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, order: list[Column]) -> DataFrame:
    """Results with their benchmark record; of several records with one key the last in ``order`` counts."""
    key = alignment_key(F.col(id_col), F.col(text_col))
    last = benchmark.withColumn("_key", key).groupBy("_key").agg(F.max_by(F.struct(*(benchmark.columns)), F.struct(*order)).alias("benchmark"))
    return results.withColumn("_key", key).join(last, "_key").drop("_key")


def technique_ids(rules: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(rule id, platform, covered technique): the technique of a rule, the parent of a sub-technique given as one, and the named sub-technique.

    Ids that the taxonomy doesn't have cover nothing.
    """
    known = taxonomy.select(F.col("technique_id").alias("covered"), "parent_id", "is_subtechnique").dropDuplicates(["covered"])
    named = rules.select("id", "platform", F.explode(F.array(F.struct(F.col("technique").alias("t"), F.lit(True).alias("main")), F.struct(F.col("sub_technique").alias("t"), F.lit(False).alias("main")))).alias("x")).select("id", "platform", F.upper(F.trim("x.t")).alias("covered"), "x.main").filter("covered is not null")
    found = named.join(known, "covered")
    up = found.filter("main and is_subtechnique and parent_id is not null").select("id", "platform", F.col("parent_id").alias("covered"))
    return found.select("id", "platform", "covered").union(up).distinct()


def coverage(rules: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Per platform and over all (platform ``all``): rules, techniques covered, their share of the parent techniques.

    Only parent techniques count in the denominator.  Rules of unknown platforms count in ``all`` alone.
    """
    parents = taxonomy.filter(~F.coalesce("is_subtechnique", F.lit(False))).select(F.col("technique_id").alias("covered")).distinct()
    ids = technique_ids(rules, taxonomy)
    stacked = ids.filter(F.col("platform").isin(*PLATFORMS)).union(ids.withColumn("platform", F.lit("all")))
    # each (platform, technique) and (platform, rule) once, then plain counts
    techniques = stacked.groupBy("platform", "covered").agg(F.count(F.lit(1)).alias("_n")).join(parents.withColumn("_parent", F.lit(1)), "covered", "left")
    hit = techniques.groupBy("platform").agg(F.count(F.lit(1)).alias("covered"), F.count("_parent").alias("covered_parents"))
    every = stacked.groupBy("platform", "id").agg(F.count(F.lit(1)).alias("_n")).groupBy("platform").agg(F.count(F.lit(1)).alias("rules"))
    total = parents.agg(F.count(F.lit(1))).scalar()
    platforms = rules.sparkSession.createDataFrame([(p,) for p in (*PLATFORMS, "all")], "platform string")
    joined = platforms.join(hit, "platform", "left").join(every, "platform", "left").fillna(0)
    return joined.select("platform", "covered", "rules", "covered_parents").withColumn("percent", F.round(F.col("covered_parents") * 100.0 / F.greatest(total, F.lit(1)), 2))


def coverage_gaps(rules: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Parent techniques that no rule covers."""
    parents = taxonomy.filter(~F.coalesce("is_subtechnique", F.lit(False))).select("technique_id").distinct()
    return parents.join(technique_ids(rules, taxonomy).select(F.col("covered").alias("technique_id")), "technique_id", "left_anti")


def coverage_lift(before: DataFrame, after: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Per platform: percent before and after, their difference and the techniques newly covered."""
    a, b = coverage(before, taxonomy), coverage(after, taxonomy)
    old, new = (technique_ids(r, taxonomy).select("platform", "covered").distinct() for r in (before, after))
    gained = new.join(old, ["platform", "covered"], "left_anti").groupBy("platform").agg(F.array_sort(F.collect_set("covered")).alias("newly_covered"))
    return a.select("platform", F.col("percent").alias("before")).join(b.select("platform", F.col("percent").alias("after")), "platform").join(gained, "platform", "left").select("platform", "before", "after", F.round(F.col("after") - F.col("before"), 2).alias("lift"), F.coalesce("newly_covered", F.array().cast("array<string>")).alias("newly_covered"))


def fidelity(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """Per id: labels over platforms, how many are the most frequent one, and whether all agree."""
    counts = labels.filter(F.col(label).isNotNull()).groupBy(id_col, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(id_col).agg(F.sum("n").alias("labels"), F.max("n").alias("agreeing"), (F.count(F.lit(1)) == 1).alias("consistent"))


def nearest_rank(df: DataFrame, value: str, percents: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Percentiles by nearest rank, index round-half-even(p / 100 x (n - 1)), to two decimals.

    Equal values are counted first; the counts are added up in a range-partitioned order, so a group of many
    different values is spread over tasks.
    """
    by = by or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    whole = counts.groupBy(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by))).agg(F.sum("_n").alias("_all"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)] or [F.lit(True)]
    placed = running(counts, by, [value], {"_upto": ("sum", F.col("_n"))}).join(F.broadcast(whole) if not by else whole, same)
    at = lambda p: F.bround(F.lit(p / 100) * (F.col("_all") - 1), 0)
    picks = [F.round(F.min(F.when(F.col("_upto") > at(p), F.col(value))), 2).alias(n) for n, p in percents.items()]
    return placed.groupBy(*by).agg(*picks)


def rates(df: DataFrame, by: list[str], **tests: Column) -> DataFrame:
    """Rows per group and the share for which each test holds."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c.cast("int")), 4).alias(k) for k, c in tests.items()))


def ablation_table(df: DataFrame, condition: str, platform: str, valid: Column, score: Column, conditions: list[str]) -> DataFrame:
    """Every condition and platform with its rows, valid share and mean score (0 without rows) and the difference to the first condition."""
    cells = df.groupBy(condition, platform).agg(F.count(F.lit(1)).alias("n"), F.avg(valid.cast("int")).alias("v"), F.avg(score).alias("s"))
    axis = df.select(platform).distinct().withColumn(condition, F.explode(F.lit(conditions)))
    full = axis.join(cells, [condition, platform], "left").fillna(0, ["n"]).select(condition, platform, "n", F.round(F.coalesce("v", F.lit(0.0)), 4).alias("valid_rate"), F.round(F.coalesce("s", F.lit(0.0)), 4).alias("mean_score"))
    base = F.max(F.when(F.col(condition) == conditions[0], F.col("mean_score"))).over(Window.partitionBy(platform))
    return full.withColumn("delta", F.round(F.col("mean_score") - base, 4))


def macro_average(table: DataFrame, platform: str, counts: list[str], means: list[str]) -> DataFrame:
    """The table and a row ``MACRO``: counts summed, the rest the unweighted mean over platforms."""
    row = table.agg(*(F.sum(c).cast(table.schema[c].dataType).alias(c) for c in counts), *(F.round(F.avg(c), 4).alias(c) for c in means)).withColumn(platform, F.lit("MACRO"))
    return table.select(platform, *counts, *means).unionByName(row)


def histogram(df: DataFrame, category: Column, leaf: Column, n: int = 5) -> DataFrame:
    """Counts per category and its most frequent leaves (equal counts by name)."""
    counts = df.groupBy(category.alias("category"), leaf.alias("leaf")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("category").orderBy(F.desc("n"), "leaf")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def set_match(mine: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """exact, recall, precision and match (recall of at least 0.9) of two result sets by id.  Two empty sets match exactly."""
    both = mine.select(key).distinct().withColumn("_m", F.lit(1)).join(theirs.select(key).distinct().withColumn("_t", F.lit(1)), key, "full")
    n = both.agg(F.count("_m").alias("mine"), F.count("_t").alias("theirs"), F.count(F.when(F.col("_m").isNotNull() & F.col("_t").isNotNull(), 1)).alias("shared"))
    share = lambda of: F.when(F.col(of) > 0, F.col("shared") / F.col(of)).otherwise(F.when((F.col("mine") == 0) & (F.col("theirs") == 0), 1.0).otherwise(0.0))
    return n.withColumns({"recall": F.round(share("theirs"), 4), "precision": F.round(share("mine"), 4)}).withColumns({"exact": (F.col("mine") == F.col("shared")) & (F.col("theirs") == F.col("shared")), "match": F.col("recall") >= 0.9})
