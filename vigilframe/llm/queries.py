"""Registered queries of the operators of this subpackage, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm import oracle
from vigilframe.llm.mixing import mixture, short_sources, source_sizes
from vigilframe.llm.neardup import document_pairs, near_duplicate_groups, near_duplicates
from vigilframe.llm.pairs import pair_defects
from vigilframe.llm.pieces import long_texts, text_pieces
from vigilframe.llm.ranking import Score, ideal_point_ranking
from vigilframe.llm.sampling import categorised, json_field, label_key, proportional_sample
from vigilframe.llm.splits import assign_splits, entity_components
from vigilframe.llm.subjects import document_subjects
from vigilframe.llm.tokens import encode_documents, vocabulary
from vigilframe.llm.words import NO_WORD, plain_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Problem 2


def family(technique: Column) -> Column:
    """``T`` and four digits in upper case, null where the text doesn't begin with them."""
    found = F.regexp_extract(F.upper(technique), r"^\s*(T\d{4})(?!\d)", 1)
    return F.when(found != "", found)


def question(text: Column) -> Column:
    """The words of a question in order, null if it has none."""
    joined = F.trim(F.regexp_replace(F.lower(text), NO_WORD, " "))
    return F.when(joined != "", joined)


def _components(spark: SparkSession, d: str) -> DataFrame:
    examples = table(spark, d, "examples")
    return entity_components(examples, "ex_id", {"family": family(F.col("technique_id")), "question": question(F.col("nl_query"))})


@query("p2_found", oracle.P2_FOUND)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.llm.splits import linking_pairs

    examples = table(spark, d, "examples")
    return linking_pairs(examples, "ex_id", question(F.col("nl_query")), family(F.col("technique_id")), table(spark, d, "split_targets"))


@query("p2_splits")
def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return assign_splits(_components(spark, d), table(spark, d, "split_targets")).select("ex_id", "component", "split")


# Problem 3


@query("p3_found", oracle.P3_FOUND)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return long_texts(text_pieces(table(spark, d, "technique_entries"), "entry_id", ["description", "detection"], with_text=False))


@query("p3_pieces")
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return text_pieces(table(spark, d, "technique_entries"), "entry_id", ["description", "detection"])


# Problem 5

DIMS = ["tactic", "complexity", "action"]


def _categorised(spark: SparkSession, d: str) -> DataFrame:
    examples = json_field(table(spark, d, "examples").select("ex_id", "tactic", "complexity", "ir"), "ir", "action", "action")
    tactics = table(spark, d, "tactics")
    # The spellings of a dozen tactics: a small map inside the plan.
    spelt = tactics.select(F.explode(F.array("tactic_id", "name", "shortname")).alias("s"), F.regexp_replace("shortname", "-", "_").alias("t")).select(label_key(F.col("s")).alias("k"), "t").filter("k is not null and t is not null").groupBy("k").agg(F.min("t").alias("t")).collect()
    named = F.create_map(*(F.lit(x) for r in spelt for x in (r.k, r.t))) if spelt else F.create_map().cast("map<string,string>")
    dims = {"tactic": F.try_element_at(named, F.coalesce(label_key(F.col("tactic")), F.lit(""))), "complexity": F.lower(F.regexp_replace("complexity", r"^\s+|\s+$", "")), "action": F.col("action")}
    return categorised(examples, table(spark, d, "sample_targets"), dims, ["ex_id"])


@query("p5_found", oracle.P5_FOUND)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_report(spark, d).filter("scarce").select("dim", "category")


@query("p5_sample")
def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return proportional_sample(_categorised(spark, d), table(spark, d, "sample_targets"), "ex_id", DIMS)[0]


@query("p5_report")
def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return proportional_sample(_categorised(spark, d), table(spark, d, "sample_targets"), "ex_id", DIMS)[1]


# Problem 6

SCORES = [Score("bleu", 0.0, 100.0), Score("rouge_l"), Score("field_f1"), Score("token_edit_sim")]


@query(
    "p6_ranking",
    """
    WITH scaled AS (
      SELECT record_id,
        CASE WHEN bleu IS NOT NULL AND NOT isnan(bleu) AND bleu BETWEEN 0 AND 100 THEN bleu / 100.0::DOUBLE END AS s0,
        CASE WHEN rouge_l IS NOT NULL AND NOT isnan(rouge_l) AND rouge_l BETWEEN 0 AND 1 THEN rouge_l END AS s1,
        CASE WHEN field_f1 IS NOT NULL AND NOT isnan(field_f1) AND field_f1 BETWEEN 0 AND 1 THEN field_f1 END AS s2,
        CASE WHEN token_edit_sim IS NOT NULL AND NOT isnan(token_edit_sim) AND token_edit_sim BETWEEN 0 AND 1 THEN token_edit_sim END AS s3
      FROM ablation),
    long AS (
      SELECT record_id, k, v FROM (
        SELECT record_id, unnest([0, 1, 2, 3]) AS k, unnest([s0, s1, s2, s3]) AS v FROM scaled)),
    bounds AS (
      SELECT k, quantile_disc(v, 0.01) AS low, quantile_disc(v, 0.5) AS mid, quantile_disc(v, 0.99) AS high FROM long GROUP BY k),
    clipped AS (
      SELECT record_id, l.k, least(greatest(coalesce(v, mid), low), high) AS x, v IS NOT NULL AS known, low, high FROM long l JOIN bounds b USING (k)),
    length AS (SELECT k, sqrt(CAST(sum(CAST(round(x * x * 1e12) AS HUGEINT)) AS DOUBLE) / 1e12) AS len FROM clipped GROUP BY k),
    points AS (
      SELECT record_id, sum(CAST(known AS INT)) AS scores_known,
        sqrt(max(CASE k WHEN 0 THEN (x - high) / len * ((x - high) / len) END) + max(CASE k WHEN 1 THEN (x - high) / len * ((x - high) / len) END) + max(CASE k WHEN 2 THEN (x - high) / len * ((x - high) / len) END) + max(CASE k WHEN 3 THEN (x - high) / len * ((x - high) / len) END)) AS best,
        sqrt(max(CASE k WHEN 0 THEN (x - low) / len * ((x - low) / len) END) + max(CASE k WHEN 1 THEN (x - low) / len * ((x - low) / len) END) + max(CASE k WHEN 2 THEN (x - low) / len * ((x - low) / len) END) + max(CASE k WHEN 3 THEN (x - low) / len * ((x - low) / len) END)) AS worst
      FROM clipped JOIN length USING (k) GROUP BY record_id),
    placed AS (SELECT record_id, CAST(scores_known AS INT) AS scores_known, CASE WHEN best + worst > 0 THEN worst / (best + worst) ELSE 0.5 END AS c FROM points)
    SELECT record_id, scores_known, round(c, 9) AS closeness, row_number() OVER (ORDER BY c DESC, record_id) AS rank FROM placed
    """,
)
def p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ideal_point_ranking(table(spark, d, "ablation"), "record_id", SCORES)


# Problem 7

SIMILARITY = 0.6


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(table(spark, d, "examples"), "ex_id", F.col("nl_query"), SIMILARITY)


@query("p7_found", oracle.P7_FOUND)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return document_pairs(*_near(spark, d))


@query("p7_groups")
def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_groups(*_near(spark, d))


# Problem 8


@query("p8_ids")
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_documents(table(spark, d, "documents"), "doc_id", "text", vocabulary("byte_bpe_50k"))


# Problem 9


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = encode_documents(table(spark, d, "documents"), "doc_id", "text", vocabulary("byte_bpe_50k"), keep=["source"], counts=True)
    return docs.withColumn("source", plain_source(F.col("source")))


def _mix_targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mix_targets")


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return short_sources(*source_sizes(_sized(spark, d), _mix_targets(spark, d)))


@query("p9_mixture")
def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(_sized(spark, d), _mix_targets(spark, d), "doc_id")[0]


@query("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture(_sized(spark, d), _mix_targets(spark, d), "doc_id")[1]


# Problem 4


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects(table(spark, d, "ablation"), "record_id", "nl_query", "hypothesis", "reference")


# Problem 10


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("source", plain_source(F.col("source")))
    return document_subjects(docs, table(spark, d, "subject_labels"), table(spark, d, "subjects"), "doc_id", "text", "source")


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


@query("p10_composition")
def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.avg("posterior"), 6).alias("mean_posterior"))
