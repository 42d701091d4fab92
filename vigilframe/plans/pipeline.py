"""From a table of questions to checked queries of all platforms, in one plan."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.dialects import render_column
from vigilframe.dialects.checking import check
from vigilframe.plans.parser import Parser, rule_parser


def documents(df: DataFrame, text: str, parser: Parser = rule_parser) -> DataFrame:
    """``df`` with the query document of each text as JSON (``document``); null where the parser fails."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(parser(t))
            except (ValueError, KeyError, TypeError):
                return None

        return texts.map(one)

    return df.withColumn("document", run(F.col(text)))


def translations(df: DataFrame, id_col: str, text: str, parser: Parser = rule_parser) -> DataFrame:
    """(id, platform, query, is_valid, error_type): every question in every language, with its static check.

    Questions without a document have no rows.
    """
    rendered = documents(df.select(id_col, text), text, parser).withColumn("_q", render_column(F.col("document"))).filter("_q is not null")
    rows = rendered.select(id_col, F.explode("_q").alias("platform", "query"))
    checked = rows.withColumn("_c", check(F.col("platform"), F.col("query")))
    return checked.select(id_col, "platform", "query", "_c.is_valid", "_c.error_type")


def accepted(rows: DataFrame, id_col: str, least: int = 3) -> DataFrame:
    """Per question how many platforms are valid, their share, and whether enough are."""
    n = rows.groupBy(id_col).agg(F.count_if("is_valid").alias("n_valid"), F.round(F.avg(F.col("is_valid").cast("int")), 4).alias("pass_rate"))
    return n.withColumn("accepted", F.col("n_valid") >= least)
