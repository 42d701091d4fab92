"""Ingest of a knowledge base: texts, chunks, vectors, an index partitioned by platform."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.functions.text import chunk_id, platform_of_path, unit_chunks
from vigilframe.operators.vectors import hashing_embedding
from vigilframe.sources.files import read_texts, save_index


def chunk_table(spark: SparkSession, path: str, size: int = 512, overlap: int = 64, least: int = 20, dimensions: int = 64) -> DataFrame:
    """chunk_id, platform, source, chunk_idx, chunk, embedding of all texts under ``path``; the embedding is the hashing one."""
    texts = read_texts(spark, path, "*.txt").withColumn("platform", platform_of_path(F.col("path"))).withColumn("source", F.element_at(F.split("path", "/"), -1))
    chunks = unit_chunks(texts, "text", size, overlap, least)
    words = F.filter(F.split(F.lower("chunk"), r"\W+"), lambda w: w != "")
    return chunks.select(chunk_id(F.col("source"), F.col("chunk_idx")).alias("chunk_id"), "platform", "source", "chunk_idx", "chunk", hashing_embedding(words, dimensions).alias("embedding"))


def ingest(spark: SparkSession, path: str, index: str, **options) -> None:
    """Replaces in the index the platforms found under ``path``; others stay."""
    save_index(chunk_table(spark, path, **options), index, "platform")


def scan_pattern(spark: SparkSession, pattern: str) -> DataFrame:
    """All event files that a glob pattern names, with the columns of any."""
    return spark.read.option("mergeSchema", True).parquet(pattern)
