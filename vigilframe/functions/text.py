"""Texts, queries and durations as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_text(x: Column) -> Column:
    """Lower case, trimmed, white space collapsed; null as empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))


def normal_query(x: Column) -> Column:
    """Without comments from ``#`` to the end of a line, then as ``normal_text``."""
    return normal_text(F.regexp_replace(x, r"(?m)#.*$", ""))


def normal_document(x: Column) -> Column:
    """Unix line ends, single blanks, at most one empty line, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "\r\n", "\n"), r"[ \t]+", " "), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


# Spellings that count as one token's.
_SPELLINGS = (
    (r"\bcount\s*\(\s*\*?\s*\)", "count"),
    (r"\bcount\s*\(\s*distinct\b", "count_distinct"),
    (">=", "gte"),
    ("<=", "lte"),
    ("!=", "neq"),
    ("==", "eq"),
)
# Signs that are tokens of their own.
_SIGNS = r"|=><!()\[\]{},;"


def query_tokens(x: Column) -> Column:
    """Tokens of a query in lower case: calls and operators in one spelling, runs of other characters and single signs."""
    spelt = F.lower(F.coalesce(x, F.lit("")))
    for pattern, name in _SPELLINGS:
        spelt = F.regexp_replace(spelt, pattern, name)
    return F.regexp_extract_all(spelt, F.lit(rf"([^\s{_SIGNS}]+|[{_SIGNS}])"), F.lit(1))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens in order, joined by blanks, repeated ones too."""
    last = F.size(tokens) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def duration_seconds(x: Column) -> Column:
    """Seconds of a duration like 24h; null where the text is none."""
    unit = F.regexp_extract(x, r"^(\d+)([smhd])$", 2)
    scale = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.regexp_extract(x, r"^(\d+)([smhd])$", 1).try_cast("long") * scale


def duration_literal(x: Column, dialect: str) -> Column:
    """-24h, ago(24h) or LAST 24 HOURS."""
    n, unit = F.regexp_extract(x, r"^(\d+)", 1), F.regexp_extract(x, r"([smhd])$", 1)
    word = F.when(unit == "s", "SECONDS").when(unit == "m", "MINUTES").when(unit == "h", "HOURS").otherwise("DAYS")
    return {"splunk": F.concat(F.lit("-"), x), "sentinel": F.concat(F.lit("ago("), x, F.lit(")")), "qradar": F.concat_ws(" ", F.lit("LAST"), n, word)}[dialect]


def estimate_tokens(x: Column) -> Column:
    """A third of the characters, at least one; none for an empty or null text."""
    n = F.length(F.coalesce(x, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 3).cast("int")))


def platform_of_path(path: Column) -> Column:
    found = F.regexp_extract(path, r"knowledge_base[/\\](\w+)[/\\]", 1)
    return F.when(found == "", "unknown").otherwise(found)


def technique_ok(x: Column) -> Column:
    return x.rlike(r"^T\d{4}$")


def sub_technique_ok(x: Column, parent: Column) -> Column:
    return x.rlike(r"^T\d{4}\.\d{3}$") & (F.split_part(x, F.lit("."), F.lit(1)) == parent)


def tactic_name(x: Column) -> Column:
    return F.replace(F.replace(F.lower(F.trim(x)), F.lit(" "), F.lit("-")), F.lit("_"), F.lit("-"))


def unit_chunks(df: DataFrame, text: str, size: int = 512, overlap: int = 64, least: int = 20, strategy: str = "word") -> DataFrame:
    """Sliding windows over the words, sentences or characters of a text: chunk_idx, chunk and n_units.

    Windows begin every size - overlap units; one with fewer than ``least`` units ends the text, so a window may lie
    wholly in the one before.  Null and empty texts have none.
    """
    clean = normal_document(F.coalesce(F.col(text), F.lit("")))
    if strategy == "word":  # which needs no normal form: white space only separates
        bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
        units, glue = F.when(bare != "", F.split(bare, r"\s+")), " "
    elif strategy == "sentence":
        units, glue = F.filter(F.transform(F.split(clean, r"(?<=[.!?])\s+"), F.trim), lambda u: u != ""), " "
    elif strategy == "char":
        units, glue = F.filter(F.split(clean, ""), lambda u: u != ""), ""
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    step = size - overlap
    marked = df.withColumn("_u", units).filter(F.size("_u") > 0)
    windows = marked.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), F.floor((F.size("_u") - 1) / step).cast("int"))))
    cut = F.slice("_u", F.col("chunk_idx") * step + 1, size)
    return windows.withColumn("_w", cut).filter(F.size("_w") >= least).withColumn("chunk", F.array_join("_w", glue)).withColumn("n_units", F.size("_w")).drop("_u", "_w")


def chunk_id(source: Column, idx: Column) -> Column:
    return F.concat(F.regexp_replace(source, r"[^\w.-]", "_"), F.format_string("__chunk_%04d", idx))


def chunk_statistics(chunks: DataFrame, by: str) -> DataFrame:
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_units").alias("units"), F.round(F.avg("n_units"), 4).alias("mean_units"), F.min("n_units").alias("least"), F.max("n_units").alias("most"))


def keyword_search(taxonomy: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Techniques by keyword: 10 for the phrase in the name, 3 for each word of the name, 1 for each of the description."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\w]+"), lambda w: w != ""))
    wanted = words(F.lit(query))
    score = F.when(F.contains(F.lower("name"), F.lit(query.lower())), 10).otherwise(0) + 3 * F.size(F.array_intersect(words(F.col("name")), wanted)) + F.size(F.array_intersect(words(F.col("description")), wanted))
    return taxonomy.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "technique_id").limit(k)


#: Markers of complexity (fixed values).
COMPLEX_MARKERS = ("sequence", "then", "followed by", "correlate", "across", "from one", "to a different")
INTERMEDIATE_MARKERS = ("more than", "exceeding", "threshold", "aggregate", "group by", "count", "distinct")


def complexity(x: Column) -> Column:
    low = F.lower(F.coalesce(x, F.lit("")))
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return F.when(any_of(COMPLEX_MARKERS), "complex").when(any_of(INTERMEDIATE_MARKERS), "intermediate").otherwise("simple")
