"""Files as DataFrames and back: JSON, JSON lines, CSV, text, manifests, small tables for people."""

from __future__ import annotations

import csv
import io
import json
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Whole documents."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_jsonl_strict(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A bad line is an error when it is read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines): bad lines don't stop the reading."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", T.StructType([*struct.fields, T.StructField("_corrupt_record", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    return parsed.filter(~bad).select(*(F.col(f"r.`{f.name}`").alias(f.name) for f in struct.fields)), parsed.filter(bad).select(F.col("value").alias("line"))


def stream_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Records of JSON lines as a stream; bad lines are left out."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*struct.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.readStream.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.filter(F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()).select(*(F.col(f"r.`{f.name}`").alias(f.name) for f in struct.fields))


def append_stream(stream: DataFrame, path: str, progress: str, wait: bool = True):
    """Appends the results of a stream to files, each exactly once; with ``wait`` up to what is there now, else on and on."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", progress)
    running = (writer.trigger(availableNow=True) if wait else writer).start()
    if wait:
        running.awaitTermination()
    return running


def write_document(df: DataFrame, path: str, key: str | None = None) -> None:
    """One JSON document: a list of the rows, under ``key`` if given.  For results that one document may hold."""
    rows = F.collect_list(F.struct(*df.columns))
    df.agg(F.to_json(F.struct(rows.alias(key)) if key else rows).alias("value")).coalesce(1).write.mode("overwrite").text(path)


RULE_FIELDS = "id string, platform string, technique string, sub_technique string"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules for the coverage audit (RULE_FIELDS) from JSON lines; what is missing is null, bad lines are left out."""
    return read_jsonl_lenient(spark, path, RULE_FIELDS)[0]


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by the header."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """The given columns in the given order; others are left out."""
    df.select(*(columns or df.columns)).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, text: one row per file; bytes that aren't UTF-8 are read as Latin-1."""
    r = spark.read.format("binaryFile")
    files = (r.option("pathGlobFilter", glob) if glob else r).option("recursiveFileLookup", True).load(path)
    text = F.coalesce(_utf8("content"), F.decode("content", "ISO-8859-1"))
    return files.select("path", text.alias("text"))


def _utf8(column: str) -> Column:
    return F.when(F.is_valid_utf8(F.col(column).cast("string")), F.col(column).cast("string"))


def manifest(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, sha256, bytes of every file."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (r.option("pathGlobFilter", glob) if glob else r).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def latest_file(spark: SparkSession, path: str, glob: str, combined: str | None = None) -> str | None:
    """The greatest name that matches, else the file named ``combined`` if it is there, else none."""
    for names in (glob, combined):
        if names:
            row = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).agg(F.max("path").alias("p")).first()
            if row.p is not None:
                return row.p
    return None


def read_stix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tactics, techniques) of a bundle; revoked and deprecated objects are left out."""
    schema = "objects array<struct<type:string,name:string,description:string,revoked:boolean,x_mitre_deprecated:boolean,x_mitre_shortname:string,x_mitre_is_subtechnique:boolean,x_mitre_platforms:array<string>,x_mitre_detection:string,external_references:array<struct<source_name:string,external_id:string>>,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>>>"
    objects = read_json(spark, path, schema).select(F.explode("objects").alias("o")).select("o.*").filter(~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False)))
    key = F.get(F.filter(F.transform("external_references", lambda r: r["external_id"]), lambda i: i.rlike(r"^TA?\d{4}")), F.lit(0))
    tactics = objects.filter("type = 'x-mitre-tactic'").select(key.alias("tactic_id"), "name", F.col("x_mitre_shortname").alias("shortname"), "description")
    sub = F.coalesce("x_mitre_is_subtechnique", F.lit(False))
    techniques = objects.filter("type = 'attack-pattern'").select(key.alias("technique_id"), "name", "description", F.transform("kill_chain_phases", lambda p: p["phase_name"]).alias("tactic_names"), sub.alias("is_subtechnique"), F.when(sub, F.split_part(key, F.lit("."), F.lit(1))).alias("parent_id"), F.col("x_mitre_platforms").alias("platforms"), F.col("x_mitre_detection").alias("detection"))
    return tactics, techniques.filter("technique_id is not null")


def save_index(vectors: DataFrame, path: str, by: str | None = None) -> None:
    """Vectors with their metadata; with ``by`` only the parts present are replaced."""
    w = vectors.write.mode("overwrite")
    (w.partitionBy(by).option("partitionOverwriteMode", "dynamic") if by else w).parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def small_rows(df: DataFrame, most: int = 10_000) -> tuple[list[str], list[list]]:
    """A result for people; more rows than ``most`` are an error rather than a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: not a table for people")
    return df.columns, [list(r) for r in rows]


def markdown(df: DataFrame) -> str:
    names, rows = small_rows(df)
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def latex(df: DataFrame) -> str:
    names, rows = small_rows(df)
    marks = str.maketrans({c: "\\" + c for c in "&%$#_{}"})
    cell = lambda v: "" if v is None else str(v).translate(marks)
    return "\n".join([r"\begin{tabular}{" + "l" * len(names) + "}", " & ".join(map(cell, names)) + r" \\ \hline", *(" & ".join(map(cell, r)) + r" \\" for r in rows), r"\end{tabular}"])


def csv_text(df: DataFrame) -> str:
    names, rows = small_rows(df)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(names)
    writer.writerows(["" if v is None else v for v in r] for r in rows)
    return out.getvalue()


def json_text(df: DataFrame) -> str:
    names, rows = small_rows(df)
    return json.dumps([dict(zip(names, r)) for r in rows], indent=2, ensure_ascii=False, default=str)


def console(df: DataFrame, width: int = 40) -> str:
    """Columns as wide as their widest cell, at most ``width``; numbers to the right."""
    names, rows = small_rows(df)
    shown = [[("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)).replace("\n", " ")[:width] for v in r] for r in rows]
    wide = [max(map(len, column)) for column in zip(names, *shown)]
    right = [bool(rows) and all(isinstance(r[k], (int, float)) for r in rows) for k in range(len(names))]
    line = lambda cells: "  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(cells, wide, right)).rstrip()
    return "\n".join([line(names), line(["-" * w for w in wide]), *map(line, shown)])


#: Formats of a result for people.
EXPORTS = {"markdown": markdown, "latex": latex, "csv": csv_text, "json": json_text, "console": console}


def pretty_rule(text: str | None) -> str | None:
    """A rule document indented by two blanks; as it stands where it can't be read."""
    if text is None:
        return None
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return text
    ElementTree.indent(root, "  ")
    return ElementTree.tostring(root, encoding="unicode")


def write_rules(df: DataFrame, path: str, column: str, mode: str = "overwrite", pretty: bool = False) -> None:
    """Rule documents, one a line; with ``pretty`` indented over several lines, an empty one between."""
    if pretty:
        indented = F.pandas_udf(lambda texts: texts.map(pretty_rule), "string")
        df.select(indented(column).alias("value")).filter("value is not null").write.mode(mode).option("lineSep", "\n\n").text(path)
    else:
        df.select(F.regexp_replace(column, r"\s*\n\s*", " ").alias("value")).write.mode(mode).text(path)
