"""Registered queries that write tables and read them again, and queries of texts and streams.

What is written goes to a folder of its own beside the checkpoints.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.core_queries import query, table
from vigilframe.durable import checkpoint_dir
from vigilframe.sources import files


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string"
_CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
_CUSTOMER_SQL = "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS INT) AS c_nationkey, c_mktsegment FROM customer"


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("cast(c_custkey as bigint) c_custkey", "c_name", "cast(c_nationkey as int) c_nationkey", "c_mktsegment")


@query("json_document", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def json_document(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "document")
    nations = table(spark, d, "nation").selectExpr("cast(n_nationkey as bigint) n_nationkey", "n_name")
    files.write_document(nations, path)
    return files.read_json(spark, path, "n_nationkey bigint, n_name string")


@query("jsonl_strict", _CUSTOMER_SQL)
def jsonl_strict(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "lines")
    files.write_json(_customers(spark, d), path)
    return files.read_jsonl_strict(spark, path, _CUSTOMER)


@query("jsonl_appended", f"{_CUSTOMER_SQL} WHERE c_custkey % 2 = 0 UNION ALL {_CUSTOMER_SQL} WHERE c_custkey % 2 = 1")
def jsonl_appended(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "lines")
    for rest in (0, 1):
        files.append_jsonl(_customers(spark, d).filter(F.col("c_custkey") % 2 == rest), path)
    return files.read_jsonl_strict(spark, path, _CUSTOMER)


def _broken_lines(spark: SparkSession, d: str) -> str:
    path = scratch(spark, "broken")
    line = F.to_json(F.struct(*_CUSTOMER_COLUMNS))
    _customers(spark, d).select(F.when(F.col("c_custkey") % 7 == 0, F.substring(line, 1, 20)).when(F.col("c_custkey") % 7 == 1, F.concat(F.lit("  "), line)).otherwise(line).alias("value")).write.text(path)
    return path


@query("jsonl_lenient", f"{_CUSTOMER_SQL} WHERE c_custkey % 7 <> 0")
def jsonl_lenient(spark: SparkSession, d: str) -> DataFrame:
    return files.read_jsonl_lenient(spark, _broken_lines(spark, d), _CUSTOMER)[0]


@query("jsonl_bad_lines", "SELECT '{\"c_custkey\":' || substr(CAST(c_custkey AS VARCHAR) || ',\"c_name\":\"' || c_name, 1, 7) AS line FROM customer WHERE c_custkey % 7 = 0")
def jsonl_bad_lines(spark: SparkSession, d: str) -> DataFrame:
    return files.read_jsonl_lenient(spark, _broken_lines(spark, d), _CUSTOMER)[1]


@query("jsonl_stream", f"{_CUSTOMER_SQL} WHERE c_custkey % 7 <> 0")
def jsonl_stream(spark: SparkSession, d: str) -> DataFrame:
    out = scratch(spark, "streamed")
    files.append_stream(files.stream_jsonl(spark, _broken_lines(spark, d), _CUSTOMER), out, scratch(spark, "progress"))
    return spark.read.schema(_CUSTOMER).parquet(out)


@query("csv_round_trip", "SELECT c_mktsegment, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', \"' || c_mktsegment || '\"' AS c_quoted FROM customer")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    quoted = _customers(spark, d).withColumn("c_quoted", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')))
    files.write_csv(quoted, path, ["c_mktsegment", "c_custkey", "c_quoted"])
    return files.read_csv(spark, path)


@query("text_files", "SELECT n_name AS line FROM nation")
def text_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "texts")
    table(spark, d, "nation").select("n_name").coalesce(1).write.text(path)
    lines = files.read_texts(spark, path, "*.txt").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter("line <> ''")


@query("file_manifest", "SELECT sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS sha256, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS bytes FROM nation")
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "texts")
    table(spark, d, "nation").orderBy("n_nationkey").select("n_name").coalesce(1).write.text(path)
    return files.manifest(spark, path, "*.txt").select("sha256", "bytes")


@query("bundle_tactics", "SELECT tactic_id, name, shortname, description FROM tactics")
def bundle_tactics(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "bundle")
    t = table(spark, d, "tactics")
    objects = t.select(F.lit("x-mitre-tactic").alias("type"), "name", "description", F.lit(False).alias("revoked"), F.col("shortname").alias("x_mitre_shortname"), F.array(F.struct(F.lit("catalogue").alias("source_name"), F.col("tactic_id").alias("external_id"))).alias("external_references"))
    withdrawn = objects.withColumn("revoked", F.lit(True)).withColumn("name", F.lit("withdrawn"))
    files.write_document(objects.union(withdrawn), path, "objects")
    return files.read_stix(spark, path)[0]


@query("index_round_trip", "SELECT vec_id, label FROM embeddings WHERE label IS NOT NULL")
def index_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "index")
    v = table(spark, d, "embeddings").filter("label is not null")
    files.save_index(v, path, "label")
    files.save_index(v.filter("label = 3"), path, "label")  # only this part is replaced
    return files.load_index(spark, path).select("vec_id", F.col("label").cast(v.schema["label"].dataType).alias("label"))


@query("index_pattern", "SELECT event_id, user_id, event_type FROM events")
def index_pattern(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.sources.ingest import scan_pattern

    return scan_pattern(spark, f"{d}/event*.parquet").select("event_id", "user_id", "event_type")


@query("coverage_rules", "SELECT CAST(ex_id AS VARCHAR) AS id, 'any' AS platform, technique_id AS technique, CAST(NULL AS VARCHAR) AS sub_technique FROM examples WHERE technique_id IS NOT NULL")
def coverage_rules(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "rules")
    rules = table(spark, d, "examples").filter("technique_id is not null").select(F.col("ex_id").cast("string").alias("id"), F.lit("any").alias("platform"), F.col("technique_id").alias("technique"))
    files.append_jsonl(rules, path)
    return files.read_rules(spark, path)


@query("markdown_table", "SELECT '| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS text FROM nation")
def markdown_table(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(files.markdown(table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey")),)], "text string")


# Scans by event type


@query("scan_by_type", "SELECT event_id FROM events WHERE event_type = 'purchase' AND value > 50")
def scan_by_type(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.plans.compile import Source, compile_query
    from vigilframe.plans.query import parse

    e = table(spark, d, "events")
    tables = {"authentication": e.filter("event_type = 'signup'"), "network": e.filter("event_type = 'purchase'")}
    q = parse({"action": "filter", "event_type": "network", "filter": {"conditions": [{"field": "value", "op": "gt", "value": 50}]}})
    return compile_query(q, Source(tables, time_column="ts")).select("event_id")


@query("scan_by_category", "SELECT event_id FROM events WHERE replace(event_type, 'error', 'process') = 'process' AND value <= 50")
def scan_by_category(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.plans.compile import Source, compile_query
    from vigilframe.plans.query import parse

    e = table(spark, d, "events").withColumn("kind", F.replace("event_type", F.lit("error"), F.lit("process")))
    q = parse({"action": "filter", "event_type": "process", "filter": {"conditions": [{"field": "value", "op": "lte", "value": 50}]}})
    return compile_query(q, Source({"any": e}, type_column="kind", time_column="ts")).select("event_id")


# Texts


@query("durations", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 ELSE 86400 END AS seconds, '-' || CAST(l_quantity AS BIGINT) || ['s', 'm', 'h', 'd'][l_linenumber % 4 + 1] AS splunk, 'ago(' || CAST(l_quantity AS BIGINT) || ['s', 'm', 'h', 'd'][l_linenumber % 4 + 1] || ')' AS sentinel, 'LAST ' || CAST(l_quantity AS BIGINT) || ' ' || ['SECONDS', 'MINUTES', 'HOURS', 'DAYS'][l_linenumber % 4 + 1] AS qradar FROM lineitem")
def durations(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.functions.text import duration_literal, duration_seconds

    unit = F.get(F.array(*map(F.lit, "smhd")), (F.col("l_linenumber") % 4).cast("int"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_quantity").cast("long").cast("string"), unit).alias("t"))
    return rows.select("l_orderkey", "l_linenumber", duration_seconds(F.col("t")).alias("seconds"), *(duration_literal(F.col("t"), p).alias(p) for p in ("splunk", "sentinel", "qradar")))


@query("text_documents", "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) AS digest FROM documents")
def text_documents(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.functions.text import normal_document

    return table(spark, d, "documents").select("doc_id", F.md5(normal_document(F.col("text"))).alias("digest"))


@query("path_platforms", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE coalesce(nullif(regexp_extract(platform, '^\\w+$'), ''), 'unknown') END AS platform, regexp_replace(coalesce(source, ''), '[^\\w.-]', '_', 'g') || '__chunk_' || lpad(CAST(doc_id % 50 AS VARCHAR), 4, '0') AS chunk_id FROM documents")
def path_platforms(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.functions.text import chunk_id, platform_of_path

    folder = F.when(F.col("doc_id") % 3 == 0, F.lit("notes")).otherwise(F.lit("knowledge_base"))
    path = F.concat(F.lit("/data/"), folder, F.lit("/"), F.coalesce("platform", F.lit("-")), F.lit("/a.txt"))
    return table(spark, d, "documents").select("doc_id", platform_of_path(path).alias("platform"), chunk_id(F.coalesce("source", F.lit("")), (F.col("doc_id") % 50).cast("int")).alias("chunk_id"))


@query("chunk_totals", "WITH u AS (SELECT doc_id, doc_type, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS n FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_type, least(n - i * 448, 512) AS n FROM (SELECT doc_type, n, unnest(generate_series(0, (n - 1) // 448)) AS i FROM u WHERE n > 0)) SELECT doc_type, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS units, round(avg(n), 4) AS mean_units, CAST(min(n) AS INT) AS least, CAST(max(n) AS INT) AS most FROM w WHERE n >= 20 GROUP BY 1")
def chunk_totals(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.functions.text import chunk_statistics, unit_chunks

    return chunk_statistics(unit_chunks(table(spark, d, "documents").select("doc_type", "text"), "text"), "doc_type")


@query("error_histogram", "WITH c AS (SELECT platform AS category, coalesce(error, '') AS leaf, count(*) AS n FROM ablation GROUP BY ALL) SELECT category, leaf, n, CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, leaf) AS INT) AS rank FROM c QUALIFY rank <= 5")
def error_histogram(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.evaluation import histogram

    return histogram(table(spark, d, "ablation"), F.col("platform"), F.coalesce("error", F.lit("")))


@query("pass_rates", "SELECT platform, count(*) AS n, round(avg(CAST(is_valid AS INT)), 4) AS valid FROM ablation GROUP BY 1")
def pass_rates(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.operators.evaluation import rates

    return rates(table(spark, d, "ablation"), ["platform"], valid=F.col("is_valid"))


# Streams: read to their end, so that they give a table.


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("stream_append", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 50")
def stream_append(spark: SparkSession, d: str) -> DataFrame:
    out = scratch(spark, "appended")
    found = _event_stream(spark, d).filter("event_type = 'purchase' and value > 50").select("event_id", "user_id", "value")
    files.append_stream(found, out, scratch(spark, "progress"))
    return spark.read.schema(found.schema).parquet(out)


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) >= 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    from vigilframe.plans.fields import Binding
    from vigilframe.plans.query import parse
    from vigilframe.streaming import windowed_query

    q = parse({"action": "filter+aggregate", "time_window": "1d", "filter": {"conditions": [{"field": "event_type", "op": "eq", "value": "error"}]}, "aggregation": {"function": "count", "group_by": ["user_id"], "alias": "n"}, "threshold": {"field": "n", "op": "gte", "value": 2}})
    windows = windowed_query(_event_stream(spark, d), q, Binding(), "ts").select("window_start", "user_id", "n")
    out = scratch(spark, "windows")

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    windows.writeStream.outputMode("complete").option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).foreachBatch(replace).start().awaitTermination()
    return spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
