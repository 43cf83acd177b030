"""The driver's tables as logs and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same views for the SQL oracles.
LOGS_SQL = """
    SELECT event_id AS id, epoch_us(ts) // 1000 AS ts, 'host' || (user_id % 10) AS host, 'app' || (user_id % 7) AS app,
           CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 5 WHEN 'view' THEN 6 ELSE 7 END AS severity,
           event_type || ' user=' || user_id || ' took ' || CAST(round(value * 100) AS BIGINT) || ' units' AS message,
           json_extract_string(props, '$.k') AS f_k, CAST(user_id AS VARCHAR) AS f_user, event_type AS f_type
    FROM events
"""
DOC_LOGS_SQL = """
    SELECT doc_id AS id, doc_id * 60000 AS ts, source AS host, lang AS app, CAST(doc_id % 8 AS INTEGER) AS severity, text AS message
    FROM documents
"""
SPANS_SQL = """
    SELECT lpad(CAST(l_orderkey AS VARCHAR), 32, '0') AS trace_id, lpad(CAST(l_linenumber AS VARCHAR), 16, '0') AS span_id,
           CASE WHEN l_linenumber = 1 THEN '' ELSE lpad('1', 16, '0') END AS parent_id,
           l_returnflag || ' ' || l_linestatus AS name, l_returnflag || '-' || l_linestatus AS service, 'node' || (l_suppkey % 10) AS host,
           epoch_us(CAST(l_shipdate AS TIMESTAMP)) AS start_us, CAST(l_quantity AS BIGINT) * 1000 AS duration_us,
           CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END AS status
    FROM lineitem
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "signup", 5).when(F.col("event_type") == "view", 6).otherwise(7)
    cents = F.round(F.col("value") * 100).cast("bigint")
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        F.concat(F.lit("host"), (F.col("user_id") % 10).cast("string")).alias("host"),
        F.concat(F.lit("app"), (F.col("user_id") % 7).cast("string")).alias("app"),
        severity.alias("severity"),
        F.concat(F.col("event_type"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(" took "), cents.cast("string"), F.lit(" units")).alias("message"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type")).alias("fields"),
    )


def doc_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") * 60000).alias("ts"), F.col("source").alias("host"), F.col("lang").alias("app"), (F.col("doc_id") % 8).cast("int").alias("severity"), F.col("text").alias("message"), F.lit(None).cast("map<string,string>").alias("fields")
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: F.lpad(c.cast("string"), 32, "0")
    part = lambda c: F.lpad(c.cast("string"), 16, "0")
    day = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    return _table(spark, sf_dir, "lineitem").select(
        key(F.col("l_orderkey")).alias("trace_id"),
        part(F.col("l_linenumber")).alias("span_id"),
        F.when(F.col("l_linenumber") == 1, "").otherwise(part(F.lit(1))).alias("parent_id"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("name"),
        F.lit(0).alias("kind"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("service"),
        F.concat(F.lit("node"), (F.col("l_suppkey") % 10).cast("string")).alias("host"),
        (day * 1000).alias("start_us"),
        (F.col("l_quantity").cast("bigint") * 1000).alias("duration_us"),
        F.when(F.col("l_returnflag") == "R", 2).otherwise(0).alias("status"),
        F.lit("").alias("status_message"),
        F.lit(None).cast("string").alias("attributes"),
        F.lit(None).cast("string").alias("events"),
    )
