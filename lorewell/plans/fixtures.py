"""The library's tables (documents, messages, events, entities, relations, units) made from a star schema's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, content, project, source_path."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("project"), F.col("source").alias("source_path"))


def versioned(docs: DataFrame) -> DataFrame:
    """Adds version: 1 for the first document of a source path, then counting on by id; null without a path."""
    n = F.row_number().over(Window.partitionBy("source_path").orderBy("id"))
    return docs.withColumn("version", F.when(F.col("source_path").isNotNull(), n))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seq, role, text, project, id."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), F.col("turn").cast("long").alias("seq"), "role", "text",
        F.concat(F.lit("p"), (F.col("conv_id") % 4).cast("string")).alias("project"),
        F.concat(F.lit("s"), F.col("conv_id").cast("string"), F.lit(":msg:"), F.col("turn").cast("string")).alias("id"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, session_id, kind, tool_name, is_error, body, created_at, file_path."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.lit("tool_result").alias("kind"), F.col("event_type").alias("tool_name"),
        (F.col("event_type") == "error").alias("is_error"), F.col("props").alias("body"), F.col("ts").alias("created_at"),
        F.concat(F.lit("src/m"), (k % 10).cast("string"), F.lit("/f"), k.cast("string"), F.lit(".py")).alias("file_path"),
    )


EVENTS_SQL = """
SELECT event_id AS id, 'u' || user_id AS session_id, 'tool_result' AS kind, event_type AS tool_name, event_type = 'error' AS is_error,
       props AS body, ts AS created_at, 'src/m' || (k % 10) || '/f' || k || '.py' AS file_path
FROM (SELECT *, try_cast(nullif(regexp_extract(props, '(\\d+)', 1), '') AS BIGINT) AS k FROM events)
"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities: id (text), canonical_name, type."""
    t = lambda n: table(spark, sf_dir, n)
    one = lambda df, key, name, tag, kind: df.select(F.concat(F.lit(tag), F.col(key).cast("string")).alias("id"), F.col(name).alias("canonical_name"), F.lit(kind).alias("type"))
    return (
        one(t("region"), "r_regionkey", "r_name", "r", "Region").unionByName(one(t("nation"), "n_nationkey", "n_name", "n", "Nation")).unionByName(one(t("customer"), "c_custkey", "c_name", "c", "Customer"))
        .unionByName(one(t("supplier"), "s_suppkey", "s_name", "s", "Supplier")).unionByName(one(t("part"), "p_partkey", "p_name", "p", "Part"))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations: source, predicate, target."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string"))
    one = lambda df, a, p, b: df.select(a.alias("source"), F.lit(p).alias("predicate"), b.alias("target"))
    pairs = dealt(t("lineitem").select("l_suppkey", "l_partkey"), None, "l_suppkey", "l_partkey").distinct()
    return (
        one(t("nation"), key("n", "n_nationkey"), "part_of", key("r", "n_regionkey")).unionByName(one(t("customer"), key("c", "c_custkey"), "located_in", key("n", "c_nationkey")))
        .unionByName(one(t("supplier"), key("s", "s_suppkey"), "located_in", key("n", "s_nationkey"))).unionByName(one(pairs, key("s", "l_suppkey"), "supplies", key("p", "l_partkey")))
    )


def edge_rows(spark: SparkSession, sf_dir: str) -> int:
    """How many relations there are at most; nothing but the files' ends is read."""
    return sum(table(spark, sf_dir, n).count() for n in ("nation", "customer", "supplier", "lineitem"))


NODES_SQL = """
SELECT 'r' || r_regionkey AS id, r_name AS canonical_name, 'Region' AS type FROM region UNION ALL
SELECT 'n' || n_nationkey, n_name, 'Nation' FROM nation UNION ALL
SELECT 'c' || c_custkey, c_name, 'Customer' FROM customer UNION ALL
SELECT 's' || s_suppkey, s_name, 'Supplier' FROM supplier UNION ALL
SELECT 'p' || p_partkey, p_name, 'Part' FROM part
"""
EDGES_SQL = """
SELECT 'n' || n_nationkey AS source, 'part_of' AS predicate, 'r' || n_regionkey AS target FROM nation UNION ALL
SELECT 'c' || c_custkey, 'located_in', 'n' || c_nationkey FROM customer UNION ALL
SELECT 's' || s_suppkey, 'located_in', 'n' || s_nationkey FROM supplier UNION ALL
SELECT DISTINCT 's' || l_suppkey, 'supplies', 'p' || l_partkey FROM lineitem
"""
