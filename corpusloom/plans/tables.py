"""The given tables in the shapes of this library: articles and sources, documents, audit events, turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.postings import index_of
from corpusloom.storage import scratch  # noqa: F401  the queries take it from here

HELD = ["ASIA", "EUROPE", "AMERICA", "AFRICA"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text", F.col("lang").alias("space"))


def sources(spark, d) -> DataFrame:
    """Orders as articles, their suppliers as raw files."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_path"), F.col("l_suppkey").alias("raw_path"))


def raw_files(spark, d) -> DataFrame:
    """Suppliers labelled with their region."""
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("raw_path"), F.col("r_name").alias("space"), F.sha2("s_name", 256).alias("sha256"))


def users(spark, d) -> DataFrame:
    """Customers as users: they hold their own region and the one before it."""
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("other"))
    rows = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.join(F.broadcast(regions), F.col("k") == (F.col("r_regionkey") + 1) % 5).select(F.col("c_custkey").alias("user_id"), F.array("r_name", "other").alias("spaces"))


def index(spark, d):
    """The documents' inverted index: an application's first query over a folder builds it, its others read it."""
    return index_of(docs(spark, d), "documents")


def questions(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.lit("en+fr").alias("acl_key"), "text")


def readable(spark, d, spaces=("en", "fr")) -> DataFrame:
    return docs(spark, d).where(F.col("space").isin(*spaces)).select(F.lit("+".join(spaces)).alias("acl_key"), "path")


def audit(spark, d) -> DataFrame:
    """Events as the audit log: purchase a query, view a vote for, error a vote against, the rest as they are."""
    kind = F.col("event_type")
    action = F.when(kind == "purchase", "query").when(kind == "view", "feedback_up").when(kind == "error", "feedback_down").when(kind == "signup", "login_failed").otherwise("read_denied")
    k = F.get_json_object("props", "$.k")
    detail = F.when((kind == "purchase") & (k.cast("int") % 3 == 0), "no-evidence").otherwise("")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", "user_id", action.alias("action"), k.alias("target"), detail.alias("detail"), "value")


def turns(spark, d) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("conv"), "turn", "text")



AUDIT_SQL = """audit AS (SELECT event_id AS id, ts, user_id,
  CASE event_type WHEN 'purchase' THEN 'query' WHEN 'view' THEN 'feedback_up' WHEN 'error' THEN 'feedback_down' WHEN 'signup' THEN 'login_failed' ELSE 'read_denied' END AS action,
  json_extract_string(props, '$.k') AS target,
  CASE WHEN event_type = 'purchase' AND CAST(json_extract_string(props, '$.k') AS INT) % 3 = 0 THEN 'no-evidence' ELSE '' END AS detail, value FROM events)"""
LABELS_SQL = "lab AS (SELECT s_suppkey AS raw_path, r_name AS space FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), src AS (SELECT l_orderkey AS article_path, l_suppkey AS raw_path FROM lineitem)"
TOKENS_SQL = "regexp_extract_all(lower(text), '[0-9A-Za-z_]+')"
