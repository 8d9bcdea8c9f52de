"""How the driver's tables stand for the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: path is source/lang/doc_id."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("source"), F.col("lang").alias("imports"), F.col("source").alias("folder"), "doc_id", "n_chars")


#: The same in SQL, to start an oracle's WITH.
FILES_SQL = "files AS (SELECT concat_ws('/', source, lang, doc_id::VARCHAR) AS path, text AS source, lang AS imports, source AS folder, doc_id, n_chars FROM documents)"


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow each other in an order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    nxt = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return li.join(nxt, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst").where("src <> dst").distinct()


EDGES_SQL = """edges AS (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_partkey <> b.l_partkey)"""


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade between nations: customer's nation to supplier's nation, per line."""
    c, o, li, s = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "supplier"))
    return (
        li.select("l_orderkey", "l_suppkey").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src")), "o_custkey")
        .join(s.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst")), "l_suppkey").select("src", "dst")
    )


TRADE_SQL = """trade AS (
  SELECT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
