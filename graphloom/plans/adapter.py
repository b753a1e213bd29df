"""Engine relations from the trade tables: nodes, edges, files, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"region": "utility", "nation": "infrastructure", "customer": "service", "supplier": "integration", "part": "model"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(rows: DataFrame, key: str, most: int = 20_000) -> DataFrame:
    """The rows dealt over tasks by a key, about so many each: what is small as a file is read by one task, however long its rows then take."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))
    return rows.repartition(n, key)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """id, kind, category, label, file_path."""
    t = lambda n: table(spark, d, n)
    place = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("place"))

    def of(df: DataFrame, kind: str, key: str, name: str, path) -> DataFrame:
        return df.select(F.concat(F.lit(f"{kind}::"), F.col(key)).alias("id"), F.lit(kind).alias("kind"), F.lit(KINDS[kind]).alias("category"), F.col(name).alias("label"), path.alias("file_path"))

    out = of(t("region"), "region", "r_regionkey", "r_name", F.col("r_name"))
    out = out.unionByName(of(t("nation").join(F.broadcast(place), "n_nationkey"), "nation", "n_nationkey", "n_name", F.col("place")))
    for kind, p in (("customer", "c"), ("supplier", "s")):
        df = t(kind).join(F.broadcast(place), F.col(f"{p}_nationkey") == F.col("n_nationkey"))
        out = out.unionByName(of(df, kind, f"{p}_{kind[:4]}key", f"{p}_name", F.concat_ws("/", F.col("place"), F.col(f"{p}_name"))))
    parts = t("part").filter("p_size <= 40")
    return out.unionByName(of(parts, "part", "p_partkey", "p_name", F.concat_ws("/", F.lit("parts"), "p_brand", "p_name")))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """source, target, type, weight (lines of orders for CALLS, else 1). CALLS may lead outside of nodes."""
    t = lambda n: table(spark, d, n)
    e = lambda df, a, b, kind: df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"), F.lit(1.0).alias("weight"))
    key = lambda kind, c: F.concat(F.lit(f"{kind}::"), F.col(c))
    out = e(t("nation"), key("region", "n_regionkey"), key("nation", "n_nationkey"), "CONTAINS")
    out = out.unionByName(e(t("customer"), key("nation", "c_nationkey"), key("customer", "c_custkey"), "CONTAINS")).unionByName(e(t("supplier"), key("nation", "s_nationkey"), key("supplier", "s_suppkey"), "CONTAINS"))
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    bought = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    calls = bought.groupBy("o_custkey", "l_partkey", "p_size").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    far = F.when(F.col("p_size") > 40, key("external::part", "l_partkey")).otherwise(key("part", "l_partkey"))
    out = out.unionByName(calls.select(key("customer", "o_custkey").alias("source"), far.alias("target"), F.lit("CALLS").alias("type"), "weight"))
    uses = lines.select("l_partkey", "l_suppkey").distinct().join(t("part").filter("p_size <= 40").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    out = out.unionByName(e(uses, key("part", "l_partkey"), key("supplier", "l_suppkey"), "USES"))
    return out.unionByName(e(t("part").filter("p_size <= 40"), key("part", "p_partkey"), key("brand", "p_brand"), "INHERITS_FROM"))


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id"), F.lit(".txt"))).alias("path"), F.col("text").alias("content"))


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of parts: a third lacks a class, half has a docstring (some longer than summaries may be)."""
    p, name = table(spark, d, "part"), F.translate("p_name", " ", "_")
    return p.select(
        F.concat(F.lit("part::"), "p_partkey").alias("id"), F.lit("function").alias("kind"), F.concat_ws("/", F.lit("src/parts"), "p_brand", F.concat(name, F.lit(".py"))).alias("file_path"),
        F.when(F.col("p_partkey") % 5 != 0, name).alias("function_name"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("class_name"), F.col("p_size").alias("start_line"), (F.col("p_size") + 10).alias("end_line"),
        F.repeat(F.concat("p_name", F.lit("\n")), 60).alias("source_code"), F.when(F.col("p_size") % 2 == 0, F.repeat(F.concat("p_type", F.lit(". ")), F.col("p_size") % 30)).alias("docstring"), F.split("p_type", " ").alias("parameters"),
    )


#: The same relations for DuckDB, as common table expressions.
SQL = """
place AS (SELECT n_nationkey, r_name || '/' || n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT 'region::' || r_regionkey AS id, 'region' AS kind, 'utility' AS category, r_name AS label, r_name AS file_path FROM region
  UNION ALL SELECT 'nation::' || n.n_nationkey, 'nation', 'infrastructure', n.n_name, place FROM nation n JOIN place USING (n_nationkey)
  UNION ALL SELECT 'customer::' || c_custkey, 'customer', 'service', c_name, place || '/' || c_name FROM customer JOIN place ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier::' || s_suppkey, 'supplier', 'integration', s_name, place || '/' || s_name FROM supplier JOIN place ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part::' || p_partkey, 'part', 'model', p_name, 'parts/' || p_brand || '/' || p_name FROM part WHERE p_size <= 40),
edges AS (
  SELECT 'region::' || n_regionkey AS source, 'nation::' || n_nationkey AS target, 'CONTAINS' AS type, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'nation::' || c_nationkey, 'customer::' || c_custkey, 'CONTAINS', 1.0 FROM customer
  UNION ALL SELECT 'nation::' || s_nationkey, 'supplier::' || s_suppkey, 'CONTAINS', 1.0 FROM supplier
  UNION ALL SELECT 'customer::' || o_custkey, CASE WHEN p_size > 40 THEN 'external::part::' ELSE 'part::' END || l_partkey, 'CALLS', count(*)::DOUBLE
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, l_partkey, p_size
  UNION ALL SELECT DISTINCT 'part::' || l_partkey, 'supplier::' || l_suppkey, 'USES', 1.0 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 40
  UNION ALL SELECT 'part::' || p_partkey, 'brand::' || p_brand, 'INHERITS_FROM', 1.0 FROM part WHERE p_size <= 40),
profiles AS (SELECT 'part::' || p_partkey AS id, 'function' AS kind, 'src/parts/' || p_brand || '/' || replace(p_name, ' ', '_') || '.py' AS file_path, CASE WHEN p_partkey % 5 <> 0 THEN replace(p_name, ' ', '_') END AS function_name,
  CASE WHEN p_size % 3 <> 0 THEN p_brand END AS class_name, p_size AS start_line, p_size + 10 AS end_line, repeat(p_name || chr(10), 60) AS source_code, CASE WHEN p_size % 2 = 0 THEN repeat(p_type || '. ', p_size % 30) END AS docstring, string_split(p_type, ' ') AS parameters FROM part),
files AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content FROM documents)
"""
