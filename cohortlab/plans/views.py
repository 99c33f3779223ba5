"""Study-shaped views over the shared tables, once for Spark and once as SQL text.

No view drops rows by id: hashes and integer division only assign labels,
cohorts and batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlab.functions.hashing import phash_sql
from cohortlab.operators.twogroup import cohens_d_pooled, group_moments
from cohortlab.session import small


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- SQL text ------------------------------------------------------------

_SAMPLE_COLS = f"""
  vec_id AS sample_id,
  CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y,
  CASE WHEN label <= 3 THEN 0 WHEN label <= 6 THEN 1 ELSE 2 END AS stage,
  CASE WHEN {phash_sql('vec_id', '1')} % 2 = 0 THEN 'male' ELSE 'female' END AS sex,
  40e0 + {phash_sql('vec_id', '2')} % 40 + CASE WHEN label >= 5 THEN 8 ELSE 0 END AS age,
  'b' || CAST({phash_sql('vec_id', '3')} % 5 AS VARCHAR(10)) AS batch_mixed,
  'n' || CAST(({phash_sql('vec_id', '4')} % 3) * 2 + CASE WHEN label >= 5 THEN 1 ELSE 0 END AS VARCHAR(10)) AS batch_nested,
  CASE WHEN {phash_sql('vec_id', '5')} % 4 = 0 THEN 'transfer' ELSE 'train' END AS cohort
"""

LETTERS = "abcdefghijklmnopqrstuvwxyz"

SQL = {
    "measure": """measure AS (
  SELECT vec_id AS sample_id, 'f' || lpad(CAST(generate_subscripts(embedding, 1) - 1 AS VARCHAR), 2, '0') AS feature,
         CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)""",
    "sample": f"sample AS (SELECT {_SAMPLE_COLS}, vec_id // 4 AS subject FROM embeddings)",
    "doc": """doc AS (
  SELECT d.doc_id, l.quality AS y, l.toxic, d.lang, d.source, d.n_chars, CAST(d.n_chars AS DOUBLE) AS chars,
         CAST(length(d.text) - length(replace(d.text, ' ', '')) + 1 AS DOUBLE) AS words
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
    "letters": f"""letters AS (
  SELECT doc_id AS sample_id, f AS feature, CAST(length(lower(text)) - length(replace(lower(text), f, '')) AS DOUBLE) AS value
  FROM documents CROSS JOIN (SELECT unnest([{', '.join(repr(c) for c in LETTERS)}]) AS f))""",
    "cells": """cells AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, 's' || CAST(l.l_suppkey % 6 AS VARCHAR) AS library,
         CASE WHEN l.l_suppkey % 6 < 3 THEN 'case' ELSE 'control' END AS condition, p.p_type AS cell_type,
         greatest(l.l_quantity - 30, 0) AS gene_a, greatest(l.l_quantity - 45, 0) AS gene_b
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)""",
    "probe": """probe AS (
  SELECT p.p_partkey AS probe, p.p_brand AS gene, l.l_suppkey AS sample_id, l.l_extendedprice AS value
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)""",
    "edge": """pair AS (
  SELECT least(nc.n_name, ns.n_name) AS a, greatest(nc.n_name, ns.n_name) AS b, count(*) AS n
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation nc ON c.c_nationkey = nc.n_nationkey
  JOIN nation ns ON s.s_nationkey = ns.n_nationkey WHERE nc.n_name <> ns.n_name GROUP BY 1, 2),
edge AS (SELECT a, b, n * 1e0 / (SELECT max(n) FROM pair) AS score FROM pair)""",
    "effect": """moments AS (
  SELECT c_mktsegment AS dataset, 'r' || CAST(n_regionkey AS VARCHAR) AS feature,
         count(*) FILTER (c_custkey % 2 = 1) AS n1, count(*) FILTER (c_custkey % 2 = 0) AS n0,
         avg(c_acctbal) FILTER (c_custkey % 2 = 1) AS m1, avg(c_acctbal) FILTER (c_custkey % 2 = 0) AS m0,
         var_samp(c_acctbal) FILTER (c_custkey % 2 = 1) AS v1, var_samp(c_acctbal) FILTER (c_custkey % 2 = 0) AS v0
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
effect AS (SELECT dataset, feature, n1, n0, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS d FROM moments)""",
    "term": """term AS (SELECT p_type AS term, p_brand AS member, count(*) AS n_parts FROM part GROUP BY 1, 2)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)


def then(*names: str) -> str:
    """Views followed by further CTEs of the query."""
    return with_views(*names) + ","


# ---- Spark ---------------------------------------------------------------

def measure(spark: SparkSession, sf: str) -> DataFrame:
    """Long measurements (sample_id, feature, value)."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("_p", "value"))
    return e.select("sample_id", F.format_string("f%02d", "_p").alias("feature"), F.col("value").cast("double").alias("value"))


def sample(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return e.selectExpr(*_split_columns(_SAMPLE_COLS), "vec_id div 4 AS subject")


def _split_columns(text: str) -> list[str]:
    """The shared select list holds one column per line."""
    return [line.strip().rstrip(",") for line in text.strip().splitlines()]


def labelled(spark: SparkSession, sf: str, cols: Sequence[str] = ("y",)) -> DataFrame:
    """Measurements with sample columns; the label columns ride along with the vector, no join."""
    e = table(spark, sf, "embeddings").selectExpr("embedding", *_split_columns(_SAMPLE_COLS), "vec_id div 4 AS subject")
    e = e.select("sample_id", *cols, F.posexplode("embedding").alias("_p", "value"))
    return e.select("sample_id", *cols, F.format_string("f%02d", "_p").alias("feature"), F.col("value").cast("double").alias("value"))


def doc(spark: SparkSession, sf: str) -> DataFrame:
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    return d.join(l, "doc_id").select(
        "doc_id", F.col("quality").alias("y"), "toxic", "lang", "source", "n_chars",
        F.col("n_chars").cast("double").alias("chars"), words.cast("double").alias("words"),
    )


def letters(spark: SparkSession, sf: str) -> DataFrame:
    """Letter counts of whole texts as measurements: (sample_id, feature, value)."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.lower("text").alias("_t"))
    count = lambda c: (F.length("_t") - F.length(F.replace("_t", F.lit(c), F.lit("")))).cast("double")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), count(c).alias("value")) for c in LETTERS]))
    return d.select("sample_id", pairs.alias("_s")).select("sample_id", "_s.feature", "_s.value")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part").select("p_partkey", "p_type")
    lib = F.col("l_suppkey") % 6
    return l.join(small(p), l.l_partkey == p.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.concat(F.lit("s"), lib.cast("string")).alias("library"),
        F.when(lib < 3, "case").otherwise("control").alias("condition"), F.col("p_type").alias("cell_type"),
        F.greatest(F.col("l_quantity") - 30, F.lit(0.0)).alias("gene_a"), F.greatest(F.col("l_quantity") - 45, F.lit(0.0)).alias("gene_b"),
    )


def probe(spark: SparkSession, sf: str) -> DataFrame:
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part").select("p_partkey", "p_brand")
    return l.join(small(p), l.l_partkey == p.p_partkey).select(
        F.col("p_partkey").alias("probe"), F.col("p_brand").alias("gene"), F.col("l_suppkey").alias("sample_id"), F.col("l_extendedprice").alias("value")
    )


def edge(spark: SparkSession, sf: str) -> DataFrame:
    """Trade between nations as an undirected scored edge list."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    nation = small(n)
    cust = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("cn"))
    supp = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("sn"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    # combine lines per (order, supplier nation) before they meet the orders
    part = li.join(small(supp), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "sn").agg(F.count(F.lit(1)).alias("m"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    named = part.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    pair = named.filter(F.col("cn") != F.col("sn")).groupBy(F.least("cn", "sn").alias("a"), F.greatest("cn", "sn").alias("b")).agg(F.sum("m").alias("n"))
    return pair.withColumn("_m", pair.agg(F.max("n")).scalar()).select("a", "b", (F.col("n") / F.col("_m")).alias("score"))


def effect(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised balance difference per market segment (dataset) and region (feature)."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, sf, "customer").join(small(n), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_mktsegment").alias("dataset"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("feature"),
        (F.col("c_custkey") % 2).alias("y"), F.col("c_acctbal").alias("value"),
    )
    return group_moments(c, ["dataset", "feature"]).select("dataset", "feature", "n1", "n0", cohens_d_pooled().alias("d"))


def term(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("term"), F.col("p_brand").alias("member")).agg(F.count(F.lit(1)).alias("n_parts"))
