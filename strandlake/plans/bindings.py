"""Domain tables as views of the generic test tables; the same SQL for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HITS = """
SELECT l_returnflag || l_linestatus AS guide, 'chr' || CAST(l_suppkey % 22 + 1 AS STRING) AS chrom, l_partkey * 3 + l_linenumber AS pos,
CASE WHEN CAST(l_quantity AS BIGINT) % 2 = 0 THEN '+' ELSE '-' END AS strand, l_linenumber - 1 AS mm, CAST(round(l_tax * 100) AS INT) % 3 AS bulge,
l_linenumber - 1 + CAST(round(l_tax * 100) AS INT) % 3 AS total,
CASE WHEN CAST(round(l_tax * 100) AS INT) % 3 = 0 THEN 'X' WHEN l_linenumber % 2 = 0 THEN 'DNA' ELSE 'RNA' END AS bulge_type,
CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 1001 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score,
CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 733 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score_ref,
CASE WHEN l_orderkey % 2 = 1 THEN 'alt' ELSE 'ref' END AS origin, o_custkey AS sample, n_name AS population, r_name AS superpopulation,
concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING), CAST(CAST(l_quantity AS BIGINT) AS STRING)) AS id,
l_partkey AS part
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""
FEATURES = "SELECT 'chr' || CAST(p_partkey % 22 + 1 AS STRING) AS chrom, p_partkey * 3 AS start, p_partkey * 3 + p_size * 4 AS \"end\", p_type AS label FROM {part}"
SAMPLES = """
SELECT CAST(c_custkey AS STRING) AS sample_id, c_custkey AS sample, n_name AS population, r_name AS superpopulation,
CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex, 'd' || CAST(c_custkey % 3 AS STRING) AS database
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""
GENOTYPES = """
SELECT CASE WHEN l_partkey % 23 = 22 THEN 'chrX' ELSE 'chr' || CAST(l_partkey % 23 + 1 AS STRING) END AS chrom, l_partkey AS pos, 'A' AS ref, 'G' AS alt, CAST(o_custkey AS STRING) AS sample_id,
CASE min(l_linenumber) % 4 WHEN 0 THEN '0|1' WHEN 1 THEN '1|0' WHEN 2 THEN '1|1' ELSE '0/1' END AS gt
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY l_partkey, o_custkey"""
#: Single-base calls on the sequences of the documents; up to two alternates at a place.
CALLS = """
SELECT CAST(l_partkey % 1000 AS STRING) AS chrom, CAST((l_orderkey * 31 + l_suppkey) % 3000 AS BIGINT) AS pos, substr('ACGTAC', CAST((l_orderkey + l_suppkey) % 4 + 1 + o_custkey % 2 AS INT), 1) AS alt, 's' || CAST(o_custkey % 7 AS STRING) AS sample_id,
CASE min(l_linenumber) % 4 WHEN 0 THEN '0|1' WHEN 1 THEN '1|0' WHEN 2 THEN '1|1' ELSE '0/1' END AS gt
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
GROUP BY l_partkey % 1000, (l_orderkey * 31 + l_suppkey) % 3000, substr('ACGTAC', CAST((l_orderkey + l_suppkey) % 4 + 1 + o_custkey % 2 AS INT), 1), o_custkey % 7"""
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels")


def bind(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view over the tables that its text names."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql.replace('"end"', "`end`"), **used)


def oracle(body: str, **views: str) -> str:
    """``body`` after WITH clauses for the views, over the oracle's own tables."""
    text = ", ".join(f"{k} AS ({v.format(**{t: t for t in TABLES})})" for k, v in views.items())
    return f"WITH {text} {body}" if text else body
