"""Set operations between tables of hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import collapse_clusters


def split_targets(ref: DataFrame, var: DataFrame, site: tuple[str, ...] = ("chrom", "pos", "cluster_pos")) -> dict[str, DataFrame]:
    """common: rows in both; semi_common: rows of either at sites of the reference that a variant row shares; unique: variant rows at other sites."""
    cols = ref.columns
    var = var.select(*cols).distinct()
    ref = ref.distinct()
    at_ref = var.join(ref.select(*site).distinct(), list(site), "left_semi").select(*cols)
    return {
        "common": ref.intersect(var),
        "semi_common": at_ref.union(ref.join(var.select(*site).distinct(), list(site), "left_semi").select(*cols)).distinct(),
        "unique": var.join(ref.select(*site).distinct(), list(site), "left_anti").select(*cols),
    }


def compare_sites(expected: DataFrame, found: DataFrame) -> DataFrame:
    """One row: missing, extra, common sites by (chrom, pos, strand), and whether both are none."""
    key = ["chrom", "pos", "strand"]
    e = expected.select(*key).distinct().withColumn("e", F.lit(1))
    f = found.select(*key).distinct().withColumn("f", F.lit(1))
    both = e.join(f, key, "full")
    return both.agg(F.count_if(F.col("f").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("extra"), F.count_if(F.col("e").isNotNull() & F.col("f").isNotNull()).alias("common")).withColumn("passed", (F.col("missing") == 0) & (F.col("extra") == 0))


def union_haplotype_inputs(tables: list[DataFrame], keys: list[str], gap: int) -> DataFrame:
    """The distinct rows of all tables, one for each cluster of near positions."""
    rows = reduce(lambda a, b: a.unionByName(b), tables).distinct()
    return collapse_clusters(rows, keys, gap)


def concat_tables(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
