"""Whole jobs made of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import best_per_cluster, cluster_by_gap, collapse_dealt
from ..operators.intervals import annotate_overlaps, asof_collapsed
from ..operators.sets import union_haplotype_inputs
from ..operators.summary import summary_by_guide


def site_report(hits: DataFrame, features: DataFrame, gap: int = 3, length: int = 23, pivot: str = "score") -> DataFrame:
    """The distinct sites: hits clustered by gaps, one representative each, annotated with the features they meet."""
    clustered = cluster_by_gap(hits, ["guide", "chrom"], gap, home="_home")
    best = best_per_cluster(clustered, ["guide", "chrom", "_home", "cluster"], pivot).where("best").drop("_home")
    return annotate_overlaps(best, features, length)


def site_summary(hits: DataFrame, features: DataFrame, gap: int = 3, length: int = 23) -> DataFrame:
    """How many distinct sites each guide has by edit class and origin."""
    return summary_by_guide(site_report(hits, features, gap, length))


def reconcile(first: DataFrame, second: DataFrame, gap: int) -> DataFrame:
    """Sites of two haplotypes in reference coordinates (id, chrom, strand, pos, score): collapsed in each, then matched one to one."""
    columns = ["id", "chrom", "strand", "pos", "score"]
    return reconcile_sites(first.select(*columns, F.lit(True).alias("first")).unionByName(second.select(*columns, F.lit(False).alias("first"))), gap)


def reconcile_sites(sites: DataFrame, gap: int) -> DataFrame:
    """``reconcile`` of one table with both haplotypes, of which ``first`` (boolean) tells them apart.

    What is collapsed or matched lies within ``gap``, so in one cluster of both haplotypes together: rows are shuffled once, by
    the bin in which that cluster starts, and all the rest are windows where they lie.
    """
    keys = ["chrom", "strand"]
    dealt = cluster_by_gap(sites, keys, gap, width=1 << 18, home="_home").drop("cluster").repartition(*keys, "_home")
    best = collapse_dealt(dealt, [*keys, "_home", "first"], gap, ties=("pos", "id"))
    return asof_collapsed(best, keys, "_home", "first", "pos", gap)


def reconcile_inputs(tables: list[DataFrame], gap: int) -> DataFrame:
    return union_haplotype_inputs(tables, ["chrom", "strand"], gap)


def reconcile_summary(matched: DataFrame, unmapped: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows by origin, and how many predictions of each haplotype have no reference coordinates."""
    out = matched.groupBy("origin").agg(F.count("*").alias("n"))
    for name, df in (unmapped or {}).items():
        out = out.unionByName(df.agg(F.lit(f"{name}_unmapped").alias("origin"), F.count("*").alias("n")))
    return out
