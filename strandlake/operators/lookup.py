"""Sorted, limited and filtered views of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TIES = ("pos", "strand", "id")


def top_score(df: DataFrame, n: int = 1000, metric: str = "score", ascending: bool = False, per_guide: bool = True, ties=TIES) -> DataFrame:
    """The best ``n`` off-targets (more than one edit), per guide or over all; null counts as -1."""
    value = F.coalesce(F.col(metric), F.lit(-1))
    order = [value.asc() if ascending else value.desc(), *ties]
    rows = df.where("total > 1")
    if not per_guide:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("guide").orderBy(*order))).where(F.col("rank") <= n)


def top_delta(df: DataFrame, n: int, signed: bool = True, per_guide: bool = True, ties=TIES) -> DataFrame:
    """The ``n`` largest differences of variant and reference score, or of their absolute values; null last."""
    d = F.col("score") - F.col("score_ref")
    rows = df.withColumn("delta", d if signed else F.abs(d))
    order = [F.col("delta").desc_nulls_last(), *ties]
    if not per_guide:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("guide").orderBy(*order))).where(F.col("rank") <= n)


def page(df: DataFrame, guide: str, order: str, second: str | None = None, ascending: bool = False, lo=None, hi=1000, number: int = 0, size: int = 10, ties=TIES) -> DataFrame:
    """One page of a guide's rows, with one or two sort keys in one direction, and a range of the first key."""
    rows = df.where(F.col("guide") == guide)
    if lo is not None:
        rows = rows.where(F.col(order).between(lo, hi))
    key = lambda c: F.col(c).asc() if ascending else F.col(c).desc()
    return rows.orderBy(*[key(c) for c in (order, second) if c], *ties).offset(number * size).limit(size)


def by_position(df: DataFrame, guide: str, chrom: str, lo: int, hi: int) -> DataFrame:
    return df.where((F.col("guide") == guide) & (F.col("chrom") == chrom) & F.col("pos").between(lo, hi))


def by_edit_class(df: DataFrame, guide: str, bulge_type: str, bulge: int, mm: int, variant_only: bool = False) -> DataFrame:
    rows = df.where((F.col("guide") == guide) & (F.col("bulge_type") == bulge_type) & (F.col("bulge") == bulge) & (F.col("mm") == mm))
    return rows.where("origin = 'alt'") if variant_only else rows


def by_sample(df: DataFrame, guide: str, sample, private: bool = False, order: list[Column] | None = None) -> DataFrame:
    """Rows of a guide that a sample carries (exact membership), or that it alone carries."""
    rows = df.where((F.col("guide") == guide) & F.array_contains("samples", F.lit(sample)))
    rows = rows.where(F.size("samples") == 1) if private else rows
    return rows.orderBy(*order) if order else rows


def sort_integrated(df: DataFrame, ties=TIES) -> DataFrame:
    return df.orderBy(F.col("score").desc_nulls_last(), "total", *ties)


def filter_sort_hits(df: DataFrame, filters: list[tuple], sorts: list[Column], hide_ref: bool = False, ties=TIES) -> DataFrame:
    from .clean import filter_expr

    rows = filter_expr(df, filters)
    rows = rows.where("origin = 'alt'") if hide_ref else rows
    return rows.orderBy("mm", "bulge", *sorts, *ties)


def carrier_scope(df: DataFrame, sample, panels: DataFrame) -> DataFrame:
    """A sample's hits with scope: private, shared_panel (all carriers in its panel) or shared_other.

    ``panels`` has (sample, panel); ``df`` has id and samples.
    """
    own = df.where(F.array_contains("samples", F.lit(sample)))
    carriers = own.select("id", F.explode("samples").alias("sample")).join(panels, "sample", "left")
    mine = panels.where(F.col("sample") == F.lit(sample)).select(F.col("panel").alias("own_panel")).limit(1)
    scope = carriers.join(F.broadcast(mine)).groupBy("id").agg(F.countDistinct("sample").alias("n"), F.count_if(~F.coalesce(F.col("panel") == F.col("own_panel"), F.lit(False))).alias("other"))
    return own.join(scope, "id").withColumn("scope", F.when(F.col("n") == 1, "private").when(F.col("other") == 0, "shared_panel").otherwise("shared_other")).drop("n", "other")
