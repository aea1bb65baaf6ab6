"""Ranking metrics per query, over tables (query, rank from 1, rel)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cluster import value_ranks


def _hit() -> Column:
    return F.col("rel") != 0


def reciprocal_rank(df: DataFrame, digits: int = 6) -> DataFrame:
    """1 / rank of the first relevant row, 0 without one."""
    first = F.min(F.when(_hit(), F.col("rank")))
    return df.groupBy("query").agg(F.round(F.coalesce(F.lit(1.0) / first, F.lit(0.0)), digits).alias("rr"))


def mean_reciprocal_rank(df: DataFrame, digits: int = 6) -> DataFrame:
    return reciprocal_rank(df, 15).agg(F.round(F.avg("rr"), digits).alias("mrr"))


def precision_at_k(df: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Share of relevant rows among the first ``k``; null for queries with fewer rows."""
    return df.groupBy("query").agg(F.round(F.when(F.count("*") >= k, F.count_if(_hit() & (F.col("rank") <= k)) / F.lit(k)), digits).alias("precision"))


def r_precision(df: DataFrame, digits: int = 6) -> DataFrame:
    """Relevant rows up to the last relevant one, over its rank; 0 without one."""
    return df.groupBy("query").agg(F.round(F.coalesce(F.count_if(_hit()) / F.max(F.when(_hit(), F.col("rank"))), F.lit(0.0)), digits).alias("r_precision"))


def average_precision(df: DataFrame, digits: int = 6) -> DataFrame:
    """Mean of the precision at each relevant rank, 0 without one."""
    seen = F.count_if(_hit()).over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    p = df.withColumn("_p", F.when(_hit(), seen / F.col("rank")))
    return p.groupBy("query").agg(F.round(F.coalesce(F.avg("_p"), F.lit(0.0)), digits).alias("ap"))


def mean_average_precision(df: DataFrame, digits: int = 6) -> DataFrame:
    return average_precision(df, 15).agg(F.round(F.avg("ap"), digits).alias("map"))


def _discount(rank: Column, method: int) -> Column:
    if method not in (0, 1):
        raise ValueError("method must be 0 or 1")
    return F.when(rank == 1, F.lit(1.0)).otherwise(F.log2(rank)) if method == 0 else F.log2(rank + 1)


def dcg_at_k(df: DataFrame, k: int, method: int = 0, digits: int = 6) -> DataFrame:
    """dcg, and ndcg: over that of the best order, 0 if that is 0."""
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.col("rel").desc(), "rank"))
    r = df.withColumn("_best", best)
    gain = lambda c: F.sum(F.when(F.col(c) <= k, F.col("rel") / _discount(F.col(c), method)).otherwise(0.0))
    out = r.groupBy("query").agg(gain("rank").alias("_d"), gain("_best").alias("_i"))
    return out.select("query", F.round("_d", digits).alias("dcg"), F.round(F.when(F.col("_i") > 0, F.col("_d") / F.col("_i")).otherwise(0.0), digits).alias("ndcg"))


def rank_normalize(df: DataFrame, group: list[str], value: str, threshold: float = 0.8, flip: bool = False, digits: int = 6) -> DataFrame:
    """``df`` with rank (ties average, over the group's largest) and label (rank above the threshold)."""
    r = value_ranks(df, group, value, "_r", flip)
    most = r.groupBy(*group).agg(F.max("_r").alias("_most")).select(*[F.col(c).alias(f"_m{i}") for i, c in enumerate(group)], "_most")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_m{i}")) for i, c in enumerate(group)])
    share = F.col("_r") / F.col("_most")
    return r.join(most, same).withColumns({"rank": F.round(share, digits), "label": (share > threshold).cast("int")}).select(*[c for c in df.columns if c not in ("rank", "label")], "rank", "label")
