"""Row repair, filters and projections of hits."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import pam_matches

#: Final column names by the names that intermediate tables have used for them.
NAMES = {"Chromosome": "chrom", "Chr": "chrom", "Position": "pos", "Start_coordinate": "pos", "Cluster_Position": "cluster_pos", "Direction": "strand", "Strand": "strand", "Mismatches": "mm", "Bulge_Size": "bulge", "Total": "total", "Samples": "samples", "CFD": "score", "CFD_ref": "score_ref", "Reference": "reference", "Real_Guide": "guide", "Spacer+PAM": "guide", "rsID": "rsids", "AF": "afs"}
#: Operators that filter_expr accepts.
COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "contains": lambda c, v: c.contains(v), "startswith": lambda c, v: c.startswith(v)}


def filter_pam(hits: DataFrame, motif: str, five_prime: bool = False, dna: str = "dna") -> DataFrame:
    """Hits whose PAM bases each share a base with the motif; shorter sequences do not match."""
    n = len(motif)
    part = F.substring(F.col(dna), 1, n) if five_prime else F.right(F.col(dna), F.lit(n))
    return hits.where(pam_matches(part, motif))


def cap_total_edits(hits: DataFrame, most: int) -> DataFrame:
    """Hits with at most so many mismatches and bulges; -1 keeps all."""
    return hits if most < 0 else hits.where(F.col("mm") + F.col("bulge") <= most)


def normalize_missing(df: DataFrame, rsid: str = "rsid", token: str = "n") -> DataFrame:
    """The token for missing values becomes null in every text column, and ``.`` in the rsID column."""
    text = [c for c, t in df.dtypes if t == "string"]
    return df.select(*[F.when(~F.coalesce((F.col(c) == token) | ((F.col(c) == ".") if c == rsid else F.lit(False)), F.lit(False)), F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])


def _numeric(column: str) -> Column:
    parts = F.split(F.col(column), ",")
    return F.coalesce(F.forall(parts, lambda x: x.try_cast("double").isNotNull() | x.isin("NA", "n", "")), F.lit(True))


def drop_malformed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose listed columns hold comma-separated numbers or missing values."""
    return df.where(reduce(operator.and_, map(_numeric, columns)))


def count_malformed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count_if(~reduce(operator.and_, map(_numeric, columns))).alias("malformed"), F.count("*").alias("rows"))


def drop_nonoverlapping_indel(hits: DataFrame) -> DataFrame:
    """Reference rows, and indel rows whose indel meets the hit's interval."""
    reach = F.greatest(F.length("ref"), F.length("alt"))
    meets = (F.col("indel_start") < F.col("pos") + F.col("length")) & (F.col("indel_start") + reach > F.col("pos"))
    return hits.where((F.col("origin") == "ref") | F.coalesce(meets, F.lit(False)))


def standardize_columns(df: DataFrame) -> DataFrame:
    """Final names; ``reference`` after the third column, the scores last; the placeholder chromosome goes."""
    out = df.drop("Chromosome_fake", "chrom_fake")
    out = out.withColumnsRenamed({k: v for k, v in NAMES.items() if k in out.columns and v not in out.columns})
    rest = [c for c in out.columns if c not in ("reference", "score", "score_ref")]
    has = lambda *c: [x for x in c if x in out.columns]
    return out.select(*rest[:3], *has("reference"), *rest[3:], *has("score", "score_ref"))


def project_criterion(df: DataFrame, criterion: str) -> DataFrame:
    """The columns of one criterion of a wide result, without its suffix, and those of none."""
    known = ("fewest", "CFD", "CRISTA")
    if criterion not in known:
        raise ValueError(f"criterion must be one of {known}")
    own = [c for c in df.columns if c.endswith(f"_{criterion}")]
    common = [c for c in df.columns if not c.endswith(tuple(f"_{k}" for k in known))]
    return df.select(*common, *[F.col(c).alias(c.removesuffix(f"_{criterion}")) for c in own])


def filter_expr(df: DataFrame, terms: list[tuple[str, str, object]]) -> DataFrame:
    """Rows that meet every (column, operator, value)."""
    for column, op, value in terms:
        if op not in COMPARE or column not in df.columns:
            raise ValueError(f"unknown operator or column: {column} {op}")
        df = df.where(COMPARE[op](F.col(column), value))
    return df


def scored(score: Column) -> Column:
    return F.when(score.between(0, 1), score)


def floor_zero_maf(afs: Column) -> Column:
    return F.transform(afs, lambda x: F.when(x == 0, F.lit(0.00001)).otherwise(x))


def effective_score(alt: Column, ref: Column) -> Column:
    """The reference's score unless the variant's is strictly greater."""
    return F.when(ref.isNull() | (alt > ref), alt).otherwise(ref)


def risk_score(df: DataFrame) -> DataFrame:
    return df.withColumn("risk", F.col("score") - F.col("score_ref")).withColumn("abs_risk", F.abs(F.col("score") - F.col("score_ref")))


def with_origin(df: DataFrame) -> DataFrame:
    """``origin`` is ref iff there are no samples; reference rows carry their aligned sequence as REF and no ALT."""
    ref = F.col("samples").isNull() | (F.size("samples") <= 0)
    return df.withColumn("origin", F.when(ref, "ref").otherwise("alt")).withColumn("aligned_ref", F.when(ref, F.col("aligned_alt")).otherwise(F.col("aligned_ref"))).withColumn("aligned_alt", F.when(ref, F.lit(None)).otherwise(F.col("aligned_alt")))


def partition_mask(total: Column, origin: Column, not_in_ref: Column | None = None) -> Column:
    """on_target (no edits) before variant (not found in the reference, or of variant origin) before reference."""
    variant = origin == "alt" if not_in_ref is None else F.coalesce(not_in_ref == "y", F.lit(False)) | (origin == "alt")
    return F.when(total == 0, "on_target").when(variant, "variant").otherwise("reference")


def fill_annotation_buckets(labels: Column) -> Column:
    """Labels by source, from their suffix, which is taken off; those without a known one are ENCODE's."""
    known = ["personal", "GENCODE", "DHS", "COSMIC"]
    part = lambda s: F.array_sort(F.array_distinct(F.transform(F.filter(labels, lambda x: x.endswith(f"_{s}")), lambda x: F.regexp_replace(x, f"_{s}$", ""))))
    rest = F.array_sort(F.array_distinct(F.filter(labels, lambda x: ~reduce(operator.or_, [x.endswith(f"_{s}") for s in known]))))
    return F.struct(*[part(s).alias(s.lower()) for s in known], rest.alias("encode"))


def categories(hits: DataFrame) -> DataFrame:
    """``hits`` with the sorted array of categories that hold: PAM creation, coding, tumour suppressor, regulatory, on-target chromosome.

    Needs pam_created, cds, tsg, ccre (booleans). A tumour suppressor counts only in coding sequence. The guide's
    on-target chromosome is that of its hits without edits.
    """
    targets = hits.where("total = 0").select("guide", F.col("chrom").alias("_t")).distinct().groupBy("guide").agg(F.collect_set("_t").alias("_targets"))
    joined = hits.join(targets, "guide", "left")
    flags = F.array(F.when(F.col("pam_created"), "PAM_creation"), F.when(F.col("cds"), "CDS"), F.when(F.col("tsg") & F.col("cds"), "TSG"), F.when(F.col("ccre"), "cCRE"), F.when(F.array_contains("_targets", F.col("chrom")), "same_chromosome"))
    return joined.withColumn("categories", F.array_sort(F.array_compact(flags))).drop("_targets")
