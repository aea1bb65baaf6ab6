"""Column functions over genotype strings and lists of variant attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_genotype(gt: Column, ploidy: Column | int) -> Column:
    """The allele tokens of ``0|1``, ``0/1`` or ``1``: at most ``ploidy``, never repeated to fill up."""
    n = F.lit(ploidy) if isinstance(ploidy, int) else ploidy
    return F.when(n > 0, F.slice(F.split(gt, r"[|/]"), F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def is_phased(gt: Column) -> Column:
    return ~gt.contains("/")


def ploidy(chrom: Column, sex: Column) -> Column:
    """2 on autosomes; X: 1 for males; Y: 1 for males, 0 for females. Pseudo-autosomal regions are not told apart."""
    name = F.upper(F.regexp_replace(chrom, "^chr", ""))
    male, female = F.lower(sex).isin("male", "m"), F.lower(sex).isin("female", "f")
    return F.when((name == "X") & F.coalesce(male, F.lit(False)), 1).when((name == "Y") & F.coalesce(male, F.lit(False)), 1).when((name == "Y") & F.coalesce(female, F.lit(False)), 0).otherwise(2)


def genotype_counts(gt: Column, n: Column | int, allele: str = "1") -> Column:
    """(ac, an, carrier, hom, called): another alternate allele counts as reference, ``.`` as missing."""
    tokens = parse_genotype(gt, n)
    called = F.size(F.filter(tokens, lambda t: (t != ".") & (t != "")))
    alt = F.size(F.filter(tokens, lambda t: t == allele))
    size = F.size(tokens)
    return F.struct(alt.cast("bigint").alias("ac"), called.cast("bigint").alias("an"), (alt > 0).cast("bigint").alias("carrier"), ((alt > 0) & (alt == size) & (called == size)).cast("bigint").alias("hom"), (called > 0).cast("bigint").alias("called"))


def min_maf(afs: Column) -> Column:
    """The smallest value of a list of frequencies given as text, numbers that do not parse left out."""
    return F.array_min(F.filter(F.transform(afs, lambda x: x.try_cast("double")), lambda x: x.isNotNull()))


def first_known(values: Column) -> Column:
    """The first entry that is not a token for a missing value."""
    return F.get(F.filter(values, lambda x: x.isNotNull() & ~x.isin("", "NA", "n", ".", "-")), F.lit(0))
