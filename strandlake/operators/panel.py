"""Preparation of population panels: variants and genotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["chrom", "pos", "ref", "alt"]
GROUP = ["group_kind", "db", "subpop"]
COUNTS = ["ac", "an", "n_carrier", "n_hom", "n_called"]


def sites_to_genotypes(variants: DataFrame, groups: list[str], carrier: str = "0/1", joint: bool = False) -> DataFrame:
    """A pseudo-sample for each group of a summary table: a carrier genotype where the group's allele count is above 0."""
    field = "AC_joint_" if joint else "AC_"
    each = variants.select(*KEY, "info", F.explode(F.array(*map(F.lit, groups))).alias("sample_id"))
    count = F.coalesce(F.element_at("info", F.concat(F.lit(field), F.col("sample_id"))).try_cast("bigint"), F.lit(0))
    return each.select(*KEY, "sample_id", F.when(count > 0, carrier).otherwise("0/0").alias("gt"))


def filter_variants(variants: DataFrame, accepted: list[str] | None = None, af_min: float = 0.0) -> DataFrame:
    """Records with an accepted FILTER value and a largest frequency of at least ``af_min`` (missing: 0; 0 keeps all)."""
    rows = variants.where(F.arrays_overlap("filter", F.array(*map(F.lit, accepted)))) if accepted else variants
    return rows.where(F.coalesce(F.array_max("af"), F.lit(0.0)) >= af_min) if af_min > 0 else rows


def split_multiallelic(genotypes: DataFrame) -> DataFrame:
    """One row for each alternate allele of ``alts``: its index in the genotype becomes 1, every other allele 0."""
    each = genotypes.select("chrom", "pos", "ref", F.posexplode("alts").alias("_i", "alt"), "sample_id", "gt")
    own = (F.col("_i") + 1).cast("string")
    mark = lambda t: F.when(t == ".", ".").when(t == own, "1").otherwise("0")
    tokens = F.transform(F.split("gt", r"[|/]"), mark)
    return each.select(*KEY, "sample_id", F.when(F.col("gt").contains("|"), F.array_join(tokens, "|")).otherwise(F.array_join(tokens, "/")).alias("gt"))


def join_multiallelic(variants: DataFrame) -> DataFrame:
    return variants.groupBy("chrom", "pos", "ref").agg(F.array_sort(F.collect_set("alt")).alias("alts"))


def derive_an_deltas(old: DataFrame, new: DataFrame, phantom_free: tuple[str, ...] = ()) -> DataFrame:
    """Per group how an and n_called differ between two tables of the same records, and whether the difference is sound.

    ``ok``: carriers are equal in every record and the differences are the same in all; ``warn``: a database declared
    free of phantom samples has one.
    """
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (*KEY, *GROUP)]
    j = old.alias("o").join(new.alias("n"), same)
    d, c = F.col("n.an") - F.col("o.an"), F.col("n.n_called") - F.col("o.n_called")
    equal = (F.col("o.n_carrier") == F.col("n.n_carrier")) & (F.col("o.ac") == F.col("n.ac"))
    out = j.groupBy(*[F.col(f"o.{g}").alias(g) for g in GROUP]).agg(F.min(d).alias("d_an"), F.min(c).alias("d_called"), F.bool_and(equal).alias("_eq"), (F.max(d) == F.min(d)).alias("_an"), (F.max(c) == F.min(c)).alias("_called"))
    return out.select(*GROUP, "d_an", "d_called", (F.col("_eq") & F.col("_an") & F.col("_called")).alias("ok"), (F.col("db").isin(*phantom_free) & ((F.col("d_an") != 0) | (F.col("d_called") != 0)) if phantom_free else F.lit(False)).alias("warn"))


def apply_an_deltas(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """``counts`` with the groups' differences added, and ``sound``: an > 0, an >= ac and called >= carriers still hold."""
    same = [F.col(f"c.{g}").eqNullSafe(F.col(f"d.{g}")) for g in GROUP]
    j = counts.alias("c").join(deltas.alias("d"), same, "left")
    an = F.col("c.an") + F.coalesce("d.d_an", F.lit(0))
    called = F.col("c.n_called") + F.coalesce("d.d_called", F.lit(0))
    out = j.select(*[F.col(f"c.{c}").alias(c) for c in (*KEY, *GROUP, "ac")], an.alias("an"), F.col("c.n_carrier").alias("n_carrier"), F.col("c.n_hom").alias("n_hom"), called.alias("n_called"))
    return out.withColumn("sound", (F.col("an") > 0) & (F.col("an") >= F.col("ac")) & (F.col("n_called") >= F.col("n_carrier")))


def registries_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """The records and groups that are in one table only, or whose counts differ: key, group, what."""
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*KEY, *GROUP)]
    j = a.withColumn("_a", F.lit(1)).alias("a").join(b.withColumn("_b", F.lit(1)).alias("b"), same, "full")
    differs = F.concat_ws(",", *[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in COUNTS])
    what = F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").otherwise(differs)
    return j.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in (*KEY, *GROUP)], what.alias("what")).where("what != ''")


def sample_variants(genotypes: DataFrame, sample: object) -> DataFrame:
    """The variants that a sample carries."""
    return genotypes.where((F.col("sample_id") == F.lit(sample)) & F.exists(F.split("gt", r"[|/]"), lambda t: ~t.isin("0", ".", ""))).select(*KEY)


def hierarchy(samples: DataFrame) -> DataFrame:
    """Per superpopulation and population its sorted samples."""
    return samples.groupBy("superpopulation", "population").agg(F.array_sort(F.collect_set("sample_id")).alias("samples"))
