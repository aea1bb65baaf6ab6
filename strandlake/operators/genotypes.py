"""Allele counts, combinations of variants and haplotypes from genotype tables (chrom, pos, ref, alt, sample_id, gt)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genotype import genotype_counts, is_phased, parse_genotype, ploidy

KEY = ["chrom", "pos", "ref", "alt"]
#: Unphased variants of which all subsets can be made.
MOST_PUTATIVE = 20
COUNTS = ["ac", "an", "n_carrier", "n_hom", "n_called"]
#: What the people of one word of a bitmap have in common, and its number among those words.
WORD = ["database", "superpopulation", "sex", "_first", "_w"]


def genotyped_roster(samples: DataFrame, genotypes: DataFrame) -> DataFrame:
    """The samples that have genotypes: the right denominator of allele numbers."""
    return samples.join(genotypes.select("sample_id").distinct(), "sample_id", "left_semi")


def _group(df: DataFrame) -> DataFrame:
    """One row for each record and group: (db, superpopulation), (db) and global; a person in two databases counts once in global."""
    return df.select("*", F.explode(F.array(F.struct(F.lit("db_subpop").alias("group_kind"), F.col("database").alias("db"), F.col("superpopulation").alias("subpop")), F.struct(F.lit("db").alias("group_kind"), F.col("database").alias("db"), F.lit(None).cast("string").alias("subpop")), F.struct(F.lit("global").alias("group_kind"), F.lit(None).cast("string").alias("db"), F.lit(None).cast("string").alias("subpop")))).alias("_g")).where("_g.group_kind != 'global' or _first").select("*", "_g.*").drop("_g", "_first")


def _roster(samples: DataFrame) -> DataFrame:
    """Samples with a flag for the row that stands for the person in global counts: the one of the smallest database."""
    first = samples.groupBy("sample_id").agg(F.min("database").alias("_db"))
    return samples.join(first, "sample_id").withColumn("_first", F.col("database").eqNullSafe(F.col("_db"))).drop("_db")


def _by_record(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by place into as many parts as a shuffle has, so that groups of a record are counted where they lie.

    The number is stated, or else adaptive execution joins parts up to a size after compression, at which genotypes, which
    are much alike, take gigabytes of hash table in one task.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chrom", "pos")


def allele_counts(genotypes: DataFrame, samples: DataFrame) -> DataFrame:
    """The five counts of each record and group over the samples that have a genotype there; groups without carriers are left out."""
    rows = genotypes.join(_roster(samples), "sample_id")
    rows = rows.withColumn("_c", genotype_counts(F.col("gt"), ploidy(F.col("chrom"), F.col("sex")))).select(*KEY, "database", "superpopulation", "_first", "_c")
    out = _group(_by_record(rows)).groupBy(*KEY, "group_kind", "db", "subpop").agg(*[F.sum(f"_c.{c}").alias(n) for c, n in zip(("ac", "an", "carrier", "hom", "called"), COUNTS, strict=True)])
    return out.where("n_carrier > 0")


def allele_counts_panel(genotypes: DataFrame, samples: DataFrame) -> DataFrame:
    """As ``allele_counts`` over the whole panel: samples that are not listed at a record are homozygous for the reference.

    Baseline per chromosome and group (ploidies of all samples) plus, for the listed ones, how they differ from it:
    work in proportion to carriers, not to records times samples.
    """
    roster = _roster(samples)
    chroms = genotypes.select("chrom").distinct()
    base = _group(roster.join(F.broadcast(chroms)).withColumn("_p", ploidy(F.col("chrom"), F.col("sex")))).groupBy("chrom", "group_kind", "db", "subpop").agg(F.sum("_p").alias("_an"), F.count_if(F.col("_p") > 0).alias("_called"))
    rows = genotypes.join(roster, "sample_id").withColumn("_p", ploidy(F.col("chrom"), F.col("sex")))
    rows = rows.withColumn("_c", genotype_counts(F.col("gt"), F.col("_p"))).select(*KEY, "database", "superpopulation", "_first", "_p", "_c")
    delta = _group(_by_record(rows)).groupBy(*KEY, "group_kind", "db", "subpop").agg(F.sum("_c.ac").alias("ac"), F.sum(F.col("_c.an") - F.col("_p")).alias("_dan"), F.sum("_c.carrier").alias("n_carrier"), F.sum("_c.hom").alias("n_hom"), F.sum(F.col("_c.called") - (F.col("_p") > 0).cast("int")).alias("_dcalled")).where("n_carrier > 0")
    same = lambda c: F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}"))
    # As many rows as there are chromosomes and groups of the panel.
    j = delta.alias("d").join(F.broadcast(base).alias("b"), (F.col("d.chrom") == F.col("b.chrom")) & (F.col("d.group_kind") == F.col("b.group_kind")) & same("db") & same("subpop"))
    return j.select(*[F.col(f"d.{c}").alias(c) for c in (*KEY, "group_kind", "db", "subpop")], "ac", (F.col("_an") + F.col("_dan")).alias("an"), "n_carrier", "n_hom", (F.col("_called") + F.col("_dcalled")).alias("n_called"))


def record_stats(counts: DataFrame, digits: int = 6) -> DataFrame:
    """Per record the global frequencies of allele, carriers and homozygotes, and the superpopulation with the highest frequency (ties to the smaller label)."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    g = F.col("group_kind") == "global"
    label = F.concat_ws("::", "db", "subpop")
    best = F.when(F.col("group_kind") == "db_subpop", F.struct((-ratio("ac", "an")).alias("neg"), label.alias("label")))
    out = counts.groupBy(*KEY).agg(F.max(F.when(g, ratio("ac", "an"))).alias("_af"), F.max(F.when(g, ratio("n_carrier", "n_called"))).alias("_cf"), F.max(F.when(g, ratio("n_hom", "n_called"))).alias("_hf"), F.min(best).alias("_b"))
    return out.select(*KEY, F.round("_af", digits).alias("af"), F.round("_cf", digits).alias("carrier_freq"), F.round("_hf", digits).alias("hom_freq"), F.round(-F.col("_b.neg"), digits).alias("max_af"), F.col("_b.label").alias("max_af_group"), (F.col("_af") > 0).alias("observed"))


def _slots(gt: Column, n: Column) -> Column:
    return F.transform(parse_genotype(gt, n), lambda t: t == "1")


def combinations(hits: DataFrame, genotypes: DataFrame, samples: DataFrame) -> DataFrame:
    """Per hit and sample that carries all of the hit's variants: phased, haplotypes carrying all, and whether all do.

    ``hits`` has id and ``variants``, an array of (chrom, pos, ref, alt). Joins start from the variants' carriers.
    """
    wanted = hits.select("id", F.size(F.array_distinct("variants")).alias("k"), F.explode(F.array_distinct("variants")).alias("v")).select("id", "k", "v.*")
    carried = genotypes.join(samples.select("sample_id", "sex").dropDuplicates(["sample_id"]), "sample_id").withColumn("_p", ploidy(F.col("chrom"), F.col("sex")))
    carried = carried.withColumn("_s", _slots(F.col("gt"), F.col("_p"))).where(F.exists("_s", lambda x: x))
    per = wanted.join(carried, KEY).groupBy("id", "k", "sample_id").agg(F.count("*").alias("n"), F.bool_and(is_phased(F.col("gt"))).alias("phased"), F.max("_p").alias("ploidy"), F.collect_list("_s").alias("_all"))
    full = per.where("n = k")
    both = F.aggregate(F.col("_all"), F.array_repeat(F.lit(True), F.col("ploidy")), lambda acc, x: F.zip_with(acc, x, lambda a, b: F.coalesce(a & b, F.lit(False))))
    haplotypes = F.size(F.filter(both, lambda x: x))
    return full.select("id", "k", "sample_id", "ploidy", F.col("phased") | (F.col("k") == 1), haplotypes.cast("bigint").alias("_h")).toDF("id", "k", "sample_id", "ploidy", "phased", "haplotypes")


def _people(samples: DataFrame) -> DataFrame:
    return _roster(samples.select("sample_id", "database", "superpopulation", "sex").dropDuplicates(["sample_id", "database"]))


def packed_genotypes(genotypes: DataFrame, samples: DataFrame) -> DataFrame:
    """Carriers as bitmaps: a row for each record and word of 64 people of which one at least has the allele.

    People of one word share database, superpopulation and sex, hence ploidy (``_p``), so that the counts of a group are
    sums of bit counts and no word is taken apart. ``held``: the allele stands in the genotype; ``any``: in a slot that
    exists at this ploidy; ``h0``, ``h1``: in that slot; ``loose``: unphased. One person in two databases has a bit in each.
    Numbers are given inside each class of the roster, of which a person is one row.
    """
    number = F.row_number().over(Window.partitionBy(*WORD[:-1]).orderBy("sample_id")) - 1
    words = _people(samples).withColumn("_n", number).withColumns({"_w": F.floor(F.col("_n") / 64), "_bit": F.expr("shiftleft(1L, _n % 64)")}).drop("_n")
    rows = genotypes.select(*KEY, "sample_id", "gt").where(F.exists(F.split("gt", r"[|/]"), lambda t: t == "1")).join(words, "sample_id")
    rows = rows.withColumn("_p", ploidy(F.col("chrom"), F.col("sex"))).withColumn("_s", _slots(F.col("gt"), F.col("_p")))
    on = lambda c: F.bit_or(F.when(c, F.col("_bit")).otherwise(F.lit(0).cast("bigint")))
    slot = lambda i: F.get("_s", F.lit(i))
    return rows.groupBy(*KEY, *WORD, "_p").agg(F.bit_or("_bit").alias("held"), on(slot(0) | F.coalesce(slot(1), F.lit(False))).alias("any"), on(slot(0)).alias("h0"), on(slot(1)).alias("h1"), on(~is_phased(F.col("gt"))).alias("loose"))


def _packed_combinations(hits: DataFrame, genotypes: DataFrame, samples: DataFrame) -> DataFrame:
    """``combinations`` as bitmaps, a row for each hit and word: ``full`` carries all of the hit's variants, ``loose`` those of them that are unphased, ``h0`` and ``h1`` the haplotypes with all; ``held`` sums the carriers of each."""
    wanted = hits.select("id", F.size(F.array_distinct("variants")).alias("k"), F.explode(F.array_distinct("variants")).alias("v")).select("id", "k", "v.*")
    per = wanted.join(packed_genotypes(genotypes, samples), KEY).groupBy("id", "k", *WORD).agg(F.count("*").alias("_n"), *[F.bit_and(c).alias(c) for c in ("any", "h0", "h1")], F.bit_or("loose").alias("loose"), F.sum(F.bit_count("held")).alias("held"), F.max("_p").alias("_p"))
    per = per.withColumn("full", F.when(F.col("_n") == F.col("k"), F.col("any")).otherwise(F.lit(0).cast("bigint")))
    within = lambda c: F.col(c).bitwiseAND(F.col("full"))
    return per.withColumns({"h0": within("h0"), "h1": within("h1"), "loose": F.when(F.col("k") > 1, within("loose")).otherwise(F.lit(0).cast("bigint"))}).drop("any", "_n")


def combination_summary(hits: DataFrame, genotypes: DataFrame, samples: DataFrame) -> DataFrame:
    """Per hit and group: carriers of all variants, haplotypes carrying all (null if any carrier is unphased), homozygotes, and for unphased ones a lower bound of carriers in cis.

    With phased carriers only those with a haplotype that holds all count. Unphased: the carriers are an upper bound and
    max(0, sum of carriers of each - (k - 1) * N) the lower one. Genotypes are read and joined once, as bitmaps.
    """
    either = F.col("h0").bitwiseOR(F.col("h1"))
    hom = F.when(F.col("_p") == 2, F.col("h0").bitwiseAND(F.col("h1"))).otherwise(either).bitwiseAND(F.bitwise_not("loose"))
    n = _packed_combinations(hits, genotypes, samples).select("id", "k", *WORD[:-1], "held", F.bit_count(F.col("loose").bitwiseOR(either)).alias("_c"), (F.bit_count("h0") + F.bit_count("h1")).alias("_h"), F.bit_count(hom).alias("_hom"), F.bit_count("loose").alias("_l"))
    out = _group(n).groupBy("id", "k", "group_kind", "db", "subpop").agg(F.sum("_c").alias("n_carrier"), F.sum("_h").alias("_h"), F.sum("_hom").alias("n_hom"), (F.sum("_l") == 0).alias("phased"), F.sum("held").alias("_sum")).where("n_carrier > 0")
    size = _group(_people(samples)).groupBy("group_kind", "db", "subpop").agg(F.count("*").alias("_n"))
    same = lambda c: F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}"))
    # ``size`` has a row for each group of the panel.
    j = out.alias("o").join(F.broadcast(size).alias("s"), same("group_kind") & same("db") & same("subpop"))
    low = F.least(F.col("n_carrier"), F.greatest(F.lit(0), F.col("_sum") - (F.col("k") - 1) * F.col("_n")))
    return j.select("id", "k", "o.group_kind", "o.db", "o.subpop", "n_carrier", F.when(F.col("phased"), F.col("_h")).alias("ac"), "n_hom", "phased", F.when(F.col("phased"), F.col("n_carrier")).otherwise(low).alias("n_carrier_low"))


def population_companion(hits: DataFrame, genotypes: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per hit: a map from group to ``carriers|haplotypes|homozygotes``."""
    s = combination_summary(hits, genotypes, samples)
    name = F.when(F.col("group_kind") == "global", "global").otherwise(F.concat_ws("::", "db", "subpop"))
    text = F.concat_ws("|", "n_carrier", F.coalesce(F.col("ac").cast("string"), F.lit("NA")), "n_hom")
    return s.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("key"), text.alias("value"))))).alias("groups"))


def phase_companion(haplotypes: DataFrame) -> DataFrame:
    return haplotypes.select("window_id", "variants", "phase_state")


def haplotype_af(afs: Column) -> Column:
    """A hit with several variants is at most as frequent as the rarest of them."""
    return F.array_min(F.filter(afs, lambda x: x.isNotNull()))


def haplotype_frequency(hits: DataFrame, genotypes: DataFrame, samples: DataFrame, digits: int = 6) -> DataFrame:
    """Per hit the share of haplotypes that carry all of its variants, over the panel's allele number on their chromosome; null if unphased.

    The allele number is the sum of the samples' ploidies there, so that males have one X and females no Y. A hit's
    variants lie on one chromosome.
    """
    c = _packed_combinations(hits, genotypes, samples).where("_first and full != 0").groupBy("id").agg(F.when(F.sum(F.bit_count("loose")) == 0, F.sum(F.bit_count("h0") + F.bit_count("h1"))).alias("_h"))
    at = hits.select("id", F.array_min(F.transform("variants", lambda v: v["chrom"])).alias("chrom"))
    sexes = samples.select("sample_id", "sex").dropDuplicates(["sample_id"]).groupBy("sex").agg(F.count("*").alias("_n"))
    # As many rows as there are chromosomes and sexes.
    number = at.select("chrom").distinct().join(F.broadcast(sexes)).groupBy("chrom").agg(F.sum(F.col("_n") * ploidy(F.col("chrom"), F.col("sex"))).alias("_an"))
    return c.join(at, "id").join(F.broadcast(number), "chrom").select("id", F.round(F.col("_h") / F.when(F.col("_an") > 0, F.col("_an")), digits).alias("haplotype_freq"))


def observed_haplotypes(windows: DataFrame, max_putative: int = 10) -> DataFrame:
    """The variant sets that real individuals carry in each window: window_id, variants, carriers, phase_state.

    ``windows`` has window_id, sample_id, pos, alt, gt and optionally phase_set, one row for each variant in the window
    and sample. A sample whose variants are all phased in one phase set gives one CONFIRMED set for each haplotype. Any
    other gives every non-empty subset of what it carries as PUTATIVE, or only the union if it carries more than
    ``max_putative`` (-1: no limit; more than MOST_PUTATIVE are then refused with an error). Equal sets are one row: carriers united, CONFIRMED only if all
    contributors are. Sets are never put together from several individuals.
    """
    ps = F.col("phase_set") if "phase_set" in windows.columns else F.lit(None).cast("string")
    v = F.struct("pos", "alt")
    rows = windows.select("window_id", "sample_id", v.alias("v"), is_phased(F.col("gt")).alias("phased"), ps.alias("ps"), _slots(F.col("gt"), F.lit(2)).alias("s"))
    per = rows.groupBy("window_id", "sample_id").agg(F.bool_and("phased").alias("phased"), F.countDistinct("ps").alias("n_ps"), F.count_if(F.col("ps").isNull()).alias("no_ps"), F.array_sort(F.collect_list(F.struct("v", "s"))).alias("e"))
    sure = F.col("phased") & ((F.col("n_ps") == 0) | ((F.col("n_ps") == 1) & (F.col("no_ps") == 0)))
    on = lambda h: F.array_sort(F.array_distinct(F.transform(F.filter("e", lambda x: F.coalesce(F.get(x["s"], F.lit(h)), F.lit(False))), lambda x: x["v"])))
    confirmed = F.filter(F.array_distinct(F.array(on(0), on(1))), lambda x: F.size(x) > 0)
    carried = F.array_sort(F.array_distinct(F.transform(F.filter("e", lambda x: F.exists(x["s"], lambda t: t)), lambda x: x["v"])))
    per = per.withColumns({"sure": sure, "confirmed": confirmed, "carried": carried})
    k = F.size("carried")
    if max_putative > MOST_PUTATIVE:
        raise ValueError(f"max_putative must be at most {MOST_PUTATIVE}")
    limit = max_putative if max_putative >= 0 else MOST_PUTATIVE
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2.0), F.least(k, F.lit(limit))) - 1).cast("int"))
    subsets = F.transform(masks, lambda m: F.filter("carried", lambda x, i: (F.floor(m / F.pow(F.lit(2.0), i)).cast("int") % 2) == 1))
    wide = k > limit
    union = F.array("carried") if max_putative >= 0 else F.raise_error(F.lit(f"more than {MOST_PUTATIVE} unphased variants in one window and sample")).cast("array<array<struct<pos:bigint,alt:string>>>")
    putative = F.when(k == 0, F.array().cast("array<array<struct<pos:bigint,alt:string>>>")).when(wide, union).otherwise(subsets)
    sets = per.select("window_id", "sample_id", "sure", F.explode(F.when(F.col("sure"), F.col("confirmed")).otherwise(putative)).alias("variants"))
    return sets.groupBy("window_id", "variants").agg(F.array_sort(F.collect_set("sample_id")).alias("carriers"), F.when(F.bool_and("sure"), "CONFIRMED").otherwise("PUTATIVE").alias("phase_state"))


def combine_by_shared_samples(singles: DataFrame, layers: int = 3, peel: bool = True) -> DataFrame:
    """The older lattice: sets of variants at rising positions whose carriers meet, layer by layer; with ``peel`` a set loses the samples of its supersets.

    ``singles`` has window_id, pos, alt, carriers. Kept as a check of observed_haplotypes on phased data.
    """
    one = singles.select("window_id", F.array(F.struct("pos", "alt")).alias("variants"), F.col("pos").alias("last"), "carriers")
    out, top = one, one
    for _ in range(layers - 1):
        nxt = singles.select("window_id", F.struct("pos", "alt").alias("v"), F.col("pos").alias("p"), F.col("carriers").alias("c2"))
        top = top.join(nxt, "window_id").where("p > last").select("window_id", F.array_append("variants", F.col("v")).alias("variants"), F.col("p").alias("last"), F.array_intersect("carriers", "c2").alias("carriers")).where(F.size("carriers") > 0)
        out = out.unionByName(top)
    out = out.select("window_id", "variants", F.array_sort("carriers").alias("carriers"))
    if not peel:
        return out
    # A sample's sets are those of its variants at rising places, up to ``layers``: one with fewer than it could have is in a larger one.
    places = singles.select("window_id", "pos", F.explode("carriers").alias("s")).groupBy("window_id", "s").agg(F.countDistinct("pos").alias("_k"))
    each = out.select("window_id", "variants", F.explode("carriers").alias("s")).join(places, ["window_id", "s"])
    left = each.where(F.size("variants") == F.least(F.lit(layers), F.col("_k")))
    return left.groupBy("window_id", "variants").agg(F.array_sort(F.collect_set("s")).alias("carriers"))


def merge_panels(panels: dict[str, DataFrame], genotypes: DataFrame | None = None, samples: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """One row per record: ``af_<db>`` of each source, the sorted sources, and, with genotypes, the pooled frequency over their union."""
    rows = None
    for db, p in panels.items():
        own = p.select(F.regexp_replace("chrom", "^(?!chr)", "chr").alias("chrom"), "pos", "ref", "alt", F.lit(db).alias("_db"), "af")
        rows = own if rows is None else rows.unionByName(own)
    out = rows.groupBy(*KEY).agg(*[F.max(F.when(F.col("_db") == db, F.col("af"))).alias(f"af_{db}") for db in panels], F.array_sort(F.collect_set("_db")).alias("sources"))
    if genotypes is None:
        return out
    pooled = allele_counts_panel(genotypes, samples).where("group_kind = 'global'").select(*KEY, F.round(F.col("ac") / F.col("an"), digits).alias("af_pooled"))
    return out.join(pooled, KEY, "left")


def attach_variant_info(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``windows`` (chrom, pos, alt, ...) with rsid (``.`` if missing), ref (``N``), global frequency (0) and carriers; rows without carriers go."""
    g = counts.where("group_kind = 'global'").select("chrom", "pos", "alt", F.col("ref").alias("_ref"), "rsid", F.when(F.col("an") > 0, F.col("ac") / F.col("an")).alias("_af"), "n_carrier")
    j = windows.join(g, ["chrom", "pos", "alt"], "left").where("n_carrier > 0")
    return j.select(*windows.columns, F.coalesce("_ref", F.lit("N")).alias("ref"), F.coalesce("rsid", F.lit(".")).alias("rsid"), F.coalesce("_af", F.lit(0.0)).alias("af"), "n_carrier")


def attach_sample_meta(results: DataFrame, samples: DataFrame) -> DataFrame:
    """One row for each carrier, with population, superpopulation and database, ``unknown`` where the roster lacks it."""
    rows = results.withColumn("sample_id", F.explode("samples")).join(samples.select("sample_id", "population", "superpopulation", "database"), "sample_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("population", "superpopulation", "database")})


def add_gene_info(results: DataFrame, genes: DataFrame) -> DataFrame:
    return results.join(genes.select("gene", "description", "gene_type").dropDuplicates(["gene"]), "gene", "left").withColumns({c: F.coalesce(c, F.lit("NA")) for c in ("description", "gene_type")})
