"""Aggregations of hits for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .clean import partition_mask
from .cluster import score_ranks, value_ranks
from .shared import once

SCORE_TIERS, TOTAL_TIERS = (0.5, 0.2, 0.05), (1, 2, 3, 4)
TIES = ("pos", "strand", "id")


def summary_by_guide(df: DataFrame, pam_created: Column | None = None) -> DataFrame:
    created = F.lit(False) if pam_created is None else pam_created
    return df.groupBy("guide", "bulge_type", "mm", "bulge").agg(F.count_if(F.col("origin") == "ref").alias("n_ref"), F.count_if(F.col("origin") == "alt").alias("n_alt"), F.count("*").alias("n"), F.count_if(created).alias("n_pam_created"))


def mm_bulge_counts(df: DataFrame, mm: list[int]) -> DataFrame:
    """Per guide, origin and bulge size the counts by mismatches, one column each, 0 where there are none."""
    return df.groupBy("guide", "origin", "bulge").pivot("mm", mm).count().fillna(0).withColumnsRenamed({str(m): f"mm{m}" for m in mm})


def summary_by_sample(carried: DataFrame, samples: DataFrame, created: str | None = None) -> DataFrame:
    """Per guide and sample: its hits, those of its population and of its superpopulation (each hit once), PAM creations.

    ``carried`` has guide, id, sample (one row for each carrier); samples without hits stay, with zeros, for each guide.
    """
    known = carried.select("guide", "id", "sample", *([created] if created else [])).distinct().join(samples, "sample")
    flag = F.col(created) if created else F.lit(False)
    own = known.groupBy("guide", "sample").agg(F.count("*").alias("n_sample"), F.count_if(flag).alias("n_pam_created"))
    pop = known.select("guide", "population", "id").distinct().groupBy("guide", "population").agg(F.count("*").alias("n_population"))
    sup = known.select("guide", "superpopulation", "id").distinct().groupBy("guide", "superpopulation").agg(F.count("*").alias("n_superpopulation"))
    # The result has a row for each sample and guide by contract.
    grid = samples.join(F.broadcast(carried.select("guide").distinct()))
    out = grid.join(own, ["guide", "sample"], "left").join(pop, ["guide", "population"], "left").join(sup, ["guide", "superpopulation"], "left")
    n = ("n_sample", "n_population", "n_superpopulation", "n_pam_created")
    return out.select("guide", "sample", "population", "superpopulation", *[F.coalesce(c, F.lit(0)).alias(c) for c in n])


def population_distribution(carried: DataFrame) -> DataFrame:
    """Per guide, group (REF or superpopulation), total and bulge: distinct hits, and those of the group with at most that total."""
    rows = carried.select("guide", F.when(F.col("origin") == "ref", "REF").otherwise(F.col("superpopulation")).alias("grp"), "total", "bulge", "id").distinct()
    n = rows.groupBy("guide", "grp", "total", "bulge").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("guide", "grp").orderBy("total").rangeBetween(Window.unboundedPreceding, 0)
    return n.withColumn("n_cumulative", F.sum("n").over(upto))


def specificity_score(df: DataFrame, digits: int = 6) -> DataFrame:
    """100 / (100 + sum of scores) per guide, and 1 where the sum is 0."""
    s = F.sum(F.coalesce("score", F.lit(0.0)))
    return df.groupBy("guide").agg(s.alias("_s")).select("guide", F.round(F.when(F.col("_s") == 0, 1.0).otherwise(F.lit(100.0) / (F.lit(100.0) + F.col("_s"))), digits).alias("specificity"))


def score_histogram(df: DataFrame) -> DataFrame:
    """Per guide, origin and bin of 0.01 (0 to 100, all present) the number of hits with that score."""
    bins = df.sparkSession.range(101).select(F.col("id").cast("int").alias("bin"))
    n = df.where(F.col("score").between(0, 1)).groupBy("guide", "origin", F.floor(F.round(F.col("score") * 1000).cast("bigint") / F.lit(10)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = df.select("guide", "origin").distinct().join(F.broadcast(bins))
    return grid.join(n, ["guide", "origin", "bin"], "left").select("guide", "origin", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def mmb_matrix(df: DataFrame, mm: int, bulge: int) -> DataFrame:
    """Counts by origin, bulges 0..bulge and mismatches 0..mm, zero cells present."""
    cell = df.sparkSession.range((mm + 1) * (bulge + 1)).select((F.col("id") % (mm + 1)).cast("int").alias("mm"), F.floor(F.col("id") / (mm + 1)).cast("int").alias("bulge"), F.explode(F.array(F.lit("ref"), F.lit("alt"))).alias("origin"))
    n = df.groupBy("origin", "mm", "bulge").agg(F.count("*").alias("n"))
    return cell.join(n, ["origin", "mm", "bulge"], "left").select("origin", "bulge", "mm", F.coalesce("n", F.lit(0)).alias("n"))


def _tiers(second: str | None) -> dict[str, Column]:
    out = {f"score_{t}": F.col("score") >= t for t in SCORE_TIERS}
    out |= {f"{second}_{t}": F.col(second) >= t for t in SCORE_TIERS} if second else {}
    out |= {f"total_{t}": F.col("total") <= t for t in TOTAL_TIERS}
    return out | {"variant": F.col("origin") == "alt", "variant_score_0.05": (F.col("origin") == "alt") & (F.col("score") >= 0.05)}


def tier_counts(df: DataFrame, second: str | None = None) -> DataFrame:
    """tier, n over off-targets (rows with at least one edit)."""
    tiers = _tiers(second)
    one = df.where("total > 0").agg(*[F.count_if(c).alias(k) for k, c in tiers.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("tier"), F.col(f"`{k}`").alias("n")) for k in tiers])).alias("t")).select("t.tier", "t.n")


def tier_frames(df: DataFrame, second: str | None = None) -> DataFrame:
    """Every off-target once for each tier that it is in."""
    held = F.array_compact(F.array(*[F.when(c, k) for k, c in _tiers(second).items()]))
    return df.where("total > 0").withColumn("tier", F.explode(held))


def perfect_matches(df: DataFrame) -> DataFrame:
    n = df.where("total = 0").select("guide", "chrom", "pos", "strand").distinct().groupBy("guide").agg(F.count("*").alias("n_perfect"))
    return n.withColumn("ambiguous", F.col("n_perfect") >= 2)


def dedupe_reference(df: DataFrame, keys: tuple[str, ...] = ("chrom", "pos", "strand", "aligned_ref"), ties=("id",)) -> DataFrame:
    """Only the first of the reference rows that are equal on ``keys``; variant and on-target rows stay."""
    kind = partition_mask(F.col("total"), F.col("origin"))
    w = Window.partitionBy(*keys, "_kind").orderBy(*ties)
    return df.withColumn("_kind", kind).withColumn("_r", F.row_number().over(w)).where("_kind != 'reference' or _r = 1").drop("_kind", "_r")


def origin_by_population(carried: DataFrame) -> DataFrame:
    """Off-targets by origin, and variant ones by superpopulation, each once: kind, name, n.

    On-target rows (``total`` 0) count nowhere. Without a column ``superpopulation`` the samples' ``database`` stands in
    for it; a carrier without either is ``unknown``.
    """
    off = carried.where("total != 0")
    group = "superpopulation" if "superpopulation" in carried.columns else "database"
    by_origin = off.select("id", "origin").distinct().groupBy(F.col("origin").alias("name")).agg(F.count("*").alias("n")).select(F.lit("origin").alias("kind"), "name", "n")
    by_group = off.where("origin = 'alt'").select("id", F.coalesce(group, F.lit("unknown")).alias("name")).distinct().groupBy("name").agg(F.count("*").alias("n"))
    return by_origin.unionByName(by_group.select(F.lit(group).alias("kind"), "name", "n"))


def counted_labels(labels: Column) -> Column:
    """The categories that a hit's distinct labels count for, once for each label: personal ones none, CTCF-bound ones ``CTCF-only`` and what stands before the semicolon, gene ones themselves without their suffix, all others none."""
    none = F.array().cast("array<string>")
    own = lambda x: F.when(x.contains("_personal"), none).when(x.contains("CTCF-bound"), F.array(F.lit("CTCF-only"), F.substring_index(x, ";", 1))).when(x.contains("_gencode"), F.array(F.replace(x, F.lit("_gencode"), F.lit("")))).otherwise(none)
    return F.flatten(F.transform(F.array_distinct(F.coalesce(labels, none)), own))


def cumulative_annotation_counts(annotated: DataFrame, most: int = 14) -> DataFrame:
    """Per guide, category and threshold 0..most: labels of hits with at most so many edits that count for it; ``General`` counts the hits, with labels or without.

    ``annotated`` has guide, total and labels, one row for each hit. Each guide has a row for every category.
    """
    rows = annotated.select("guide", "total", F.explode(F.concat(F.array(F.lit("General")), counted_labels(F.col("labels")))).alias("label"))
    n = rows.groupBy("guide", "label", "total").agg(F.count("*").alias("n"))
    # As many rows as there are guides, categories and thresholds.
    t = n.sparkSession.range(most + 1).select(F.col("id").cast("int").alias("threshold"))
    grid = n.select("guide").distinct().join(n.select("label").distinct()).join(t)
    upto = Window.partitionBy("guide", "label").orderBy("threshold")
    full = grid.join(n.withColumnRenamed("total", "threshold"), ["guide", "label", "threshold"], "left")
    return full.select("guide", "label", "threshold", F.sum(F.coalesce("n", F.lit(0))).over(upto).alias("n"))


def motif_profile(df: DataFrame, guide: str = "guide_seq", dna: str = "dna", most: int = 14) -> DataFrame:
    """Per guide, threshold and position (from 0): how often each base mismatches the guide there, or a gap stands, over hits with at most so many edits.

    Where the guide has N the observed base counts.
    """
    letters = lambda c: F.filter(F.split(F.col(c), ""), lambda x: x != "")
    pairs = F.arrays_zip(letters(guide).alias("g"), letters(dna).alias("d"))
    each = df.select(F.col(guide).alias("guide"), "total", F.posexplode(pairs).alias("position", "p")).select("guide", "total", "position", F.upper("p.g").alias("g"), F.upper("p.d").alias("d"))
    kind = F.when(F.col("g") == "-", "DNA").when(F.col("d") == "-", "RNA").when((F.col("g") == "N") | (F.col("g") != F.col("d")), F.col("d"))
    n = each.withColumn("kind", kind).where("kind is not null").groupBy("guide", "position", "kind", "total").agg(F.count("*").alias("n"))
    t = n.sparkSession.range(most + 1).select(F.col("id").cast("int").alias("total"))
    grid = n.select("guide", "position", "kind").distinct().join(F.broadcast(t))
    upto = Window.partitionBy("guide", "position", "kind").orderBy("total")
    return grid.join(n, ["guide", "position", "kind", "total"], "left").select("guide", "position", "kind", F.col("total").alias("threshold"), F.sum(F.coalesce("n", F.lit(0))).over(upto).alias("n"))


def personal_private(sites: DataFrame) -> DataFrame:
    """Per sample the sites it carries, those it alone carries, and their ratio. ``sites`` has id and samples."""
    rows = sites.select("id", F.explode("samples").alias("sample"), (F.size("samples") == 1).alias("only"))
    return rows.groupBy("sample").agg(F.count("*").alias("personal"), F.count_if("only").alias("private")).withColumn("ratio", F.round(F.col("private") / F.col("personal"), 6))


def mean_private_ratio(sites: DataFrame, digits: int = 6) -> DataFrame:
    """One row: how many samples carry a site, and the mean of their ratios of private to personal sites."""
    return personal_private(sites).agg(F.count("*").alias("samples"), F.round(F.avg("ratio"), digits).alias("mean_ratio"))


def two_sample_t(a: DataFrame, b: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """One row: the means, and Student's t with equal variances between a column of two tables."""
    s = lambda df, p: df.agg(F.count(column).alias(f"n_{p}"), F.avg(column).alias(f"mean_{p}"), F.var_samp(column).alias(f"v_{p}"))
    both = s(a, "a").join(F.broadcast(s(b, "b")))
    pooled = ((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / (F.col("n_a") + F.col("n_b") - 2)
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(pooled * (F.lit(1.0) / F.col("n_a") + F.lit(1.0) / F.col("n_b")))
    return both.select("n_a", "n_b", F.round("mean_a", digits).alias("mean_a"), F.round("mean_b", digits).alias("mean_b"), F.round(t, digits).alias("t"))


def score_correlation(df: DataFrame, x: str = "score", y: str = "score_ref", digits: int = 6) -> DataFrame:
    """Pearson's and Spearman's correlation per guide; ties get their average rank."""
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("guide", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    r = value_ranks(value_ranks(r, ["guide"], "_x", "_rx"), ["guide"], "_y", "_ry")
    return r.groupBy("guide").agg(F.round(F.corr("_x", "_y"), digits).alias("pearson"), F.round(F.corr("_rx", "_ry"), digits).alias("spearman"))


def rank_correlation(df: DataFrame, second: str = "score_ref", clip: int = 10_000, digits: int = 6, ties=TIES) -> DataFrame:
    """The same over the ranks by both scores, clipped at ``clip``, of the rows that are in the first ``clip`` of either."""
    # A few rows of each guide, which the ranks below read several times.
    return score_correlation(once(score_ranks(df, second, clip, ties)), "rank_score", "rank_second", digits)


def score_maf_heatmap(df: DataFrame, bin_: Column, decade: Column, decades: list[float]) -> DataFrame:
    """Off-targets with more than one edit by score bin (rows) and frequency decade (columns); empty cells 0.1."""
    n = df.where("total > 1").select(bin_.alias("bin"), decade.alias("decade")).where("bin is not null and decade is not null")
    out = n.groupBy("bin").pivot("decade", decades).count()
    names = {c: f"d{i}" for i, c in enumerate(out.columns[1:])}
    return out.withColumnsRenamed(names).select("bin", *[F.coalesce(F.col(c).cast("double"), F.lit(0.1)).alias(c) for c in names.values()])


def category_overlap(df: DataFrame) -> DataFrame:
    """How many hits have each combination of categories."""
    return df.groupBy(F.array_join("categories", "&").alias("combination")).agg(F.count("*").alias("n"))


def guide_top_stats(df: DataFrame, ks: tuple[int, ...] = (10, 100, 1000), least: float = 0.1, key: str = "aligned_ref", digits: int = 6, ties=TIES) -> DataFrame:
    """Per guide and k, of the variant ones among the k best sites by score: how many there are, how many lie on the
    on-target's chromosome, have a regulatory element (``ccre``), or stand in coding sequence (a ``gene_region`` with
    CDS), and the mean, deviation, least and largest frequency (``af``); and the number of duplicates dropped.

    Sites: off-targets with more than one edit and a score of at least ``least``; of those with equal ``key`` the best,
    among equal scores one with a regulatory element. The on-target is a guide's first row without edits of that score.
    """
    good = df.where(F.col("score") >= least)
    target = good.where("total = 0").groupBy("guide").agg(F.min_by("chrom", F.struct(*ties)).alias("_target"))
    rows = good.where("total > 1")
    order = [F.col("score").desc(), F.col("ccre").desc_nulls_last(), *ties]
    same = Window.partitionBy("guide", key)
    rows = rows.withColumn("duplicates", F.count("*").over(same) - 1).withColumn("_d", F.row_number().over(same.orderBy(*order))).where("_d = 1")
    r = rows.withColumn("_r", F.row_number().over(Window.partitionBy("guide").orderBy(*order))).where(F.col("_r") <= max(ks))
    r = r.join(target, "guide", "left").withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("_r <= k")
    alt = F.col("origin") == "alt"
    af = F.when(alt, F.col("af"))
    return r.groupBy("guide", "k").agg(
        F.count("*").alias("n"), F.count_if(alt).alias("n_alt"), F.sum("duplicates").alias("duplicates"),
        F.count_if(alt & (F.col("chrom") == F.col("_target"))).alias("n_same_chrom"), F.count_if(alt & F.col("ccre").isNotNull()).alias("n_ccre"),
        F.count_if(alt & F.coalesce(F.col("gene_region").contains("CDS"), F.lit(False))).alias("n_cds"),
        F.round(F.avg(af), digits).alias("mean_af"), F.round(F.stddev_samp(af), digits).alias("std_af"), F.min(af).alias("min_af"), F.max(af).alias("max_af"),
    )


def alt_target_counts(df: DataFrame) -> DataFrame:
    """Rows with at most one edit, with their guide's number of rows, variant rows, and variant rows with a score of its own."""
    alt = F.col("origin") == "alt"
    counts = df.groupBy(F.col("guide").alias("_guide")).agg(F.count("*").alias("n_rows"), F.count_if(alt).alias("n_alt"), F.count_if(alt & (F.col("score") > F.col("score_ref"))).alias("n_alt_score"))
    return df.where("total <= 1").join(counts, F.col("guide").eqNullSafe(F.col("_guide"))).drop("_guide")


def alt_in_top_k(df: DataFrame, k: int, by_score: bool = True, ties=TIES) -> DataFrame:
    order = [F.col("score").desc_nulls_last()] if by_score else [F.col("total")]
    w = Window.partitionBy("guide").orderBy(*order, *ties)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy("guide").agg(F.count_if(F.col("origin") == "alt").alias("n_alt"), F.count("*").alias("n"))


def superpopulation_overlap(carried: DataFrame, min_risk: float, min_score: float) -> DataFrame:
    """How many hits have each combination of carriers' superpopulations, among hits with enough risk and score."""
    rows = carried.where((F.col("score") >= min_score) & (F.col("score") - F.col("score_ref") >= min_risk))
    return rows.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("superpopulation")), "&").alias("combination")).groupBy("combination").agg(F.count("*").alias("n"))


def accumulation_curve(carried: DataFrame, permutations: int = 100, seed: int = 0, digits: int = 6) -> DataFrame:
    """Per population and number of individuals: the mean, and the half-width of its 95% interval, of distinct hits over shuffles.

    A shuffle orders a population's samples by a hash of (seed, shuffle, sample). A hit counts from the first sample
    that carries it. A sample's places in all shuffles are one array, and a hit's are the least of its carriers' place by
    place, so that a hit is one row whatever the number of shuffles and carriers.
    """
    rows = carried.select("population", "sample", "id").distinct()
    shuffles = carried.sparkSession.range(permutations).select(F.col("id").cast("int").alias("shuffle"))
    people = rows.select("population", "sample").distinct().join(F.broadcast(shuffles))
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col("shuffle"), F.col("sample")))
    place = people.withColumn("place", F.row_number().over(Window.partitionBy("population", "shuffle").orderBy(h, "sample")))
    lists = place.groupBy("population", "sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("shuffle", "place"))), lambda x: x["place"]).alias("places"))
    least = rows.join(lists, ["population", "sample"]).groupBy("population", "id").agg(*[F.min(F.get("places", F.lit(i))).alias(f"_p{i}") for i in range(permutations)])
    first = least.select("population", F.posexplode(F.array(*[f"_p{i}" for i in range(permutations)])).alias("shuffle", "place"))
    new = first.groupBy("population", "shuffle", "place").agg(F.count("*").alias("new"))
    upto = Window.partitionBy("population", "shuffle").orderBy("place")
    curve = place.select("population", "shuffle", "place").join(new, ["population", "shuffle", "place"], "left").withColumn("seen", F.sum(F.coalesce("new", F.lit(0))).over(upto))
    return curve.groupBy("population", F.col("place").alias("individuals")).agg(F.round(F.avg("seen"), digits).alias("mean"), F.round(F.lit(1.96) * F.stddev_samp("seen") / F.sqrt(F.count("*")), digits).alias("half_width"))
