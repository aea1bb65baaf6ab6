"""Data-quality jobs. All give issue rows: check, severity, n, examples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed limits of the checks.
MAX_ALLELE, MAX_ALTS, EDGE, MIN_PASS, EXAMPLES = 50, 10, 26, 0.1, 5


def _issues(df: DataFrame, tests: dict[str, tuple[str, Column]], key: Column) -> DataFrame:
    """One pass: a count and the smallest examples of each test; tests without a hit are left out."""
    aggs = []
    for name, (_, test) in tests.items():
        aggs += [F.count_if(test).alias(f"n_{name}"), F.min(F.when(test, key)).alias(f"e_{name}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.lit(sev).alias("severity"), F.col(f"n_{name}").alias("n"), F.col(f"e_{name}").alias("example")) for name, (sev, _) in tests.items()])
    return one.select(F.explode(rows).alias("r")).select("r.*").where("n > 0")


def check_variants(variants: DataFrame, lengths: DataFrame) -> DataFrame:
    """Issues of a variant table (chrom, pos, ref, alts, filter, af, and optionally info): check, severity, n, example.

    With ``info``, whose keys stand in the order of the record, a contig is reported whose records have the key ``AF`` at
    several places: readers that keep the place of the first record then miss the others.
    """
    v = variants.join(F.broadcast(lengths.select(F.col("chrom"), F.col("length").alias("_len"))), "chrom", "left")
    key = F.concat_ws("_", "chrom", "pos", "ref", F.array_join("alts", ","))
    symbolic = F.exists("alts", lambda a: a.startswith("<"))
    breakend = F.exists("alts", lambda a: a.rlike(r"[\[\]]"))
    plain = F.filter("alts", lambda a: a.rlike("^[ACGTNacgtn]+$"))
    indel = F.exists(plain, lambda a: F.length(a) != F.length("ref"))
    short = F.coalesce(F.size("af") < F.size("alts"), F.lit(False))
    tests = {
        "foreign_contig": ("error", F.col("_len").isNull()),
        "long_allele": ("warning", (F.length("ref") > MAX_ALLELE) | F.exists(plain, lambda a: F.length(a) > MAX_ALLELE)),
        "many_alts": ("warning", F.size("alts") >= MAX_ALTS),
        "breakend": ("warning", breakend),
        "symbolic": ("warning", symbolic),
        "indel_at_edge": ("warning", indel & (F.col("pos") < EDGE)),
        "outside_contig": ("error", (F.col("pos") < 1) | (F.col("pos") > F.col("_len"))),
        "af_short_snp": ("warning", short & ~indel),
        "af_short_indel": ("warning", short & indel),
    }
    found = _issues(v, tests, key)
    repeats = v.groupBy("chrom", "pos").agg(F.count("*").alias("k")).where("k > 1")
    dup = repeats.agg(F.count("*").alias("n"), F.min(F.concat_ws("_", "chrom", "pos")).alias("example")).where("n > 0").select(F.lit("duplicate_position").alias("check"), F.lit("warning").alias("severity"), "n", "example")
    passed = v.agg(F.count_if(F.array_contains("filter", "PASS")).alias("p"), F.count("*").alias("k")).where(f"k > 0 and p < {MIN_PASS} * k").select(F.lit("low_pass_ratio").alias("check"), F.lit("warning").alias("severity"), F.col("p").alias("n"), F.lit(None).cast("string").alias("example"))
    out = found.unionByName(dup).unionByName(passed)
    if "info" not in variants.columns:
        return out
    place = F.array_position(F.map_keys("info"), "AF")
    places = v.where(place > 0).groupBy("chrom").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b")
    return out.unionByName(places.agg(F.count("*").alias("n"), F.min("chrom").alias("example")).where("n > 0").select(F.lit("af_place_varies").alias("check"), F.lit("warning").alias("severity"), "n", "example"))


def check_phasing(genotypes: DataFrame) -> DataFrame:
    """An issue where a contig has both phased and unphased genotypes."""
    g = genotypes.groupBy("chrom").agg(F.count_if(F.col("gt").contains("|")).alias("p"), F.count_if(F.col("gt").contains("/")).alias("u")).where("p > 0 and u > 0")
    return g.agg(F.count("*").alias("n"), F.min("chrom").alias("example")).where("n > 0").select(F.lit("mixed_phasing").alias("check"), F.lit("warning").alias("severity"), "n", "example")


def _missing(a: DataFrame, b: DataFrame, key: str, check: str, severity: str) -> DataFrame:
    gone = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")
    first = gone.orderBy(key).limit(EXAMPLES).agg(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ",").alias("example"))
    return gone.agg(F.count("*").alias("n")).join(F.broadcast(first)).where("n > 0").select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "n", "example")


def check_samples(roster: DataFrame, genotypes: DataFrame) -> DataFrame:
    """Genotyped samples without a roster entry are an error; the other way it is information."""
    return _missing(genotypes, roster, "sample_id", "not_in_roster", "error").unionByName(_missing(roster, genotypes, "sample_id", "not_genotyped", "info"))


def check_contigs(variants: DataFrame, tiles: DataFrame) -> DataFrame:
    """Variant contigs that the genome lacks, a leading ``chr`` left out of account."""
    plain = lambda d: d.select(F.regexp_replace("chrom", "^chr", "").alias("chrom"))
    return _missing(plain(variants), plain(tiles), "chrom", "contig_not_in_genome", "warning")


def check_guides(guides: DataFrame) -> DataFrame:
    """Issues of guides (guide, spacer, pam): empty or non-IUPAC motifs, empty guides, guides shorter than the motif, several lengths."""
    iupac = "^[ACGTRYSWKMBDHVNacgtryswkmbdhvn]*$"
    tests = {
        "empty_motif": ("error", F.coalesce(F.col("pam") == "", F.lit(True))),
        "motif_letters": ("error", ~F.col("pam").rlike(iupac)),
        "empty_guide": ("error", F.coalesce(F.col("guide") == "", F.lit(True))),
        "guide_letters": ("error", ~F.col("guide").rlike(iupac)),
        "shorter_than_motif": ("error", F.length("guide") < F.length("pam")),
    }
    found = _issues(guides, tests, F.col("guide"))
    sizes = guides.agg(F.countDistinct(F.length("guide")).alias("n")).where("n > 1").select(F.lit("several_lengths").alias("check"), F.lit("error").alias("severity"), "n", F.lit(None).cast("string").alias("example"))
    return found.unionByName(sizes)


def check_rate(df: DataFrame, ok: Column, most: float = 0.5) -> DataFrame:
    """One row: rows, failing, passed. An empty table passes."""
    return df.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failing")).withColumn("passed", F.col("failing") <= F.col("rows") * F.lit(most))


def require_rate(df: DataFrame, ok: Column, most: float = 0.5) -> DataFrame:
    """``df`` itself, after a job that raises if more than the share ``most`` fails."""
    got = check_rate(df, ok, most).first()
    if not got["passed"]:
        raise ValueError(f"{got['failing']} of {got['rows']} rows fail; at most {most:.0%} may")
    return df


def check_features(lines: DataFrame) -> DataFrame:
    """Issues of BED text (column ``value``): fewer than four columns, bad coordinates, labels of several words, or no data at all."""
    data = lines.where(~F.col("value").rlike(r"^(#|track|browser)") & (F.trim("value") != "")).withColumn("p", F.split("value", "\t"))
    start, end = F.get("p", F.lit(1)).try_cast("bigint"), F.get("p", F.lit(2)).try_cast("bigint")
    tests = {
        "columns": ("error", F.size("p") < 4),
        "coordinates": ("error", (F.size("p") >= 3) & F.coalesce(start.isNull() | end.isNull() | (start > end), F.lit(True))),
        "label": ("error", (F.size("p") >= 4) & F.get("p", F.lit(3)).rlike(r"\s")),
    }
    empty = data.agg(F.count("*").alias("k")).where("k = 0").select(F.lit("no_data").alias("check"), F.lit("error").alias("severity"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("example"))
    return _issues(data, tests, F.col("value")).unionByName(empty)


def union_issues(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)
