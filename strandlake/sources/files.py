"""Readers and writers of the file formats around the tables. All give fixed schemas; nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MISSING = ("", "NA", "n", ".", "NaN", "None")
#: Curated columns of an export, in order.
CURATED = ("site_rank", "guide", "chrom", "start", "strand", "aligned_spacer", "aligned_target", "pam", "mm", "bulge", "total", "bulge_type", "origin", "pam_creation", "score", "score_ref", "score_alt", "risk", "variants", "samples", "annotations", "perfect_match")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each line's place in its split of the file; a split is read by one task, in order."""
    last, n = None, 0
    for batch in batches:
        place = []
        for key in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n = n + 1 if key == last else 0
            last = key
            place.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], ["value", "file", "block", "n"])


def read_fasta(spark: SparkSession, path: str, tile: int = 100_000, overlap: int = 100) -> DataFrame:
    """(chrom, start, seq): upper-case tiles that start every ``tile`` bases and run ``overlap`` on.

    Files are read in splits, so that a chromosome is no single task. One row for each piece of a contig in a split tells
    its name and where it begins; lines are then cut at tile borders and put together by tile. A contig without a
    sequence has one empty tile; what stands before the first name of a file is left out.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = lines.mapInArrow(_numbered, "value string, file string, block long, n long")
    head = F.col("value").startswith(">")
    inside = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    seq = F.upper(F.regexp_replace("value", r"\s", ""))
    rows = rows.select("file", "block", "n", F.when(head, F.regexp_extract("value", r"^>\s*(\S*)", 1)).alias("name"), F.when(head, "").otherwise(seq).alias("seq")).withColumn("part", F.count("name").over(inside))
    piece = Window.partitionBy("file", "block", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("seq")).over(piece), F.lit(0)))
    parts = rows.groupBy("file", "block", "part").agg(F.max("name").alias("name"), F.sum(F.length("seq")).alias("size"))
    order = Window.partitionBy("file").orderBy("block", "part")
    parts = parts.withColumns({"chrom": F.last("name", ignorenulls=True).over(order), "contig": F.count("name").over(order)}).where("contig > 0")
    before = Window.partitionBy("file", "contig").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0))).select("file", "block", "part", "chrom", "contig", "first")
    own = rows.join(parts, ["file", "block", "part"]).select("file", "contig", "chrom", (F.col("first") + F.col("at")).alias("a"), "seq", "name").where("seq != '' or name is not null")
    end = F.col("a") + F.greatest(F.length("seq"), F.lit(1))
    tiles = F.sequence(F.greatest(F.lit(0), F.floor((F.col("a") - overlap) / F.lit(tile))), F.floor((end - 1) / F.lit(tile)))
    cut = own.select("*", F.explode(F.when(F.col("seq") == "", F.array(F.lit(0).cast("bigint"))).otherwise(tiles)).alias("t"))
    lo, hi = F.greatest(F.col("a"), F.col("t") * tile), F.least(F.col("a") + F.length("seq"), F.col("t") * tile + tile + overlap)
    text = F.substring(F.col("seq"), (lo - F.col("a") + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("s")))), lambda x: x["s"]), "")
    return cut.groupBy("file", "contig", "chrom", "t").agg(joined.alias("seq")).select("chrom", (F.col("t") * tile).cast("bigint").alias("start"), "seq").where("seq != '' or start = 0")


#: Bytes of VCF headers that may go to all tasks.
HEADERS = 64 << 20


def read_vcf(spark: SparkSession, path: str, header: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(variants, genotypes) of VCF text. ``header``: the #CHROM line of all files; by default each file has its own.

    Files may list different samples, or the same in another order. Files without a #CHROM line have no genotypes.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    split = F.split("value", "\t")
    p = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select("file", split.alias("p"))
    at = lambda i: F.get("p", F.lit(i))
    pairs = F.transform(F.split(at(7), ";"), lambda x: F.split(x, "=", 2))
    info = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda x: F.struct(F.get(x, F.lit(0)), F.coalesce(F.get(x, F.lit(1)), F.lit(""))))))
    v = p.select("file", at(0).alias("chrom"), at(1).try_cast("bigint").alias("pos"), F.when(at(2) != ".", at(2)).alias("rsid"), at(3).alias("ref"), F.split(at(4), ",").alias("alts"), F.split(at(6), ";").alias("filter"), info.alias("info"), F.slice("p", F.lit(10), F.greatest(F.size("p"), F.lit(0))).alias("gts"))
    v = v.withColumn("af", F.transform(F.split(F.element_at("info", "AF"), ","), lambda x: x.try_cast("double")))
    variants = v.select("chrom", "pos", "rsid", "ref", "alts", "filter", "af", "info")
    names = lambda column: F.slice(column, F.lit(10), F.greatest(F.size(column), F.lit(0)))
    if header is None:
        heads = lines.where(F.col("value").startswith("#CHROM")).groupBy("file").agg(F.min("value").alias("value"))
        size = heads.agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("b")).first()
        if not size["n"]:
            raise ValueError(f"no #CHROM line in {path}")
        heads = heads.select("file", names(split).alias("ids"))
        v = v.join(F.broadcast(heads) if size["b"] <= HEADERS else heads, "file")
    else:
        v = v.withColumn("ids", F.array(*map(F.lit, header.split("\t")[9:])).cast("array<string>"))
    g = v.select("chrom", "pos", "ref", "alts", "ids", F.posexplode("gts").alias("_i", "field")).where(F.col("_i") < F.size("ids"))
    return variants, g.select("chrom", "pos", "ref", "alts", F.get("ids", F.col("_i")).alias("sample_id"), F.get(F.split("field", ":"), F.lit(0)).alias("gt"))


def import_snp_dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(variants, genotypes) of JSON text that maps ``chrom,pos`` to entries ``s:gt,...;ref,alt;rsid;af`` joined by ``$``.

    Entries with fewer than three fields or without an alternate are skipped. Keys and values hold no quotes, so that the
    end of a value cuts the text: a dictionary of a whole chromosome, mostly one line, is read in splits.
    """
    pair = r'"([^"]*)"\s*:\s*"([^"]*)'
    cut = spark.read.text(path, lineSep='",').select(F.explode(F.regexp_extract_all("value", F.lit(pair), F.lit(0))).alias("pair"))
    entries = cut.select(F.regexp_extract("pair", pair, 1).alias("key"), F.regexp_extract("pair", pair, 2).alias("value"))
    e = entries.select(F.split("key", ",").alias("k"), F.explode(F.split("value", r"\$")).alias("e")).select("k", F.split("e", ";").alias("f")).where(F.size("f") >= 3)
    e = e.withColumn("a", F.split(F.get("f", F.lit(1)), ",")).where(F.coalesce(F.get("a", F.lit(1)) != "", F.lit(False)))
    base = e.select(F.get("k", F.lit(0)).alias("chrom"), F.get("k", F.lit(1)).try_cast("bigint").alias("pos"), F.get("a", F.lit(0)).alias("ref"), F.get("a", F.lit(1)).alias("alt"), F.get("f", F.lit(2)).alias("rsid"), F.get("f", F.lit(3)).try_cast("double").alias("af"), F.get("f", F.lit(0)).alias("carriers"))
    g = base.select("chrom", "pos", "ref", "alt", F.explode(F.split("carriers", ",")).alias("c")).where(F.col("c").contains(":"))
    return base.drop("carriers"), g.select("chrom", "pos", "ref", "alt", F.split("c", ":")[0].alias("sample_id"), F.split("c", ":")[1].alias("gt"))


def read_samples(spark: SparkSession, rosters: dict[str, str]) -> DataFrame:
    """sample_id, population, superpopulation, sex, database of tab-separated rosters by database; headers and blank lines are skipped."""
    out = []
    for db, path in rosters.items():
        p = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p"))
        out.append(p.select(*[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(("sample_id", "population", "superpopulation", "sex"))], F.lit(db).alias("database")))
    return reduce(lambda a, b: a.unionByName(b), out)


def read_features(spark: SparkSession, path: str, source: str, personal: bool = False) -> DataFrame:
    """chrom, start, end, label, source of a BED file; personal labels get a suffix."""
    p = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser)") & (F.trim("value") != "")).select(F.split("value", "\t").alias("p"))
    at = lambda i: F.get("p", F.lit(i))
    label = F.concat(at(3), F.lit("_personal")) if personal else at(3)
    return p.select(at(0).alias("chrom"), at(1).try_cast("bigint").alias("start"), at(2).try_cast("bigint").alias("end"), label.alias("label"), F.lit("personal" if personal else source).alias("source"))


def read_guides(spark: SparkSession, guides: str, pam: str) -> DataFrame:
    """guide, spacer, pam, pam_5prime. The PAM file's first line: the motif with N in place of the guide, and a length whose sign is the side."""
    line = spark.read.text(pam).first()
    motif, n = line["value"].split()
    size, five = abs(int(n)), int(n) < 0
    own = motif[:size] if five else motif[-size:]
    g = spark.read.text(guides).select(F.upper(F.trim("value")).alias("guide")).where("guide != ''")
    return g.select("guide", F.regexp_replace("guide", f"^N{{{size}}}" if five else f"N{{{size}}}$", "").alias("spacer"), F.lit(own).alias("pam"), F.lit(five).alias("pam_5prime"))


def read_results(spark: SparkSession, path: str, schema: str, names: dict[str, str] | None = None) -> DataFrame:
    """A tab-separated table by column names: other names in use are mapped, tokens for missing values become null, types follow ``schema``."""
    from pyspark.sql.types import _parse_datatype_string

    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    raw = raw.withColumnsRenamed({k: v for k, v in (names or {}).items() if k in raw.columns})
    target = _parse_datatype_string(schema)
    gone = [f.name for f in target.fields if f.name not in raw.columns]
    if gone:
        raise ValueError(f"columns not found: {gone}")
    return raw.select(*[F.when(~F.col(f"`{f.name}`").isin(*MISSING), F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name) for f in target.fields])


def write_results(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """Parquet by guide and chromosome, sorted by position, in files of bounded size; gives it back as read from there.

    Rows are dealt by ranges of (guide, chromosome, position), so that a guide or chromosome with most rows is written by
    many tasks. Partition pruning and the ranges of positions of files and row groups serve the look-ups.
    """
    dealt = df.repartitionByRange("guide", "chrom", "pos").sortWithinPartitions("guide", "chrom", "pos")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("guide", "chrom").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def curated(df: DataFrame) -> DataFrame:
    """The curated columns as text: the ALT alignment falls back to the REF one, lists are comma-joined, blanks are ``-``."""
    rows = df.withColumn("aligned_target", F.coalesce("aligned_alt", "aligned_ref")).withColumn("perfect_match", F.when(F.col("total") == 0, "Yes").otherwise("No"))
    kinds = dict(rows.dtypes)
    text = lambda c: F.array_join(c, ",") if kinds[c].startswith("array") else F.col(c).cast("string")
    value = lambda c: F.when(F.trim(text(c)) != "", text(c)) if c in kinds else F.lit(None).cast("string")
    return rows.select(*[F.coalesce(value(c), F.lit("-")).alias(c) for c in CURATED])


def export_curated(df: DataFrame, path: str) -> None:
    curated(df).write.mode("overwrite").csv(path, sep="\t", header=True)


def read_chrom_alias(spark: SparkSession, path: str) -> DataFrame:
    p = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("p"))
    return p.select(*[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(("assembly", "genbank", "ucsc"))])


def read_lifted_bed(spark: SparkSession, path: str) -> DataFrame:
    """off_target_id, ref_chrom, ref_start (from 1) of BED rows with the id as fourth column."""
    p = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", "\t").alias("p"))
    return p.select(F.get("p", F.lit(3)).alias("off_target_id"), F.get("p", F.lit(0)).alias("ref_chrom"), (F.get("p", F.lit(1)).try_cast("bigint") + 1).alias("ref_start"))


def read_unlifted(spark: SparkSession, path: str) -> DataFrame:
    p = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return p.select(F.get(F.split("value", "\t"), F.lit(3)).alias("off_target_id"))
