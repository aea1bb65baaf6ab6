import json
import random

from pyspark.sql import functions as F

from strandlake.sources import files


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_fasta_tiles(spark, tmp_path):
    path = write(tmp_path, "a.fa", ">chr1 some words\nacgt\nACGT\n>chr2\nTT\n")
    got = {(r["chrom"], r["start"]): r["seq"] for r in files.read_fasta(spark, path, 4, 2).collect()}
    assert got == {("chr1", 0): "ACGTAC", ("chr1", 4): "ACGT", ("chr2", 0): "TT"}


def test_fasta_in_splits(spark, tmp_path):
    r = random.Random(3)
    want, folder = {}, tmp_path / "genome"
    folder.mkdir()
    for name in ("x", "y"):
        text = "; before any name\n"
        for i in range(5):
            seq = "".join(r.choice("acgtN") for _ in range(r.choice([0, 3, 61, 400, 1999])))
            text += f"> {name}{i} about it\r\n" + "".join(seq[k : k + 50] + "\r\n" for k in range(0, len(seq), 50)) + "\n"
            for at in range(0, max(1, len(seq)), 64):
                want[f"{name}{i}", at] = seq[at : at + 74].upper()
        (folder / f"{name}.fa").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = files.read_fasta(spark, str(folder), 64, 10)
        assert {(x["chrom"], x["start"]): x["seq"] for x in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_vcf(spark, tmp_path):
    path = write(tmp_path, "a.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\nchr1\t5\t.\tA\tG,T\t.\tPASS\tAF=0.1,0.2;DB\tGT:DP\t0|1:3\t1|2\n")
    v, g = files.read_vcf(spark, path)
    r = v.first()
    assert (r["pos"], r["rsid"], r["alts"], r["af"], r["info"]["DB"]) == (5, None, ["G", "T"], [0.1, 0.2], "")
    assert {(x["sample_id"], x["gt"]) for x in g.collect()} == {("S1", "0|1"), ("S2", "1|2")}


def test_vcf_files_have_their_own_samples(spark, tmp_path):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"
    folder = tmp_path / "many"
    folder.mkdir()
    for name, samples, row in (("a", "S1\tS2", "chr1\t5\t.\tA\tG\t.\tPASS\t.\tGT\t0|1\t1|1"), ("b", "S2\tS1\tS3", "chr2\t7\t.\tA\tG\t.\tPASS\t.\tGT\t0|0\t1|0\t0|1")):
        (folder / f"{name}.vcf").write_text(f"{head}\t{samples}\n{row}\n")
    (folder / "c.vcf").write_text(f"{head.rpartition(chr(9))[0]}\nchr3\t9\t.\tA\tG\t.\tPASS\t.\n")
    v, g = files.read_vcf(spark, str(folder))
    assert v.count() == 3
    assert {(x["chrom"], x["sample_id"], x["gt"]) for x in g.collect()} == {("chr1", "S1", "0|1"), ("chr1", "S2", "1|1"), ("chr2", "S2", "0|0"), ("chr2", "S1", "1|0"), ("chr2", "S3", "0|1")}


def test_snp_dictionary(spark, tmp_path):
    path = write(tmp_path, "d.json", '{"chr1,5": "S1:0|1,S2:1|1;A,G;rs1;0.01$;A;rs2", "chr1,9": "bad"}')
    v, g = files.import_snp_dictionary(spark, path)
    assert [(r["pos"], r["alt"], r["rsid"]) for r in v.collect()] == [(5, "G", "rs1")]
    assert g.count() == 2


def test_snp_dictionary_is_read_in_splits(spark, tmp_path):
    text = {f"chr1,{i}": f"S{i % 7}:0|1;A,G;rs{i};0.5" for i in range(5000)}
    for name, kinds in (("a.json", {}), ("b.json", {"separators": (",", ":")}), ("c.json", {"indent": 1})):
        path = write(tmp_path, name, json.dumps(text, **kinds))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        try:
            v, g = files.import_snp_dictionary(spark, path)
            assert v.rdd.getNumPartitions() > 4
            assert {(r["chrom"], r["pos"], r["rsid"]) for r in v.collect()} == {("chr1", i, f"rs{i}") for i in range(5000)}
            assert g.count() == 5000
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rosters_features_guides(spark, tmp_path):
    r = files.read_samples(spark, {"d": write(tmp_path, "s.txt", "#id\tp\ts\tx\nS1\tTSI\tEUR\tmale\n\n")}).first()
    assert (r["sample_id"], r["superpopulation"], r["database"]) == ("S1", "EUR", "d")
    f = files.read_features(spark, write(tmp_path, "f.bed", "chr1\t1\t5\tx\n"), "encode", personal=True).first()
    assert (f["label"], f["source"]) == ("x_personal", "personal")
    g = files.read_guides(spark, write(tmp_path, "g.txt", "ACGTNNN\n"), write(tmp_path, "p.txt", "NNNNNGG 3\n")).first()
    assert (g["spacer"], g["pam"], g["pam_5prime"]) == ("ACGT", "NGG", False)


def test_results_round_trip(spark, tmp_path):
    path = write(tmp_path, "r.tsv", "Guide\tPos\tScore\nG\t5\tNA\nG\t6\t0.5\n")
    df = files.read_results(spark, path, "guide string, pos long, score double", {"Guide": "guide", "Pos": "pos", "Score": "score"})
    assert [tuple(r) for r in df.orderBy("pos").collect()] == [("G", 5, None), ("G", 6, 0.5)]
    out = str(tmp_path / "o")
    files.write_results(df.withColumn("chrom", F.lit("c")), out)
    assert spark.read.parquet(out).where("guide = 'G' and chrom = 'c'").count() == 2
    one = files.curated(df.withColumn("total", F.lit(0)).withColumn("aligned_alt", F.lit(None).cast("string")).withColumn("aligned_ref", F.lit("R"))).first()
    assert (one["aligned_target"], one["perfect_match"], one["samples"]) == ("R", "Yes", "-")


def test_alias_and_lifted(spark, tmp_path):
    assert files.read_chrom_alias(spark, write(tmp_path, "a.txt", "# x\n1\tCM1\tchr1\n")).first()["ucsc"] == "chr1"
    assert files.read_lifted_bed(spark, write(tmp_path, "l.bed", "chr1\t4\t5\tid1\n")).first()["ref_start"] == 5
    assert files.read_unlifted(spark, write(tmp_path, "u.bed", "#Deleted\nchr1\t4\t5\tid2\n")).first()["off_target_id"] == "id2"


def test_store_is_pruned(spark, tmp_path):
    """A hot chromosome is dealt over several files of bounded size; a look-up reads its partition and pushes the positions down."""
    from strandlake.operators import lookup

    rows = spark.range(4000).select(F.when(F.col("id") % 8 == 0, "H").otherwise("G").alias("guide"), F.when(F.col("id") % 10 < 7, "1").otherwise("2").alias("chrom"), (F.col("id") * 7 % 4000).alias("pos"), F.col("id").cast("string").alias("id"))
    stored = files.write_results(rows, str(tmp_path / "store"), 500)
    assert stored.dtypes == rows.dtypes and stored.count() == 4000  # a chromosome named 1 stays text
    hot = spark.read.parquet(str(tmp_path / "store" / "guide=G" / "chrom=1"))
    sizes = hot.groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi")).orderBy("lo").collect()
    assert len(sizes) >= 5 and all(r["n"] <= 500 for r in sizes) and all(a["hi"] < b["lo"] for a, b in zip(sizes, sizes[1:]))
    found = lookup.by_position(stored, "G", "1", 100, 200)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(guide" in plan and "GreaterThanOrEqual(pos,100)" in plan and "LessThanOrEqual(pos,200)" in plan
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in lookup.by_position(rows, "G", "1", 100, 200).collect())
