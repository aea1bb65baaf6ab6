"""Hand cases of the off-target operators, and invariants."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import genotype as gt
from strandlake.functions import sequence as sq
from strandlake.operators import clean, cluster, genotypes, intervals, lookup, metrics, panel, quality, search, sets, summary
from strandlake.plans import jobs

HIT = "guide string, chrom string, pos long, strand string, mm int, bulge int, total int, score double, score_ref double, origin string, id string"


def hit(pos, score=0.5, origin="ref", id_=None, total=2, chrom="chr1", guide="G"):
    return (guide, chrom, pos, "+", total, 0, total, score, 0.1, origin, id_ or f"{pos}{origin}{score}")


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


def c(name):
    return F.col(name)


@pytest.mark.parametrize("a,b,n", [("ACGT", "ACGT", 0), ("ACGT", "acgA", 1), ("RCGT", "ACGT", 0), ("RCGT", "TCGT", 1), ("AC-T", "ACGA", 1), ("ACGT", "AC-T", 0), ("NNNN", "ACGT", 0)])
def test_mismatches_are_iupac_aware(spark, a, b, n):
    assert one(spark, sq.count_mismatches(c("a"), c("b")), a=a, b=b) == n


def test_sequence_functions(spark):
    assert one(spark, sq.reverse_complement(c("a")), a="ACGRn-") == "-nYCGT"
    assert one(spark, sq.mark_mismatches(c("a"), c("b")), a="ACGT", b="AGGT") == "AgGT"
    assert one(spark, sq.insert_gaps(c("a"), c("b")), a="ACGT", b="xx-xx") == "AC-GT"
    assert one(spark, sq.count_ref_mm(c("a")), a="AcgT-") == 2
    s = one(spark, sq.seed_split(c("a"), c("b"), False), a="aCGT-cGT", b="ACG-ACGT")
    assert (s["seed"], s["non_seed"]) == (2, 2)
    assert one(spark, sq.base_editor_flags(c("a"), 2, 4), a="ACGTT") == "CBE,GBE,TBE"
    assert one(spark, sq.base_editor_flags(c("a"), 1, 0), a="ACGTT") == ""
    assert one(spark, sq.pam_matches(c("a"), "NGG"), a="TGG") and not one(spark, sq.pam_matches(c("a"), "NGG"), a="TGA")
    assert one(spark, sq.pam_created(c("a"), c("b"), "NGG"), a="TGA", b="TGG") == "TGG"
    assert len(sq.expand_iupac("A")) == sum("A" in v for v in sq.IUPAC.values())
    k = one(spark, sq.parse_variant_key(c("a")), a="chr_un_1_55_A_GT")
    assert (k["chrom"], k["pos"], k["ref"], k["alt"]) == ("chr_un_1", 55, "A", "GT")
    assert one(spark, sq.parse_variant_key(c("a")), a="nonsense") is None
    assert one(spark, sq.kmer_counts(c("a"), 2), a="ACAC") == {"AC": 2, "CA": 1}
    assert [x["kmer"] for x in one(spark, sq.one_hot(c("a"), 2), a="ACG")] == ["AC", "CG"]
    assert [one(spark, sq.af_decade(c("a")), a=x) for x in (0.0, 0.5, 0.1)] == [1e-5, 1.0, 1.0]
    assert one(spark, sq.af_decade(c("a")), a=0.02) == pytest.approx(0.01)


@pytest.mark.parametrize("seed", range(6))
def test_alignment_features_equal_a_recount(spark, seed):
    r = random.Random(seed)
    guide = "".join(r.choice("ACGT-") if 0 < i < 19 else "A" for i in range(20)) + "TGG"
    dna = "".join(x if x != "-" and r.random() < 0.6 else r.choice("ACGT") for x in guide[:19]) + ("-" if guide[19] != "-" else "A") + "AGG"
    flank = "ACC" + dna.replace("-", "") + "GTA"
    f = one(spark, sq.crista_features(c("a"), c("b"), c("f")), a=guide, b=dna, f=flank)
    pairs = list(zip(guide, dna))[:-3]
    bad = [a != b and "-" not in (a, b) for a, b in pairs]
    runs = sum(pairs[i][0] != pairs[i][1] and pairs[i + 1][0] == pairs[i + 1][1] for i in range(len(pairs) - 1))
    assert (f["mm"], f["rna_bulges"], f["dna_bulges"], f["runs"]) == (sum(bad), guide.count("-"), dna.count("-"), runs)
    assert f["run_length"] == pytest.approx((sum(bad) + guide.count("-") + dna.count("-")) / runs if runs else 0)
    back = bad[::-1]
    assert [f[k] for k in ("mm_1_4", "mm_5_8", "mm_9_12", "mm_13_16", "mm_17_end")] == [*map(int, back[0:16:4]), sum(back[16:-3])]
    kind = lambda *kinds: sum(a + b in kinds for a, b in pairs)
    assert (f["wobble"], f["rr"], f["yy"], f["transversions"]) == (kind("GA", "TC"), kind("GC", "GT", "AC", "AT"), kind("CA", "CG", "TA", "TG"), kind("AG", "CT"))
    plain = dna.replace("-", "")
    number = lambda x: int(x.translate(str.maketrans("ACGT", "1234")))
    assert [f[f"n_{x}"] for x in "acgt"] == [plain.count(x) for x in "ACGT"]
    assert (f["pam_last"], f["pam_first"], f["first_base"]) == (number(plain[-2:]), number(plain[-3]), number(plain[0]))
    assert f["couples"] == [number(plain[len(plain) - 8 + i : len(plain) - 6 + i]) for i in range(4)] and f["seed_bases"] == [number(plain[i]) for i in range(-8, -3)]
    heat = lambda x: sum(sq.ENTHALPY[x[i : i + 2]] for i in range(len(x) - 1))
    assert f["enthalpy"] == pytest.approx(heat(plain)) and f["flank_enthalpy"] == pytest.approx(heat(flank))
    assert f["flank_gc"] == pytest.approx(sum(x in "GC" for x in flank) / len(flank)) and f["downstream"] == [3, 4, 1]


def test_features_are_counted_in_batches(spark):
    rows = [("ACGTACGTACGTACGTTGG", "ACGAACGTACGTACGTTGG"), ("AC", "A"), ("", ""), (None, "ACGT"), ("ACÉTACGTTGG", "ACÜTACGTTGGAA")]
    f = sq.crista_features(c("a"), c("b"))
    got = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id int, a string, b string").select("id", f["mm"].alias("mm"), f["runs"].alias("runs"), f["mm_13_16"].alias("q"), f["enthalpy"].alias("e"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "transform(" not in plan and "regexp_replace" not in plan
    assert [(r["mm"], r["runs"], r["q"]) for r in got.orderBy("id").collect()] == [(1, 1, 1), (0, 0, 0), (0, 0, 0), (None, None, 0), (1, 1, 0)]
    assert [r["e"] for r in got.orderBy("id").collect()][1:3] == [0.0, 0.0]


@pytest.mark.parametrize("pos,strand,want", [(105, "+", "5A>G"), (95, "+", "1A>G"), (105, "-", "16T>C"), (90, "-", "20T>C")])
def test_variant_in_spacer(spark, pos, strand, want):
    got = one(spark, sq.variant_in_spacer(c("p"), F.lit("A"), F.lit("G"), F.lit(100), c("s"), F.lit(20)), p=pos, s=strand)
    assert got == want


@pytest.mark.parametrize("g,n,want", [("0|1", 2, (1, 2, 1, 0, 1)), ("1|1", 2, (2, 2, 1, 1, 1)), ("1|.", 2, (1, 1, 1, 0, 1)), ("1|2", 2, (1, 2, 1, 0, 1)), (".", 2, (0, 0, 0, 0, 0)), ("1", 1, (1, 1, 1, 1, 1)), ("0|1", 1, (0, 1, 0, 0, 1)), ("1", 0, (0, 0, 0, 0, 0))])
def test_genotype_counts(spark, g, n, want):
    r = one(spark, gt.genotype_counts(c("g"), n), g=g)
    assert tuple(r[k] for k in ("ac", "an", "carrier", "hom", "called")) == want


@pytest.mark.parametrize("chrom,sex,n", [("chr1", "male", 2), ("chrX", "male", 1), ("X", "female", 2), ("chrY", "female", 0), ("chrY", "male", 1)])
def test_ploidy(spark, chrom, sex, n):
    assert one(spark, gt.ploidy(c("a"), c("b")), a=chrom, b=sex) == n


def test_lists(spark):
    assert one(spark, gt.min_maf(F.split("a", ",")), a="0.2,x,0.05") == 0.05
    assert one(spark, gt.first_known(F.split("a", ",")), a="NA,.,rs5,rs6") == "rs5"


def test_gap_chaining(spark):
    df = spark.createDataFrame([hit(p) for p in (1, 4, 7, 11, 11)], HIT)
    got = {r["pos"]: r["cluster"] for r in cluster.cluster_by_gap(df, ["guide", "chrom"], 3).collect()}
    assert got == {1: 0, 4: 0, 7: 0, 11: 1}


def test_variant_wins_only_if_strictly_better(spark):
    rows = [hit(1, 0.5, "ref"), hit(2, 0.5, "alt"), hit(50, 0.5, "ref"), hit(51, 0.6, "alt"), hit(90, 0.1, "alt")]
    for order in itertools.islice(itertools.permutations(rows), 0, 120, 37):
        df = cluster.cluster_by_gap(spark.createDataFrame(list(order), HIT), ["guide", "chrom"], 3)
        best = cluster.best_per_cluster(df, ["guide", "chrom", "cluster"]).where("best").collect()
        assert sorted((r["pos"], r["origin"], r["not_in_ref"], r["n_others"]) for r in best) == [(1, "ref", "n", 1), (51, "alt", "n", 1), (90, "alt", "y", 0)]


def test_panel_is_larger_than_cap_when_many_are_hard(spark):
    rows = [hit(i, 0.9, "ref", f"h{i}") for i in range(5)] + [hit(i + 10, 0.2, "ref", f"s{i}", 5) for i in range(5)] + [hit(99, 0.5, "ref", "p", 0)]
    df = spark.createDataFrame(rows, HIT)
    assert cluster.severity_panel(df, 3).count() == 6
    assert cluster.severity_panel(df, 7).count() == 8


def test_reference_wins_panel_cluster_and_only_label(spark):
    rows = [(*hit(1, 0.7, "alt", "b"), "B", 1), (*hit(2, 0.3, "ref", "r"), "REF", 1)]
    df = spark.createDataFrame(rows, HIT + ", panel string, cluster int")
    got = {r["id"]: (r["label"], r["best"]) for r in cluster.merge_panel_clusters(df, ["cluster"]).collect()}
    assert got == {"b": ("B_only", True), "r": ("REF", False)}


def test_partitions_sum_to_all(spark):
    df = spark.createDataFrame([hit(1, total=0), hit(2, origin="alt"), hit(3)], HIT)
    kinds = df.select(clean.partition_mask(F.col("total"), F.col("origin")).alias("k")).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in kinds} == {"on_target": 1, "variant": 1, "reference": 1}
    assert sum(r["n"] for r in summary.mmb_matrix(df, 3, 1).collect()) == 3


def test_clean_operators(spark):
    df = spark.createDataFrame([("ACGTGG",), ("ACGTGA",), ("GG",)], "dna string")
    assert [r["dna"] for r in clean.filter_pam(df, "NGG").collect()] == ["ACGTGG"]
    wide = spark.createDataFrame([(1, 2.0, 3.0)], "id int, score_CFD double, score_fewest double")
    assert clean.project_criterion(wide, "CFD").columns == ["id", "score"]
    with pytest.raises(ValueError):
        clean.filter_expr(wide, [("id", "drop", 1)])
    assert clean.standardize_columns(spark.createDataFrame([(1, 2, 3, 4, 5, 6)], "Chromosome int, Position int, strand int, CFD int, Reference int, x int")).columns == ["chrom", "pos", "strand", "reference", "x", "score"]
    b = spark.createDataFrame([(["a_COSMIC", "b", "a_COSMIC", "g_personal"],)], "l array<string>").select(clean.fill_annotation_buckets(F.col("l")).alias("b")).first()["b"]
    assert (b["cosmic"], b["encode"], b["personal"]) == (["a"], ["b"], ["g"])
    assert spark.createDataFrame([([0.0, None, 0.2],)], "a array<double>").select(clean.floor_zero_maf(F.col("a")).alias("a")).first()["a"] == [0.00001, None, 0.2]
    o = clean.with_origin(spark.createDataFrame([(None, "X", "Y"), (["s"], "X", "Y")], "samples array<string>, aligned_alt string, aligned_ref string")).collect()
    assert [(r["origin"], r["aligned_ref"], r["aligned_alt"]) for r in o] == [("ref", "X", None), ("alt", "Y", "X")]


def test_overlap_join_reports_each_pair_once(spark):
    a = spark.createDataFrame([("1", "c", 5), ("2", "c", 95), ("3", "d", 5)], "id string, chrom string, pos long")
    f = spark.createDataFrame([("c", 0, 300, "wide"), ("c", 26, 30, "edge"), ("c", 28, 40, "out")], "chrom string, start long, end long, label string")
    got = {r["id"]: r["labels"] for r in intervals.annotate_overlaps(a, f, 23, width=10).collect()}
    assert got == {"1": ["edge", "wide"], "2": ["wide"], "3": None}


def test_asof_claims(spark):
    schema = "id string, chrom string, strand string, pos long"
    a = spark.createDataFrame([("a1", "c", "+", 10), ("a2", "c", "+", 14), ("a3", "c", "-", 10), ("a4", "c", "+", 100)], schema)
    b = spark.createDataFrame([("b1", "c", "+", 13), ("b2", "c", "+", 104)], schema)
    got = sorted((r["id_a"] or "", r["id_b"] or "", r["origin"]) for r in intervals.asof_match(a, b, ["chrom", "strand"], "pos", 3).collect())
    assert got == [("", "b2", "b_only"), ("a1", "", "a_only"), ("a2", "b1", "both"), ("a3", "", "a_only"), ("a4", "", "a_only")]
    none = b.limit(0)
    assert {r["origin"] for r in intervals.asof_match(a, none, ["chrom", "strand"], "pos", 3).collect()} == {"a_only"}
    assert intervals.asof_match(a.limit(0), none, ["chrom", "strand"], "pos", 3).count() == 0


WIN = "window_id long, sample_id string, pos long, alt string, gt string, phase_set string"


def haplotypes(spark, rows, cap=10):
    out = genotypes.observed_haplotypes(spark.createDataFrame(rows, WIN), cap)
    return {(tuple(v["pos"] for v in r["variants"]), tuple(r["carriers"]), r["phase_state"]) for r in out.collect()}


def test_haplotypes(spark):
    cis = [(1, "s", 1, "G", "1|0", None), (1, "s", 2, "G", "1|0", None)]
    assert haplotypes(spark, cis) == {((1, 2), ("s",), "CONFIRMED")}
    trans = [(1, "s", 1, "G", "1|0", None), (1, "s", 2, "G", "0|1", None)]
    assert haplotypes(spark, trans) == {((1,), ("s",), "CONFIRMED"), ((2,), ("s",), "CONFIRMED")}
    unphased = [(1, "s", 1, "G", "0/1", None), (1, "s", 2, "G", "0/1", None)]
    assert {h[0] for h in haplotypes(spark, unphased)} == {(1,), (2,), (1, 2)}
    assert haplotypes(spark, unphased, 1) == {((1, 2), ("s",), "PUTATIVE")}
    two_sets = [(1, "s", 1, "G", "1|0", "a"), (1, "s", 2, "G", "1|0", "b")]
    assert {h[2] for h in haplotypes(spark, two_sets)} == {"PUTATIVE"}
    assert haplotypes(spark, [(1, "s", 1, "G", "1|1", "a")]) == {((1,), ("s",), "CONFIRMED")}
    apart = [(1, "s", 1, "G", "1|0", None), (1, "t", 2, "G", "1|0", None)]
    assert {h[0] for h in haplotypes(spark, apart)} == {(1,), (2,)}


def test_subsets_are_never_cut_short(spark):
    rows = [(1, "s", p, "G", "0/1", None) for p in range(genotypes.MOST_PUTATIVE + 1)]
    with pytest.raises(ValueError):
        haplotypes(spark, rows, genotypes.MOST_PUTATIVE + 1)
    with pytest.raises(Exception, match="unphased variants"):
        haplotypes(spark, rows, -1)
    assert len(haplotypes(spark, rows[:6], -1)) == 2**6 - 1


def test_lattice_agrees_on_phased_data(spark):
    singles = spark.createDataFrame([(1, 1, "G", ["s", "t"]), (1, 2, "G", ["s"])], "window_id long, pos long, alt string, carriers array<string>")
    got = {(tuple(v["pos"] for v in r["variants"]), tuple(r["carriers"])) for r in genotypes.combine_by_shared_samples(singles).collect()}
    assert got == {((1,), ("t",)), ((1, 2), ("s",))}


SAMPLE = "sample_id string, population string, superpopulation string, sex string, database string"
GT = "chrom string, pos long, ref string, alt string, sample_id string, gt string"


def test_panel_counts_equal_a_dense_recount(spark):
    people = [(f"s{i}", "p", "x" if i < 3 else "y", "male" if i % 2 else "female", "d") for i in range(5)] + [("s0", "p", "x", "female", "e")]
    samples = spark.createDataFrame(people, SAMPLE)
    rows = [("chrX", 1, "A", "G", "s1", "1"), ("chrX", 1, "A", "G", "s2", "0|1"), ("chr1", 5, "A", "G", "s0", "1|.")]
    g = spark.createDataFrame(rows, GT)
    listed = {(r[0], r[4]) for r in rows}
    dense = spark.createDataFrame(rows + [(ch, p, "A", "G", s, "0" if ch == "chrX" and sex == "male" else "0|0") for ch, p in (("chrX", 1), ("chr1", 5)) for s, sex in {(x[0], x[3]) for x in people} if (ch, s) not in listed], GT)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    a = genotypes.allele_counts_panel(g, samples)
    assert key(a) == key(genotypes.allele_counts(dense, samples).select(*a.columns))
    glob = {r["chrom"]: r for r in a.where("group_kind = 'global'").collect()}
    assert (glob["chr1"]["an"], glob["chr1"]["ac"], glob["chrX"]["an"]) == (9, 1, 8)


def test_combination_bounds(spark):
    samples = spark.createDataFrame([(f"s{i}", "p", "x", "female", "d") for i in range(4)], SAMPLE)
    g = spark.createDataFrame([("c", p, "A", "G", f"s{i}", "0/1") for p in (1, 2) for i in range(3)], GT)
    hits = spark.createDataFrame([("h", [("c", 1, "A", "G"), ("c", 2, "A", "G")])], "id string, variants array<struct<chrom:string,pos:long,ref:string,alt:string>>")
    r = genotypes.combination_summary(hits, g, samples).where("group_kind = 'global'").first()
    assert (r["n_carrier"], r["ac"], r["n_carrier_low"]) == (3, None, 2)
    assert genotypes.population_companion(hits, g, samples).first()["groups"]["global"] == "3|NA|0"
    assert genotypes.haplotype_frequency(hits, g, samples).first()["haplotype_freq"] is None


def test_packed_combinations_equal_people_one_by_one(spark):
    rng = random.Random(5)
    people = [(f"s{i:03}", "p", rng.choice(["x", "y", None]), rng.choice(["male", "female"]), "d") for i in range(150)]
    people += [(s, p, "z", sex, "e") for s, p, _, sex, _ in people[::3]]
    samples = spark.createDataFrame(people + people[:2], SAMPLE)
    sex = {p[0]: p[3] for p in people}
    places = [(ch, p, "A", "G") for ch in ("chr1", "chrX", "chrY") for p in range(4)]
    call = {"chr1": ["0|1", "1|0", "1|1", "1|1", "1"], "chrX": ["1", "1|1", "0|1", "1|0"], "chrY": ["1", "0|1"]}
    rows = [(*v, s, rng.choice(["0/1", "1/1"]) if rng.random() < 0.02 and v[1] != 3 else rng.choice(call[v[0]])) for v in places for s in sorted(sex) if rng.random() < 0.8]
    g = spark.createDataFrame(rows, GT)
    sets = {f"{ch}:{a}": [v for v in places if v[0] == ch and a <= v[1] <= b] for ch in call for a, b in ((0, 2), (1, 2), (3, 3))} | {"chr1:none": [places[0], ("chr1", 99, "A", "G")]}
    hits = spark.createDataFrame([(i, v + v[:1]) for i, v in sets.items()], "id string, variants array<struct<chrom:string,pos:long,ref:string,alt:string>>")
    have = {(r[:4], r[4]): r[5] for r in rows}
    want, freq = set(), {}
    for i, vs in sets.items():
        each = {}
        for s in sex:
            p = 2 if vs[0][0] == "chr1" else 1 if sex[s] == "male" else 2 if vs[0][0] == "chrX" else 0
            slots = [re.split(r"[|/]", have.get((v, s), "0"))[:p] for v in vs]
            if all("1" in x for x in slots):
                each[s] = (len(vs) == 1 or not any("/" in have[v, s] for v in vs), sum(all(len(x) > h and x[h] == "1" for x in slots) for h in range(2)), p)
        total = sum((2 if vs[0][0] == "chr1" else 1 if x == "male" else 2 if vs[0][0] == "chrX" else 0) for x in sex.values())
        if each:
            freq[i] = round(sum(h for _, h, _ in each.values()) / total, 6) if all(f for f, _, _ in each.values()) else None
        groups = {("global", None, None): set(sex)}
        for s, _, sub, _, db in people:
            groups.setdefault(("db", db, None), set()).add(s)
            groups.setdefault(("db_subpop", db, sub), set()).add(s)
        for name, members in groups.items():
            own = [each[s] for s in members if s in each and (not each[s][0] or each[s][1])]
            if own:
                phased = all(f for f, _, _ in own)
                held = sum("1" in re.split(r"[|/]", have.get((v, s), "")) for v in vs for s in members)
                low = len(own) if phased else min(len(own), max(0, held - (len(vs) - 1) * len(members)))
                want.add((i, len(vs), *name, len(own), sum(h for _, h, _ in own) if phased else None, sum(f and h == p for f, h, p in own), phased, low))
    assert {r[0] for r in want if r[6] is None} and {r[0] for r in want if r[6] is not None}
    assert {tuple(r) for r in genotypes.combination_summary(hits, g, samples).collect()} == want
    assert {r["id"]: r["haplotype_freq"] for r in genotypes.haplotype_frequency(hits, g, samples).collect()} == freq
    packed = genotypes.packed_genotypes(g, samples)
    assert packed.count() < g.count() / 4


def test_haplotype_frequency_counts_ploidies(spark):
    samples = spark.createDataFrame([(f"s{i}", "p", "x", "male" if i < 3 else "female", "d") for i in range(5)], SAMPLE)
    g = spark.createDataFrame([("chrX", 1, "A", "G", "s0", "1"), ("chrX", 1, "A", "G", "s3", "1|1"), ("chr2", 1, "A", "G", "s0", "0|1"), ("chrY", 1, "A", "G", "s1", "1")], GT)
    hits = spark.createDataFrame([(ch, [(ch, 1, "A", "G")]) for ch in ("chrX", "chr2", "chrY")], "id string, variants array<struct<chrom:string,pos:long,ref:string,alt:string>>")
    got = {r["id"]: r["haplotype_freq"] for r in genotypes.haplotype_frequency(hits, g, samples).collect()}
    assert got == {"chrX": round(3 / 7, 6), "chr2": 0.1, "chrY": round(1 / 3, 6)}


def test_panel_operators(spark):
    m = spark.createDataFrame([("c", 1, "A", ["G", "T"], "s", "1|2")], "chrom string, pos long, ref string, alts array<string>, sample_id string, gt string")
    assert {r["alt"]: r["gt"] for r in panel.split_multiallelic(m).collect()} == {"G": "1|0", "T": "0|1"}
    base = spark.createDataFrame([("c", 1, "A", "G", "global", None, None, 1, 10, 1, 0, 5)], "chrom string, pos long, ref string, alt string, group_kind string, db string, subpop string, ac long, an long, n_carrier long, n_hom long, n_called long")
    delta = panel.derive_an_deltas(base, base.withColumn("an", F.lit(8).cast("long")))
    assert delta.first()["ok"] and delta.first()["d_an"] == -2
    assert panel.apply_an_deltas(base, delta).first()["an"] == 8
    assert panel.registries_equal(base, base).count() == 0


def genome(spark, seq, tile=50, overlap=30):
    return spark.createDataFrame([("c", at, seq[at : at + tile + overlap]) for at in range(0, len(seq), tile)], "chrom string, start long, seq string")


SEQ = "TTTTACGTACGATCGATTACGGATTTNNNNACGTACGATCCATTACGGAACCGTAATCGATCGTACGTTTTACGTACGATGGATTACGGTTTTTTTTTTTTTTTT"


def brute(seq, guide, mm):
    comp = str.maketrans("ACGT", "TGCA")
    for i in range(len(seq) - len(guide) - 2):
        w = seq[i : i + len(guide) + 3]
        if "N" in w:
            continue
        for strand, s in (("+", w), ("-", w.translate(comp)[::-1])):
            k = sum(a != b for a, b in zip(guide, s))
            if s[-2:] == "GG" and k <= mm:
                yield i, strand, k


@pytest.mark.parametrize("mm", [0, 1, 3])
def test_search_equals_brute_force(spark, mm):
    guide = "ACGTACGATCGATTA"
    g = spark.createDataFrame([(guide,)], "spacer string")
    got = search.search_ungapped(genome(spark, SEQ), g, 50, "NGG", len(guide), mm)
    assert sorted((r["pos"], r["strand"], r["mm"]) for r in got.collect()) == sorted(brute(SEQ, guide, mm))


def test_gapped_search_equals_exhaustive_alignment(spark):
    guide, comp = "ACGTACGATCGA", str.maketrans("ACGT", "TGCA")
    seq = "TTTT" + "ACGTACGATCGATGG" + "CCCC" + "ACGTACATCGATGG" + "TTTT" + "ACGTTACGATCGATGG" + "AAAA" + "ACGTACGATCCATGG" + "T" * 10
    want = set()
    for size in (11, 12, 13):
        for i in range(len(seq) - size - 2):
            w = seq[i : i + size + 3]
            for strand, s in (("+", w), ("-", w.translate(comp)[::-1])):
                if s[-2:] == "GG":
                    want |= {(i, strand, *x) for x in search.alignments(guide, s[:-3], 1, 1, 1, 2)}
    g = spark.createDataFrame([(guide,)], "spacer string")
    got = search.search_gapped(genome(spark, seq, 40, 20), g, 40, "NGG", 12, 1, 1, 1, 2)
    rows = [(r["pos"], r["strand"], r["crrna"], r["dna"], r["mm"], r["bulge_dna"], r["bulge_rna"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 3


def test_least_mismatches_equal_the_alignments():
    r = random.Random(4)
    sets = lambda s: np.array([[1 << "ACGT".index(x) for x in s]], np.uint8)
    for _ in range(60):
        guide = "".join(r.choice("ACGT") for _ in range(7))
        site = list(guide)
        for _ in range(r.randrange(3)):
            at = r.randrange(len(site))
            site[at : at + 1] = r.choice([[], ["A"], [site[at], "C"]])
        site = "".join(site)
        got = search.least_mismatches(sets(guide), sets(site), 2, 1)[0]
        want = np.full((3, 2), 99)
        for _, _, k, d, b in search.alignments(guide, site, 99, 2, 1):
            want[d, b] = min(want[d, b], k)
        # Gaps at the guide's end are alignments of the program only where the guide ends there in both.
        assert (got <= want).all() and ((got == want) | (want == 99)).all()


def test_many_guides_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "GUIDES", 2)
    guides = ["ACGTACGATCGATTA", "ACGTACGATCCATTA", "TTACGATCGATCGTA", "CCCCCCCCCCCCCCC", "NCGTACGATCGATTR"]
    got = search.search_ungapped(genome(spark, SEQ), spark.createDataFrame([(g,) for g in guides], "spacer string"), 50, "NGG", 15, 2)
    want = sorted((g, *x) for g in guides[:4] for x in brute(SEQ, g, 2))
    assert sorted((r["guide"], r["pos"], r["strand"], r["mm"]) for r in got.where("guide not like 'N%'").collect()) == want
    assert (0, "+") in {(r["mm"], r["strand"]) for r in got.where("guide like 'N%'").collect()}


def test_ranks_and_clusters_across_bins(spark):
    r = random.Random(6)
    data = [hit(r.randrange(400), r.choice([None, 0.1, 0.2, 0.2, 0.9]), id_=str(i), total=r.randrange(3), guide=r.choice("GH")) for i in range(300)]
    df = spark.createDataFrame(data, HIT)
    for guide in "GH":
        own = sorted((x for x in data if x[0] == guide), key=lambda x: (x[7] is None, -(x[7] or 0), x[6], x[2], x[3], x[10]))
        got = {x["id"]: x["place"] for x in cluster.ranked(df, ["guide"], [("score", True), ("total", False)], "place", width=16).where(F.col("guide") == guide).collect()}
        assert got == {x[10]: i for i, x in enumerate(own, 1)}
    wide, narrow = ({x["id"]: x["cluster"] for x in cluster.cluster_by_gap(df, ["guide", "chrom"], 3, width=w).collect()} for w in (1 << 20, 8))
    assert wide == narrow and len(set(wide.values())) > 10 and min(wide.values()) == 0
    known = [x for x in data if x[7] is not None and x[0] == "G"]
    got = {x["id"]: x["rank"] for x in cluster.value_ranks(df, ["guide"], "score", "rank").where("guide = 'G' and score is not null").collect()}
    below = {x[10]: sum(y[7] < x[7] for y in known) for x in known}
    nulls = sum(x[7] is None for x in data if x[0] == "G")
    assert got == {x[10]: nulls + below[x[10]] + (sum(y[7] == x[7] for y in known) + 1) / 2 for x in known}


def test_genes_of_nearest_features(spark):
    hits = spark.createDataFrame([(1, "c", 10), (2, "c", 100), (3, "d", 5)], "id long, chrom string, pos long")
    features = spark.createDataFrame([("c", 5, 20, "gene_id=G1;gene_name=ABC"), ("c", 1100, 1200, "x; gene_id=G2")], "chrom string, start long, end long, label string")
    got = {r["id"]: (r["gene_id"], r["gene_name"], r["distance_kb"], r["region"]) for r in intervals.gene_distance(intervals.nearest_feature(hits, features)).collect()}
    assert got == {1: ("G1", "ABC", 0.0, None), 2: ("G1", "ABC", -0.081, "intergenic"), 3: (None, None, None, None)}


def test_nearest_features_are_ordered_in_a_stated_number_of_parts(spark):
    hits = spark.range(400).select("id", F.concat(F.lit("c"), F.col("id") % 5).alias("chrom"), (F.col("id") * 700).alias("pos"))
    features = spark.range(50).select(F.concat(F.lit("c"), F.col("id") % 5).alias("chrom"), (F.col("id") * 5000).alias("start"), (F.col("id") * 5000 + 10).alias("end"), F.lit("x").alias("label"))
    near = intervals.nearest_feature(hits, features, width=10_000)
    assert near.count() == 400
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan


def test_registered_gapped_search_takes_every_guide(spark):
    from strandlake.plans.queries import g3_search_gapped

    letters, comp = str.maketrans("ACGT", "abcd"), str.maketrans("ACGT", "TGCA")
    guides = {3: "ACGTACGATCGATTACCTGA", 10: "TTGACCATGCATCAGTACCA", 57: "CATCATGTTACGACTTGCAC", 199: "GGATTACATACCTGTCAATC"}
    texts = {i: "TTTT" + g + "TGG" + "CAT" + g[:9] + g[10:] + "AGG" + "TTA" for i, g in guides.items()}
    bench = spark.createDataFrame([(i, g.translate(letters)) for i, g in guides.items()], "item_id long, text string")
    seqs = spark.createDataFrame([(i, t.translate(letters)) for i, t in texts.items()], "doc_id long, text string")
    want = set()
    for doc, seq in texts.items():
        for size in (19, 20, 21):
            for i in range(len(seq) - size - 2):
                w = seq[i : i + size + 3]
                for strand, s in (("+", w), ("-", w.translate(comp)[::-1])):
                    if s[-2:] == "GG":
                        want |= {(g, str(doc), i, strand, *x) for g in guides.values() for x in search.alignments(g, s[:-3], 4, 1, 1, 4)}
    got = [(r["guide"], r["chrom"], r["pos"], r["strand"], r["crrna"], r["dna"], r["mm"], r["bulge_dna"], r["bulge_rna"]) for r in g3_search_gapped(seqs, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {x[0] for x in got} == set(guides.values())


def test_haplotypes_put_into_windows(spark):
    w = spark.createDataFrame([(1, 10, "ACGTTGG", [(11, "T"), (13, "A")])], "window_id long, pos long, seq string, variants array<struct<pos:long,alt:string>>")
    r = search.apply_haplotype(w, "ATGATGG", 0, "NGG").first()
    assert (r["hap_seq"], r["mm"]) == ("ATGATGG", 0)
    assert search.reference_rows(w, "ATGATGG", 1).count() == 0


def test_indel_contigs(spark):
    v = spark.createDataFrame([("c", 5, "A", "AGG"), ("c", 7, "C", "T")], "chrom string, pos long, ref string, alt string")
    tiles = spark.createDataFrame([("c", 0, "TTTTTACCCCCCCC")], "chrom string, start long, seq string")
    r = search.indel_windows(v, tiles, 3, 50).collect()
    assert [(x["contig_start"], x["seq"]) for x in r] == [(2, "TTTAGGCCC")]


def test_cfd_score(spark):
    w = spark.createDataFrame([("A", "G", 2, 0.5), ("C", "A", 3, 0.5)], "rna string, dna string, pos int, w double")
    p = spark.createDataFrame([("GG", 1.0)], "pam string, w double")
    g = "A" * 20
    rows = [("same", g, g, "GG"), ("one", g, "ACAAAAAAAAAAAAAAAAAA", "GG"), ("pam", g, g, "TT"), ("short", "ACGT", "ACGT", "GG"), ("bad", g, "N" + g[1:], "GG")]
    got = {r["id"]: r["score"] for r in search.cfd_score(spark.createDataFrame(rows, "id string, crrna string, dna string, pam2 string"), w, p).collect()}
    assert got == {"same": 1.0, "one": 0.5, "pam": 0.0, "short": None, "bad": 0.0}


def test_cfd_score_of_bulges_and_pam_side(spark):
    w = spark.createDataFrame([("A", "G", 1, 0.5), ("-", "G", 4, 0.25), ("A", "-", 2, 0.125)], "rna string, dna string, pos int, w double")
    p = spark.createDataFrame([("GG", 1.0)], "pam string, w double")
    g = "A" * 20
    rows = [("dna", "AAAA-" + g[4:], "C" + "CAAC" + g[4:], "GG", "DNA", 1), ("rna", g, "C-" + g[2:], "GG", "RNA", 1), ("plain", g, "C" + g[1:], "GG", "X", 0)]
    table = spark.createDataFrame(rows, "id string, crrna string, dna string, pam2 string, bulge_type string, bulge int")
    # Of the DNA bulge the first letters go: the mismatch then stands at place 1, the gap at place 4.
    assert {r["id"]: r["score"] for r in search.cfd_score(table, w, p, 5).collect()} == {"dna": 0.125, "rna": 0.0625, "plain": 0.5}
    assert {r["score"] for r in search.cfd_score(table, w, p, five_prime=True).collect()} == {None}


def test_labels_that_count(spark):
    rows = [("G", 1, ["dELS;CTCF-bound", "pELS;CTCF-bound", "exon_gencode", "mine_personal", "other"]), ("G", 0, None), ("H", 3, ["mine_personal", "exon_gencode", "exon_gencode"])]
    got = summary.cumulative_annotation_counts(spark.createDataFrame(rows, "guide string, total int, labels array<string>"), 3).where("n > 0").collect()
    assert sorted((r["guide"], r["label"], r["threshold"], r["n"]) for r in got) == sorted([("G", "General", 0, 1), *[("G", "General", t, 2) for t in (1, 2, 3)], *[("G", c, t, n) for c, n in (("CTCF-only", 2), ("dELS", 1), ("pELS", 1), ("exon", 1)) for t in (1, 2, 3)], ("H", "General", 3, 1), ("H", "exon", 3, 1)])


def test_extract_region(spark):
    tiles = genome(spark, SEQ, 20, 10)
    regions = spark.createDataFrame([(1, "c", 15, 47), (2, "c", 0, 3)], "region_id long, chrom string, start long, end long")
    assert {r["region_id"]: r["sequence"] for r in intervals.extract_region(tiles, regions, 20).collect()} == {1: SEQ[15:47], 2: SEQ[:3]}


def test_only_spread_regions_are_gathered(spark):
    seq, n = "".join(random.Random(3).choice("ACGT") for _ in range(5 * intervals.PIECE + 100)), intervals.PIECE
    tiles = spark.createDataFrame([("c", 0, seq[: 3 * n + 57]), ("c", 3 * n, seq[3 * n :])], "chrom string, start long, seq string")
    spans = [(0, 30), (n - 40, n), (n - 1, n + 1), (n, n + 40), (10, 5 * n + 90), (3 * n - 5, 3 * n + 5), (len(seq) - 7, len(seq) + 20), (len(seq), len(seq) + 5), (50, 50)]
    got = intervals.extract_region(tiles, spark.createDataFrame([(i, "c", a, b) for i, (a, b) in enumerate(spans)], "region_id long, chrom string, start long, end long"), 3 * n)
    assert {r["region_id"]: r["sequence"] for r in got.collect()} == {i: seq[a:b] for i, (a, b) in enumerate(spans) if a < len(seq)}
    plan = got._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and "Aggregate" not in plan.children().apply(0).toString()


def test_metrics(spark):
    rel = [0, 1, 1, 0, 0, 1]
    df = spark.createDataFrame([("q", i + 1, x) for i, x in enumerate(rel)] + [("z", 1, 0)], "query string, rank int, rel int")
    # (1/2 + 2/3 + 3/6) / 3, and (1/2 + 0) / 2.
    assert {r["query"]: r["ap"] for r in metrics.average_precision(df).collect()} == {"q": 0.555556, "z": 0.0}
    assert metrics.mean_reciprocal_rank(df).first()["mrr"] == 0.25
    graded = spark.createDataFrame([("q", i + 1, x) for i, x in enumerate([1, 0, 2, 3])], "query string, rank int, rel int")
    # 1 + 0 + 2 / log2(3) + 3 / 2, and 1 + 0 + 2 / log2(4).
    assert metrics.dcg_at_k(graded, 10).first()["dcg"] == 3.76186
    assert metrics.dcg_at_k(graded, 3, 1).first()["dcg"] == 2.0


def test_quality_checks(spark):
    g = spark.createDataFrame([("ACGTNNN", "", "NGG"), ("AC", "", "NGG"), ("AC!TACG", "", "NGG")], "guide string, spacer string, pam string")
    assert {r["check"] for r in quality.check_guides(g).collect()} == {"shorter_than_motif", "guide_letters", "several_lengths"}
    bed = spark.createDataFrame([("chr1\t5\t9\tx",), ("chr1\t9\t5\tx",), ("chr1\t1",), ("chr1\t1\t2\ta b",)], "value string")
    assert {r["check"]: r["n"] for r in quality.check_features(bed).collect()} == {"coordinates": 1, "columns": 1, "label": 1}
    assert quality.check_features(bed.limit(0)).first()["check"] == "no_data"
    assert quality.check_rate(bed.limit(0), F.lit(False)).first()["passed"]
    with pytest.raises(ValueError):
        quality.require_rate(bed, F.lit(False))
    mixed = spark.createDataFrame([("c", "0|1"), ("c", "0/1")], "chrom string, gt string")
    assert quality.check_phasing(mixed).first()["check"] == "mixed_phasing"


def test_sets_and_lookup(spark):
    a = spark.createDataFrame([hit(1), hit(2)], HIT)
    r = sets.compare_sites(a, a).first()
    assert r["passed"] and r["common"] == 2
    assert lookup.page(a, "G", "pos", ascending=True, lo=2).count() == 1
    assert unmatched(a) == (2, 1, ["2"])


def unmatched(a):
    r = intervals.unmatched_examples(a.withColumn("k", F.col("pos").cast("string")), F.col("pos") == 1, "k").first()
    return r["rows"], r["unmatched"], r["examples"]


def test_reconcile_counts(spark):
    rows = lambda *p: spark.createDataFrame([(f"i{x}", "c", "+", x, 0.5) for x in p], "id string, chrom string, strand string, pos long, score double")
    m = jobs.reconcile(rows(1, 50), rows(2, 90), 3)
    got = {r["origin"]: r["n"] for r in jobs.reconcile_summary(m, {"a": rows(7)}).collect()}
    assert got == {"both": 1, "a_only": 1, "b_only": 1, "a_unmapped": 1}


@pytest.mark.parametrize("gap", [0, 3])
def test_reconcile_shuffles_sites_once(spark, gap):
    """Equal to collapsing and matching each side by itself, also across bins, at equal places and claimed from both sides, in one shuffle of the sites."""
    r = random.Random(gap)
    data = [(f"{k}{i}", r.choice("cd"), r.choice("+-"), r.choice([0, 1 << 18, 5 << 18, 1 << 20]) + r.randrange(-400, 400), r.choice([None, 0.25, 0.5, r.random()])) for k in "ab" for i in range(700)]
    data += [(f"{k}n", "c", "+", None, 0.5) for k in "ab"] + [(f"{k}x", None, "+", 5, 0.5) for k in "a"]
    data += [(f"{k}{p}", "e", "+", p, 0.5) for k, ps in (("a", (10, 14, 30, 50, 53)), ("b", (12, 31, 33, 50, 90))) for p in ps]
    sites = "id string, chrom string, strand string, pos long, score double"
    a, b = (spark.createDataFrame([x for x in data if x[0][0] == k], sites) for k in "ab")
    keys, columns = ["chrom", "strand"], ["chrom", "strand", "id_a", "on_a", "id_b", "on_b", "origin"]
    alone = [cluster.collapse_clusters(d, keys, gap, ties=("pos", "id")) for d in (a, b)]
    want = intervals.asof_match(*alone, keys, "pos", gap).select(columns).collect()
    matched = jobs.reconcile(a, b, gap)
    got = matched.select(columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and {x["origin"] for x in got} == {"both", "a_only", "b_only"}
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("piece", [1 << 16, 7])
def test_ranks_of_unique_values_are_summed_in_pieces(spark, piece):
    """Nearly every value is unique, one guide has most rows: places, average ranks and severities equal a plain sort."""
    r = random.Random(8)
    data = [hit(r.randrange(4000), r.choice([None, 0.25, *[r.random()] * 8]), id_=str(i), total=r.randrange(4), guide="G" if i % 4 else "H") for i in range(600)]
    df = spark.createDataFrame(data, HIT)
    assert (len(cluster.bounds(df, ["score"], piece)["score"]) > 60) == (piece == 7)
    for guide in "GH":
        own = sorted((x for x in data if x[0] == guide), key=lambda x: (x[7] is None, -(x[7] or 0), x[6], x[2], x[3], x[10]))
        got = cluster.ranked(df, ["guide"], [("score", True), ("total", False)], "place", width=512, piece=piece).where(F.col("guide") == guide).collect()
        assert {x["id"]: x["place"] for x in got} == {x[10]: i for i, x in enumerate(own, 1)}
        ranks = {x["id"]: x["rank"] for x in cluster.value_ranks(df, ["guide"], "score", "rank", piece=piece).where(F.col("guide") == guide).collect()}
        low = lambda x: -1.0 if x is None else x
        assert ranks == {x[10]: sum(low(y[7]) < low(x[7]) for y in own) + (sum(y[7] == x[7] for y in own) + 1) / 2 for x in own}
    off = [x for x in data if x[6] != 0]
    severity = {x[10]: min(1 + sum((y[7] or -1) > (x[7] or -1) for y in off), 1 + sum(y[6] < x[6] for y in off)) for x in off}
    panel_ = cluster.severity_panel(df, 10_000, piece=piece).where("total != 0").collect()
    assert {x["id"]: x["severity"] for x in panel_} == severity


def test_no_window_spans_a_key_of_unique_values(spark):
    df = spark.createDataFrame([hit(i, i / 1000, id_=str(i)) for i in range(200)], HIT)
    plan = cluster.value_ranks(df, ["guide"], "score", "rank", piece=10)._jdf.queryExecution().optimizedPlan().toString()
    sums = [x for x in plan.splitlines() if "Window" in x]
    assert len(sums) == 2 and all("_piece" in x for x in sums)


@pytest.mark.parametrize("layers", [1, 2, 3])
def test_peeled_sets_equal_the_definition(spark, layers):
    r = random.Random(layers)
    singles = [(w, p, a, sorted(r.sample("abcde", r.randint(1, 4)))) for w in (1, 2) for p in range(4) for a in r.sample("ACGT", r.randint(0, 2))]
    schema = "window_id int, pos long, alt string, carriers array<string>"
    whole, peeled = ({(x["window_id"], tuple(tuple(v) for v in x["variants"])): set(x["carriers"]) for x in genotypes.combine_by_shared_samples(spark.createDataFrame(singles, schema), layers, peel).collect()} for peel in (False, True))
    want = {k: c - {s for (w, v), d in whole.items() if w == k[0] and set(v) > set(k[1]) for s in d} for k, c in whole.items()}
    assert peeled == {k: c for k, c in want.items() if c}


def test_score_ranks_take_heads_only(spark):
    """Ranks beyond ``clip`` are never worked out: no join with ranks of all rows; the same rows as whole rankings give."""
    rows = [("g" if i % 3 else "h", i * 7 % 50, "+", str(i), float(i * 37 % 11) if i % 10 else None, float(i * 53 % 13)) for i in range(120)]
    df = spark.createDataFrame(rows, "guide string, pos long, strand string, id string, score double, score_ref double")
    whole = {k: {x[3]: n for g in "gh" for n, x in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[k] is None, -(r[k] or 0), r[1], r[2], r[3])), 1)} for k in (4, 5)}
    want = sorted((r[3], min(7, whole[4][r[3]]), min(7, whole[5][r[3]])) for r in rows if whole[4][r[3]] <= 7 or whole[5][r[3]] <= 7)
    got = cluster.score_ranks(df, "score_ref", 7)
    assert sorted(tuple(x) for x in got.select("id", "rank_score", "rank_second").collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "WindowGroupLimit" in plan


def test_allele_counts_are_made_where_records_lie(spark):
    g = spark.createDataFrame([("chr1", i, "A", "G", f"s{k}", "0|1") for i in range(40) for k in range(4)], "chrom string, pos long, ref string, alt string, sample_id string, gt string")
    samples = spark.createDataFrame([(f"s{k}", "p", f"x{k % 2}", "female", f"d{k % 3}") for k in range(4)], SAMPLE)
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        for make in (genotypes.allele_counts, genotypes.allele_counts_panel):
            out = make(g, samples)
            assert out.rdd.getNumPartitions() == 5  # not joined into one by their size
            assert out.where("group_kind = 'global'").select("ac", "an", "n_carrier").distinct().collect() == [(4, 8, 4)]
            assert out.count() == 40 * 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)


def test_a_cluster_belongs_to_the_bin_where_it_starts(spark):
    places = [0, 3, 6, 9, 12, 15, 30, 33, 40, 41, 44, 60, 63]  # with bins of 8, the first cluster reaches into a bin without a start
    df = spark.createDataFrame([("g", c, p) for c in ("a", None) for p in places], "guide string, chrom string, pos long")
    rows = lambda w: {(r["chrom"], r["pos"]): (r["cluster"], r["home"]) for r in cluster.cluster_by_gap(df, ["guide", "chrom"], 3, width=w, home="home").collect()}
    narrow, wide = rows(8), rows(1 << 20)
    want, n = {}, -1
    for k, p in enumerate(places):
        if not k or p - places[k - 1] > 3:
            n, first = n + 1, p
        want[p] = (n, first // 8)
    assert all(narrow[c, p] == want[p] and wide[c, p] == (want[p][0], 0) for c in ("a", None) for p in places) and len(narrow) == 2 * len(places)


def test_labels_of_one_length_need_no_second_join(spark):
    hits = spark.createDataFrame([(f"h{i}", "c" if i % 5 else None, i * 7) for i in range(40)], "id string, chrom string, pos long")
    f = spark.createDataFrame([("c", 20, 41, "x"), ("c", 20, 41, "x"), ("c", 63, 64, "y"), ("c", 0, 200, "z"), ("c", 230, 235, None)], "chrom string, start long, end long, label string")
    one, each = (intervals.annotate_overlaps(hits, f, n, width=10) for n in (23, F.lit(23)))
    assert one.columns == each.columns and sorted(map(str, one.collect())) == sorted(map(str, each.collect()))
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_severity_ranks_are_broadcast_or_shuffled(spark, monkeypatch):
    r = random.Random(3)
    df = spark.createDataFrame([(f"i{k}", k, "+", r.randint(0, 9), r.choice([None, 0.1, 0.4, 0.9])) for k in range(300)], "id string, pos long, strand string, total long, score double")
    few = sorted(map(str, cluster.severity_panel(df, 80).collect()))
    monkeypatch.setattr(cluster, "VALUES", 0)
    assert few == sorted(map(str, cluster.severity_panel(df, 80).collect())) and len(few) >= 80
