"""Column functions over nucleotide strings. All are lazy Spark expressions; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import alignments

# The IUPAC codes and the bases that each stands for, and their complements.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
COMPLEMENT_FROM = "ACGTRYSWKMBDHVNacgtryswkmbdhvn"
COMPLEMENT_TO = "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"
#: The code whose base set has the bits of its place here (A = 1, C = 2, G = 4, T = 8).
BY_MASK = "".join(next(k for k, v in IUPAC.items() if sum(1 << "ACGT".index(b) for b in v) == m) for m in range(1, 16))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO))


def base_mask(letter: Column) -> Column:
    """The base set of a code as 4 bits; 0 for anything else."""
    return F.when(letter == "", 0).otherwise(F.position(F.upper(letter), F.lit(BY_MASK)))


def iupac_match(a: Column, b: Column) -> Column:
    """Whether the base sets of two codes intersect, in any case."""
    return base_mask(a).bitwiseAND(base_mask(b)) != 0


def letters(seq: Column) -> Column:
    """The characters of a string as an array; empty for the empty string."""
    return F.filter(F.split(seq, ""), lambda x: x != "")


def _mismatch(a: Column, b: Column) -> Column:
    return (a != "-") & (b != "-") & ~iupac_match(a, b)


def count_mismatches(guide: Column, dna: Column) -> Column:
    """Positions at which two aligned strings differ: IUPAC-aware, in any case, gaps skipped."""
    pairs = F.zip_with(letters(guide), letters(dna), lambda a, b: F.coalesce(_mismatch(a, b), F.lit(False)))
    return F.size(F.filter(pairs, lambda x: x))


def mark_mismatches(guide: Column, dna: Column) -> Column:
    """``dna`` with its mismatching bases in lower case."""
    return F.array_join(F.zip_with(letters(guide), letters(dna), lambda a, b: F.when(_mismatch(a, b), F.lower(b)).otherwise(b)), "")


def count_ref_mm(aligned: Column) -> Column:
    return F.length(F.regexp_replace(aligned, "[^a-z]", ""))


def count_gaps(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[^-]", ""))


def insert_gaps(seq: Column, template: Column) -> Column:
    """``seq`` with a gap wherever ``template`` has one."""
    start = F.named_struct(F.lit("out"), F.lit(""), F.lit("at"), F.lit(1))

    def step(acc, x):
        return F.named_struct(F.lit("out"), F.concat(acc["out"], F.when(x == "-", "-").otherwise(F.substring(seq, acc["at"], F.lit(1)))), F.lit("at"), acc["at"] + F.when(x == "-", 0).otherwise(1))

    return F.aggregate(letters(template), start, step, lambda acc: acc["out"])


def pam_of(alt: Column, ref: Column, origin: Column, n: int, five_prime: bool) -> Column:
    """The PAM part of the aligned sequence: that of ALT on variant rows, else of REF."""
    seq = F.when(origin == "alt", alt).otherwise(ref)
    return F.substring(seq, 1, n) if five_prime else F.right(seq, F.lit(n))


def pam_regex(motif: str, lower: bool = False) -> str:
    """A pattern of the strings whose every code shares a base with the motif's; with ``lower`` also codes in lower case."""
    bits = {k: set(v) for k, v in IUPAC.items()}
    if lower:
        bits |= {k.lower(): v for k, v in bits.items()}
    return "^" + "".join("[" + "".join(k for k, v in bits.items() if v & bits[c.upper()]) + "]" for c in motif) + "$"


def pam_matches(pam: Column, motif: str) -> Column:
    return F.upper(pam).rlike(pam_regex(motif))


def pam_created(ref_pam: Column, alt_pam: Column, motif: str) -> Column:
    """The PAM that a variant creates: the ALT one where the reference's does not match the motif, else null."""
    return F.when(~pam_matches(ref_pam, motif), alt_pam)


def edits(part: Column) -> Column:
    return count_ref_mm(part) + count_gaps(part)


def seed_split(aligned: Column, crrna: Column, five_prime: bool) -> Column:
    """(seed, non_seed): mismatches and gaps in the half next to the PAM and in the other, DNA-bulge gaps included.

    The half is ``length div 2``; with an odd length the middle belongs to the far half.
    """
    half = F.floor(F.length(aligned) / F.lit(2)).cast("int")
    near = lambda s: F.left(s, half) if five_prime else F.right(s, half)
    far = lambda s: F.substring(s, half + 1, F.length(s)) if five_prime else F.left(s, F.length(s) - half)
    return F.struct((edits(near(aligned)) + count_gaps(near(crrna))).alias("seed"), (edits(far(aligned)) + count_gaps(far(crrna))).alias("non_seed"))


def base_editor_flags(seq: Column, lo: int, hi: int, bases: str = "ACGT") -> Column:
    """Which base editors have a target in places [lo - 1, hi) of the sequence, as ``ABE,CBE``; empty if none."""
    window = F.upper(F.substring(seq, lo, max(0, hi - lo + 1)))
    return F.array_join(F.array_compact(F.array(*[F.when(window.contains(b), f"{b}BE") for b in bases])), ",")


def variant_in_spacer(pos: Column, ref: Column, alt: Column, start: Column, strand: Column, length: Column) -> Column:
    """A variant's place in the protospacer and its alleles on the guide's strand, as ``12A>G``.

    Before the start it counts as 1 on the plus strand and as the length on the minus strand, where alleles are
    reverse-complemented and a deletion is counted from its other end.
    """
    at = pos - start
    correction = F.greatest(F.lit(0), F.length(ref) - F.length(alt))
    minus = F.when(at < 1, length).otherwise(F.abs(at - 1 - length + correction))
    plus = F.greatest(at, F.lit(1))
    own = lambda a: F.when(strand == "+", a).otherwise(reverse_complement(a))
    return F.concat(F.when(strand == "+", plus).otherwise(minus).cast("string"), own(ref), F.lit(">"), own(alt))


def parse_variant_key(key: Column) -> Column:
    """(chrom, pos, ref, alt) of ``chrom_pos_ref_alt``; contigs may contain ``_``; null where it does not parse."""
    pattern = r"^(.+)_(\d+)_([^_]+)_([^_]+)$"
    part = lambda i: F.regexp_extract(key, pattern, i)
    return F.when(key.rlike(pattern), F.struct(part(1).alias("chrom"), part(2).try_cast("bigint").alias("pos"), part(3).alias("ref"), part(4).alias("alt")))


def cfd_terms(crrna: Column, dna: Column) -> Column:
    """The table keys (rna, dna, pos) of the places where an alignment differs: T is U in RNA, dna complemented, pos from 1."""
    u = F.translate(F.upper(crrna), "T", "U")
    d = F.translate(F.upper(dna), "ACGT", "TGCA")
    pairs = F.zip_with(letters(u), letters(d), lambda r, x: F.struct(r.alias("rna"), x.alias("dna")))
    keyed = F.transform(pairs, lambda p, i: F.struct(p["rna"].alias("rna"), p["dna"].alias("dna"), (i + 1).alias("pos")))
    return F.filter(keyed, lambda p: F.translate(p["rna"], "U", "T") != F.translate(p["dna"], "ACGT", "TGCA"))


# The published nearest-neighbour enthalpies of two bases that follow each other.
ENTHALPY = {
    "AA": 9.1, "AC": 6.5, "AG": 7.8, "AT": 8.6,
    "CA": 5.8, "CC": 11.0, "CG": 11.9, "CT": 7.8,
    "GA": 5.6, "GC": 11.1, "GG": 11.0, "GT": 6.5,
    "TA": 6.0, "TC": 5.6, "TG": 5.8, "TT": 9.1,
}
#: Mispairs (guide base, then DNA base) by kind. Fixed values.
MISPAIRS = {"wobble": ("GA", "TC"), "rr": ("GT", "GC", "AT", "AC"), "yy": ("CG", "CA", "TG", "TA"), "transversions": ("AG", "CT")}


def enthalpy(seq: Column) -> Column:
    """The sum of the enthalpies of neighbouring bases; pairs with another letter count 0."""
    table = F.create_map(*[F.lit(x) for pair in ENTHALPY.items() for x in pair])
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq) - 1, F.lit(1))), lambda i: F.coalesce(table[F.substring(seq, i, F.lit(2))], F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def base_code(seq: Column) -> Column:
    """A, C, G, T as 1 to 4 and N as 0, digit by digit, as a number."""
    return F.translate(seq, "ACGTN", "12340").try_cast("int")


def crista_features(guide: Column, dna: Column, flank: Column | None = None, pam: int = 3) -> Column:
    """Counts that describe an alignment whose last ``pam`` letters are the PAM; ``flank`` is the DNA with its surroundings.

    mm, rna_bulges (gaps in the guide), dna_bulges (gaps in the DNA); runs of places that differ and are followed by an
    equal one, and edits per run; mismatches by quartets counted from the PAM, of which, as the published model has it,
    the first place stands for a whole quartet and all but the last three for the rest; mispairs by
    kind; bases and GC of the DNA, its two PAM letters, the letter before them and the first one; the four pairs and the
    five bases next to the PAM as codes; enthalpies, GC share and last three bases of the flank, where there is one.
    What is counted place by place is counted over many alignments at once. Take fields of the expression itself, so that
    only these are worked out.
    """
    run, kind = alignments.counter(pam, MISPAIRS, ENTHALPY)
    plain = F.replace(F.upper(dna), F.lit("-"))
    wide = F.lit(None).cast("string") if flank is None else F.upper(flank)
    x = F.arrow_udf(run, kind)(F.upper(guide), F.upper(dna), plain, wide)
    in_guide, in_dna = count_gaps(guide), count_gaps(dna)
    without = lambda seq, base: F.length(F.translate(seq, base, ""))
    bases = {f"n_{b.lower()}": F.length(plain) - without(plain, b) for b in "ACGT"}
    code = lambda from_end, size: base_code(F.substring(plain, F.length(plain) - from_end + 1, F.lit(size)))
    return F.struct(
        x["mm"].alias("mm"), in_guide.alias("rna_bulges"), in_dna.alias("dna_bulges"),
        x["runs"].alias("runs"), F.when(x["runs"] > 0, (x["mm"] + in_guide + in_dna) / x["runs"]).otherwise(0.0).alias("run_length"),
        *[x[name].alias(name) for name in ("mm_1_4", "mm_5_8", "mm_9_12", "mm_13_16", "mm_17_end", *MISPAIRS)],
        *[z.alias(name) for name, z in bases.items()], (bases["n_g"] + bases["n_c"]).alias("gc"),
        code(2, 2).alias("pam_last"), code(3, 1).alias("pam_first"), base_code(F.substring(plain, 1, 1)).alias("first_base"),
        F.array(*[code(8 - i, 2) for i in range(4)]).alias("couples"), F.array(*[code(8 - i, 1) for i in range(5)]).alias("seed_bases"),
        x["enthalpy"].alias("enthalpy"), x["flank_enthalpy"].alias("flank_enthalpy"),
        F.when(F.length(wide) > 0, (F.length(wide) - without(wide, "GC")) / F.length(wide)).alias("flank_gc"),
        F.array(*[base_code(F.substring(wide, F.length(wide) - 2 + i, F.lit(1))) for i in range(3)]).alias("downstream"),
    )


def af_decade(x: Column) -> Column:
    """1e-5 for 0, 1 from 0.1 up, else ten to minus the number of leading zeros and one."""
    return F.when(x == 0, F.lit(1e-5)).when(x >= 0.1, F.lit(1.0)).otherwise(F.pow(F.lit(10.0), F.floor(F.log10(x) + F.lit(1e-12))))


def truncate1(x: Column) -> Column:
    return F.floor(F.round(x * 1000).cast("bigint") / F.lit(100)) / F.lit(10.0)


def kmer_counts(seq: Column, k: int) -> Column:
    """A map from each k-mer of the sequence to how often it occurs."""
    n = F.length(seq) - k + 1
    mers = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.map_from_entries(F.transform(F.array_distinct(mers), lambda m: F.struct(m, F.size(F.filter(mers, lambda x: x == m)))))


def one_hot(seq: Column, k: int) -> Column:
    """The k-mer at each position, as (pos from 0, kmer)."""
    n = F.length(seq) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(i.alias("pos"), F.substring(seq, i + 1, F.lit(k)).alias("kmer"))))


def gc_count(seq: Column) -> Column:
    return F.length(F.regexp_replace(F.upper(seq), "[^GC]", ""))


def expand_iupac(motif: str) -> list[str]:
    """All strings of codes that match a degenerate motif; each code expands to every code that shares a base with it."""
    out = [""]
    for c in motif.upper():
        own = [k for k, v in IUPAC.items() if set(v) & set(IUPAC[c])]
        out = [x + k for x in out for k in own]
    return out
