"""Joins on intervals, nearest features and as-of matches.

Catalyst plans a range condition as a nested loop. Here both sides are cut into bins, joined by equality on
(chromosome, bin), and each pair is kept in the bin in which the later of the two starts, so that it comes once and
no ``distinct`` is needed. Bins are sized by the caller or by the longest interval.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Letters of a tile in one row of ``extract_region``.
PIECE = 2048


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / F.lit(width)), F.floor((F.greatest(end, start + 1) - 1) / F.lit(width))))


def overlap_join(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], on: tuple[str, ...] = ("chrom",), width: int = 1000) -> DataFrame:
    """Pairs of rows with equal ``on`` whose half-open spans meet. Columns other than ``on`` must have different names."""
    (a0, a1), (b0, b1) = a_span, b_span
    left = a.withColumn("_bin", _bins(F.col(a0), F.col(a1), width))
    right = b.withColumn("_bin", _bins(F.col(b0), F.col(b1), width))
    meet = (F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1)) & (F.col("_bin") == F.floor(F.greatest(F.col(a0), F.col(b0)) / F.lit(width)))
    return left.join(right, [*on, "_bin"]).where(meet).drop("_bin")


def annotate_overlaps(hits: DataFrame, features: DataFrame, length: Column | int, width: int = 1000) -> DataFrame:
    """``hits`` (with a unique ``id``) and ``labels``: the sorted distinct labels of features that meet [pos, pos + length); null where none does.

    With one ``length`` for all, each feature stands in every bin in which a hit that it meets may begin, and the features
    of a bin are one row, so that hits are shuffled once. Else pairs are joined, gathered by hit and joined again.
    """
    if isinstance(length, int):
        posted = features.select("chrom", "start", "end", "label", _bins(F.col("start") - length + 1, F.col("end"), width).alias("_bin"))
        bins = posted.groupBy("chrom", "_bin").agg(F.collect_set(F.struct("start", "end", "label")).alias("_near"))
        placed = hits.withColumn("_bin", F.floor(F.col("pos") / F.lit(width))).join(bins, ["chrom", "_bin"], "left")
        met = placed.withColumn("_met", F.filter("_near", lambda f: (F.col("pos") < f["end"]) & (f["start"] < F.col("pos") + length)))
        own = F.array_sort(F.array_distinct(F.filter(F.transform("_met", lambda f: f["label"]), lambda x: x.isNotNull())))
        return met.select("id", *[c for c in hits.columns if c not in ("id", "labels")], F.when(F.size("_met") > 0, own).alias("labels"))
    spans = hits.select("id", "chrom", F.col("pos").alias("_h0"), (F.col("pos") + length).alias("_h1"))
    found = overlap_join(spans, features.select("chrom", F.col("start").alias("_f0"), F.col("end").alias("_f1"), "label"), ("_h0", "_h1"), ("_f0", "_f1"), width=width)
    labels = found.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return hits.join(labels, "id", "left")


def nearest_feature(hits: DataFrame, features: DataFrame, length: int = 1, width: int = 100_000) -> DataFrame:
    """``hits`` with the nearest feature's label and the signed distance (0 inside, negative before the hit); ties to the smaller label.

    Ordered windows inside bins of ``width`` bases give the largest feature end so far and the next start; what lies in
    other bins comes from one row for each bin, so that no task has to order a chromosome.
    """
    h = hits.select("chrom", F.col("pos").alias("at"), F.lit(1).alias("kind"), "id", F.lit(None).cast("bigint").alias("end"), F.lit(None).cast("string").alias("label"))
    f = features.select("chrom", F.col("start").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(hits.schema["id"].dataType).alias("id"), F.col("end").cast("bigint").alias("end"), "label")
    rows = h.unionByName(f).withColumn("_bin", F.floor(F.col("at") / F.lit(width)))
    ends_ = F.when(F.col("kind") == 0, F.struct(F.col("end").alias("end"), F.col("at").alias("start")))
    starts_ = F.when(F.col("kind") == 0, F.struct(F.col("at").alias("start")))
    per = rows.groupBy("chrom", "_bin").agg(F.max(ends_).alias("_e"), F.min(starts_).alias("_s"))
    order = Window.partitionBy("chrom").orderBy("_bin")
    carry = per.select("chrom", "_bin", F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_ce"), F.min("_s").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_cs"))
    before = Window.partitionBy("chrom", "_bin").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("chrom", "_bin").orderBy(F.col("at").desc(), F.col("kind").asc()).rowsBetween(Window.unboundedPreceding, 0)
    # A stated number of parts: adaptive execution would join them until a task orders millions of rows.
    dealt = rows.repartition(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chrom", "_bin")
    at = dealt.withColumns({"_l": F.max(ends_).over(before), "_r": F.min(starts_).over(after)}).where("kind = 1").join(carry, ["chrom", "_bin"])
    at = at.withColumns({"_l": F.greatest("_l", "_ce"), "_r": F.least("_r", "_cs")})
    dl = F.greatest(F.lit(0), F.col("at") - F.col("_l.end") + 1)
    dr = F.greatest(F.lit(0), F.col("_r.start") - (F.col("at") + length) + 1)
    pick = at.select("id", "chrom", F.when(F.col("_l").isNotNull() & (F.col("_r").isNull() | (dl <= dr)), -dl).when(F.col("_r").isNotNull(), dr).alias("distance"), F.col("_l.end").alias("_end"), F.col("_r.start").alias("_start"))
    ends = features.groupBy("chrom", F.col("end").cast("bigint").alias("_end")).agg(F.min("label").alias("_le"))
    starts = features.groupBy("chrom", F.col("start").alias("_start")).agg(F.min("label").alias("_ls"))
    named = pick.join(ends, ["chrom", "_end"], "left").join(starts, ["chrom", "_start"], "left")
    named = named.select("id", "distance", F.when(F.col("distance") <= 0, F.col("_le")).otherwise(F.col("_ls")).alias("nearest"))
    return hits.join(named, "id", "left")


def gene_distance(near: DataFrame) -> DataFrame:
    """``nearest_feature``'s result with what its label says of the gene, the distance in kb, and the region.

    Labels are attributes like ``gene_id=G1;gene_name=ABC``; what is missing there is null. ``region`` is ``intergenic``
    where the feature does not hold the hit, and null where it does or there is none.
    """
    value = lambda key: F.regexp_extract("nearest", rf"(?:^|;)\s*{key}=([^;]*)", 1)
    own = lambda key: F.when(value(key) != "", value(key))
    return near.withColumns({"gene_id": own("gene_id"), "gene_name": own("gene_name"), "distance_kb": F.col("distance") / F.lit(1000.0), "region": F.when(F.col("distance") != 0, "intergenic")})


def match_empirical(hits: DataFrame, empirical: DataFrame, assays: list[str], slack: int = 4, below: int = 50) -> tuple[DataFrame, DataFrame]:
    """(hits with one column for each assay, empirical rows that no hit matches).

    A site matches a hit if it meets [cluster_pos - slack, cluster_pos + slack) on its chromosome; of several values
    of an assay the largest counts, among rows with fewer than ``below`` edits.
    """
    e = empirical.where(F.col("mm_bul") < below).withColumn("_eid", F.xxhash64("chrom", "start", "end", "assay", "value"))
    spans = hits.select("id", "chrom", (F.col("cluster_pos") - slack).alias("_h0"), (F.col("cluster_pos") + slack).alias("_h1"))
    pairs = overlap_join(spans, e.select("chrom", F.col("start").alias("_e0"), F.col("end").alias("_e1"), "assay", "value", "_eid"), ("_h0", "_h1"), ("_e0", "_e1"))
    wide = pairs.groupBy("id").pivot("assay", assays).agg(F.max("value"))
    return hits.join(wide, "id", "left"), e.join(pairs.select("_eid").distinct(), "_eid", "left_anti").drop("_eid")


def flag_dense_regions(hits: DataFrame, regions: DataFrame) -> DataFrame:
    """``hits`` with the variant count and sequence of the first region (by start, end) that holds their position, else null."""
    spans = hits.select("id", "chrom", F.col("pos").alias("_h0"), (F.col("pos") + 1).alias("_h1"))
    pairs = overlap_join(spans, regions.select("chrom", F.col("start").alias("_r0"), F.col("end").alias("_r1"), "n_variants", "iupac"), ("_h0", "_h1"), ("_r0", "_r1"))
    first = pairs.groupBy("id").agg(F.min_by(F.struct("n_variants", "iupac"), F.struct("_r0", "_r1", "n_variants", "iupac")).alias("_d"))
    return hits.join(first, "id", "left").withColumns({"dense_variants": F.col("_d.n_variants"), "dense_iupac": F.col("_d.iupac")}).drop("_d")


def asof_match(a: DataFrame, b: DataFrame, by: list[str], on: str, tolerance: int, id_: str = "id") -> DataFrame:
    """Each row of ``a`` with its nearest row of ``b`` within ``tolerance`` and equal ``by``, each ``b`` claimed once; unmatched ``b`` follow.

    Result: by, id_a, on_a, id_b, on_b, origin (both, a_only, b_only). Of equal distances the earlier ``b`` is nearest,
    and of several claims the closest, then the smallest (on, id), stays; the others become a_only. Rows are ordered
    inside bins; each ``b`` also stands in the neighbouring bins that its tolerance reaches, so a group of equal ``by``
    may be of any size, and no pair is formed.
    """
    width = F.lit(max(1, 64 * tolerance))
    bin_ = lambda x: F.floor(x / width)
    ra = a.select(*by, F.col(on).alias("_on"), F.lit(1).alias("_kind"), F.col(id_).alias("_id")).withColumn("_bin", bin_(F.col("_on")))
    rb = b.select(*by, F.col(on).alias("_on"), F.lit(0).alias("_kind"), F.col(id_).alias("_id"))
    near_b = rb.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_(F.col("_on") - tolerance), bin_(F.col("_on")), bin_(F.col("_on") + tolerance)))))
    rows = ra.unionByName(near_b)
    mark = F.when(F.col("_kind") == 0, F.struct(F.col("_on").alias("on"), F.col("_id").alias("id")))
    prev = F.last(mark, ignorenulls=True).over(Window.partitionBy(*by, "_bin").orderBy("_on", "_kind", F.col("_id").desc()).rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.last(mark, ignorenulls=True).over(Window.partitionBy(*by, "_bin").orderBy(F.col("_on").desc(), F.col("_kind"), F.col("_id").desc()).rowsBetween(Window.unboundedPreceding, 0))
    near = rows.withColumns({"_p": prev, "_n": nxt}).where("_kind = 1")
    gp, gn = F.col("_on") - F.col("_p.on"), F.col("_n.on") - F.col("_on")
    chosen = F.when(F.col("_p").isNotNull() & (F.col("_n").isNull() | (gp <= gn)), F.col("_p")).otherwise(F.col("_n"))
    near = near.withColumn("_b", chosen).withColumn("_gap", F.abs(F.col("_on") - F.col("_b.on")))
    near = near.withColumn("_b", F.when(F.col("_gap") <= tolerance, F.col("_b")))
    # Only rows that found a ``b`` are ranked by claim; the many without one stay where they are.
    claim = Window.partitionBy(*by, "_b").orderBy("_gap", "_on", "_id")
    claimed = near.where("_b is not null").withColumn("_b", F.when(F.row_number().over(claim) == 1, F.col("_b")))
    near = near.where("_b is null").select(claimed.columns).unionByName(claimed)
    left = near.select(*by, F.col("_id").alias("id_a"), F.col("_on").alias("on_a"), F.col("_b.id").alias("id_b"), F.col("_b.on").alias("on_b"), F.when(F.col("_b").isNotNull(), "both").otherwise("a_only").alias("origin"))
    taken = left.where("id_b is not null").select(*by, F.col("id_b").alias("_id"), F.col("on_b").alias("_on"))
    rest = rb.join(taken, [*by, "_id", "_on"], "left_anti")
    none = lambda f: F.lit(None).cast(f.dataType)
    return left.unionByName(rest.select(*by, none(a.schema[id_]).alias("id_a"), none(a.schema[on]).alias("on_a"), F.col("_id").alias("id_b"), F.col("_on").alias("on_b"), F.lit("b_only").alias("origin")))


def asof_collapsed(rows: DataFrame, by: list[str], home: str, first: str, on: str, tolerance: int, id_: str = "id") -> DataFrame:
    """``asof_match`` of the rows of one table that are ``first`` with the others, where rows of one side lie more than ``tolerance`` apart.

    Rows within ``tolerance`` of each other share ``home``. So only neighbours in the order of both sides can match, and a
    row is claimed by those beside it: one order tells all, and rows that lie by (by, home) stay where they are.
    """
    order = Window.partitionBy(*by, home).orderBy(on, first)
    before, after = (lambda c, n=1: F.lag(c, n).over(order)), (lambda c, n=1: F.lead(c, n).over(order))
    beside = rows.select(*by, home, first, on, id_, *[f(c).alias(f"_{k}_{c}") for k, f in (("p", before), ("n", after)) for c in (first, on, id_)])
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in by], F.col(first))
    near = lambda k, gap: F.when(known & ~F.col(f"_{k}_{first}") & (gap <= tolerance), gap)
    near_p, near_n = near("p", F.col(on) - F.col(f"_p_{on}")), near("n", F.col(f"_n_{on}") - F.col(on))
    side = F.when(near_p <= F.coalesce(near_n, near_p), -1).when(near_n.isNotNull(), 1).otherwise(0)
    chosen = beside.withColumns({"_side": side, "_gap": F.coalesce(F.least(near_p, near_n), F.lit(0))})
    # Of two that claim the row between them the closer has it, then the earlier.
    lost = F.when(F.col("_side") == 1, (after("_side", 2) == -1) & (after("_gap", 2) < F.col("_gap"))).when(F.col("_side") == -1, (before("_side", 2) == 1) & (before("_gap", 2) <= F.col("_gap")))
    taken = F.coalesce(before("_side") == 1, F.lit(False)) | F.coalesce(after("_side") == -1, F.lit(False))
    out = chosen.withColumns({"_has": F.when(F.coalesce(lost, F.lit(False)), 0).otherwise(F.col("_side")), "_taken": taken}).where(F.col(first) | ~F.col("_taken"))
    a = lambda c: F.when(F.col(first), F.col(c))
    b = lambda c: F.when(~F.col(first), F.col(c)).when(F.col("_has") == -1, F.col(f"_p_{c}")).when(F.col("_has") == 1, F.col(f"_n_{c}"))
    origin = F.when(~F.col(first), "b_only").when(F.col("_has") != 0, "both").otherwise("a_only")
    return out.select(*by, a(id_).alias("id_a"), a(on).alias("on_a"), b(id_).alias("id_b"), b(on).alias("on_b"), origin.alias("origin"))


def map_contigs(preds: DataFrame, alias: DataFrame, source: str = "assembly", target: str = "ucsc") -> tuple[DataFrame, DataFrame]:
    """(rows with the contig's other name as ``mapped``, rows whose contig has none)."""
    names = alias.select(F.col(source).alias("chrom"), F.col(target).alias("mapped")).where("mapped is not null").dropDuplicates(["chrom"])
    joined = preds.join(names, "chrom", "left")
    return joined.where("mapped is not null"), joined.where("mapped is null").drop("mapped")


def join_lifted(preds: DataFrame, lifted: DataFrame, id_: str = "off_target_id") -> DataFrame:
    return preds.join(lifted.select(id_, "ref_chrom", "ref_start"), id_)


def lift_over(preds: DataFrame, blocks: DataFrame, width: int = 10_000) -> DataFrame:
    """``preds`` (id, chrom, pos, strand) with ref_chrom, ref_pos, ref_strand through the chain block that holds the position; null outside of all.

    Blocks with a minus strand run backwards and flip the strand. Of several blocks the one with the smallest target counts.
    """
    spans = preds.select("id", "chrom", F.col("pos").alias("_p0"), (F.col("pos") + 1).alias("_p1"), "strand")
    b = blocks.select(F.col("src_chrom").alias("chrom"), "src_start", "src_end", "dst_chrom", "dst_start", "dst_strand")
    pairs = overlap_join(spans, b, ("_p0", "_p1"), ("src_start", "src_end"), width=width)
    forward = F.col("dst_start") + F.col("_p0") - F.col("src_start")
    backward = F.col("dst_start") + F.col("src_end") - 1 - F.col("_p0")
    at = pairs.select("id", F.struct(F.col("dst_chrom").alias("ref_chrom"), F.when(F.col("dst_strand") == "+", forward).otherwise(backward).alias("ref_pos"), F.when(F.col("dst_strand") == "+", F.col("strand")).otherwise(F.translate("strand", "+-", "-+")).alias("ref_strand")).alias("_t"))
    one = at.groupBy("id").agg(F.min("_t").alias("_t"))
    return preds.join(one, "id", "left").select(*preds.columns, "_t.ref_chrom", "_t.ref_pos", "_t.ref_strand")


def extract_region(tiles: DataFrame, regions: DataFrame, tile: int) -> DataFrame:
    """The sequence of each region (region_id, chrom, start, end; half-open, from 0) out of overlapping tiles (chrom, start, seq).

    Each tile gives the part of the region between its own start and the next tile's, ``tile`` further on. Tiles are cut
    into pieces, as a substring is found by counting from the string's start. A region that lies in one piece is done
    with the join; only what is spread over several is gathered by region.
    """
    width = min(tile, PIECE)
    spans = regions.select("region_id", "chrom", F.col("start").alias("_r0"), F.col("end").alias("_r1"))
    cut = F.regexp_extract_all(F.substring("seq", 1, tile), F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    own = tiles.select("chrom", "start", F.posexplode(cut).alias("_i", "_s")).where("_s is not null").select("chrom", (F.col("start") + F.col("_i") * width).alias("_t0"), (F.col("start") + F.col("_i") * width + F.length("_s")).alias("_t1"), "_s")
    pairs = overlap_join(spans, own, ("_r0", "_r1"), ("_t0", "_t1"), width=width)
    lo, hi = F.greatest("_r0", "_t0"), F.least("_r1", "_t1")
    found = F.substring(F.col("_s"), (lo - F.col("_t0") + 1).cast("int"), (hi - lo).cast("int"))
    whole = (F.col("_t0") <= F.col("_r0")) & (F.col("_r1") <= F.col("_t1"))
    part = F.struct(F.col("_t0").alias("at"), found.alias("s"))
    spread = pairs.where(~whole).groupBy("region_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["s"]), "").alias("sequence"))
    return pairs.where(whole).select("region_id", found.alias("sequence")).unionByName(spread)


def unmatched_examples(df: DataFrame, matched: Column, key: str, most: float = 0.5, n: int = 5) -> DataFrame:
    """One row: rows, unmatched, the first examples, and whether at most the share ``most`` is unmatched; an empty table passes."""
    examples = df.where(~matched).select(key).distinct().orderBy(key).limit(n).agg(F.array_sort(F.collect_list(key)).alias("examples"))
    counts = df.agg(F.count("*").alias("rows"), F.count_if(~matched).alias("unmatched"))
    return counts.join(F.broadcast(examples)).withColumn("passed", F.col("unmatched") <= F.col("rows") * F.lit(most))


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)
