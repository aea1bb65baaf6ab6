"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Lines of fewer characters must be equal to count as repeated; longer ones may differ by one edit.
EDIT_FROM = 16
#: From this length on, deletion variants are made only of the short segment in which two lines can differ.
LONG = 4096
#: Characters of such a segment, and how many segments a longer one is cut into at a time.
SEGMENT, CUT = 256, 16
#: Least and most words of 64 bits of the filter that keeps most documents out of the shuffle that fetches candidate lines.
FILTER_WORDS = 1 << 12, 1 << 20
#: Parts into which equal lines, however many, are dealt by their document when what is known of them is joined to them.
SALTS = 8


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(*parts) -> Column:
    return F.xxhash64(*parts)


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line that is not blank, by its place."""
    t = F.trim(F.col("p"))
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(split_lines(F.col("text"))).alias("line", "p"))
    return rows.select("doc_id", "version", "line", t.alias("t")).where("t != ''")


def _segment_keys(t: Column, n: Column, segments: int) -> Column:
    """Keys of which two lines within one edit share one: the shorter is cut into ``segments``, and they agree before and after one of them."""
    out = []
    for shorter in (n, n - 1):
        cut = [F.floor(shorter * j / F.lit(segments)).cast("int") for j in range(segments + 1)]
        out += [_hash(F.lit(j), shorter, F.substring(t, F.lit(1), cut[j]), F.right(t, shorter - cut[j + 1])) for j in range(segments)]
    return F.array(*out)


def _sharing(lines: DataFrame, keys: Column) -> DataFrame:
    """h1, h2 of the lines that share one of their keys with another line."""
    each = lines.select("h1", "h2", F.explode(F.array_distinct(keys)).alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    return each.join(shared, "key", "left_semi").select("h1", "h2").distinct()


def repeated_lines(docs: DataFrame, edits: int = 1) -> DataFrame:
    """doc_id, version, line of every line that goes.

    A line goes if an earlier one, by (doc_id, line, version), is equal to it after trimming spaces, or, when both
    have at least EDIT_FROM characters and ``edits`` is 1, is within one edit (one character put in, left out or
    changed). ``version`` is the text's hash, so that a repeated row of one document is that document itself.
    """
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    t, n = F.col("t"), F.length("t")
    first = F.struct("doc_id", "line", "version")
    lines = materialize(_lines(docs).select("doc_id", "version", "line", _hash(t).alias("h1"), _hash(F.lit("2"), t).alias("h2"), n.alias("n"), F.when((n >= EDIT_FROM) & F.lit(edits > 0), _segment_keys(t, n, 2)).alias("keys")), "lines")
    groups = lines.groupBy("h1", "h2").agg(F.min(first).alias("first"), F.count("*").alias("copies"), F.first("keys").alias("keys"))
    repeats = _to_lines(lines, groups.where("copies > 1").select("h1", "h2", "first")).where(first != F.col("first")).select("doc_id", "version", "line")
    if not edits:
        return repeats.distinct()

    long = groups.where("keys is not null")
    near = long.join(_sharing(long, F.col("keys")), ["h1", "h2"])
    spent: list[DataFrame] = []
    keep = lambda df, name: spent.append(materialize(df, name)) or spent[-1]
    places = keep(near.select("h1", "h2", F.col("first.doc_id").alias("doc_id"), F.col("first.line").alias("line"), F.col("first.version").alias("version")), "near")
    every = keep(_fetch(docs, places), "fetched")
    fetched = every.where(n <= LONG)
    closer = fetched.join(_sharing(fetched, _segment_keys(t, n, 16)), ["h1", "h2"], "left_semi")
    variants = keep(_variants(closer, keep), "variants")

    # Rows of one key hold equal strings. Those with the same deleted place and length are within one change of each
    # other: each is compared with the earliest. A full line is compared with the lines that are one longer.
    hubs = variants.groupBy("key", "at", "n").agg(F.min(F.struct("first", "t")).alias("hub"), F.count("*").alias("k"))
    changed = variants.where("at > 0").join(hubs.where("k > 1").select("key", "at", "n", "hub"), ["key", "at", "n"])
    full = variants.where("at = 0").select("key", F.col("t").alias("ft"), F.col("first").alias("ff"), (F.col("n") + 1).alias("n"), F.col("h1").alias("fh1"), F.col("h2").alias("fh2"))
    longer = variants.where("at > 0").join(full, ["key", "n"])
    shorter = hubs.where("at > 0").join(full, ["key", "n"])
    within = lambda a, b: F.levenshtein(a, b, 1) >= 0
    gone = (
        changed.where((F.col("hub.first") < F.col("first")) & within(F.col("t"), F.col("hub.t"))).select("h1", "h2")
        .union(longer.where((F.col("ff") < F.col("first")) & within(F.col("t"), F.col("ft"))).select("h1", "h2"))
        .union(shorter.where((F.col("hub.first") < F.col("ff")) & within(F.col("hub.t"), F.col("ft"))).select("fh1", "fh2"))
        .union(_near_long(every.where(n >= LONG), keep))
        .distinct()
    )
    gone = materialize(gone, "gone")
    discard(*spent)
    return repeats.union(_to_lines(lines, gone).select("doc_id", "version", "line")).distinct()


def _to_lines(lines: DataFrame, known: DataFrame) -> DataFrame:
    """``lines`` with what is known of equal lines by (h1, h2); lines without go."""
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h1", "h2", "salt"])


def _fetch(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The texts of the lines at ``places``. A bit filter of bounded size first drops most documents without any."""
    words = FILTER_WORDS[0]
    while words < FILTER_WORDS[1] and 8 * words < places.count():
        words = FILTER_WORDS[1] if words == FILTER_WORDS[1] // 16 else words * 16
    slot, bit = F.pmod(F.xxhash64("doc_id"), F.lit(words)).alias("slot"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64)).cast("int").alias("bit")
    bits = places.select(slot, bit).groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    some = docs.select("doc_id", "text", slot, bit).join(F.broadcast(bits), "slot").where(F.getbit("bits", F.col("bit")) == 1).select("doc_id", "text", F.xxhash64("text").alias("version"))
    wanted = places.groupBy("doc_id", "version").agg(F.collect_list(F.struct("line", "h1", "h2")).alias("wanted"))
    rows = some.dropDuplicates(["doc_id", "version"]).join(wanted.hint("shuffle_hash"), ["doc_id", "version"])
    rows = rows.select("doc_id", "version", split_lines(F.col("text")).alias("p"), F.explode("wanted").alias("x"))
    return rows.select("x.h1", "x.h2", F.struct("doc_id", F.col("x.line").alias("line"), "version").alias("first"), F.trim(F.get("p", F.col("x.line"))).alias("t"))


def _near_long(lines: DataFrame, keep) -> DataFrame:
    """h1, h2 of the long lines that are within one edit of an earlier one.

    Each row has a line's segment ``m`` outside of which it agrees with another line, as ``k1`` and ``k2`` tell, and
    ``more``, 1 if a character is to be left out of it and 0 if not. Segments are cut again until they are short.
    """
    hashes = lambda *x: (F.xxhash64(F.lit(1), *x), F.xxhash64(F.lit(2), *x))
    n = F.length("t").cast("int")
    state = lines.select("h1", "h2", "first", F.col("t").alias("m"), F.explode(F.array(*[F.struct((n - k).alias("k1"), F.lit(0).alias("k2"), F.lit(k).alias("more")) for k in (0, 1)])).alias("x"))
    state = state.select("h1", "h2", "first", F.col("x.k1").cast("long").alias("k1"), F.col("x.k2").cast("long").alias("k2"), "x.more", "m")
    longest = lines.agg(F.max(n)).first()[0] or 0
    while longest > SEGMENT:
        size = F.length("m") - F.col("more")
        cuts = []
        for j in range(CUT):
            a, b = (F.floor(size * i / F.lit(CUT)).cast("int") for i in (j, j + 1))
            k1, k2 = hashes("k1", "k2", F.lit(j), F.substring("m", F.lit(1), a), F.right(F.col("m"), size - b))
            cuts.append(F.struct(k1.alias("k1"), k2.alias("k2"), F.substring(F.col("m"), a + 1, b - a + F.col("more")).alias("m")))
        each = state.select("h1", "h2", "first", "more", F.explode(F.array(*cuts)).alias("x")).select("h1", "h2", "first", "x.k1", "x.k2", "more", "x.m")
        each = keep(each, "segments")
        # Only rows with the same number of characters left after leaving out can meet, and the key holds that number.
        shared = each.groupBy("k1", "k2").agg(F.count("*").alias("k"), F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("k > 1 and lo != hi").select("k1", "k2")
        state = keep(each.join(shared, ["k1", "k2"], "left_semi"), "sharing")
        longest = -(-longest // CUT) + 1

    m = F.col("m")
    out = lambda i: F.concat(F.substring(m, F.lit(1), i - 1), F.substring(m, i + 1, F.length(m)))
    key = lambda *x: F.struct(*[c.alias(f"v{i}") for i, c in enumerate(hashes("k1", "k2", *x), 1)])
    places = F.sequence(F.lit(1), F.greatest(F.length(m), F.lit(1)))
    # One change: equal length, equal without the character at one place. One put in: the longer without one is the other.
    changed = F.transform(places, lambda i: key(i, out(i)))
    left = F.array_distinct(F.when(F.col("more") == 1, F.transform(places, lambda i: key(F.lit(0), out(i)))).otherwise(F.array(key(F.lit(0), m))))
    same = state.where("more = 0").select("h1", "h2", "first", F.lit(0).alias("more"), F.explode(changed).alias("v"), F.lit(True).alias("one"))
    other = state.select("h1", "h2", "first", "more", F.explode(left).alias("v"), F.lit(False).alias("one"))
    rows = keep(same.union(other).select("h1", "h2", "first", "more", "one", "v.v1", "v.v2"), "long-variants")
    # Of the longer lines the earliest counts for the shorter, and the other way round.
    hubs = rows.groupBy("v1", "v2", "one").agg(F.min(F.when(F.col("more") == 0, F.col("first"))).alias("plain"), F.min(F.when(F.col("more") == 1, F.col("first"))).alias("longer"), F.count("*").alias("k")).where("k > 1")
    met = rows.join(hubs, ["v1", "v2", "one"])
    return met.where(F.when(F.col("one") | (F.col("more") == 1), F.col("plain")).otherwise(F.col("longer")) < F.col("first")).select("h1", "h2")


def _variants(lines: DataFrame, keep) -> DataFrame:
    """Each line's deletion neighbourhood, of which rows stay whose key another line has as well.

    ``key`` is the hash of the line without its character ``at``, or of the whole line where ``at`` is 0.
    """
    t = F.col("t")
    keys = F.transform(F.sequence(F.lit(0), F.length(t)), lambda i: F.when(i == 0, _hash(t)).otherwise(_hash(F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))))
    slim = keep(lines.select("h1", "h2", F.posexplode(keys).alias("at", "key")), "neighbourhood")
    shared = slim.groupBy("key").agg(F.count("*").alias("k"), F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("k > 1 and lo != hi").select("key")
    return slim.join(shared, "key", "left_semi").join(lines, ["h1", "h2"]).withColumn("n", F.length("t"))


def dedup_lines(docs: DataFrame, edits: int = 1, text: str = "text", gone: str = "lines_gone") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text`` and their number in ``gone``.

    See ``repeated_lines`` for what goes; the earliest of each stays. Blank lines never go. Rows with a null doc_id or
    text, or an empty text, are returned as they are, with 0. Other columns pass through unless one is named as ``gone``.
    """
    keep = [c for c in docs.columns if c != gone]
    drop = repeated_lines(docs.select("doc_id", F.col(f"`{text}`").alias("text")), edits).groupBy("doc_id", "version").agg(F.collect_list("line").alias("__lines_drop"))
    drop = drop.select(F.col("doc_id").alias("__lines_id"), F.col("version").alias("__lines_version"), "__lines_drop")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    rows = rows.join(drop.hint("shuffle_hash"), (F.col("doc_id") == F.col("__lines_id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__lines_version")), "left")
    clean = F.array_join(F.filter(split_lines(F.col(f"`{text}`")), lambda p, i: ~F.array_contains("__lines_drop", i)), "\n")
    return rows.select(*[F.when(F.col("__lines_drop").isNull(), F.col(f"`{c}`")).otherwise(clean).alias(c) if c == text else F.col(f"`{c}`") for c in keep], F.coalesce(F.size("__lines_drop"), F.lit(0)).alias(gone))


def oracle() -> str:
    """The deduplicated texts in DuckDB SQL. Near lines: every pair that agrees in one half, from the first difference on."""
    return f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS t FROM d),
l AS (SELECT doc_id, line, trim(t) AS t FROM p WHERE trim(t) <> ''),
g AS (SELECT t, length(t) AS n, min(row(doc_id, line)) AS first FROM l GROUP BY t),
h AS (SELECT t, n, first, unnest([n, n - 1]) AS m FROM g WHERE n >= {EDIT_FROM}),
c AS (SELECT a.t AS u, b.t AS v, a.n AS nu, b.n AS nv, a.first AS fu, b.first AS fv FROM h a JOIN h b ON a.m = b.m AND left(a.t, a.m // 2) = left(b.t, b.m // 2) AND a.n >= b.n AND a.t <> b.t
UNION SELECT a.t, b.t, a.n, b.n, a.first, b.first FROM h a JOIN h b ON a.m = b.m AND right(a.t, a.m - a.m // 2) = right(b.t, b.m - b.m // 2) AND a.n >= b.n AND a.t <> b.t),
f AS (SELECT *, coalesce(list_position(list_transform(range(1, nv + 1), lambda i: substr(u, i, 1) <> substr(v, i, 1)), true), nv + 1) AS place FROM c),
e AS (SELECT * FROM f WHERE right(u, nu - place) = right(v, nu - place) AND nu = nv OR right(u, nu - place) = right(v, nu - place) AND nu = nv + 1),
gone AS (SELECT CASE WHEN fu > fv THEN u ELSE v END AS t FROM e),
drop_ AS (SELECT l.doc_id, l.line FROM l JOIN g USING (t) WHERE row(l.doc_id, l.line) <> g.first UNION SELECT l.doc_id, l.line FROM l SEMI JOIN gone USING (t)),
k AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY line) AS text, count(*) AS n FROM p ANTI JOIN drop_ USING (doc_id, line) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, (coalesce(len(ls), 0) - CASE WHEN d.text IS NULL THEN 0 ELSE coalesce(k.n, 0) END)::INTEGER AS lines_gone
FROM d LEFT JOIN k USING (doc_id)"""
