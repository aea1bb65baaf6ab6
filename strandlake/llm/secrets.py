"""Secret scan with an incremental ledger of content-addressed blobs, in DataFrame functions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlaps; a match stays if its ``group`` has ``least`` characters.

    ``needs``: strings of which every matching text holds one; texts without any are not searched.
    A change of a rule must raise its ``version``.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()
    version: int = 1


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: A token that could run on to the left of a match would be tried from each of its places: such matches begin a word.
BEGINS = "(?<![A-Za-z0-9_-])"
_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: The kinds in the order in which findings of one start are listed; the first three are the base kinds.
RULES = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, (":", "=")),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16, ("AKIA",)),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", needs=("PRIVATE KEY-----",)),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}", needs=("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
    Rule("jwt", BEGINS + r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=("eyJ",), version=2),
    Rule("url_login", r"://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@", needs=("://",)),
)
BASE = ("assign", "access", "hex")
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


def address(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def _matches(rule: Rule) -> Column:
    """For each match: the length of what stands before it (since the last match), its own, and whether it stays."""
    text = F.col("content")
    gaps = F.transform(F.split(text, F.lit(rule.pattern), -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    # All three are zipped once: what a lambda takes from outside is computed anew for each match.
    zipped = F.filter(F.arrays_zip(gaps.alias("g"), whole.alias("m"), kept.alias("k")), lambda x: x["m"].isNotNull())
    each = F.transform(zipped, lambda x, i: F.struct(F.lit(rule.kind).alias("rule"), i.alias("i"), x["g"].alias("gap"), F.length(x["m"]).alias("length"), (F.length(x["k"]) >= rule.least).alias("stays")))
    none = F.array().cast("array<struct<rule:string,i:int,gap:int,length:int,stays:boolean>>")
    pending = F.array_contains("rules", rule.kind)
    for_text = F.lit(not rule.needs)
    for x in rule.needs:
        for_text = for_text | text.contains(x)
    return F.when(pending & for_text, each).otherwise(none)


def scan_blobs(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """The new rows of the ledger: blob, rule, version, spans.

    ``versions`` has a column ``content`` with every historical version of every path. Each distinct content (a blob,
    by its SHA-256) is scanned once, and only for the rules of whose present version ``ledger`` has no row for it.
    A scanned pair without findings gets a row with no spans, so that it is not scanned again. Spans are in code
    points, end exclusive.
    """
    blobs = versions.select(address(F.col("content")).alias("blob"), F.coalesce("content", F.lit("")).alias("content")).dropDuplicates(["blob"])
    now = F.array(*[F.lit(r.kind) for r in rules])
    if ledger is None:
        pending = blobs.withColumn("rules", now)
    else:
        versions_now = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
        seen = ledger.where(F.coalesce(versions_now[F.col("rule")] == F.col("version"), F.lit(False))).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        pending = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(now, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("rules") > 0)
    matched = pending.select("blob", "rules", F.flatten(F.array(*map(_matches, rules))).alias("m"))
    found = matched.select("blob", "rules", F.explode_outer(F.concat("m", F.transform("rules", lambda r: F.struct(r.alias("rule"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("gap"), F.lit(None).cast("int").alias("length"), F.lit(False).alias("stays"))))).alias("m")).select("blob", "m.*")
    run = Window.partitionBy("blob", "rule").orderBy(F.col("i").asc_nulls_first())
    end = F.sum(F.coalesce(F.col("gap") + F.col("length"), F.lit(0))).over(run)
    spans = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    version = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    return spans.groupBy("blob", "rule").agg(F.array_sort(F.collect_list(F.when(F.col("stays"), F.struct("start", "end")))).alias("spans")).select("blob", "rule", version[F.col("rule")].alias("version"), "spans")


def update_ledger(versions: DataFrame, path: str, rules=RULES) -> DataFrame:
    """The ledger at ``path`` (a folder that all executors share) after it has taken in ``versions``.

    Reads the ledger if there is one, scans the pairs of blob and rule version that it lacks, and appends them. A second
    call with the same versions and rules scans nothing.
    """
    spark = versions.sparkSession
    ledger = None
    try:
        ledger = spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    scan_blobs(versions, ledger, rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


#: Parts into which the paths of one blob are dealt when findings are joined to them.
SALTS = 16


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """Each row of ``versions`` (without content) with the findings of its blob.

    Adds ``findings``: an array of (start, order, kind, end), sorted, over the present rule versions; empty where
    nothing was found. A column of that name is replaced, others pass through. The paths of one blob, however many, are
    dealt into SALTS parts by their other columns, and the findings, which few blobs have, go to each part.
    """
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    version = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    hits = ledger.where((F.size("spans") > 0) & F.coalesce(version[F.col("rule")] == F.col("version"), F.lit(False)))
    each = hits.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("rule")].alias("order"), F.col("rule").alias("kind"), s["end"].alias("end"))).alias("f"))
    by_blob = each.groupBy(F.col("blob").alias("__secrets_blob")).agg(F.array_sort(F.flatten(F.collect_list("f"))).alias("__secrets_found"))
    by_blob = by_blob.withColumn("__secrets_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
    keep = [F.col(f"`{c}`") for c in versions.columns if c not in ("content", "findings")]
    salt = F.pmod(F.xxhash64(*keep), F.lit(SALTS)).cast("int") if keep else F.lit(0)
    paths = versions.select(*keep, address(F.col("content")).alias("__secrets_blob"), salt.alias("__secrets_salt"))
    return paths.join(by_blob, ["__secrets_blob", "__secrets_salt"], "left").select(*keep, F.coalesce("__secrets_found", none).alias("findings"))


def digest(findings: DataFrame) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans, and all spans as a string."""
    text = lambda f: F.array_join(F.transform(f, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    return findings.select("doc_id", *map(count, BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"))


def oracle() -> str:
    """The same in DuckDB SQL, over every document rather than every blob; what stands before a word is matched with it and cut off again."""
    words = lambda x: x.pattern.startswith(BEGINS)
    hits = " UNION ALL ".join(
        f"SELECT r, '{x.kind}' AS kind, {k} AS ord, regexp_split_to_array(text, '{esc}') AS g, regexp_extract_all(text, '{esc}', 0) AS m, regexp_extract_all(text, '{esc}', {2 * words(x)}) AS o, regexp_extract_all(text, '{esc}', {2 if words(x) else x.group}) AS q, {x.least} AS least FROM d WHERE regexp_matches(text, '{esc}')"
        for k, x in enumerate(RULES)
        for esc in [(f"(^|[^A-Za-z0-9_-])({x.pattern.removeprefix(BEGINS)})" if words(x) else x.pattern).replace("'", "''")]
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
h AS ({hits}),
e AS (SELECT r, kind, ord, least, m, o, q, g, unnest(range(1, len(m) + 1)) AS i FROM h),
s AS (SELECT r, kind, ord, length(o[i]) AS n, length(q[i]) >= least AS stays, sum(length(g[i]) + length(m[i])) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM e),
f AS (SELECT r, kind, ord, (e - n)::BIGINT AS a, e::BIGINT AS e FROM s WHERE stays),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, ord) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""
