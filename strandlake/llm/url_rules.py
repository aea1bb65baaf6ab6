"""URL filter: association rules mined by FP-growth, matched through an inverted index."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: Fixed rules as (verdict, host, path); the longest that fits an url decides.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BAD = "=bad"
#: Parts into which the pages of one url are dealt when the flagged urls are joined to them.
SALTS = 16


@dataclass(frozen=True)
class Mining:
    """Which rules are kept.

    A rule must fit ``count`` labelled urls and the share ``support`` of them, and be right in the share ``confidence``
    of the urls it fits even at the lower end of the interval of ``deviations`` standard deviations (Wilson's), so that
    chance does not make it. All tokens of an url are combined. FP-growth takes over where no url has more than ``width``
    tokens left (the combinations of n tokens are 2^n); the others are first split by their rarest tokens. ``width``
    changes how much is done in which way, never the rules.
    """

    support: float = 0.002
    confidence: float = 0.5
    count: int = 5
    deviations: float = 1.96
    width: int = 10


def lower_bound(bad: Column, n: Column, z: float) -> Column:
    """The lower end of Wilson's interval of the share bad / n."""
    p = bad / n
    return (p + F.lit(z * z) / (2 * n) - z * F.sqrt((p * (1 - p) + F.lit(z * z) / (4 * n)) / n)) / (1 + F.lit(z * z) / n)


def host(url: Column) -> Column:
    return ascii_lower(F.when(url.contains("://"), F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)).otherwise(""))


def path(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def tokens(url: Column) -> Column:
    """Distinct tokens of an url: its host and the domains above it, path segments, file ending and query keys."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(F.reverse(labels), 1, i), ".")))
    segments = F.transform(F.split(path(url), "/"), lambda x: F.concat(F.lit("path="), x))
    ending = F.transform(F.regexp_extract_all(path(url), F.lit(r"\.([A-Za-z0-9]+)$"), F.lit(1)), lambda x: F.concat(F.lit("ending="), x))
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("key="), x))
    all_ = F.array_distinct(F.concat(domains, segments, ending, keys))
    return F.when(url.contains("://"), F.filter(all_, lambda x: ~x.isin("path=", "host="))).otherwise(F.array().cast("array<string>"))


def mine(pages: DataFrame, labels: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """The rules: antecedent (array of tokens), confidence, support (labelled urls that it fits and that are bad, as a share).

    A page is bad when the label row of its id (doc_id = page_id) has quality 0 or toxic 1; of several rows one
    suffices. Pages with a null id or url, and label rows with neither value, teach nothing. An empty table gives no
    rules. Rules are minimal: one whose tokens include those of another rule adds nothing and is left out.
    """
    y = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 0), F.lit(False)) | F.coalesce((F.col("toxic") == 1), F.lit(False))).alias("bad"))
    rows = pages.where("page_id is not null and url is not null").select(F.col("page_id").alias("doc_id"), tokens(F.col("url")).alias("t")).join(y, "doc_id").where(F.size("t") > 0)
    baskets = materialize(rows.select(F.monotonically_increasing_id().alias("b"), "t", F.col("bad").cast("int").alias("bad")), "baskets")
    total = baskets.count()
    least = max(mining.count, math.ceil(mining.support * total))
    none = baskets.select(F.col("t").alias("antecedent"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")).limit(0)
    if total < least:
        return none
    good = lambda bad, n: (bad >= mining.confidence * n) & (lower_bound(bad, n, mining.deviations) >= mining.confidence)
    bad_least = math.ceil(mining.confidence * least)
    # Conditional databases: the urls that hold all tokens of ``prefix`` (``held`` of them), with those of their other
    # tokens that come after it in the order. The first one has no prefix and all tokens.
    state = baskets.select("b", "bad", F.array().cast("array<string>").alias("prefix"), F.lit(total).cast("long").alias("held"), F.transform("t", lambda x: F.struct(x.alias("token"), F.lit(None).cast("long").alias("alone"))).alias("rest"))
    found, narrow = [], []
    while True:
        each = state.select("b", "bad", "prefix", "held", F.explode("rest").alias("x")).select("b", "bad", "prefix", "held", "x.token", "x.alone")
        counts = each.groupBy("prefix", "token").agg(F.count("*").alias("n"), F.sum("bad").alias("k"), F.max("held").alias("held"), F.max("alone").alias("alone"))
        counts = materialize(counts.where((F.col("n") >= least) & (F.col("k") >= bad_least)), "tokens")
        right = good(F.col("k"), F.col("n"))
        found.append(counts.where(right).select(F.array_append("prefix", F.col("token")).alias("antecedent"), "n", "k"))
        # What is a rule already is in no other minimal rule; neither is a token that all urls of the prefix hold, nor
        # one that no url without the prefix holds: leaving it, or the prefix, out fits the same urls.
        open_ = counts.where(~right & (F.col("n") < F.col("held")) & (F.col("alone").isNull() | (F.col("n") < F.col("alone"))))
        kept = each.drop("alone").join(open_.select("prefix", "token", "n", F.coalesce("alone", "n").alias("alone")), ["prefix", "token"])
        rest = F.array_sort(F.collect_list(F.struct("n", "token", "alone")))
        state = materialize(kept.groupBy("b", "bad", "prefix").agg(rest.alias("rest")).where(F.size("rest") > 1), "conditional")
        widest = materialize(state.groupBy("prefix").agg((F.max(F.size("rest")) > mining.width).alias("wide")), "prefixes")
        narrow.append(state.join(widest.where("not wide"), "prefix", "left_semi").select("bad", "prefix", F.transform("rest", lambda x: x["token"]).alias("rest")))
        wide = widest.where("wide")
        if wide.isEmpty():
            break
        split = state.join(wide, "prefix", "left_semi").select("b", "bad", "prefix", "rest", F.posexplode("rest").alias("i", "x"))
        after = F.transform(F.expr("slice(rest, i + 2, size(rest))"), lambda x: F.struct(x["token"].alias("token"), x["alone"].alias("alone")))
        state = materialize(split.select("b", "bad", F.array_append("prefix", F.col("x.token")).alias("prefix"), F.col("x.n").alias("held"), after.alias("rest")).where(F.size("rest") > 0), "split")

    rows = reduce(DataFrame.unionByName, narrow)
    # Items carry their prefix, so that one run mines all databases and combines none with another.
    rows = rows.withColumn("p", F.to_json("prefix")).select(F.transform(F.when(F.col("bad") == 1, F.array_append("rest", BAD)).otherwise(F.col("rest")), lambda x: F.to_json(F.struct(F.col("p").alias("p"), x.alias("x")))).alias("items"))
    items = materialize(rows, "items")
    many = items.count()
    growth = FPGrowth(itemsCol="items", minSupport=min(1.0, (bad_least - 0.5) / max(1, many)), numPartitions=max(pages.sparkSession.sparkContext.defaultParallelism, many // 50_000))
    item = F.transform("items", lambda x: F.from_json(x, "p string, x string"))
    sets = growth.fit(items).freqItemsets.select(item.alias("items"), "freq")
    sets = sets.select(F.from_json(F.get("items", F.lit(0))["p"], "array<string>").alias("prefix"), F.transform("items", lambda x: x["x"]).alias("items"), "freq")
    whole = F.array_sort(F.concat("prefix", F.array_remove("items", BAD)))
    sets = materialize(sets.select(whole.alias("antecedent"), F.array_contains("items", BAD).alias("bad"), F.size(F.array_remove("items", BAD)).alias("tokens"), "freq").where("tokens > 1"), "itemsets")
    pairs = sets.where("bad").select("antecedent", F.col("freq").alias("k")).join(sets.where("not bad").select("antecedent", F.col("freq").alias("n")), "antecedent")
    found.append(pairs.where((F.col("n") >= least) & good(F.col("k"), F.col("n"))).select("antecedent", "n", "k"))
    rules = reduce(DataFrame.unionByName, found).select(F.array_sort("antecedent").alias("antecedent"), (F.col("k") / F.col("n")).alias("confidence"), (F.col("k") / F.lit(total)).alias("support"))
    rules = materialize(rules, "rules")
    return rules.join(_longer(rules), "antecedent", "left_anti")


def _longer(rules: DataFrame) -> DataFrame:
    """The antecedents that hold all tokens of another one. Rules meet where they share a rule's first token."""
    short = rules.select(F.col("antecedent").alias("part"), F.get("antecedent", F.lit(0)).alias("token"))
    held = rules.select("antecedent", F.explode("antecedent").alias("token")).join(short, "token")
    return held.where((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0)).select("antecedent").distinct()


def flagged_urls(urls: DataFrame, rules: DataFrame, index_limit: int = 50_000) -> DataFrame:
    """The distinct urls that hold every token of some rule.

    Inverted index: each rule is posted under the one of its tokens that fewest rules hold. Only urls with that token
    are compared with it. The index is broadcast if it has at most ``index_limit`` rows, else joined by shuffle.
    """
    rules = materialize(rules.select("antecedent"), "minimal")
    each = rules.select("antecedent", F.explode("antecedent").alias("token"))
    common = each.groupBy("token").agg(F.count("*").alias("n"))
    index = materialize(each.join(common, "token").groupBy("antecedent").agg(F.min_by("token", F.struct("n", "token")).alias("token")), "index")
    own = urls.select("url").where("url is not null").distinct().withColumn("t", tokens(F.col("url")))
    own = own.withColumn("token", F.explode("t"))
    if index.count() <= index_limit:
        met = own.join(F.broadcast(index), "token")
    else:  # a token of most urls is dealt into SALTS parts
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = own.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"])
    return met.where(F.size(F.array_except("antecedent", "t")) == 0).select("url").distinct()


def judge(pages: DataFrame, rules: DataFrame, fixed=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    ``rule`` is the longest fixed rule whose host is the url's or a domain above it and with whose path the url's
    begins; its verdict holds. Without one ``rule`` is null, and the url is blocked if a mined rule fits, else
    allowed. A null url, or one without ``://``, has empty host and path and is allowed.
    """
    u = F.col("url")
    rows = pages.select("page_id", "url", F.coalesce(host(u), F.lit("")).alias("host"), F.coalesce(path(u), F.lit("")).alias("path"))
    choice = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(fixed, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        choice = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(choice)
    rows = rows.withColumn("fixed", choice)
    open_ = rows.where("fixed is null")
    # The pages of one url, however many, are dealt into SALTS parts by their id; the flagged urls go to each part.
    bad = flagged_urls(open_, rules).withColumn("bad", F.lit(True)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(bad, ["url", "salt"], "left")
    return joined.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
