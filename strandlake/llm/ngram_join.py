"""N-gram Jaccard join with a prefix tree, and the components of its links."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, WordHasher, discard, materialize, mix, small_batches, text_bytes

#: Share of the hash range whose n-grams are ordered by frequency and come first in the global order.
RANGE = 0.25
#: N-grams in one task of a tree join; larger groups are dealt into several.
BLOCK = 1 << 19
#: The keys with most rows, at most HOT of them, are dealt into SALTS parts when what is known of them is joined to their rows.
HOT, SALTS = 20_000, 32


def _shingles(hasher: WordHasher, column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; fewer than ``n`` words count as one n-gram, none as none."""
    raw, starts, ends = text_bytes(column)
    row, h, _, _ = hasher.run(raw, starts, ends)
    count = np.bincount(row, minlength=len(starts))
    first = np.cumsum(count) - count
    gram = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        gram = mix(gram + h[j : len(h) - n + 1 + j] + np.uint64(j + 1))
    out = []
    for a, k in zip(first, count, strict=True):
        if k >= n:
            out.append(np.unique(gram[a : a + k - n + 1]))
        elif k:
            x = np.full(1, k, np.uint64)
            for w in h[a : a + k]:
                x = mix(x * np.uint64(3) + w)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signature(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        return int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def prefix_length(size: int, num: int, den: int) -> int:
    """N-grams of which any set within the threshold shares one, wherever they stand in the order they come first in."""
    return size - -(-num * size // den) + 1


def _profile(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """For each row its set's size and signature, the n-grams of the ordered range, and those that follow if it has too few."""

    def run(batches):
        hasher, limit = WordHasher(NOT_SPACE), np.uint64(int(RANGE * 2.0**64))
        for batch in small_batches(batches, "text"):
            sets = _shingles(hasher, batch.column(1), n)
            head, tail, size, one, two = [], [], [], [], []
            for s in sets:
                cut = int(np.searchsorted(s, limit))
                need = prefix_length(len(s), num, den) if len(s) else 0
                head.append(s[:cut].view(np.int64))
                tail.append(s[cut : max(cut, need)].view(np.int64))
                size.append(len(s))
                a, b = _signature(s)
                one.append(a)
                two.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], ["doc_id", "size", "sig1", "sig2", "head", "tail"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, size long, sig1 long, sig2 long, head array<long>, tail array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the graph of ``edges`` (a, b): the smallest node of each component.

    Alternates the large-star and small-star steps, each a shuffle of the edges, until nothing changes. Every step is
    written to the shared folder; nothing but two numbers comes to the driver. Edges of a node with many are grouped
    by partial aggregates and joined, so that no task has to hold them.
    """
    state = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = state.union(state.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        before = state
        state = materialize(large.join(lower, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "edges")
        discard(before)
        got = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (got["n"], got["s"]) == mark:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(state.select("b", "b").distinct())
        mark = (got["n"], got["s"])


class Trie:
    """Sets of ranked n-grams as a prefix tree whose unbranched paths are a few edges, each twice as long as that before.

    Each node knows its parent, the n-grams of its edge and the range of sizes of the sets below it. A list for each
    n-gram names the sets that hold it in their prefix. A search enters only the subtrees in which the query's own prefix
    names a set, level by level in vectorised steps, so that sets which share nothing rare cost it nothing.
    """

    FIRST = 16

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        parent, start, end, source, term = [0], [0], [0], [order[0]], np.zeros(len(sets), np.int64)
        stack, before = [0], None
        for i in order:
            own = sets[i]
            shared = 0
            if before is not None:
                n = min(len(own), len(before))
                differ = own[:n] != before[:n]
                shared = int(differ.argmax()) if differ.any() else n
            last = 0
            while end[stack[-1]] > shared:
                last = stack.pop()
            if end[stack[-1]] < shared:  # the edge to ``last`` branches here
                parent.append(stack[-1]), start.append(end[stack[-1]]), end.append(shared), source.append(source[last])
                parent[last], start[last] = len(parent) - 1, shared
                stack.append(len(parent) - 1)
            if len(own) > shared:
                parent.append(stack[-1]), start.append(shared), end.append(len(own)), source.append(i)
                stack.append(len(parent) - 1)
            term[i] = stack[-1]
            before = own
        for k in range(1, len(parent)):
            width = self.FIRST
            while end[k] - start[k] > width:
                parent.append(parent[k]), start.append(start[k]), end.append(start[k] + width), source.append(source[k])
                parent[k], start[k] = len(parent) - 1, end[-1]
                width *= 2
        self.parent, self.end = np.array(parent), np.array(end)
        self.size = np.array([len(x) for x in sets])
        count = len(parent)
        self.low, self.high = np.full(count, np.iinfo(np.int64).max), np.zeros(count, np.int64)
        np.minimum.at(self.low, term, self.size)
        np.maximum.at(self.high, term, self.size)
        downward = np.argsort(np.array(start), kind="stable")
        downward = np.concatenate([[0], downward[downward != 0]])
        level = np.zeros(count, np.int64)
        for k in downward[1:]:
            level[k] = level[self.parent[k]] + 1
        for k in downward[:0:-1]:
            q = self.parent[k]
            self.low[q], self.high[q] = min(self.low[q], self.low[k]), max(self.high[q], self.high[k])
        self.level = level
        edges = [sets[source[k]][start[k] : end[k]] for k in range(count)]
        self.width = np.array([len(x) for x in edges])
        self.first = np.cumsum(self.width) - self.width
        self.grams = np.concatenate(edges)
        self.term = term
        heads = [x[: prefix_length(len(x), num, den)] for x in sets]
        posted = np.concatenate(heads)
        order = np.argsort(posted, kind="stable")
        self.posted, self.holder = posted[order], np.repeat(np.arange(len(sets)), [len(x) for x in heads])[order]
        self.overlap, self.alive = np.zeros(count, np.int64), np.zeros(count, bool)

    def search(self, query: np.ndarray, most: int | None = None) -> np.ndarray:
        """The sets of at most ``most`` n-grams with |a & b| / |a | b| >= num / den; subtrees go as soon as their bound is below it."""
        num, den, n = self.num, self.den, len(query)
        largest = den * n // num if most is None else min(most, den * n // num)
        head = query[: prefix_length(n, num, den)]
        a, b = np.searchsorted(self.posted, head, "left"), np.searchsorted(self.posted, head, "right")
        named = np.unique(np.concatenate([self.holder[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True) if i < j] or [self.holder[:0]]))
        named = named[(den * self.size[named] >= num * n) & (self.size[named] <= largest)]
        if not len(named):
            return named
        overlap, alive = self.overlap, self.alive
        alive[0], overlap[0] = True, 0
        paths, at = [], np.unique(self.term[named])
        while len(at):
            paths.append(at)
            at = np.unique(self.parent[at[at != 0]])
        paths = np.unique(np.concatenate(paths))
        level = self.level[paths]
        for d in range(1, int(level.max()) + 1):
            some = paths[level == d]
            some = some[alive[self.parent[some]]]
            if not len(some):
                break
            width = self.width[some]
            at = np.cumsum(width) - width
            grams = self.grams[np.repeat(self.first[some] - at, width) + np.arange(int(width.sum()))]
            place = np.searchsorted(query, grams)
            has = query[np.minimum(place, n - 1)] == grams
            now = overlap[self.parent[some]] + np.add.reduceat(has.astype(np.int64), at)
            end = at + width - 1
            rest = np.minimum(self.high[some] - self.end[some], n - place[end] - has[end])
            overlap[some] = now
            # Overlap c suffices for size s if (den + num) c >= num (n + s); the smallest size below asks least.
            alive[some] = (den + num) * (now + rest) >= num * (n + self.low[some])
        ok = alive[self.term[named]]
        both = overlap[self.term[named]]
        alive[paths] = False
        return named[ok & (den * both >= num * (n + self.size[named] - both))]


def ranked(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets with their n-grams as ranks, those that fewest of the sets hold first, so that sets that differ part early."""
    universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat = flat.reshape(-1)
    rank = np.empty(len(universe), np.int64)
    rank[np.argsort(np.bincount(flat, minlength=len(universe)), kind="stable")] = np.arange(len(universe))
    return [np.sort(rank[part]) for part in np.split(flat, np.cumsum([len(x) for x in sets])[:-1])]


def link_forest(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int, labels: np.ndarray | None = None, most: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among the sets that connect what all links do, without listing them.

    Sets of one label are connected already. From the sets of each label not yet reached, largest labels first, searches
    go on from all sets of every label they reach; those leave the tree when half of it is gone. ``most``: the size up
    to which a set looks for others, by its position filter.
    """
    labels = ids if labels is None else labels
    own: dict[int, list[int]] = {}
    for i, k in enumerate(labels.tolist()):
        own.setdefault(k, []).append(i)
    if len(own) < 2:
        return []
    sets = ranked(sets)
    edges, left = [], set(own)
    trie, inside = None, []
    for label in sorted(own, key=lambda k: (-len(own[k]), k)):
        if label not in left:
            continue
        left.discard(label)
        todo = list(own[label])
        while todo and left:
            if trie is None or 2 * len(left) < built:
                built = len(left)
                inside = [i for k in left for i in own[k]]
                trie = Trie([sets[i] for i in inside], num, den)
            at = todo.pop()
            for k in trie.search(sets[at], None if most is None else int(most[at])):
                other = inside[k]
                if int(labels[other]) in left:
                    left.discard(int(labels[other]))
                    todo += own[int(labels[other])]
                    edges.append((int(ids[at]), int(ids[other])))
    return edges


def _with_known(rows: DataFrame, known: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``rows`` joined with ``known``, a written table that has the keys' number of rows as ``k``; the hot keys' rows are dealt by ``column``."""
    total = known.agg(F.sum("k")).first()[0] or 0
    hot = F.col("k") >= max(1024, total // HOT)
    marks = known.where(hot).select(*keys, F.lit(True).alias("hot"))
    dealt = rows.join(F.broadcast(marks), keys, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    spread = known.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(spread.drop("k"), [*keys, "salt"]).drop("salt")


def _prefixes(profile: DataFrame, reps: DataFrame, num: int, den: int, keep) -> DataFrame:
    """rep, g, size, lo, hi, bucket: the prefix n-grams of each representative, and which sizes a partner can have whose first common n-gram it is.

    At place ``p`` of a set of ``size`` at most ``size - p`` n-grams can be common, which bounds the partner from above.
    Sets linked with each other are in the same bucket of sizes or in neighbouring ones.
    """
    one = profile.join(reps.select("sig1", "sig2", F.col("rep").alias("doc_id")), ["sig1", "sig2", "doc_id"]).select(F.col("doc_id").alias("rep"), "size", "head", "tail")
    held = one.select("rep", F.explode("head").alias("g"))
    shared = keep(held.groupBy("g").agg(F.count("*").alias("k")).where("k > 1"), "shared").withColumn("df", F.col("k"))
    heads = _with_known(held, shared, ["g"], "rep").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("shared"))
    sizes = one.select("rep", "size", F.size("head").alias("heads"), F.when(F.size("tail") > 0, F.col("tail")).alias("tail"))
    need = F.col("size") - F.expr(f"(size * {num} + {den} - 1) div {den}") + 1
    alone = F.col("heads") - F.size("shared")  # n-grams of the range that no other set has: they come first of all
    taken = F.slice(F.col("shared"), 1, F.greatest(F.lit(0), F.least(F.size("shared"), (need - alone).cast("int"))))
    none = F.array().cast("array<struct<df:bigint,g:bigint>>")
    place = lambda g, p: F.struct(g.alias("g"), p.cast("long").alias("p"))
    both = F.concat(F.transform(taken, lambda x, i: place(x["g"], alone + i)), F.transform(F.coalesce("tail", F.array().cast("array<bigint>")), lambda x, i: place(x, F.col("heads") + i)))
    rows = sizes.join(heads, "rep", "left").withColumn("shared", F.coalesce("shared", none)).select("rep", "size", F.explode(both).alias("x")).select("rep", "size", "x.g", "x.p")
    width = math.log(den / num) * 1.000001 + 1e-6
    lo, hi = F.expr(f"(size * {num} + {den} - 1) div {den}"), F.least(F.expr(f"size * {den} div {num}"), F.expr(f"(size - p) * {den + num} div {num} - size"))
    bucket = lambda n: F.floor(F.log(n) / F.lit(width)).cast("int")
    rows = rows.select("rep", "g", "size", lo.alias("lo"), hi.alias("hi"), bucket(F.col("size")).alias("bucket")).where("hi >= lo")
    return rows.withColumn("next", bucket(F.col("hi")) > F.col("bucket"))


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """rep, grams: the packed n-gram sets of the wanted representatives (rep, sig1)."""

    def run(batches):
        hasher, seen = WordHasher(NOT_SPACE), set()
        for batch in small_batches(batches, "text"):
            own = _shingles(hasher, batch.column(1), n)
            ok = []
            for i, s, sig in zip(batch.column(0).to_pylist(), own, batch.column(2).to_pylist(), strict=True):
                ok.append(i not in seen and _signature(s)[0] == sig)
                if ok[-1]:
                    seen.add(i)
            out = [batch.column(0), pa.array([s.tobytes() for s in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["rep", "grams"]).filter(pa.array(ok, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted.hint("shuffle_hash"), "rep")
    return texts.select("rep", "text", "sig1").mapInArrow(run, "rep long, grams binary")


def _linked(rows: DataFrame, keys: list[str], columns: list[str], links) -> DataFrame:
    """The edges (a, b) that ``links`` finds in the rows of each key, given the key's columns as arrays and the sets.

    Rows are sorted by key within partitions and read as a stream, so that a task holds one key at a time.
    """
    width = len(keys)

    def solve(held):
        arrays = [np.concatenate([np.asarray(b.column(width + i)) for b in held]) for i in range(len(columns))]
        return links(*arrays, [np.frombuffer(x, np.uint64) for b in held for x in b.column(width + len(columns)).to_pylist()])

    def run(batches):
        held, last = [], None
        for batch in batches:
            key = np.stack([np.asarray(batch.column(i), np.int64) for i in range(width)])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            edges = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                own = tuple(key[:, a])
                if held and own != last:
                    edges += solve(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = own
            yield _edges(edges)
        if held:
            yield _edges(solve(held))

    return rows.select(*keys, *columns, "grams").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], ["a", "b"])


def _star_links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The links among the pairs (rep, size, hub): each hub is looked up in trees of those that it is paired with."""
    many = pairs.groupBy("hub").agg(F.ceil(F.sum("size") / F.lit(BLOCK)).cast("int").alias("parts")).where("parts > 1")
    dealt = pairs.join(many, "hub", "left").select("hub", "rep", F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    rows = dealt.union(dealt.select("hub", F.col("hub").alias("rep"), "part").distinct()).join(sets, "rep")

    def links(hubs, reps, sets):
        hub = int(hubs[0])
        own = ranked(sets)
        spokes = np.flatnonzero(reps != hub)
        at = np.flatnonzero(reps == hub)
        if not len(at) or not len(spokes):
            return []
        found = Trie([own[i] for i in spokes], num, den).search(own[at[0]])
        return [(hub, int(reps[spokes[k]])) for k in found]

    return _linked(rows.withColumn("key", F.col("hub")), ["key", "part"], ["hub", "rep"], links)


def _cross_links(entries: DataFrame, sets: DataFrame, num: int, den: int, keep) -> DataFrame:
    """Links between different clusters, by tree joins where several clusters meet in an n-gram's bucket of sizes.

    ``entries`` has the columns of ``_prefixes`` and cluster. Sets of a bucket also visit the next one if the partner
    may be as large. What meets nowhere else is a group of its own, of which each set is sent once. Of groups above BLOCK
    n-grams, which may have chained up by common n-grams, each n-gram's bucket is joined by itself, and if that is above
    BLOCK, each pair of its parts.
    """
    rows = entries.withColumn("at", F.explode(F.when(F.col("next"), F.array(F.col("bucket"), F.col("bucket") + 1)).otherwise(F.array("bucket"))))
    group = rows.groupBy("g", "at").agg(F.min("cluster").alias("c0"), F.max("cluster").alias("c1"), F.max("bucket").alias("top"), F.min("rep").alias("hub"), F.count("*").alias("k"), F.ceil(F.sum("size") / F.lit(BLOCK)).cast("int").alias("parts"))
    open_ = keep(group.where("c0 != c1 and top = at").select("g", "at", "hub", "parts", "k"), "open")
    work = keep(_with_known(rows, open_, ["g", "at"], "rep").select("g", "at", "rep", "size", "cluster", "hi", "hub", "parts"), "work")
    group = keep(components(work.select(F.col("rep").alias("a"), F.col("hub").alias("b"))), "groups")
    members = work.select("rep", "size", "cluster").distinct().join(group.select(F.col("node").alias("rep"), "component"), "rep")
    members = keep(members.join(members.groupBy("component").agg((F.sum("size") > BLOCK).alias("wide")), "component"), "members")

    def whole(reps, clusters, sets):
        return link_forest(reps, sets, num, den, clusters)

    links = keep(_linked(members.where("not wide").join(sets, "rep"), ["component"], ["rep", "cluster"], whole), "links")
    dealt = work.join(members.where("wide").select("rep"), "rep", "left_semi").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, F.col("part")).alias("i"), F.greatest(j, F.col("part")).alias("j")))
    dealt = dealt.select("g", "at", "rep", "cluster", "hi", F.explode(pair).alias("x")).select("g", "at", "x.i", "x.j", "rep", "cluster", "hi")

    def one_gram(reps, clusters, most, sets):
        return link_forest(reps, sets, num, den, clusters, most)

    more = keep(_linked(dealt.join(sets, "rep"), ["g", "at", "i", "j"], ["rep", "cluster", "hi"], one_gram), "links")
    return links.union(more)


def jaccard_components(docs: DataFrame, n: int = 4, threshold: tuple[int, int] = (85, 100), size: str = "n_shingles", component: str = "component_id") -> DataFrame:
    """doc_id, the size of the set and the smallest doc_id reachable by links, for each row of ``docs``.

    A set: the distinct ``n``-word sequences of the whole text, A-Z in lower case; a shorter text is one sequence, one
    without words (or a null text) is empty and linked with nothing. Two sets are linked when their Jaccard similarity
    is at least the threshold, decided in integers over 64-bit n-gram hashes. Rows with a null doc_id get a null
    component; rows that share a doc_id count as one node; other columns are not read.

    Equal sets are one representative from the start. N-grams have a global order: those in a fixed range of hashes
    come first, ordered by how many sets hold them, then the others. A pair above the threshold has a first common
    n-gram in that order, in both prefixes, and its place and both sizes pass the length and positional filters.
    Representatives come first: in each n-gram's bucket of sizes all are compared with one of them, through prefix
    trees, and links that hold make clusters. Only where several clusters still meet in an n-gram are all compared,
    again through prefix trees. Nothing is connected that was not verified.
    """
    num, den = threshold
    profile = materialize(_profile(docs, n, num, den), "profile")
    reps = profile.where("size > 0 and doc_id is not null").groupBy("sig1", "sig2").agg(F.min("doc_id").alias("rep"), F.min("size").alias("size"))
    spent: list[DataFrame] = []
    keep = lambda df, name: spent.append(materialize(df, name)) or spent[-1]
    prefix = keep(_prefixes(profile, reps, num, den, keep), "prefix")
    shared = keep(prefix.groupBy("g").agg(F.count("*").alias("k"), F.min("size").alias("least"), F.max("size").alias("most")).where("k > 1"), "shared")
    entries = _with_known(prefix, shared, ["g"], "rep").where("hi >= least and lo <= most").drop("least", "most")
    entries = keep(entries, "entries")
    discard(*(x for x in spent if x is not entries))
    spent[:] = [entries]
    hubs = entries.groupBy("g", "bucket").agg(F.min(F.struct(F.col("rep").alias("hub"), F.col("size").alias("n"), F.col("lo").alias("from"), F.col("hi").alias("to"))).alias("h"), F.count("*").alias("k")).where("k > 1").select("g", "bucket", "h.*", "k")
    near = _with_known(entries, keep(hubs, "hubs"), ["g", "bucket"], "rep").where("rep != hub and size between from and to and n between lo and hi")
    pairs = keep(near.select("rep", "size", "hub").distinct(), "pairs")
    sets = keep(_sets(docs, entries.select("rep").distinct().join(reps.select("rep", "sig1"), "rep"), n), "sets")
    star = keep(_star_links(pairs, sets, num, den), "star")
    clusters = keep(components(star), "clusters")
    labelled = entries.join(clusters.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("cluster", F.coalesce("component", "rep")).drop("component")
    cross = _cross_links(labelled, sets, num, den, keep)
    found = materialize(components(cross.union(star)).select(F.col("node").alias("rep"), "component"), "components")
    discard(*spent)
    own = reps.join(found, "rep", "left").select("sig1", "sig2", F.coalesce("component", "rep").alias("least"))
    return profile.join(own, ["sig1", "sig2"], "left").select("doc_id", F.col("size").alias(size), F.when(F.col("doc_id").isNotNull(), F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("doc_id"))).alias(component))


def keep_one(docs: DataFrame, n: int = 4, threshold: tuple[int, int] = (85, 100)) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id; rows with a null doc_id stay."""
    gone = jaccard_components(docs, n, threshold).where("component_id != doc_id").select("doc_id")
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(n: int = 4, num: int = 85, den: int = 100) -> str:
    """The same in DuckDB SQL: every pair of sets that shares an n-gram is compared."""
    gram = " || chr(31) || ".join(f"w[i + {j}]" for j in range(n))
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, chr(31))] ELSE list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: {gram})) END AS g FROM d),
k AS (SELECT g, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g),
e AS (SELECT rep, len(g) AS n, unnest(g) AS x FROM k),
l AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND {num} * a.n <= {den} * b.n AND {num} * b.n <= {den} * a.n GROUP BY a.rep, b.rep, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c(node, root) AS (SELECT rep, rep FROM k UNION SELECT u.b, c.root FROM c JOIN u ON u.a = c.node WHERE c.root < u.b),
r AS (SELECT node, min(root) AS root FROM c GROUP BY node)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(r.root, s.doc_id)::BIGINT AS component_id
FROM s LEFT JOIN k ON list_sort(s.g) = k.g LEFT JOIN r ON r.node = k.rep"""
