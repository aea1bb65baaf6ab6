"""Ranked lexical search: shards of block-compressed postings, searched by block-max MaxScore, their best rows merged."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import ALNUM, WordHasher, materialize, small_batches, text_bytes

#: Postings of a block; bytes of text and documents of a shard; bytes of text that are sorted at once.
BLOCK, SHARD_BYTES, SHARD_DOCS, SLICE = 64, 16 << 20, 1 << 16, 4 << 20
#: Terms of the queries that are searched in one pass over the index.
QUERY_TERMS = 1 << 20
#: Of a document's length: the part that counts whatever it is, and in proportion to the mean.
FLAT, SLOPE = 10, 90
_FIELDS = {"n": "<u4", "terms": "<u8", "t_blocks": "<u4", "b_size": "u1", "b_last": "<u4", "b_width": "u1", "s_size": "u1", "s_tf": "<u4", "s_n": "<u4", "payload": "u1"}


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Where groups of these sizes start, and the end of the last."""
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of the groups laid end to end."""
    return np.arange(int(sizes.sum())) - np.repeat(_starts(sizes)[:-1], sizes)


def count_terms(hasher: WordHasher, raw, starts, ends):
    """(hash, row, occurrences) of the terms of a slice of texts, by hash and row. A longer text goes through in cuts."""
    found = []
    cuts = hasher._cuts(raw, int(starts[0]), int(ends[0]), SLICE) if len(starts) == 1 and ends[0] - starts[0] > SLICE else [None]
    for cut in cuts:
        a, b = (starts, ends) if cut is None else (np.array(cut[:1]), np.array(cut[1:]))
        row, term, _, _ = hasher.run(raw, a, b)
        order = np.argsort(term, kind="stable")
        found.append(_merge(term[order], row[order], np.ones(len(row), np.int64)))
    return found[0] if len(found) == 1 else _merge(*_sorted(found))


def _sorted(found):
    term, row, tf = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(term, kind="stable")  # rows ascend already
    return term[order], row[order], tf[order]


def _merge(term, row, tf):
    """Equal neighbours (term, row) as one, occurrences added."""
    if not len(term):
        return term, row, tf
    new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])]))
    return term[new], row[new], np.add.reduceat(tf, new)


def encode(term, doc, tf, n) -> dict[str, np.ndarray]:
    """The arrays of a shard: postings sorted by (term, doc) as compressed blocks; ``n`` is each document's length.

    A block's skyline holds its pairs (tf, n) that no other pair of the block beats in both, so that the block's largest
    score is known without its postings, for whatever statistics the corpus has by then.
    """
    new = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    length = np.diff(np.append(new, len(term)))
    t_blocks = -(-length // BLOCK)
    size = np.full(int(t_blocks.sum()), BLOCK)
    ends = np.cumsum(t_blocks) - 1
    size[ends] = length - (t_blocks - 1) * BLOCK
    start = _starts(size)
    block = np.repeat(np.arange(len(size)), size)
    last = doc[start[1:] - 1] if len(size) else doc[:0]
    gap = doc.copy()
    gap[1:] -= np.where(term[1:] == term[:-1], doc[:-1], 0)
    widths = lambda x: np.where(x < 1 << 8, 1, np.where(x < 1 << 16, 2, 4))
    tops = lambda x: widths(np.maximum.reduceat(x, start[:-1])) if len(size) else np.zeros(0, np.int64)
    wd, wt = tops(gap), tops(tf)
    byte = _starts(size * (wd + wt))
    payload, at = np.zeros(int(byte[-1]), np.uint8), _within(size)
    for value, width, base in ((gap, wd, byte[:-1]), (tf, wt, byte[:-1] + size * wd)):
        place = base[block] + at * width[block]
        for k in range(4):
            own = width[block] > k
            payload[place[own] + k] = (value[own] >> (8 * k)) & 255
    order = np.lexsort((-tf, n[doc], block))
    b, t = block[order], tf[order]
    top = np.maximum.accumulate(b * (np.int64(1) << 33) + t)
    seen = np.concatenate([[True], top[1:] > top[:-1]]) if len(b) else np.zeros(0, bool)
    return {"n": n, "terms": term[new], "t_blocks": t_blocks, "b_size": size, "b_last": last, "b_width": wd * 8 + wt, "s_size": np.bincount(b[seen], minlength=len(size)), "s_tf": t[seen], "s_n": n[doc[order][seen]], "payload": payload}


def build_index(docs: DataFrame) -> DataFrame:
    """A row for each shard of ``docs``: doc_ids, n_docs (those with a term), n_terms, and the arrays of ``encode`` as bytes.

    Shards are made of the rows of one task as they are read, so no posting is shuffled; they do not depend on each other
    or on any statistic, so that an index grows by appending. Terms are known by 64-bit hashes.
    """

    def shard(ids, found, n) -> pa.RecordBatch:
        parts = encode(*_merge(*_sorted(found)), n)
        arrays = {"doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "n_docs": pa.array([int((n > 0).sum())], pa.int64()), "n_terms": pa.array([int(n.sum())], pa.int64())}
        return pa.RecordBatch.from_pydict(arrays | {k: pa.array([parts[k].astype(kind).tobytes()], pa.binary()) for k, kind in _FIELDS.items()})

    def run(batches):
        hasher = WordHasher(ALNUM)
        ids, found, lengths, size, rows = [], [], [], 0, 0
        for batch in small_batches(batches, "text", SLICE):
            raw, starts, ends = text_bytes(batch.column(1))
            more = int((ends - starts).sum())
            if rows and (size + more > SHARD_BYTES or rows + batch.num_rows > SHARD_DOCS):
                yield shard(pa.concat_arrays(ids), found, np.concatenate(lengths))
                ids, found, lengths, size, rows = [], [], [], 0, 0
            term, row, tf = count_terms(hasher, raw, starts, ends)
            ids.append(batch.column(0))
            found.append((term, row + rows, tf))
            lengths.append(np.bincount(row, tf, batch.num_rows).astype(np.int64))
            size, rows = size + more, rows + batch.num_rows
        if rows:
            yield shard(pa.concat_arrays(ids), found, np.concatenate(lengths))

    fields = [T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType()), *(T.StructField(k, T.BinaryType()) for k in _FIELDS)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, T.StructType(fields))


def discount(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """The length norm m of documents of ``n`` terms."""
    if SLOPE * docs * int(n.max(initial=0)) >= 1 << 63:
        return np.array([FLAT + SLOPE * int(x) * docs // terms for x in n], np.int64)
    return FLAT + SLOPE * docs * n.astype(np.int64) // max(1, terms)


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a weight is multiplied by for ``tf`` occurrences in a document of norm ``m``; grows with tf, falls with m."""
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Shard:
    """A stored shard opened for searching: each block's largest share is known, its postings are decoded when asked for."""

    def __init__(self, fields: dict[str, bytes], docs: int, terms: int):
        for k, kind in _FIELDS.items():
            setattr(self, k, np.frombuffer(fields[k], kind) if k in fields else None)
        self.block = _starts(self.t_blocks)
        self.top = np.maximum.reduceat(share(self.s_tf, discount(self.s_n, docs, terms)), _starts(self.s_size)[:-1]) if len(self.b_size) else np.zeros(0, np.int64)
        if self.n is not None:
            self.m = discount(self.n, docs, terms)
            self.wd, self.wt = (self.b_width // 8).astype(np.int64), (self.b_width % 8).astype(np.int64)
            self.byte = _starts(self.b_size * (self.wd + self.wt))
            self.last = self.b_last.astype(np.int64)
            self.kept: dict[int, tuple] = {}

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The places of ``terms`` in the shard, -1 for those it lacks."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def decode(self, blocks: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, tf) of some ascending blocks of the list that starts at block ``first``."""
        size = self.b_size[blocks].astype(np.int64)
        at, each = _within(size), np.repeat(np.arange(len(blocks)), size)
        wd, wt, byte = self.wd[blocks], self.wt[blocks], self.byte[blocks]
        values = []
        for width, base in ((wd, byte), (wt, byte + size * wd)):
            place, width = base[each] + at * width[each], width[each]
            value = self.payload[place].astype(np.int64)
            for k in (1, 2, 3):
                own = np.flatnonzero(width > k)
                if not len(own):
                    break
                value[own] |= self.payload[place[own] + k].astype(np.int64) << (8 * k)
            values.append(value)
        before = np.where(blocks > first, self.last[blocks - 1], 0)
        run = np.cumsum(values[0])
        head = _starts(size)[:-1]
        return run - np.repeat(run[head] - values[0][head] - before, size), values[1]

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, shares) of a whole list; the queries of a task share what was decoded."""
        if t not in self.kept:
            doc, tf = self.decode(np.arange(self.block[t], self.block[t + 1]), self.block[t])
            self.kept[t] = doc, share(tf, self.m[doc])
        return self.kept[t]

    def look_up(self, t: int, docs: np.ndarray, least: np.ndarray, w: int) -> np.ndarray:
        """Scores that term ``t`` adds to ascending ``docs``; -1 where even its block's maximum stays under ``least``.

        Blocks all of whose documents are rejected are not decoded.
        """
        lo, hi = self.block[t], self.block[t + 1]
        b = lo + np.searchsorted(self.last[lo:hi], docs)
        inside = b < hi
        top = np.where(inside, self.top[np.minimum(b, hi - 1)] * w, 0)
        out = np.where(top < least, -1, 0)
        asked = np.flatnonzero(inside & (out == 0))
        if len(asked):
            if t in self.kept:
                doc, part = self.kept[t]
            else:
                doc, tf = self.decode(np.unique(b[asked]), lo)
                part = share(tf, self.m[doc])
            at = np.minimum(np.searchsorted(doc, docs[asked]), len(doc) - 1)
            hit = doc[at] == docs[asked]
            out[asked[hit]] = part[at[hit]] * w
        return out


class Best:
    """The ``k`` best (score, doc_id) of a query so far; of equal scores the smaller doc_id, null last."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def floor(self) -> int:
        """Less than this score is of no use."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score, doc, null) -> None:
        own = score >= self.floor()
        score, doc, null = (np.concatenate(x) for x in ((self.score, score[own]), (self.doc, doc[own]), (self.null, null[own])))
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


def search_shard(shard: Shard, ids: np.ndarray, null: np.ndarray, terms: np.ndarray, weights: np.ndarray, bounds: np.ndarray, best: Best) -> None:
    """Adds a shard's documents to ``best``. ``bounds``: the most that each term of the query adds to any document of the corpus."""
    at = shard.find(terms)
    own = np.flatnonzero((at >= 0) & (bounds > 0))
    own = own[np.argsort(bounds[own], kind="stable")]
    at, weights, upto = at[own], weights[own], np.cumsum(bounds[own])
    if not len(own):
        return

    def complete(docs: np.ndarray, partial: np.ndarray, lists: int) -> None:
        """Scores ``docs`` in the first ``lists`` lists, from the one with the largest bound on, dropping who cannot get in."""
        least = best.floor()
        for j in range(lists - 1, -1, -1):
            rest = int(upto[j - 1]) if j else 0
            more = shard.look_up(int(at[j]), docs, least - rest - partial, int(weights[j]))
            stays = more >= 0
            docs, partial = docs[stays], (partial + more)[stays]
            if not len(docs):
                return
        best.add(partial, ids[docs], null[docs])

    def gather(lists) -> np.ndarray:
        acc = np.zeros(len(shard.n), np.int64)
        for j in lists:
            doc, part = shard.postings(int(at[j]))
            acc[doc] += part * int(weights[j])
        return acc

    done = np.zeros(0, np.int64)
    if best.floor() == 1:  # no threshold yet: the documents of the lists with the largest bounds give one
        j, n = len(own), 0
        while j and n < best.k:
            j -= 1
            n += int(shard.b_size[shard.block[at[j]] : shard.block[at[j] + 1]].sum())
        acc = gather(range(j, len(own)))
        done = np.flatnonzero(acc)
        complete(done, acc[done], j)
    first = int(np.searchsorted(upto, best.floor()))  # the lists before this one together do not reach the threshold
    if first < len(own):
        acc = gather(range(first, len(own)))
        acc[done] = 0
        docs = np.flatnonzero(acc)
        partial = acc[docs]
        near = partial + (int(upto[first - 1]) if first else 0) >= best.floor()
        complete(docs[near], partial[near], first)


def _stored(row: pa.RecordBatch, names) -> dict[str, bytes]:
    return {k: row.column(k)[0].as_buffer() for k in names}


def term_bounds(index: DataFrame, terms: np.ndarray, docs: int, total: int) -> DataFrame:
    """at, df, top: for each of the ascending ``terms`` the documents that hold it and the largest share in any of them."""
    names = ["terms", "t_blocks", "b_size", "s_size", "s_tf", "s_n"]

    def run(batches):
        df, top = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                s = Shard(_stored(batch.slice(i, 1), names), docs, total)
                at = s.find(terms)
                own = np.flatnonzero(at >= 0)
                if len(own):
                    head = s.block[:-1]
                    df[own] += np.add.reduceat(s.b_size.astype(np.int64), head)[at[own]]
                    top[own] = np.maximum(top[own], np.maximum.reduceat(s.top, head)[at[own]])
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at]), pa.array(top[at])], ["at", "df", "top"])

    return index.select(*names).mapInArrow(run, "at long, df long, top long").groupBy("at").agg(F.sum("df").alias("df"), F.max("top").alias("top"))


def _search(index: DataFrame, block: list[tuple], k: int, docs: int, total: int) -> DataFrame:
    """query, doc_id, score: the best ``k`` documents of each task's shards for the queries (arrays of hashes)."""
    terms = np.unique(np.concatenate(block))
    weights, tops = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    for r in term_bounds(index, terms, docs, total).collect():
        weights[r["at"]], tops[r["at"]] = weight(r["df"], docs), r["top"]
    own = [np.searchsorted(terms, q) for q in block]

    def run(batches):
        best = [Best(k) for _ in own]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = row.column("doc_ids").flatten()
                null = np.asarray(ids.is_null())
                number = ids.fill_null(0).to_numpy()
                s = Shard(_stored(row, _FIELDS), docs, total)
                for b, q in zip(best, own, strict=True):
                    search_shard(s, number, null, terms[q], weights[q], weights[q] * tops[q], b)
        for i in range(0, len(best), 4096):
            part = list(enumerate(best))[i : i + 4096]
            query = np.concatenate([np.full(len(b.score), j) for j, b in part])
            doc, null, score = (np.concatenate([getattr(b, x) for _, b in part]) for x in ("doc", "null", "score"))
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(doc, pa.int64(), mask=null), pa.array(score, pa.int64())], ["query", "doc_id", "score"])

    return index.select("doc_ids", *_FIELDS).mapInArrow(run, "query long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``k`` documents with the highest scores above 0.

    Terms are runs of letters, digits and non-ASCII characters, A-Z in lower case. Every row of ``docs`` is a document,
    repeated ones too; those without a term (null, empty) count nowhere. A null doc_id comes after others of its score.
    Equal scores go by doc_id. Items without a term give no rows; repeated rows of an item are one, and different texts
    of one item_id are ranked each for itself. Other columns are not read.

    The index is written once. The items are the stated query set: they come to the driver and go to the tasks in blocks
    of at most QUERY_TERMS terms (or one item), and each block is a pass over the index. A task keeps one heap for each
    item over all its shards, so that ``k`` rows of an item for each task are shuffled.
    """
    index = materialize(build_index(docs), "index")
    counts = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n, total = counts["docs"] or 0, counts["terms"] or 0
    hasher, out = WordHasher(ALNUM), None
    kind = items.schema["item_id"].dataType

    def ranked(block, names):
        found = _search(index, block, k, n, total)
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        known = docs.sparkSession.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("query", T.LongType()), T.StructField("item_id", kind)]))
        return best.join(F.broadcast(known), "query").select("item_id", "rank", "doc_id", "score")

    block, names, size = [], [], 0
    for r in items.select("item_id", "text").where("text is not null").distinct().toLocalIterator():
        raw, starts, ends = text_bytes(pa.array([r["text"]]))
        terms = np.unique(hasher.run(raw, starts, ends)[1])
        if block and size + len(terms) > QUERY_TERMS:
            out = ranked(block, names) if out is None else out.unionByName(ranked(block, names))
            block, names, size = [], [], 0
        if len(terms):
            block.append(terms)
            names.append(r["item_id"])
            size += len(terms)
    if block:
        out = ranked(block, names) if out is None else out.unionByName(ranked(block, names))
    if out is None:
        return docs.sparkSession.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    return out


def oracle(k: int = 10) -> str:
    words = lambda x: rf"regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
q AS (SELECT row_number() OVER () AS q, item_id, list_distinct({words('text')}) AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
qt AS (SELECT q, item_id, unnest(w) AS term FROM q),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
x AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * ({FLAT} + ({SLOPE} * n * n_docs) // n_terms))))::BIGINT AS score FROM qt JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {k}"""
