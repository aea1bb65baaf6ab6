"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block of queries and of a block of candidates.
QUERIES, CANDIDATES = 4096, 16384
_TILE = 2048


def _matrix(table: pa.Table, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, hashes of the vectors, weights [rows, terms]) of a block; missing terms weigh 0. Vectors of other lengths are padded."""
    column = table.column("embedding").combine_chunks()
    ends = np.cumsum(np.asarray(pa.compute.list_value_length(column)))
    flat = np.floor(np.asarray(column.flatten(), np.float64) * scale)
    size = np.diff(np.concatenate([[0], ends]))
    row = np.repeat(np.arange(len(size)), size)
    term = np.arange(len(flat)) - np.repeat(ends - size, size)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[row, term] = flat
    return table.column("vec_id").to_numpy(), table.column("own").to_numpy(), out


def _accumulate(q: np.ndarray, w: np.ndarray, kind) -> np.ndarray:
    """Scores [queries, candidates]: for each term, its postings times the queries' weights are added."""
    terms = min(q.shape[1], w.shape[1])
    scores = np.zeros((len(q), len(w)), kind)
    part = np.empty_like(scores)
    for t in range(terms):
        asked = np.flatnonzero(q[:, t])
        posted = np.flatnonzero(w[:, t])
        if not len(asked) or not len(posted):
            continue
        if 2 * len(posted) > len(w) and 2 * len(asked) > len(q):  # a long postings list: its zeros add nothing
            np.multiply(q[:, t, None], w[None, :, t], out=part)
            scores += part
        else:
            scores[np.ix_(asked, posted)] += q[asked, t, None] * w[None, posted, t]
    return scores


def search_block(query_ids, query_own, q, ids, own, w, k: int):
    """The best ``k`` candidates of the block for each query, all but rows of its id and vector: (query, its vector's hash, candidate, score)."""
    terms = min(q.shape[1], w.shape[1])
    largest = np.abs(q).max(initial=0) * np.abs(w).max(initial=0) * max(1, terms)
    kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else object
    order = np.argsort(ids, kind="stable")
    ids, own, w = ids[order], own[order], w[order]
    if kind is object:
        q, w = (np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (q, w))
    else:
        q, w = q.astype(kind), w.astype(kind)
    out = []
    for a in range(0, len(q), 64):
        best_s, best_i = None, None
        for b in range(0, len(w), _TILE):
            s = _accumulate(q[a : a + 64], w[b : b + _TILE], kind)
            i = np.broadcast_to(np.arange(b, min(b + _TILE, len(w))), s.shape)
            if kind is not object:
                s = np.where((ids[i] == query_ids[a : a + 64, None]) & (own[i] == query_own[a : a + 64, None]), -np.inf, s)
            if best_s is not None:
                s, i = np.concatenate([best_s, s], 1), np.concatenate([best_i, i], 1)
            if kind is not object and s.shape[1] > 4 * k:
                at = _select(s, k)
                s, i = np.take_along_axis(s, at, 1), np.take_along_axis(i, at, 1)
            best_s, best_i = s, i
        for row, qid in enumerate(query_ids[a : a + 64]):
            which = int(query_own[a + row])
            found = [(-int(s), int(i)) for s, i in zip(best_s[row], best_i[row]) if ids[i] != qid or own[i] != which]
            out += [(int(qid), which, int(ids[i]), max(-(1 << 63), min((1 << 63) - 1, -s))) for s, i in sorted(found)[:k]]
    return out


def _select(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, of equal ones those further left, in ascending order of column."""
    n = s.shape[1]
    top = np.partition(s, n - k, 1)[:, n - k, None]
    above, equal = s > top, s == top
    room = k - above.sum(1, keepdims=True)
    take = above | (equal & (np.cumsum(equal, 1) <= room))
    return np.nonzero(take)[1].reshape(len(s), k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` best candidates by integer inner product.

    Components become floor(scale * x). Every row of ``vectors`` is a candidate but those equal to the query in id and
    vector; fewer than ``k`` give fewer rows; ties go to the smaller vec_id. Rows with a null id, a null vector or a
    component that is null or not finite take no part. Vectors may differ in length (missing terms weigh 0). Of several
    candidates with one vec_id each counts; of several queries with one vec_id each different vector gets its own ranks,
    and equal ones are one query. Other columns are not read.

    Queries and candidates are dealt into blocks of bounded size by a hash of the row; every pair of blocks is scored
    in a task of its own, and only its best rows are shuffled on, to be merged. At most Q * N / CANDIDATES rows of
    queries and N * Q / QUERIES rows of candidates are sent.
    """
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable).withColumn("own", F.xxhash64("embedding"))
    rows, asked = clean(vectors), clean(queries).dropDuplicates(["vec_id", "own"])
    nq, nc = max(1, math.ceil(asked.count() / QUERIES)), max(1, math.ceil(rows.count() / CANDIDATES))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "own"), F.lit(n)).cast("int")
    left = asked.withColumn("qb", deal(nq)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    right = rows.withColumn("cb", deal(nc)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        found = search_block(*_matrix(q, scale), *_matrix(c, scale), k) if q.num_rows and c.num_rows else []
        columns = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("query_id", "own", "vec_id", "score"), columns, strict=True)})

    best = left.groupBy("qb", "cb").cogroup(right.select("vec_id", "embedding", "own", "qb", "cb").groupBy("qb", "cb")).applyInArrow(run, "query_id long, own long, vec_id long, score long")
    order = Window.partitionBy("query_id", "own").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 20) -> str:
    return f"""
WITH v AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
q AS (SELECT DISTINCT vec_id, embedding, w FROM v WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, q.embedding AS e, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score FROM q JOIN v c ON q.vec_id <> c.vec_id OR q.embedding <> c.embedding),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
