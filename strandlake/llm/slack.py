"""Packing of token sequences with minimum bin slack: subset sums choose what fills each window, cuts close what is left open."""

from __future__ import annotations

import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, small_batches
from .packing import _encoder

#: Bits of a rank among pieces of one length, in the keys by which runs are found.
RANK_BITS = 38
#: Pieces cut by the plan up to which their keys are sent to all tasks.
BROADCAST_CUTS = 100_000


def tokens(docs: DataFrame, model: str, capacity: int = 4096, end: int = 2, memo: bool = True) -> DataFrame:
    """key, doc_id, start, length, doc_tokens, ids_crc32, ids of every document's pieces before packing.

    A document is its text's ids (null: none) and then ``end``; one longer than ``capacity`` is cut into pieces of
    ``capacity``, the last may be shorter. ``key`` tells the rows of one written table apart. ``ids`` are little-endian
    numbers of two bytes, or of four where one needs it; null where a piece fills a sequence alone.
    """

    def run(batches):
        encode = _encoder(model, memo)
        tail, key = np.array([end], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        for batch in small_batches(batches, "text"):
            out = []
            for r, text in enumerate(batch.column(1).to_pylist()):
                data = (encode(text) if text else b"") + tail
                for at in range(0, len(data), 4 * capacity):
                    part = data[at : at + 4 * capacity]
                    n, ids = len(part) // 4, None
                    if n < capacity:
                        wide = np.frombuffer(part, "<u4")
                        ids = wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else part
                    out.append((key, r, at // 4, n, len(data) // 4, zlib.crc32(part), ids))
                    key += 1
            keys, row, start, length, whole, crc, ids = zip(*out, strict=True)
            columns = [pa.array(keys, pa.int64()), batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, whole, crc)), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "key long, doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary")


def closest(count: np.ndarray, target: int) -> tuple[int, dict[int, int]]:
    """The multiset of lengths, each at most as often as ``count`` has it, whose sum is closest to ``target`` from below: (sum, length -> how often).

    The reachable sums are the bits of a number; long lengths come first, and the search ends when the target is reached.
    The counts are found backwards: of each length as few as lead to a sum that was reachable before it.
    """
    reach, mask, steps = 1, (1 << (target + 1)) - 1, []
    for n in np.flatnonzero(count[1 : target + 1])[::-1] + 1:
        n, before, left, step = int(n), reach, min(int(count[n]), target // int(n)), 1
        while left:  # 1, 2, 4, ... copies and the rest make every number of copies
            step = min(step, left)
            reach |= reach << (step * n)
            left, step = left - step, 2 * step
        reach &= mask
        steps.append((n, before))
        if reach >> target:
            break
    total = at = reach.bit_length() - 1
    chosen = {}
    for n, before in reversed(steps):
        while not before >> at & 1:
            at -= n
            chosen[n] = chosen.get(n, 0) + 1
    return total, chosen


@dataclass
class Layout:
    """Where pieces go: runs of (piece length, first rank, count, begin, length, first sequence, offset).

    The i-th piece of a run has its ids from ``begin`` on in sequence first + i. ``cut``: pieces that the plan cuts.
    """

    runs: np.ndarray
    sequences: int = 0
    cut: int = 0


def plan(histogram: dict[int, int], capacity: int = 4096) -> Layout:
    """A packing of the pieces counted in ``histogram`` into windows of ``capacity``; without any padding.

    Each window takes the longest piece that is left and the multiset of remaining lengths closest to what it lacks; it
    is repeated while its pieces last. Where no multiset fills a window, the longest other piece is cut to do so, and its
    rest stays in play. When less than a window is left, the windows are the powers of two that the rest is the sum of.
    The work depends on the capacity, not on the counts.
    """
    count = np.zeros(capacity + 1, np.int64)
    pool: dict[int, deque] = {}
    for n, k in histogram.items():
        count[n] = k
        pool[n] = deque([(n, 0, k, 0)])
    runs, sequence, cut = [], 0, 0

    def put(n: int, times: int, length: int, offset: int) -> None:
        """The first ``length`` ids of ``times`` pieces of ``n`` go to the windows from ``sequence`` on; rests stay."""
        nonlocal cut
        window, rests = sequence, []
        count[n] -= times
        while times:
            piece, rank, k, begin = pool[n].popleft()
            use = min(k, times)
            if use < k:
                pool[n].appendleft((piece, rank + use, k - use, begin))
            runs.append((piece, rank, use, begin, length, window, offset))
            if length < n:
                rests.append((piece, rank, use, begin + length))
                cut += use * (begin == 0)
            window, times = window + use, times - use
        for piece, rank, k, begin in rests:
            pool.setdefault(n - length, deque()).append((piece, rank, k, begin))
            count[n - length] += k

    left = sum(n * k for n, k in histogram.items())
    while left:
        width = min(capacity, 1 << (left.bit_length() - 1)) if left < capacity else capacity
        seed = int(np.flatnonzero(count)[-1])
        if seed >= width:
            times = int(count[seed]) if seed == width == capacity else 1
            put(seed, times, width, 0)
            sequence, left = sequence + times, left - times * width
            continue
        count[seed] -= 1
        total, chosen = closest(count, width - seed)
        count[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        lacks, other = width - seed - total, 0
        if lacks:  # every piece that is left is longer than what is lacking, or it would have been chosen
            rest = count.copy()
            for n, k in chosen.items():
                rest[n] -= k
            other = int(np.flatnonzero(rest)[-1])
        times = min(int(count[n]) // (k + (n == other)) for n, k in chosen.items())
        if other and other not in chosen:
            times = min(times, int(count[other]))
        offset = 0
        for n in sorted(chosen, reverse=True):
            for _ in range(chosen[n]):
                put(n, times, n, offset)
                offset += n
        if other:
            put(other, times, lacks, offset)
        sequence, left = sequence + times, left - times * width
    return Layout(np.array(sorted(runs), np.int64).reshape(-1, 7), sequence, cut)


def place(pieces: DataFrame, layout: Layout, capacity: int) -> DataFrame:
    """A row for each part of ``pieces`` in a sequence: key, doc_id, start, length, doc_tokens, ids_crc32 (of the whole piece), begin, whole, sequence_id, offset.

    Ranks are counted in salted groups, so that a length which a third of the pieces have is no task of its own; the ids
    are not shuffled.
    """
    salts = max(16, layout.sequences >> 16)
    salted = pieces.drop("ids").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "salt").orderBy("key")
    ranked = salted.withColumn("at", F.row_number().over(inside) - 1).join(first, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("at"))
    runs = layout.runs
    names = ["key", "doc_id", "start", "length", "doc_tokens", "ids_crc32", "begin", "whole", "sequence_id", "offset"]

    def run(batches):
        code = lambda n, begin, rank: ((n * (capacity + 1) + begin) << RANK_BITS) + rank
        keys = code(runs[:, 0], runs[:, 3], runs[:, 1])
        order = np.argsort(keys)
        keys, own = keys[order], runs[order]
        for batch in batches:
            whole, rank = (np.asarray(batch.column(i)) for i in (3, 6))
            row, begin = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            while len(row):
                i = np.searchsorted(keys, code(whole[row], begin, rank[row]), "right") - 1
                length = own[i, 4]
                part = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.asarray(part.column(2)) + begin), pa.array(length), part.column(4), part.column(5), pa.array(begin), pa.array(length == whole[row]), pa.array(own[i, 5] + rank[row] - own[i, 1]), pa.array(own[i, 6])], names)
                more = begin + length < whole[row]
                row, begin = row[more], (begin + length)[more]

    kinds = {"whole": "boolean"}
    return ranked.select("key", "doc_id", "start", "length", "doc_tokens", "ids_crc32", "rank").mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names))


def with_ids(places: DataFrame, pieces: DataFrame) -> DataFrame:
    """``places`` with ``ids``, the token ids of each, and their own ids_crc32."""
    names = places.columns

    def run(batches):
        for batch in small_batches(batches, "ids"):
            begin, length, full = (batch.column(c).to_pylist() for c in ("begin", "length", "n"))
            ids = []
            for data, a, k, n in zip(batch.column("ids").to_pylist(), begin, length, full, strict=True):
                ids.append(np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")[a : a + k].astype("<u4").tobytes())
            own = {c: batch.column(c) for c in names} | {"ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
            yield pa.RecordBatch.from_pydict(own)

    joined = places.join(pieces.select("key", "ids", F.col("length").alias("n")), "key")
    return joined.select(*names, "ids", "n").mapInArrow(run, places.select("*", F.lit(b"").alias("ids")).schema)


def pack(docs: DataFrame, model: str, capacity: int = 4096, end: int = 2, memo: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every row of ``docs``.

    Every sequence is full: ``capacity`` ids, but for at most one sequence of each smaller power of two. A null text
    counts as empty, so that every row has at least its end token; a null doc_id stays null; repeated rows are packed as
    often as they come; an empty table gives no rows; other columns are not read. What comes to the driver is the number
    of pieces of each length, at most ``capacity`` rows. Only pieces that the plan cuts are read again for their ids.
    """
    pieces = materialize(tokens(docs, model, capacity, end, memo), "tokens", "zstd")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    layout = plan(histogram, capacity)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if not layout.cut:
        return place(pieces, layout, capacity).select(*columns)
    places = materialize(place(pieces, layout, capacity), "places")
    parts = places.where("not whole")
    parts = F.broadcast(parts) if layout.cut <= BROADCAST_CUTS else parts
    return places.where("whole").select(*columns).unionByName(with_ids(parts, pieces).select(*columns))
