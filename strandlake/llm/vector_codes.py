"""Product codes of vectors: exact integer codebooks learnt over Hilbert-sorted blocks that know their boxes and sums."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize

#: Equal parts of a vector, entries of a part's codebook, rounds of learning, and what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Parts in a block, and bytes of components (as doubles) that are sorted and stored together in one row.
BLOCK, CHUNK_BYTES = 32, 8 << 20
#: Bits of a coordinate on the Hilbert curve.
BITS = 6
#: Sums travel in digits of this many bits, so that no number of rows and no component makes them overflow.
LIMB = 30
LONGEST = (1 << 63) - 1


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: as int64 where squared distances fit in it, else as Python integers."""
    scaled = np.floor(x * float(scale))
    if not x.size or np.abs(scaled).max() < (1 << 30) / math.sqrt(max(1, x.shape[1])):
        return scaled.astype(np.int64)
    return np.array([[int(v) * scale if abs(v) >= 1 << 53 else math.floor(v * scale) for v in row] for row in x.tolist()], object).reshape(x.shape)


def hilbert_order(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The order of points [n, d] along a Hilbert curve through their box (transposed form of the public algorithm by Skilling)."""
    n, d = points.shape
    if n < 2 or not d:
        return np.arange(n)
    wide = points.astype(np.float64)
    low = wide.min(0)
    x = np.minimum((wide - low) / np.maximum(wide.max(0) - low, 1e-300) * (1 << bits), (1 << bits) - 1).astype(np.uint32).T.copy()
    for b in range(bits - 1, 0, -1):
        q, p = np.uint32(1 << b), np.uint32((1 << b) - 1)
        for i in range(d):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p).astype(np.uint32)
            x[0] ^= np.where(up, p, swap).astype(np.uint32)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.uint32)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint32(1 << b), np.uint32((1 << b) - 1), 0).astype(np.uint32)
    x ^= turn
    planes = [(x[i] >> np.uint32(b)) & 1 for b in range(bits - 1, -1, -1) for i in range(d)]
    key = np.packbits(np.stack(planes, 1).astype(np.uint8), axis=1)
    return np.argsort(key.view(f"S{key.shape[1]}").ravel(), kind="stable")


class Blocks:
    """The parts at one position of a chunk's vectors, in Hilbert order: flat [n, d], and the box and sum of each block."""

    def __init__(self, flat: np.ndarray, lo=None, hi=None, sums=None):
        self.flat, self.starts = flat, np.arange(0, len(flat), BLOCK)
        self.sizes = np.diff(np.append(self.starts, len(flat)))
        self.lo = np.minimum.reduceat(flat, self.starts, axis=0) if lo is None else lo
        self.hi = np.maximum.reduceat(flat, self.starts, axis=0) if hi is None else hi
        self.sums = np.add.reduceat(flat, self.starts, axis=0) if sums is None else sums

    def shortlists(self, book: np.ndarray) -> np.ndarray:
        """[blocks, entries]: whether an entry may be the nearest of a part in the block's box, by its least and largest distances."""
        near, far = [], []
        for entry in book:
            below, above = self.lo - entry, self.hi - entry
            gap = np.maximum(np.maximum(below, -above), 0)
            reach = np.maximum(-below, above)
            near.append((gap * gap).sum(1))
            far.append((reach * reach).sum(1))
        return np.stack(near, 1) <= np.stack(far, 1).min(1, keepdims=True)

    def nearest(self, book: np.ndarray, short: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, entry, squared distance) of every part in the chosen blocks; each is held against its block's shortlist alone."""
        rows = np.flatnonzero(np.repeat(blocks, self.sizes))
        at = np.empty(len(self.flat), np.int64)
        at[rows] = np.arange(len(rows))
        code, best = np.zeros(len(rows), np.int64), np.full(len(rows), -1, self.flat.dtype)
        for e, entry in enumerate(book):
            own = np.flatnonzero(np.repeat(blocks & short[:, e], self.sizes))
            if not len(own):
                continue
            gap = self.flat[own] - entry
            distance, i = (gap * gap).sum(1), at[own]
            closer = (best[i] < 0) | (distance < best[i])
            best[i[closer]], code[i[closer]] = distance[closer], e
        return rows, code, best

    def tally(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many parts have each entry as nearest, the sums of those parts); a block with one entry on its list gives its stored sum."""
        short = self.shortlists(book)
        alone = short.sum(1) == 1
        which = short.argmax(1)[alone]
        count, total = np.zeros(len(book), np.int64), np.zeros(book.shape, self.flat.dtype)
        np.add.at(count, which, self.sizes[alone])
        np.add.at(total, which, self.sums[alone])
        rows, code, _ = self.nearest(book, short, ~alone)
        np.add.at(count, code, 1)
        for e in range(len(book)):
            total[e] += self.flat[rows[code == e]].sum(0)
        return count, total


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of ``width``, shorter ones filled up with 0."""
    size = np.asarray(pa.compute.list_value_length(column), np.int64)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(column.flatten(), np.float64)
    return out


def blocks(vectors: DataFrame, width: int, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """A row for each chunk of vectors: ids, labels, and for each position the order, the flat parts, boxes and sums of its blocks.

    Vectors are sorted inside chunks of bounded size where they are read, so none is shuffled.
    """
    limit, d = max(1, CHUNK_BYTES // (8 * max(1, width))), width // parts
    label = next(f.dataType for f in vectors.schema if f.name == "label")

    def chunk(table: pa.Table) -> pa.RecordBatch:
        ids, labels = (table.column(c).combine_chunks() for c in ("vec_id", "label"))
        raw = _matrix(table.column("embedding").combine_chunks(), width)
        w = whole_numbers(raw, scale)
        order = np.stack([hilbert_order(w[:, p * d : (p + 1) * d]) for p in range(parts)]).astype(np.uint32)
        stored = {"vec_ids": ids, "labels": labels}
        fields = {"kind": "f8", "ordered": order.tobytes(), "flat": raw.astype("<f8").tobytes(), "lo": b"", "hi": b"", "sums": b""}
        if w.dtype != object:
            own = [Blocks(w[order[p], p * d : (p + 1) * d]) for p in range(parts)]
            top = np.abs(w).max(initial=0)
            fields["kind"] = kind = "<i2" if top < 1 << 15 else "<i4"
            fields["flat"] = np.stack([b.flat for b in own]).astype(kind).tobytes()
            fields |= {name: np.stack([getattr(b, name) for b in own]).astype(k).tobytes() for name, k in (("lo", kind), ("hi", kind), ("sums", "<i8"))}
        lists = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in stored.items()}
        return pa.RecordBatch.from_pydict(lists | {k: pa.array([v], pa.string() if k == "kind" else pa.binary()) for k, v in fields.items()})

    def run(batches):
        kept, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, limit):
                part = batch.slice(at, limit)
                if n + part.num_rows > limit:
                    yield chunk(pa.Table.from_batches(kept))
                    kept, n = [], 0
                kept.append(part)
                n += part.num_rows
        if n:
            yield chunk(pa.Table.from_batches(kept))

    fields = [T.StructField("vec_ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)), T.StructField("kind", T.StringType()), *(T.StructField(k, T.BinaryType()) for k in ("ordered", "flat", "lo", "hi", "sums"))]
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, T.StructType(fields))


def _open(row: dict, n: int, width: int, parts: int, scale: int):
    """(order, Blocks) of each position of a stored chunk."""
    d = width // parts
    order = np.frombuffer(row["ordered"], np.uint32).reshape(parts, n)
    if row["kind"] == "f8":
        w = whole_numbers(np.frombuffer(row["flat"], "<f8").reshape(n, width), scale).astype(object)
        return [(order[p], Blocks(w[order[p], p * d : (p + 1) * d])) for p in range(parts)]
    load = lambda name, kind, k: np.frombuffer(row[name], kind).astype(np.int64).reshape(parts, k, d)
    k = -(-n // BLOCK)
    flat, lo, hi, sums = load("flat", row["kind"], n), load("lo", row["kind"], k), load("hi", row["kind"], k), load("sums", "<i8", k)
    return [(order[p], Blocks(flat[p], lo[p], hi[p], sums[p])) for p in range(parts)]


def _chunks(batches, width: int, parts: int, scale: int):
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            stored = {k: row.column(k)[0].as_py() for k in ("kind", "ordered", "flat", "lo", "hi", "sums")}
            n = len(stored["ordered"]) // (4 * parts)
            yield row, _open(stored, n, width, parts, scale)


def _fitting(books: list[np.ndarray], b: Blocks, p: int) -> np.ndarray:
    """The codebook of a position in the numbers of the blocks; large entries turn int64 blocks into Python integers."""
    book = books[p]
    if b.flat.dtype == object or (book.size and max(map(abs, book.ravel().tolist())) >= (1 << 30) / math.sqrt(max(1, book.shape[1]))):
        b.flat, b.lo, b.hi, b.sums = (x.astype(object) for x in (b.flat, b.lo, b.hi, b.sums))
        return book
    return book.astype(np.int64)


def tallies(stored: DataFrame, books: list[np.ndarray], width: int, parts: int, scale: int) -> DataFrame:
    """part, entry, place, digit, value: the counts (place -1) and sums of the parts nearest to each entry, added up in each task."""

    def run(batches):
        size = (parts, len(books[0]))
        count, total = np.zeros(size, object), np.zeros((*size, width // parts), object)
        for _, own in _chunks(batches, width, parts, scale):
            for p, (_, b) in enumerate(own):
                n, s = b.tally(_fitting(books, b, p))
                count[p] += n
                total[p] += s
        out = []
        for p, e in np.ndindex(*size):
            for place, value in enumerate([count[p, e], *total[p, e]], -1):
                left, digit, sign = abs(int(value)), 0, 1 if value >= 0 else -1
                while left:
                    out.append((p, e, place, digit, sign * (left & ((1 << LIMB) - 1))))
                    left, digit = left >> LIMB, digit + 1
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, [pa.int32()] * 4 + [pa.int64()], strict=True)], ["part", "entry", "place", "digit", "value"])

    return stored.select("kind", "ordered", "flat", "lo", "hi", "sums").mapInArrow(run, "part int, entry int, place int, digit int, value long")


def learn(stored: DataFrame, books: list[np.ndarray], rounds: int, width: int, parts: int, scale: int) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds; each round is a job whose result has at most entries x (width + parts) numbers."""
    for _ in range(rounds):
        sums: dict[tuple, int] = {}
        for r in tallies(stored, books, width, parts, scale).groupBy("part", "entry", "place", "digit").agg(F.sum("value").alias("value")).collect():
            key = (r["part"], r["entry"], r["place"])
            sums[key] = sums.get(key, 0) + (r["value"] << (LIMB * r["digit"]))
        books = [book.copy() for book in books]
        for p, book in enumerate(books):
            for e in range(len(book)):
                if n := sums.get((p, e, -1), 0):
                    book[e] = [sums.get((p, e, i), 0) // n for i in range(width // parts)]
    return books


def assign(stored: DataFrame, books: list[np.ndarray], label, width: int, parts: int, scale: int) -> DataFrame:
    """vec_id, label, code, error of every vector; vectors come from the chunks whole, so nothing is shuffled."""

    def run(batches):
        for row, own in _chunks(batches, width, parts, scale):
            ids, labels = (row.column(k).flatten() for k in ("vec_ids", "labels"))
            codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), object)
            for p, (order, b) in enumerate(own):
                book = _fitting(books, b, p)
                _, code, distance = b.nearest(book, b.shortlists(book), np.ones(len(b.starts), bool))
                codes[order, p] = code
                error[order] += distance
            text = codes.tobytes().hex()
            code = pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)])
            yield pa.RecordBatch.from_arrays([ids, labels, code, pa.array([min(int(x), LONGEST) for x in error], pa.int64())], ["vec_id", "label", "code", "error"])

    return stored.mapInArrow(run, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def with_label_error(coded: DataFrame, salts: int = 16) -> DataFrame:
    """``coded`` with the errors of equal labels (null is one of them) summed; a label that most rows have is joined in ``salts`` shares."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy("label").agg(total.alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("label", "of")
    salted = coded.withColumn("own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    return salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("own") == F.col("salt"))).drop("of", "own", "salt")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error of every kept vector; the codebook [entries, width of a part] of each position).

    Rows whose vector is null or has a component that is null or not finite are dropped. Components become
    floor(scale * x), of any size; vectors shorter than the longest are filled up with 0, and the longest to a multiple
    of ``parts``. Codebooks begin as the parts of the first ``entries`` rows by (vec_id with null last, vector); fewer
    kept rows make smaller codebooks, none an empty result. Repeated rows and ids count as often as they come. Sums that
    do not fit into a long stand as the largest long. Other columns are not read.
    """
    sound = F.col("embedding").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")).where(sound)
    longest = kept.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 0
    width = -(-longest // parts) * parts
    first = [r["embedding"] + [0.0] * (width - len(r["embedding"])) for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()]
    begun = whole_numbers(np.array(first, float).reshape(len(first), width), scale).astype(object)
    books = [begun[:, p * (width // parts) : (p + 1) * (width // parts)] for p in range(parts)]
    stored = materialize(blocks(kept, width, parts, scale), "blocks")
    books = learn(stored, books, rounds if len(first) and width else 0, width, parts, scale)
    coded = materialize(assign(stored, books, vectors.schema["label"].dataType, width, parts, scale), "codes")
    discard(stored)
    return with_label_error(coded), books


def sha256(books: list[np.ndarray]) -> str:
    """The digest of all entries' components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def oracle() -> str:
    """Vectors of one length that eight divides, as in the given tables."""
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS w FROM embeddings
WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
p AS MATERIALIZED (SELECT r, part, w[part * (len(w) // {PARTS}) + 1 : (part + 1) * (len(w) // {PARTS})] AS s FROM v, range({PARTS}) t(part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, s FROM p WHERE r <= {ENTRIES})"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, part, any_value(s) AS s, min({{'d': d, 'e': entry}}) AS m FROM (SELECT p.r, p.part, p.s, b.entry, list_sum(list_transform(list_zip(p.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{i} b USING (part)) GROUP BY r, part)""")
        if i < ROUNDS:
            steps.append(f"""c{i} AS (SELECT part, m.e AS entry, unnest(s) AS x, generate_subscripts(s, 1) AS place FROM a{i}),
d{i} AS (SELECT part, entry, place, sum(x) AS t, count(*) AS n FROM c{i} GROUP BY ALL),
n{i} AS (SELECT part, entry, list(((t - (t % n + n) % n) // n)::BIGINT ORDER BY place) AS s FROM d{i} GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n{i}.s, b{i}.s) AS s FROM b{i} LEFT JOIN n{i} USING (part, entry))""")
    return f"""WITH {', '.join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
e AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN e USING (r), h"""
