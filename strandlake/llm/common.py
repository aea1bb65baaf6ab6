"""Helpers shared by the corpus operators: shared scratch tables and vectorised text access."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType, "double": T.DoubleType, "int": T.IntegerType, "long": T.LongType, "boolean": T.BooleanType, "binary": T.BinaryType}
BYTES_PER_SLICE = 4 << 20
A_TO_Z, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set, a temporary one serves a local session; a cluster needs its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and survives lost executors.

    A caller that has written all that depends on it gives it back with ``discard``.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` of which no later plan reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def with_fields(schema: T.StructType, **more: str) -> T.StructType:
    """A schema with fields of simple types after those of ``schema``."""
    return T.StructType([*schema.fields, *(T.StructField(k, _TYPES[v]()) for k, v in more.items())])


def ascii_lower(column):
    """``column`` with A-Z alone in lower case."""
    return F.translate(column, A_TO_Z, LOWER)


def remainder(column, divisor: int):
    """crc32 of ``column`` as text, modulo ``divisor``; null for null."""
    return F.pmod(F.crc32(column.cast("string")), F.lit(divisor))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column without copying, and each row's start and end there (null: empty)."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = bounds[:-1], bounds[1:].copy()
    if column.null_count:
        gone = np.asarray(column.is_null())
        ends[gone] = starts[gone]
    return raw, starts, ends


def small_batches(batches, column: str, limit: int = BYTES_PER_SLICE):
    """Each record batch in slices of about ``limit`` bytes of ``column``, or of one row."""
    at = None
    for batch in batches:
        at = batch.schema.get_field_index(column) if at is None else at
        _, starts, ends = text_bytes(batch.column(at))
        total = np.cumsum(ends - starts)
        row = 0
        while row < batch.num_rows:
            before = total[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(row, stop - row)
            row = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of many texts at once.

    A word is a longest run of bytes whose entry in ``table`` is not 0; ``table`` also maps each such byte
    (for A-Z to lower case). The hash is polynomial over the mapped bytes, so it does not depend on the place
    of the word, and equals for equal words in every process.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, table: np.ndarray):
        self.table = table
        self.grow(1 << 20)

    def grow(self, n: int) -> None:
        inverse = pow(self.BASE, -1, 1 << 64)
        steps = np.full(n + 1, self.BASE, np.uint64)
        steps[0] = 1
        self.power = np.multiply.accumulate(steps)
        steps[1:] = inverse
        self.inverse = np.multiply.accumulate(steps)

    def run(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = 1 << 20):
        """(row, hash, first byte, byte after) of every word of the texts raw[starts[i]:ends[i]], in order."""
        rows, hashes, firsts, lasts = [], [], [], []
        i, n = 0, len(starts)
        while i < n:
            lo = int(starts[i])
            j = i + 1
            while j < n and starts[j] == ends[j - 1] and ends[j] - lo <= limit:
                j += 1
            for cut, stop in self._cuts(raw, lo, int(ends[j - 1]), limit):
                row, h, a, b = self._slice(raw, starts[i:j], cut, stop)
                rows.append(row + i)
                hashes.append(h)
                firsts.append(a)
                lasts.append(b)
            i = j
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)

    def _cuts(self, raw, lo, hi, limit):
        """Slices of about ``limit`` bytes, cut where no word runs on."""
        while hi - lo > limit:
            size = limit
            while True:
                stop = min(lo + size, hi)
                gaps = np.flatnonzero(self.table[raw[lo:stop]] == 0) if stop < hi else None
                if gaps is None or len(gaps):
                    break
                size *= 2
            cut = stop if gaps is None else lo + int(gaps[-1]) + 1
            yield lo, cut
            lo = cut
        if hi > lo:
            yield lo, hi

    def _slice(self, raw, starts, lo, hi):
        d = self.table[raw[lo:hi]]
        n = len(d)
        if n >= len(self.power):
            self.grow(2 * n)
        inside = d != 0
        before = np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        own = starts[(starts > lo) & (starts < hi)] - lo
        before[own] = False
        first = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, inside[1:]
        after[own - 1] = False
        last = np.flatnonzero(inside & ~after) + 1
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(d * self.power[:n], out=sums[1:])
        h = mix((sums[last] - sums[first]) * self.inverse[first] + (last - first).astype(np.uint64))
        row = np.searchsorted(starts, first + lo, "right") - 1
        return row, h, first + lo, last + lo


def byte_table(is_word) -> np.ndarray:
    """The table of a WordHasher: word bytes map to themselves, A-Z to lower case first; all others to 0."""
    table = np.zeros(256, np.uint64)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        table[b] = low if is_word(low) else 0
    return table


#: Words are letters, digits and all that is not ASCII.
ALNUM = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: Words are all but space, tab, newline, vertical tab, form feed and carriage return. NUL counts as 0x100 there.
NOT_SPACE = byte_table(lambda b: b != 32 and not 9 <= b <= 13)
NOT_SPACE[0] = 256
