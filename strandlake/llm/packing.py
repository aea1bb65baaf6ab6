"""Packing of token sequences: a configuration linear program, rounded, with best fit for what rounding leaves."""

from __future__ import annotations

import math
import sys
import types
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, small_batches

#: Texts of these characters alone are tokenized word by word from a memo; all others by the tokenizer as a whole.
MEMO_TEXT = "[\t\n\r -~À-ÖØ-öø-ÿ]*"
#: The tokenizer's own pre-tokens within those characters, in lower case (fixed pattern of the tokenizer's file).
MEMO_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+"
MEMO_SIZE = 250_000


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: visible Latin-1 as it is, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


class Memo(dict):
    """Token ids (as bytes) of words, taken from the tokenizer's model at their first use; bounded in size."""

    def __init__(self, model):
        self.model, self.letters = model, byte_letters()

    def __missing__(self, word: str) -> bytes:
        own = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        ids = np.array([t.id for t in self.model.tokenize(own)], "<u4").tobytes()
        if len(self) < MEMO_SIZE and len(word) <= 48:
            self[word] = ids
        return ids


class Encoder:
    """Token ids of texts by a tokenizer given as JSON, without special tokens, as little-endian 32-bit numbers."""

    def __init__(self, model: str, memo: bool = True):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.plain = re.compile(MEMO_TEXT).fullmatch
        self.words = re.compile(MEMO_WORD).findall
        self.memo = Memo(self.tokenizer.model) if memo else None

    def __call__(self, text: str) -> bytes:
        if self.memo is not None and "<|" not in text and self.plain(text):
            return b"".join(map(self.memo.__getitem__, self.words(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _encoder(model: str, memo: bool) -> Encoder:
    """One encoder for each Python worker, kept between its tasks."""
    kept = sys.modules.setdefault("_packing_encoders", types.ModuleType("_packing_encoders")).__dict__
    key = f"{zlib.crc32(model.encode())}:{memo}"
    if key not in kept:
        kept[key] = Encoder(model, memo)
    return kept[key]


def pieces(docs: DataFrame, model: str, capacity: int = 2048, end: int = 0, memo: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces.

    A document is its text's ids (null: none) and then ``end``; one longer than ``capacity`` is cut into pieces of
    ``capacity`` ids, the last may be shorter. ``model`` is the content of a tokenizer file. ``memo`` is for tokenizers
    whose words are those of MEMO_WORD.
    """

    def run(batches):
        encode = _encoder(model, memo)
        tail = np.array([end], "<u4").tobytes()
        for batch in small_batches(batches, "text"):
            row, piece, start, length, crc = [], [], [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                data = (encode(text) if text else b"") + tail
                for at in range(0, len(data), 4 * capacity):
                    part = data[at : at + 4 * capacity]
                    row.append(r)
                    piece.append(at // (4 * capacity))
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Knapsack:
    """The most valuable multisets of lengths for every capacity up to ``capacity``, by dynamic programming."""

    def __init__(self, value: np.ndarray, capacity: int):
        """``value[n]``: the value of a piece of length n, 0 where there is none."""
        falling = np.where(value > 0, value, -np.inf)[:0:-1].copy()  # by falling length, so that both operands are slices
        self.best, self.choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
        for c in range(1, capacity + 1):
            v = falling[capacity - c :] + self.best[:c]
            rest = int(v.argmax())  # of equally good ones the longest
            self.best[c] = self.best[c - 1]
            if v[rest] > self.best[c]:
                self.best[c], self.choice[c] = v[rest], c - rest
        self.first = falling + self.best[:capacity]

    def multiset(self, capacity: int) -> dict[int, int]:
        out: dict[int, int] = {}
        c = capacity
        while c > 0:
            n = int(self.choice[c])
            if n:
                out[n] = out.get(n, 0) + 1
            c -= n or 1
        return out

    def near_best(self, share: float):
        """Configurations whose value is at least ``share`` of the best one's, each begun by another length, longest first."""
        capacity = len(self.best) - 1
        for rest in np.flatnonzero(self.first >= share * self.best[capacity]):
            n = capacity - int(rest)
            out = self.multiset(int(rest))
            out[n] = out.get(n, 0) + 1
            yield out


@dataclass
class Program:
    """A feasible solution of the configuration program, and bounds of its value.

    ``uses``: configurations (length -> copies), how often each is used in fractions. ``value``: their sum plus the rest
    at one sequence for each capacity's worth of what they do not cover. ``bound``: the best dual value.
    """

    uses: list[tuple[dict[int, int], float]]
    value: float
    bound: float


def solve(counts: np.ndarray, capacity: int, rounds: int = 150, patience: int = 12, rate: float = 0.5, share: float = 0.999) -> Program:
    """The covering program min sum x_c with sum_c a_c(n) x_c >= counts[n], by multiplicative weights.

    Every length has a weight that shrinks exponentially with the share of it that is covered. Each round prices all
    lengths that are left, by value = weight * length, with one knapsack table. Its near-best configurations (an
    approximate oracle) are used one after the other while enough is left for them, for half of what the scarcest length
    allows. The prices, scaled so that no configuration is worth more than 1, are a dual solution.
    """
    left, size = counts.astype(float), np.arange(capacity + 1)
    weight = np.ones(capacity + 1)
    uses, bound, idle = [], 0.0, 0
    for turn in range(rounds):
        value = np.where(left >= 1, weight * size, 0.0)
        if not value.any() or idle == patience:
            break
        table = Knapsack(value, capacity)
        if turn % 20 == 0:
            prices = np.where(counts > 0, weight * size, 0.0)
            bound = max(bound, float(prices @ counts) / (table if turn == 0 else Knapsack(prices, capacity)).best[capacity])
        before = len(uses)
        for config in table.near_best(share):
            amount = min(left[n] / k for n, k in config.items())
            if amount < 1:
                continue
            amount = max(1.0, amount / 2)
            for n, k in config.items():
                left[n] -= amount * k
                weight[n] *= np.exp(-rate * amount * k / counts[n])
            uses.append((config, amount))
        idle = 0 if len(uses) > before else idle + 1
        if idle:  # nothing near the best fits any more: what is left of its lengths becomes cheaper
            for n in table.multiset(capacity):
                weight[n] *= np.exp(-rate)
    return Program(uses, sum(x for _, x in uses) + float(left @ size) / capacity, bound)


@dataclass
class Layout:
    """Where the pieces of each length go: runs of (length, first rank, count, first sequence, offset), and figures.

    ``bound``: no packing has fewer sequences; ``value``: the fractional program's; ``rounded``: sequences that its
    rounding made, the others are by best fit.
    """

    runs: np.ndarray
    sequences: int = 0
    bound: int = 0
    value: float = 0.0
    rounded: int = 0


def plan(histogram: dict[int, int], capacity: int, turns: int = 12) -> Layout:
    """A packing of the lengths counted in ``histogram``; its work depends on the capacity, not on the counts.

    The fractional program is solved, each configuration is used as often as its fraction says, rounded down, then those
    with the largest fractions once more while their pieces last; the program of what is left is solved again, until
    rounding places nothing. The rest goes by best fit, longest first, into the open sequences that it fills best, or
    new ones. All works on groups of equal sequences.
    """
    total = sum(n * k for n, k in histogram.items())
    left = np.zeros(capacity + 1, np.int64)
    for n, k in histogram.items():
        left[n] = k
    groups: list[list] = []  # [how many sequences, free places, [lengths]]
    if left[capacity]:
        groups.append([int(left[capacity]), 0, [capacity]])
    full, left[capacity] = int(left[capacity]), 0
    value, bound, rounded = float(full), float(full), full
    for turn in range(turns if left.any() else 0):
        program = solve(left, capacity)
        if turn == 0:
            value, bound = value + program.value, bound + program.bound
        placed = 0
        down = [(config, int(x + 1e-9)) for config, x in program.uses]
        up = [(config, 1) for config, x in sorted(program.uses, key=lambda u: -(u[1] % 1)) if x % 1 > 1e-9]
        for config, times in down + up:
            times = min([times, *(int(left[n]) // k for n, k in config.items())])
            if times > 0:
                inside = [n for n in sorted(config, reverse=True) for _ in range(config[n])]
                groups.append([times, capacity - sum(inside), inside])
                for n, k in config.items():
                    left[n] -= times * k
                placed += times
        rounded += placed
        if not placed or not left.any():
            break
    free: dict[int, list[int]] = {}
    opened = np.zeros(capacity + 1, bool)

    def put(g: int) -> None:
        free.setdefault(groups[g][1], []).append(g)
        opened[groups[g][1]] = True

    for g in range(len(groups)):
        put(g)
    for n in range(capacity - 1, 0, -1):
        k = int(left[n])
        while k:
            fits = np.flatnonzero(opened[n:])
            if not len(fits):
                each = capacity // n
                if k >= each:
                    groups.append([k // each, capacity - each * n, [n] * each])
                    k -= k // each * each
                else:
                    groups.append([1, capacity - k * n, [n] * k])
                    k = 0
                put(len(groups) - 1)
                continue
            r = n + int(fits[0])
            g = free[r].pop()
            opened[r] = bool(free[r])
            times = min(k, groups[g][0])
            if times < groups[g][0]:
                groups.append([groups[g][0] - times, r, list(groups[g][2])])
                put(len(groups) - 1)
                groups[g][0] = times
            groups[g][1] -= n
            groups[g][2].append(n)
            k -= times
            put(g)
    runs, rank, sequence = [], dict.fromkeys(histogram, 0), 0
    for times, _, inside in groups:
        offset = 0
        for n in inside:
            runs.append((n, rank[n], times, sequence, offset))
            rank[n] += times
            offset += n
        sequence += times
    runs = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return Layout(runs, sequence, max(-(-total // capacity), math.ceil(bound - 1e-6)), value, rounded)


def place(parts: DataFrame, layout: Layout) -> DataFrame:
    """``parts`` with sequence_id and offset: the r-th piece of a length goes to the r-th place for it.

    The ranks are counted in salted groups, so that a length which a third of the pieces have is no task of its own.
    """
    salts = max(16, layout.sequences >> 16)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("at", F.row_number().over(inside) - 1).join(first, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("at"))
    runs = layout.runs
    width = np.int64(1) << 48

    def run(batches):
        key = runs[:, 0] * width + runs[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            i = np.searchsorted(key, length * width + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(runs[i, 3] + rank - runs[i, 1]), pa.array(runs[i, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, model: str, capacity: int = 2048, end: int = 0, memo: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of ``docs``.

    A null text counts as empty, so that every row has at least the piece of its end token; a null doc_id stays null;
    repeated rows are packed as often as they come; an empty table gives no rows; other columns are not read. What
    comes to the driver is the number of pieces of each length, at most ``capacity`` rows.
    """
    parts = materialize(pieces(docs, model, capacity, end, memo), "pieces")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return place(parts, plan(histogram, capacity))
