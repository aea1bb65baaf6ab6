"""Packing by minimum bin slack: exact subset sums, full sequences, and an exact round trip."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm import packing, slack


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize("seed", range(20))
def test_closest_sum_equals_brute_force(seed):
    r = random.Random(seed)
    count = np.zeros(41, np.int64)
    for n in r.sample(range(1, 41), 5):
        count[n] = r.randint(1, 3)
    own = [int(n) for n in np.flatnonzero(count)]
    for target in range(41):
        sums = [sum(n * k for n, k in zip(own, ks, strict=True)) for ks in itertools.product(*[range(int(count[n]) + 1) for n in own])]
        total, chosen = slack.closest(count, target)
        assert total == max(x for x in sums if x <= target) == sum(n * k for n, k in chosen.items())
        assert all(0 < k <= count[n] for n, k in chosen.items())


def tile(layout, histogram, capacity):
    """Fills every sequence by the runs: the pieces' ids are each there once, the sequences gapless and of the right sizes."""
    seen, fill = {}, {}
    for n, rank, k, begin, length, sequence, offset in layout.runs.tolist():
        for i in range(k):
            seen.setdefault((n, rank + i), []).append((begin, length))
            fill.setdefault(sequence + i, []).append((offset, length))
    assert sorted(seen) == sorted((n, i) for n, k in histogram.items() for i in range(k))
    for (n, _), parts in seen.items():
        at = 0
        for begin, length in sorted(parts):
            assert begin == at and length > 0
            at += length
        assert at == n
    sizes = []
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    short = sorted(x for x in sizes if x < capacity)
    assert len(fill) == layout.sequences and max(sizes, default=0) <= capacity
    assert all(x & (x - 1) == 0 for x in short) and len(set(short)) == len(short)
    assert sum(len(p) > 1 for p in seen.values()) == layout.cut


@pytest.mark.parametrize("seed", range(12))
def test_plan_fills_every_sequence(seed):
    r = random.Random(seed)
    capacity = r.choice([16, 64, 256])
    histogram = {n: r.choice([1, 2, 7, 60]) for n in r.sample(range(1, capacity + 1), r.randint(1, min(40, capacity)))}
    tile(slack.plan(histogram, capacity), histogram, capacity)


@pytest.mark.parametrize("histogram", [{}, {1: 1}, {64: 5}, {47: 1000}, {33: 999, 2: 1}, {63: 1, 62: 1}, {1: 1000}])
def test_plan_of_few_lengths(histogram):
    tile(slack.plan(histogram, 64), histogram, 64)


def test_plan_cuts_few_pieces_and_does_not_grow_with_counts():
    r = random.Random(1)
    histogram = {}
    for _ in range(200_000):
        n = min(4096, 1 + int(r.lognormvariate(6, 1)))
        histogram[n] = histogram.get(n, 0) + 1
    layout = slack.plan(histogram)
    assert layout.cut <= 20
    more = slack.plan({n: k * 1_000_000 for n, k in histogram.items()})
    assert len(more.runs) <= 4 * len(layout.runs)


def sequences(out, ids, end):
    """Checks digests, places and coverage of the rows against the documents' ids; the size of each sequence."""
    places, cover = {}, {}
    for r in out:
        own = [*ids[r["doc_id"]], end]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        cover.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for parts in [*places.values(), *cover.values()]:
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
    assert all(sum(n for _, n in cover[d]) == len(ids[d]) + 1 for d in ids)
    return sorted(sum(n for _, n in p) for p in places.values())


@pytest.mark.parametrize("capacity, broadcast", [(64, 100_000), (64, 0), (4096, 100_000)])
def test_round_trip(spark, model, monkeypatch, capacity, broadcast):
    monkeypatch.setattr(slack, "BROADCAST_CUTS", broadcast)
    r = random.Random(capacity)
    texts = [" ".join(r.choices(["one", "two", "Extraordinary", "né", "x9", "日本"], k=r.randint(0, 90))) for _ in range(120)] + [None, "", "word " * 9000, "<|endoftext|> a"]
    table = spark.createDataFrame([(i, t, 5, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, length int, key string, start int")
    t = Tokenizer.from_str(model)
    ids = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    sizes = sequences(slack.pack(table, model, capacity).collect(), ids, 2)
    assert sum(sizes) % capacity == sum(x for x in sizes if x < capacity) and all(x & (x - 1) == 0 for x in sizes)


def test_repeated_rows_null_ids_and_empty_tables(spark, model):
    table = spark.createDataFrame([(None, "a b"), (1, "same text"), (1, "same text"), (2, None)], "doc_id long, text string")
    out = slack.pack(table, model, 8).collect()
    n = len(Tokenizer.from_str(model).encode("same text", add_special_tokens=False).ids) + 1
    assert sum(r["length"] for r in out if r["doc_id"] == 1) == 2 * n and sum(r["length"] for r in out if r["doc_id"] is None) == 3
    assert slack.pack(table.limit(0), model).collect() == []


def test_ids_come_back(spark, model):
    table = spark.createDataFrame([(i, f"word {i} " * (i % 9)) for i in range(40)], "doc_id long, text string")
    pieces = slack.materialize(slack.tokens(table, model, 16), "t")
    layout = slack.plan({r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}, 16)
    out = slack.with_ids(slack.place(pieces, layout, 16), pieces.where("ids is not null")).collect()
    encode = packing.Encoder(model)
    for r in out:
        own = encode(f"word {r['doc_id']} " * (r["doc_id"] % 9)) + np.array([2], "<u4").tobytes()
        assert bytes(r["ids"]) == own[4 * r["start"] : 4 * (r["start"] + r["length"])] and zlib.crc32(r["ids"]) == r["ids_crc32"]
