"""Product codes against a plain recomputation with Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from strandlake.llm import vector_codes as vc

ROW = "vec_id long, embedding array<double>, label string, code int, error string"


def plain(rows, parts, entries, rounds, scale):
    """(vec_id, label, code, error) of the kept rows and the codebooks, by the definition."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    d = width // parts
    whole = [[math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    cut = [[w[p * d : (p + 1) * d] for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda c, p: min((far(c[p], e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [[c[p] for c in cut if near(c, p)[1] == k] for k in range(len(books[p]))]
            new.append([[sum(x) // len(o) for x in zip(*o, strict=True)] if o else books[p][k] for k, o in enumerate(own)])
        books = new
    out = []
    for (i, _, label), c in zip(kept, cut, strict=True):
        best = [near(c, p) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), min(sum(x for x, _ in best), 2**63 - 1)))
    return out, books


def check(spark, rows, parts=8, entries=16, rounds=6, scale=4096):
    table = spark.createDataFrame([(i, v, label, 7, "x") for i, v, label in rows], ROW)
    coded, books = vc.compress(table, parts, entries, rounds, scale)
    want, wanted = plain(rows, parts, entries, rounds, scale)
    assert [[list(map(int, e)) for e in b] for b in books] == wanted
    sums = {}
    for _, label, _, error in want:
        sums[label] = min(sums.get(label, 0) + error, 2**63 - 1)
    got = [(r["vec_id"], r["label"], r["code"], r["error"], r["label_error"]) for r in coded.collect()]
    assert sorted(got, key=str) == sorted([(*r, sums[r[1]]) for r in want], key=str)
    assert vc.sha256(books) == hashlib.sha256(",".join(str(x) for b in wanted for e in b for x in e).encode()).hexdigest()
    return coded


@pytest.mark.parametrize("chunk", [1 << 9, 1 << 20])
def test_codes_equal_a_recomputation(spark, monkeypatch, chunk):
    monkeypatch.setattr(vc, "CHUNK_BYTES", chunk)
    r = random.Random(chunk)
    rows = [(i, [r.gauss(0, 0.2) + i % 3 for _ in range(16)], r.choice(["a", "b", None])) for i in range(200)]
    rows += [(5, [0.25] * 16, "hot")] * 90  # a third of the rows is one vector
    rows += [(900, None, "a"), (901, [1.0, None] + [0.0] * 14, "a"), (902, [math.nan] * 16, "b"), (903, [math.inf] * 16, None), (None, [0.5] * 16, "n")]
    check(spark, rows)


def test_codes_of_odd_tables(spark):
    check(spark, [])
    check(spark, [(1, None, "a")])
    check(spark, [(1, [], "a"), (2, [], None)])
    check(spark, [(3, [0.1, 0.2, 0.3], None), (1, [0.5] * 9, "a"), (1, [0.5] * 9, "a"), (2, [-0.5], "a")])  # fewer rows than entries, and lengths that no eight parts divide
    check(spark, [(i, [float(i % 2)] * 8, "t") for i in range(40)])  # ties: entries that repeat
    check(spark, [(i, [10.0 ** (i % 12) * (-1) ** i] * 8, "huge") for i in range(30)] + [(99, [1e300] + [0.0] * 7, None)])
    check(spark, [(i, [3e5 * i, -1.5] * 8, "wide") for i in range(40)])


def test_the_shortlist_keeps_every_nearest_entry():
    r = np.random.default_rng(3)
    for _ in range(30):
        flat = r.integers(-50, 50, (int(r.integers(1, 300)), 4))
        flat = flat[vc.hilbert_order(flat)]
        book = r.integers(-50, 50, (16, 4))
        b = vc.Blocks(flat)
        short = b.shortlists(book)
        distance = ((flat[:, None] - book) ** 2).sum(2)
        rows, code, best = b.nearest(book, short, np.ones(len(b.starts), bool))
        assert (code == distance.argmin(1)).all() and (best == distance.min(1)).all() and (rows == np.arange(len(flat))).all()
        count, total = b.tally(book)
        assert (count == np.bincount(distance.argmin(1), minlength=16)).all()
        assert all((total[e] == flat[distance.argmin(1) == e].sum(0)).all() for e in range(16))


def test_hilbert_neighbours_are_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    path = grid[vc.hilbert_order(grid * 8, 3)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
