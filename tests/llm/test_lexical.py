"""Ranked search against a plain scoring of every document; shards, blocks and bounds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from strandlake.llm import lexical
from strandlake.llm.common import ALNUM, WordHasher, text_bytes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    """(item, rank, doc, score) by the definition."""
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n, total = len(own), sum(s for _, _, s in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c, size in own:
            m = 100 - 90 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def check(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, 0.5, "a") for i, t in docs], "doc_id long, text string, score double, term string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = lexical.rank(d, q, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain(docs, items, k)


def corpus(seed, n):
    r = random.Random(seed)
    words = ["the", "and", *[f"w{i}" for i in range(30)], *[f"rare{i}" for i in range(300)], "Straße", "né"]
    weights = [60, 40, *[4] * 30, *[0.2] * 300, 1, 1]
    return [(i, " ".join(r.choices(words, weights, k=int(r.paretovariate(0.8) * 4) % 400))) for i in range(n)], r


@pytest.mark.parametrize("shard, terms_at_once", [(1 << 24, 1 << 20), (3000, 40)])
def test_search_equals_plain_scoring(spark, monkeypatch, shard, terms_at_once):
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical, "SLICE", shard // 2)
    monkeypatch.setattr(lexical, "QUERY_TERMS", terms_at_once)
    docs, r = corpus(shard, 900)
    docs += [(7, docs[3][1])] * 40 + [(None, docs[3][1]), (2000, None), (2001, ""), (2002, "-- !"), (2003, "THE the Rare1-rare2 " * 900)]
    items = [(i, " ".join(r.choice(docs)[1].split()[:40])) for i in range(25)] + [(90, "the"), (91, "unknown"), (92, None), (93, ""), (94, "STRASSE straße NÉ"), (0, "rare5 and w1"), (90, "the"), (None, "w3 w4")]
    check(spark, docs, items)


def test_search_of_odd_tables(spark):
    check(spark, [], [(1, "a")])
    check(spark, [(1, "a b")], [])
    check(spark, [(1, None), (2, " ")], [(1, "a")])
    check(spark, [(i, "same words here") for i in range(30)], [(1, "words"), (2, "same here")], 7)
    check(spark, [(3, "a"), (3, "a"), (1, "a b"), (2, "b b c")], [(1, "a b c c")])


def opened(texts):
    import pyarrow as pa

    raw, starts, ends = text_bytes(pa.array(texts))
    term, row, tf = lexical.count_terms(WordHasher(ALNUM), raw, starts, ends)
    n = np.bincount(row, tf, len(texts)).astype(np.int64)
    parts = lexical.encode(term, row, tf, n)
    return lexical.Shard({k: parts[k].astype(kind).tobytes() for k, kind in lexical._FIELDS.items()}, int((n > 0).sum()), int(n.sum())), (term, row, tf), n


def test_blocks_give_back_their_postings():
    docs, _ = corpus(5, 3000)
    texts = [t for _, t in docs] + ["gap"] + ["x"] * 70000 + ["gap " * 70000]  # gaps and counts of one, two and four bytes
    shard, (term, row, tf), n = opened(texts)
    for t in range(len(shard.terms)):
        doc, share = shard.postings(t)
        own = term == shard.terms[t]
        assert (doc == row[own]).all() and (share == lexical.share(tf[own], shard.m[doc])).all()
        tops = np.maximum.reduceat(share, np.arange(0, len(doc), lexical.BLOCK))
        assert (tops == shard.top[shard.block[t] : shard.block[t + 1]]).all()  # skylines give each block's exact maximum


def test_blocks_are_rejected_undecoded(monkeypatch):
    """Ten good documents set the threshold; the long list of a frequent term is then decoded only where they stand."""
    texts = ["the best match"] * 10 + ["the " + "filler " * (5 + i % 7) for i in range(20000)]
    shard, _, n = opened(texts)
    decoded, decode = [], lexical.Shard.decode
    monkeypatch.setattr(lexical.Shard, "decode", lambda self, blocks, first: decoded.append(len(blocks)) or decode(self, blocks, first))
    q = np.unique(WordHasher(ALNUM).run(*text_bytes(__import__("pyarrow").array(["the best match"])))[1])
    df = np.array([int(shard.b_size[shard.block[t] : shard.block[t + 1]].sum()) for t in shard.find(q)])
    w = np.array([lexical.weight(int(x), len(texts)) for x in df])
    tops = np.array([shard.top[shard.block[t] : shard.block[t + 1]].max() for t in shard.find(q)])
    best = lexical.Best(10)
    lexical.search_shard(shard, np.arange(len(texts)), np.zeros(len(texts), bool), q, w, w * tops, best)
    assert best.doc.tolist() == list(range(10)) and sum(decoded) <= 4 and len(shard.b_size) > 300
