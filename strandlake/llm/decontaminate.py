"""Benchmark decontamination: latent semantic retrieval of passages, then subsequence and answer checks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, WordHasher, discard, materialize, mix, small_batches, text_bytes, with_fields

#: Hashed features of words, and words of a stripe; windows are 2 to 4 stripes and start at every stripe.
FEATURES, STRIPE = 1 << 18, 16
#: Longer benchmark items are cut into overlapping pieces of so many words; pieces that one pass searches for (25 MB).
PIECE, PIECES = 48, 1 << 16
#: Bytes of a table of cosines, and terms of a block of a product.
TABLE, CHUNK = 1 << 24, 1024


@dataclass(frozen=True)
class Limits:
    """Candidates: least cosine in the latent space and least share of a piece's own projection that a window has. Only
    terms are looked up that are among those which make up the share ``telling`` of some piece's squared length.

    Leaks: at least the share ``exact`` of a piece's words stands in the window in order. Paraphrases: the content words,
    the half of a piece with the highest inverse frequencies, are cut into segments, and the share ``paraphrase`` of them
    stands there in order within each segment, whatever the order of the segments, and the share ``answer`` of the last
    one, which holds the answer. The words found, at their mean surprise, must sum to ``evidence``, so that common
    words that stand there by chance are none. At least ``words`` words must be found.
    """

    cosine: float = 0.45
    energy: float = 0.4
    telling: float = 0.97
    exact: float = 0.8
    paraphrase: float = 0.45
    answer: float = 0.2
    evidence: float = 28.0
    words: int = 4


#: Blocks without any term that are added to the corpus, so that in a small one words do not all count as common.
PRIOR = 1000
#: Word bytes as in ALNUM; the bytes that end accented capitals count as those of small letters, whatever stands before.
FOLDED = ALNUM.copy()
FOLDED[0x80:0x9F] += 0x20


def _features(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def cut_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, words): the pieces of the benchmark's items as bytes of word hashes. Items without words have none."""

    def run(batches):
        hasher = WordHasher(FOLDED)
        for batch in small_batches(batches, "text"):
            row, h, _, _ = hasher.run(*text_bytes(batch.column(1)))
            count = np.bincount(row, minlength=batch.num_rows)
            first = np.cumsum(count) - count
            ids, words = [], []
            for item, a, k in zip(batch.column(0).to_pylist(), first, count, strict=True):
                starts = [0] if k <= PIECE else [*range(0, k - PIECE, PIECE // 2), k - PIECE]
                for s in starts if k else []:
                    ids.append(item)
                    words.append(h[a + s : a + min(k, s + PIECE)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.binary())], ["item_id", "words"])

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return rows.mapInArrow(run, "item_id long, words binary")


class Terms:
    """The term space: the features of the benchmark's own words, which are all that a window can share with it."""

    def __init__(self, features: np.ndarray):
        self.count = len(features)
        self.lookup = np.full(FEATURES, -1, np.int32)
        self.lookup[features] = np.arange(len(features), dtype=np.int32)

    def of(self, h: np.ndarray) -> np.ndarray:
        """The term of each word, -1 for words outside."""
        return self.lookup[_features(h)]


def known_features(pieces: DataFrame) -> np.ndarray:
    """The features of all pieces: at most FEATURES numbers."""

    def run(batches):
        for batch in batches:
            words = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_features(words)))], ["feature"])

    return np.sort(pieces.select("words").mapInArrow(run, "feature long").distinct().toPandas()["feature"].to_numpy(np.int64))


def corpus_terms(docs: DataFrame, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """(inverse frequencies of the terms, their surprise), in one pass over all texts.

    Passages are blocks of two stripes. Inverse frequency: log((blocks + PRIOR) / (blocks with the term + 1)) over all of
    them; surprise: the same without PRIOR. Both are exact counts.
    """

    def run(batches):
        hasher, total, blocks = WordHasher(FOLDED), np.zeros(terms.count, np.int64), 0
        for batch in small_batches(batches, "text", 1 << 20):
            row, h, _, _ = hasher.run(*text_bytes(batch.column(0)))
            count = np.bincount(row, minlength=batch.num_rows)
            first = np.cumsum(count) - count
            per = -(-count // (2 * STRIPE))
            blocks += int(per.sum())
            t = terms.of(h)
            known = np.flatnonzero(t >= 0)
            r = row[known]
            block = (np.cumsum(per) - per)[r] + (known - first[r]) // (2 * STRIPE)
            total += np.bincount(np.unique(block * terms.count + t[known]) % terms.count, minlength=terms.count)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*total[at], blocks], pa.int64())], ["term", "n"])

    got = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df, blocks = np.zeros(terms.count), 0
    for t, n in zip(got["term"], got["n"], strict=True):
        if t < 0:
            blocks = n
        else:
            df[t] = n
    return np.log((blocks + PRIOR) / (df + 1)).astype(np.float32), np.log((blocks + 1) / (df + 1))


def term_weights(idf: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Squared inverse frequencies, so that rare words decide; none weighs nothing."""
    return np.square(np.maximum(idf, least)).astype(np.float32)


def latent_basis(spark, passages: list[np.ndarray], terms: Terms, weight: np.ndarray, rank: int = 256, extra: int = 8, seed: int = 5) -> np.ndarray:
    """The leading right singular vectors [terms, rank] of the TF-IDF matrix of the passages, by distributed randomised SVD.

    The passages are all pieces of a block, as in an index: windows of the corpus are folded in like queries. Each step multiplies A'A with a thin matrix: tasks hold some rows of A and send their part of the product, cut into
    blocks of CHUNK terms that have rows there. Parts are summed by block; the thin matrix, whose size the corpus does
    not change, is orthonormalised on the driver.
    """
    rows = spark.createDataFrame([(w.tobytes(),) for w in passages], "words binary").repartition(max(1, len(passages) // 512))

    def gram(m: np.ndarray) -> np.ndarray:
        width = m.shape[1]

        def run(batches):
            out = np.zeros((terms.count, width), np.float32)
            for batch in batches:
                for w in batch.column(0).to_pylist():
                    t, tf = np.unique(terms.of(np.frombuffer(w, np.uint64)), return_counts=True)
                    x = (tf * weight[t]).astype(np.float32)
                    out[t] += x[:, None] * (x @ m[t])
            some = np.flatnonzero(out.any(1))
            cuts = np.split(some, np.flatnonzero(np.diff(some // CHUNK)) + 1) if len(some) else []
            yield pa.RecordBatch.from_arrays([pa.array([int(c[0]) // CHUNK for c in cuts], pa.int32()), pa.array([c.tobytes() for c in cuts], pa.binary()), pa.array([out[c].tobytes() for c in cuts], pa.binary())], ["block", "terms", "rows"])

        def add(key, table):
            first = key[0].as_py() * CHUNK
            total = np.zeros((CHUNK, width), np.float32)
            for t, x in zip(table.column("terms").to_pylist(), table.column("rows").to_pylist(), strict=True):
                total[np.frombuffer(t, np.int64) - first] += np.frombuffer(x, np.float32).reshape(-1, width)
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "rows": pa.array([total.tobytes()], pa.binary())})

        got = rows.mapInArrow(run, "block int, terms binary, rows binary").groupBy("block").applyInArrow(add, "block int, rows binary").toPandas()
        z = np.zeros((-(-terms.count // CHUNK) * CHUNK, width), np.float32)
        for block, x in zip(got["block"], got["rows"], strict=True):
            z[block * CHUNK : (block + 1) * CHUNK] = np.frombuffer(x, np.float32).reshape(-1, width)
        return z[: terms.count]

    width = min(rank + extra, len(passages), terms.count)
    q = np.random.default_rng(seed).standard_normal((terms.count, width)).astype(np.float32)
    for _ in range(2):
        q = np.linalg.qr(gram(q))[0]
    values, vectors = np.linalg.eigh(q.T @ gram(q))
    return (q @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence; ``masks`` has a bit for each place of a word in the first sequence."""
    ones = (1 << size) - 1
    v = ones
    for w in words:
        u = v & masks.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & ones
    return size - v.bit_count()


def masks_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def run_length(size: int) -> int:
    """Words of a run that a piece of ``size`` words keeps whole if at most a fifth of them are changed, left out or put between."""
    return {1: 1, 2: 2, 5: 2}.get(size, 3)


def _runs(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words from each place on."""
    out = h[: max(0, len(h) - length + 1)]
    for j in range(1, length):
        out = mix(out) + h[j : j + len(out)]
    return out


class RunIndex:
    """The word runs of pieces, each with its piece and its place there, by hash."""

    def __init__(self, words: list[np.ndarray]):
        self.tables = []
        for length in (1, 2, 3):
            keys = [(_runs(w, length), k) for k, w in enumerate(words) if len(w) and run_length(len(w)) == length]
            if keys:
                key = np.concatenate([x for x, _ in keys])
                piece = np.concatenate([np.full(len(x), k, np.int64) for x, k in keys])
                place = np.concatenate([np.arange(len(x)) for x, _ in keys])
                order = np.argsort(key, kind="stable")
                known = np.zeros(1 << 20, bool)
                known[key >> np.uint64(44)] = True
                self.tables.append((length, key[order], piece[order], place[order], known))

    def find(self, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, piece, place in ``h`` where the piece would begin) of every run of a piece that stands in one row, each once."""
        found = [np.zeros((3, 0), np.int64)]
        for length, key, piece, place, known in self.tables:
            x = _runs(h, length)
            at = np.flatnonzero(known[x >> np.uint64(44)])
            at = at[row[at] == row[at + length - 1]]
            lo, hi = np.searchsorted(key, x[at], "left"), np.searchsorted(key, x[at], "right")
            n = hi - lo
            entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append(np.stack([np.repeat(row[at], n), piece[entry], np.repeat(at, n) - place[entry]]))
        rows, pieces, starts = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((starts, pieces, rows))
        rows, pieces, starts = rows[order], pieces[order], starts[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (pieces[1:] != pieces[:-1]) | (starts[1:] != starts[:-1])
        return rows[new], pieces[new], starts[new]


def telling_terms(t: np.ndarray, weight: np.ndarray, share: float) -> np.ndarray:
    """The dearest terms of a piece, which make up the ``share`` of its squared length."""
    t, tf = np.unique(t, return_counts=True)
    energy = np.square(tf * weight[t])
    order = np.argsort(-energy, kind="stable")
    rest = np.cumsum(energy[order]) - energy[order]
    return t[order[rest < share * energy.sum()]]


class Ordered:
    """Word sequences to be found in others: a bit mask for each, and their number of words."""

    def __init__(self, *sequences: list[int]):
        self.masks = [(masks_of(x), len(x)) for x in sequences]
        self.size = sum(n for _, n in self.masks)
        self.distinct = {x for s in sequences for x in s}
        self.repeated = self.size - len(self.distinct)

    def most(self, distinct: set[int]) -> int:
        """No more words than these can be found in a text of ``distinct`` words."""
        return len(self.distinct & distinct) + self.repeated

    def found(self, words: list[int]) -> list[int]:
        return [common_subsequence(m, n, words) for m, n in self.masks]


class Searcher:
    """Finds leaks of a block of pieces in texts."""

    def __init__(self, pieces, terms: Terms, idf, surprise, basis, limits: Limits):
        self.limits, self.items = limits, [i for i, _ in pieces]
        self.size = [len(w) for _, w in pieces]
        self.whole = [Ordered(w.tolist()) for _, w in pieces]
        self.content, self.least = [], []
        for _, w in pieces:
            x = idf[terms.of(w)]
            own, mean = w[x >= np.median(x)].tolist(), max(1e-9, float(surprise[terms.of(w)[x >= np.median(x)]].mean()))
            self.least.append(max(limits.words, limits.paraphrase * len(own), limits.evidence / mean))
            n = max(1, min(4, len(own) // 3))
            self.content.append(Ordered(*[own[len(own) * i // n : len(own) * (i + 1) // n] for i in range(n)]))
        weight = term_weights(idf)
        self.project = basis * weight[:, None]
        kept = np.zeros(terms.count + 1, bool)
        for _, w in pieces:
            kept[telling_terms(terms.of(w), weight, limits.telling)] = True
        self.lookup = np.where(kept[terms.lookup], terms.lookup, -1)
        self.project[~kept[:-1]] = 0
        self.runs = RunIndex([w for _, w in pieces])
        vectors = np.stack([self.project[terms.of(w)].sum(0) for _, w in pieces])
        self.scales = []
        for stripes in (2, 3, 4):
            at = np.array([k for k, n in enumerate(self.size) if (stripes - 2) * STRIPE < n <= (stripes - 1) * STRIPE], np.int64)
            if len(at):
                norm = np.maximum(np.linalg.norm(vectors[at], axis=1), 1e-9)
                self.scales.append((stripes, at, (vectors[at] / norm[:, None]).T.copy(), norm))

    def verify(self, k: int, words: list[int], distinct: set[int]) -> float:
        """The share of piece ``k`` that stands in ``words`` in order, or 0 if it is no leak.

        ``distinct``: the set of words; too few in common rule out both checks.
        """
        size, content, limits = self.size[k], self.content[k], self.limits
        exact = self.whole[k].most(distinct) >= limits.exact * size
        told = content.most(distinct) >= self.least[k]
        if not exact and not told:
            return 0.0
        share = self.whole[k].found(words)[0] / size
        if share >= limits.exact:
            return share
        if told:
            found = content.found(words)
            if sum(found) >= self.least[k] and found[-1] >= limits.answer * content.masks[-1][1]:
                return sum(found) / content.size * limits.exact
        return 0.0

    def search(self, hasher: WordHasher, raw, starts, ends) -> dict[int, tuple[float, int]]:
        """row -> (share, item) of the best leak of each text that has one."""
        row, h, _, _ = hasher.run(raw, starts, ends)
        if not len(row):
            return {}
        count = np.bincount(row, minlength=len(starts))
        first = np.cumsum(count) - count
        per = -(-count // STRIPE)
        base = np.cumsum(per) - per
        stripe = base[row] + (np.arange(len(row)) - first[row]) // STRIPE
        t = self.lookup[_features(h)]
        known = np.flatnonzero(t >= 0)
        total = int(per.sum())
        sums = np.zeros((total, self.project.shape[1]), np.float32)
        if len(known):
            s = stripe[known]
            cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            sums[s[cut]] = np.add.reduceat(self.project[t[known]], cut)
        owner = np.repeat(np.arange(len(starts)), per)
        best: dict[int, tuple[float, int]] = {}
        window = sums.copy()
        reach = 1
        for stripes, at, unit, norm in self.scales:
            while reach < stripes:
                same = owner[reach:] == owner[:-reach]
                window[:-reach][same] += sums[reach:][same]
                reach += 1
            length = np.linalg.norm(window, axis=1)
            step = max(16, min(4096, TABLE // (4 * len(at))))
            for a in range(0, total, step):
                dot = window[a : a + step] @ unit
                hit = (dot >= self.limits.cosine * length[a : a + step, None]) & (dot >= self.limits.energy * norm)
                which, piece = np.nonzero(hit)
                at_window = -1
                for w, k in zip((which + a).tolist(), at[piece].tolist(), strict=True):
                    if w != at_window:
                        at_window, r = w, int(owner[w])
                        lo = first[r] + max(0, (w - base[r] - 1) * STRIPE)
                        hi = min(first[r] + count[r], first[r] + (w - base[r] + stripes + 1) * STRIPE)
                        words = h[lo:hi].tolist()
                        distinct = set(words)
                    item, had = self.items[k], best.get(r)
                    if had and had[0] >= 1.0 and had[1] <= item:
                        continue
                    share = self.verify(k, words, distinct)
                    if share and (had is None or (-share, item) < (-had[0], had[1])):
                        best[r] = (share, item)
        self._search_runs(row, h, first, count, best)
        return best

    def _search_runs(self, row, h, first, count, best: dict[int, tuple[float, int]]) -> None:
        """Adds the leaks around every word run of a piece, whatever the weight and cosine of their words.

        The check sees the piece's own length of words there and a quarter more on both sides.
        """
        for r, k, start in zip(*(x.tolist() for x in self.runs.find(row, h)), strict=True):
            item, had = self.items[k], best.get(r)
            if had and had[0] >= 1.0 and had[1] <= item:
                continue
            size = self.size[k]
            lo = max(int(first[r]), start - size // 4)
            words = h[lo : min(int(first[r] + count[r]), start + size + size // 4)].tolist()
            share = self.verify(k, words, set(words))
            if share and (had is None or (-share, item) < (-had[0], had[1])):
                best[r] = (share, item)


def find_leaks(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), rank: int = 256, names: tuple[str, str, str] = ("contaminated", "item_id", "overlap")) -> DataFrame:
    """``docs`` with contaminated (boolean), item_id (the item found, else null) and overlap (its share, else 0).

    A document is contaminated if some window of it holds a benchmark piece: words in lower case, cut at all that is
    neither letter nor digit. Windows near a piece in the latent space are checked, and the places around every run of
    three words of a piece (fewer for very short ones), so that verbatim passages of any words are found, however many
    documents hold them. Whole texts are searched. ``overlap`` is the share of the piece that stands there in order, for
    paraphrases that of its content words times ``exact``; of several pieces the largest counts, then the smallest
    item_id. Null and empty texts are clean; benchmark rows with a null id or without words ask nothing; an empty
    benchmark leaves all clean. Other columns pass through unless they have one of the three ``names``.

    The benchmark is the stated query set. Its pieces are dealt into blocks of about PIECES, of which each comes to the
    driver and goes to the tasks; the texts are read once for the frequencies and once for the search, in which the
    blocks follow one another in one stage, without a shuffle.
    """
    keep = [c for c in docs.columns if c not in names]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(False).alias(names[0]), F.lit(None).cast("long").alias(names[1]), F.lit(0.0).alias(names[2]))
    schema = with_fields(docs.select(*[F.col(f"`{c}`") for c in keep]).schema, **dict(zip(names, ("boolean", "long", "double"), strict=True)))
    cut = materialize(cut_items(benchmark), "pieces")
    count = cut.count()
    if not count:
        return rows
    terms = Terms(known_features(cut))
    idf, surprise = corpus_terms(docs, terms)
    blocks = -(-count // PIECES)
    for block in range(blocks):
        own = cut.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block).toPandas().sort_values(["item_id", "words"])
        pieces = [(int(i), np.frombuffer(w, np.uint64)) for i, w in zip(own["item_id"], own["words"], strict=True)]
        if pieces:
            basis = latent_basis(docs.sparkSession, [w for _, w in pieces], terms, term_weights(idf), rank)
            rows = rows.mapInArrow(_search(Searcher(pieces, terms, idf, surprise, basis, limits), len(keep), schema.names), schema)
    discard(cut)
    return rows


def _search(searcher: Searcher, width: int, names: list[str]):
    def run(batches):
        hasher = WordHasher(FOLDED)
        for batch in small_batches(batches, "text", 1 << 20):
            found = searcher.search(hasher, *text_bytes(batch.column(names.index("text"))))
            item, share = batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist()
            for r, (s, i) in found.items():
                if item[r] is None or (-s, i) < (-share[r], item[r]):
                    item[r], share[r] = i, s
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array([i is not None for i in item]), pa.array(item, pa.int64()), pa.array(share, pa.float64())], names)

    return run
