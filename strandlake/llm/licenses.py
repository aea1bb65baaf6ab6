"""License scan: exact set-similarity join of text blocks with license templates, in DataFrame functions alone."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: What separates words.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are always reported, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: How the conditions of Creative Commons licenses are written: in one word, in two, in letters; and the words of which none may stand near the notice of a license without that condition.
CONDITIONS = {
    "nc": ("NonCommercial", "Non Commercial", "NC", "noncommercial commercial"),
    "nd": ("NoDerivatives", "No Derivatives", "ND", "noderivatives noderivs derivatives"),
    "sa": ("ShareAlike", "Share Alike", "SA", "sharealike alike"),
}
VARIANTS = ((), ("nc",), ("nd",), ("sa",), ("nc", "nd"), ("nc", "sa"))


def commons(*conditions: str) -> list[tuple[str, str, str, str]]:
    """The templates of the Creative Commons Attribution license with these conditions."""
    label = "-".join(("cc-by", *conditions))
    bars = " ".join(words for c, (*_, words) in CONDITIONS.items() if c not in conditions)
    out = []
    for style in (0, 1) if conditions else (0,):
        said = " ".join(CONDITIONS[c][style] for c in conditions)
        out.append((label, f"this work is licensed under a Creative Commons Attribution {said} 4 0 International License", f"creative commons attribution {said}", bars))
    said = " ".join(CONDITIONS[c][2] for c in conditions)
    return [*out, (label, f"licensed under CC BY {said} 4 0", f"cc by {said}", " ".join([bars, *(c for c in CONDITIONS if c not in conditions)]))]


#: Notices of public licenses as (label, text, the words without which it is not that license, the words with which it
#: is not); at most BLOCK / 2 + 1 words each, so that a whole notice lies in one block.
TEMPLATES = [
    ("mit", "released under the MIT License", "mit license", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "granted charge software obtaining", ""),
    ("apache", "licensed under the Apache License version 2 0", "apache license", ""),
    ("apache", "you may not use this file except in compliance with the License", "except compliance license", ""),
    ("gpl", "this work is licensed under the GNU General Public License version 3", "general public license", ""),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the GNU General Public License", "redistribute general public license", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary permitted", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "granted distribute purpose fee", ""),
    ("mpl", "this source code form is subject to the terms of the Mozilla Public License", "mozilla public license", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered public domain", ""),
    *(template for conditions in VARIANTS for template in commons(*conditions)),
]
#: Blocks are BLOCK words long and start every BLOCK / 2 words.
BLOCK = 64
CONTAINMENT = 0.8


def words(text: Column) -> Column:
    """The array of words of a text: A-Z in lower case, cut at SEPARATOR; empty for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def tokens(text: str) -> list[str]:
    return list(dict.fromkeys(x for x in re.split(SEPARATOR, text.lower()) if x))


def vocabulary_counts(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """How often each word of the templates occurs in the whole corpus; as many entries as the templates have words."""
    vocabulary = sorted({w for _, t, *_ in templates for w in tokens(t)})
    counted = docs.select(F.explode(words(F.col("text"))).alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").count()
    return {w: 0 for w in vocabulary} | {r["w"]: r["count"] for r in counted.collect()}


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base: places where the words of a phrase stand consecutively. Join: words are ordered by their frequency in the
    corpus, rarest first. A block that holds ``need`` of a template's words holds one of its first
    ``size - need + 1`` words, so only blocks at such words are candidates; the length filter (the block has at least
    ``need`` different words) and the positional filter (enough words come after the first common one, in the template
    and in the block) drop candidates before the exact count. A template counts only where the block also holds all its
    telling words and none of those that bar it. ``score`` is the highest containment found, 0 without.

    A null text counts as empty; a null doc_id stays null; repeated rows give repeated results; other columns are not
    read. The second pass has no shuffle, whatever the number of copies.
    """
    counts = vocabulary_counts(docs, templates)
    rank = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
    sets, index = [], {}
    for k, (label, text, telling, bars) in enumerate(templates):
        own = sorted(tokens(text), key=rank.get)
        need = math.ceil(containment * len(own) - 1e-9)
        sets.append((label, own, need, tokens(telling), tokens(bars)))
        for at, w in enumerate(own[: len(own) - need + 1]):
            index.setdefault(w, []).append((k, at))
    prefix = F.array(*map(F.lit, index))
    posted = F.create_map(*[x for w, hits in index.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(at).alias("at")) for k, at in hits]))])
    ranks = F.create_map(*[F.lit(x) for w, i in rank.items() for x in (w, i)])
    table = F.array(*[F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, own)).alias("words"), F.lit(need).alias("need"), F.array(*map(F.lit, telling)).alias("telling"), F.array(*map(F.lit, bars)).cast("array<string>").alias("bars")) for label, own, need, telling, bars in sets])
    half = BLOCK // 2

    rows = docs.select("doc_id", words(F.col("text")).alias("w"))
    w, ids = F.col("w"), F.sequence(F.lit(0), F.size("w") - 1)

    def stands(i, phrase):
        test = F.lit(True)
        for j, p in enumerate(phrase.split()):
            test = test & F.coalesce(F.get(w, i + j) == p, F.lit(False))
        return test

    def places(phrase, label):
        return F.transform(F.filter(ids, lambda i: stands(i, phrase)), lambda i: F.named_struct(F.lit("label"), F.lit(label), F.lit("at"), i))

    last = sorted({p.split()[-1] for p in phrases})
    nothing = F.array().cast("array<struct<label:string,at:int>>")
    base = F.when(
        F.arrays_overlap(w, F.array(*map(F.lit, last))),
        F.flatten(F.array(*[places(p, v) for p, v in phrases.items()])),
    ).otherwise(nothing)

    def blocks_of(i):
        b = F.floor(i / F.lit(half)).cast("int")
        return F.filter(F.array(b - 1, b), lambda x: x >= 0)

    candidates = F.array_distinct(
        F.flatten(
            F.transform(
                F.filter(ids, lambda i: F.array_contains(prefix, F.get(w, i))),
                lambda i: F.flatten(F.transform(blocks_of(i), lambda b: F.transform(posted[F.get(w, i)], lambda t: F.named_struct(F.lit("b"), b, F.lit("k"), t["k"], F.lit("at"), t["at"], F.lit("rank"), ranks[F.get(w, i)])))),
            )
        )
    )

    def block(c):
        return F.array_distinct(F.slice(w, c["b"] * half + 1, BLOCK))

    def survives(c):
        t = F.get(table, c["k"])
        known = F.filter(block(c), lambda x: F.array_contains(F.map_keys(ranks), x))
        after = F.size(F.filter(known, lambda x: ranks[x] > c["rank"]))
        return (F.size(block(c)) >= t["need"]) & (1 + F.least(F.size(t["words"]) - 1 - c["at"], after) >= t["need"])

    def contained(c):
        t = F.get(table, c["k"])
        common = F.size(F.array_intersect(block(c), t["words"]))
        told = F.size(F.array_except(t["telling"], block(c))) == 0
        return F.named_struct(F.lit("label"), t["label"], F.lit("c"), F.when((common >= t["need"]) & told & ~F.arrays_overlap(t["bars"], block(c)), common / F.size(t["words"])))

    found = F.when(F.arrays_overlap(w, prefix), F.filter(F.transform(F.filter(candidates, survives), contained), lambda x: x["c"].isNotNull())).otherwise(F.array().cast("array<struct<label:string,c:double>>"))
    rows = rows.select("doc_id", F.size(w).cast("long").alias("n_words"), F.when(F.size(w) > 0, base).otherwise(nothing).alias("base"), F.when(F.size(w) > 0, found).alias("found"))
    joined = lambda *parts: F.array_join(F.array_sort(F.array_distinct(F.concat(*parts))), ",")
    own = F.transform("base", lambda x: x["label"])
    at = F.transform("base", lambda x: x["at"].cast("long"))
    more = F.coalesce(F.transform("found", lambda x: x["label"]), F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), joined(own).alias("base_labels"), joined(own, more).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda x: x["c"])), F.lit(0.0)).alias("score"))


def oracle() -> str:
    """The same in DuckDB SQL: every block is compared with every template."""
    values = ", ".join(f"({k}, '{label}', {tokens(t)!r}, {tokens(telling)!r}, {tokens(bars)!r}::VARCHAR[])" for k, (label, t, telling, bars) in enumerate(TEMPLATES))
    phrases = " UNION ALL ".join(
        f"SELECT r, i, '{v}' AS label FROM places WHERE " + " AND ".join(f"w[i + {j + 1}] = '{p}'" for j, p in enumerate(phrase.split())) for phrase, v in PHRASES.items()
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATOR}'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT r, w, unnest(range(len(w))) AS i FROM d WHERE list_contains(w, 'license')),
base AS ({phrases}),
b AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, list(label) AS labels FROM base GROUP BY r),
t AS (SELECT * FROM (VALUES {values}) AS v(k, label, words, telling, bars)),
blocks AS (SELECT r, s, list_distinct(w[s * {BLOCK // 2} + 1 : s * {BLOCK // 2} + {BLOCK}]) AS bw FROM (SELECT r, w, unnest(range((len(w) - 1) // {BLOCK // 2} + 1)) AS s FROM d WHERE len(w) > 0)),
bt AS (SELECT r, s, unnest(bw) AS word FROM blocks),
tt AS (SELECT k, label, len(words) AS size, len(telling) AS must, unnest(list_transform(words, lambda x: struct_pack(word := x, tells := list_contains(telling, x))), recursive := true) FROM t),
hit AS (SELECT r, s, k, label, size, must, count(*) AS c FROM bt JOIN tt USING (word) GROUP BY ALL HAVING count(*) >= ceil({CONTAINMENT} * size - 1e-9) AND count(*) FILTER (tells) = must),
m AS (SELECT r, list(h.label) AS labels, max(c::DOUBLE / size) AS score FROM hit h JOIN blocks USING (r, s) JOIN t USING (k) WHERE NOT list_has_any(bw, bars) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word,
array_to_string(list_sort(list_distinct(coalesce(b.labels, []))), ',') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
coalesce(m.score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)"""
