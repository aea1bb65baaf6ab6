"""Language identification with a byte convolutional network."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytenet import ByteNet, mean_logits, spread_windows
from .common import remainder, small_batches, text_bytes, with_fields

SIZE, STRIDE = 256, 248
WIDTHS = {2: 12, 3: 12, 4: 12, 6: 12}


class LanguageModel:
    def __init__(self, net: ByteNet | None, languages: list[str]):
        self.net, self.languages = net, languages

    def predict(self, raw, starts, ends):
        """(index of the language, its probability) of each text."""
        if len(self.languages) == 1:
            return np.zeros(len(starts), int), np.ones(len(starts))
        z = mean_logits(self.net, raw, starts, ends, SIZE, STRIDE)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best]


def train(docs: DataFrame, held_out=None, max_docs: int = 3000, per_doc: int = 3, max_languages: int = 500) -> LanguageModel:
    """A model of the columns ``text`` and ``lang``.

    Learns from at most ``max_docs`` different texts (8 for each language at least), the same number of each language
    as far as it has them, and ``per_doc`` windows of each, spread over the whole text: this bound keeps the driver's
    memory fixed. Of each language those texts are drawn whose hash is smallest, however many copies they have. Rows
    where ``held_out`` is true, and those with a null text or lang, are never used. Of more than ``max_languages``
    values of ``lang`` those with most rows are learnt (of equal ones the first by name); texts in others get whichever
    learnt language is nearest.
    """
    rows = docs.select("text", "lang", *([held_out.alias("_out")] if held_out is not None else [])).where("text is not null and lang is not null and text != ''")
    if held_out is not None:
        rows = rows.where("not coalesce(_out, false)")
    rows = rows.select("text", "lang", F.xxhash64("text").alias("h"))
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    languages = sorted(r["lang"] for r in most.collect())
    rows = rows.where(F.col("lang").isin(languages))
    if len(languages) < 2:
        return LanguageModel(None, languages)
    each = max(8, max_docs // len(languages))
    smallest = Window.partitionBy("lang").orderBy("h")
    chosen = rows.select("lang", "h").distinct().withColumn("at", F.row_number().over(smallest)).where(F.col("at") <= each).select("lang", "h")
    drawn = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("text", "lang")
    index = {k: i for i, k in enumerate(languages)}

    def cut(batches):
        for batch in small_batches(batches, "text"):
            row, x = spread_windows(*text_bytes(batch.column(0)), SIZE, STRIDE, per_doc)
            y = np.array([index[k] for k in batch.column(1).to_pylist()], np.int32)[row]
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in x], pa.binary()), pa.array(y)], ["x", "y"])

    got = drawn.mapInArrow(cut, "x binary, y int").toPandas().sort_values(["y", "x"], ignore_index=True)
    x = np.frombuffer(b"".join(got["x"]), np.uint8).reshape(-1, SIZE)
    return LanguageModel(ByteNet(WIDTHS, len(languages)).fit(x, got["y"].to_numpy()), languages)


def identify(docs: DataFrame, model: LanguageModel, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two columns more: the predicted language and its probability.

    ``und`` and 0 where the text is null or has no letter, and where the model learned no language. Every byte of the
    text is covered by a window. Other columns pass through unless they have one of the two names.
    """
    keep = [c for c in docs.columns if c not in (pred, score)]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__language_letter"))
    languages = [*model.languages, "und"]

    def apply(batches):
        for batch in small_batches(batches, "text"):
            letter = np.asarray(batch.column(batch.schema.get_field_index("__language_letter")).to_numpy(zero_copy_only=False), bool)
            best, p = np.full(batch.num_rows, len(languages) - 1), np.zeros(batch.num_rows)
            if model.languages and letter.any():
                raw, starts, ends = text_bytes(batch.column(batch.schema.get_field_index("text")))
                best[letter], p[letter] = model.predict(raw, starts[letter], ends[letter])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([languages[i] for i in best], pa.string()), pa.array(p)], names)

    names = [*keep, pred, score]
    schema = with_fields(rows.drop("__language_letter").schema, **{pred: "string", score: "double"})
    return rows.mapInArrow(apply, schema)


def held_out(doc_id, parts: int = 4, part: int = 2):
    """True for documents whose crc32(doc_id as text) mod ``parts`` is ``part``; false for a null id."""
    return F.coalesce(remainder(doc_id, parts) == part, F.lit(False))
