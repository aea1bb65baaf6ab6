"""Document quality with a byte-level convolutional network."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytenet import ByteNet, mean_logits, spread_windows
from .common import remainder, small_batches, text_bytes, with_fields

SIZE, STRIDE = 384, 320
WIDTHS = {3: 16, 6: 16}


def train(docs: DataFrame, labels: DataFrame, held_out=None, per_class: int = 1500, per_doc: int = 3) -> ByteNet | float:
    """A network that tells quality 1 from 0, or the one share of label 1 where only one class is there.

    Learns from at most ``per_class`` labelled documents of each class (those with the smallest hash of doc_id) and
    ``per_doc`` chunks of each, spread over the whole text: the bound keeps the driver's memory fixed. Labels with a
    null doc_id or quality are not used; of several labels of a document the smallest counts. ``held_out`` is a
    function of the doc_id column; where it is true the label is never used.
    """
    y = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    if held_out is not None:
        y = y.where(~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = y.where("y = 0").orderBy(*order).limit(per_class).union(y.where("y = 1").orderBy(*order).limit(per_class))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id").select("text", "y")

    def cut(batches):
        for batch in small_batches(batches, "text"):
            row, x = spread_windows(*text_bytes(batch.column(0)), SIZE, STRIDE, per_doc)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in x], pa.binary()), pa.array(np.asarray(batch.column(1))[row], pa.int32())], ["x", "y"])

    got = rows.mapInArrow(cut, "x binary, y int").toPandas().sort_values(["y", "x"], ignore_index=True)
    target = got["y"].to_numpy()
    if len(set(target)) < 2:
        return float(target.mean()) if len(target) else 0.5
    x = np.frombuffer(b"".join(got["x"]), np.uint8).reshape(-1, SIZE)
    return ByteNet(WIDTHS, 2, hidden=16, seed=3).fit(x, target, epochs=6)


def score_quality(docs: DataFrame, model: ByteNet | float, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with the probability of label 1 and, as an int, whether it is 0.5 or more.

    The chunks overlap and cover the whole text; a null text counts as empty and also gets a score. Other columns
    pass through unless they have one of the two names.
    """
    keep = [c for c in docs.columns if c not in (score, predicted)]
    names = [*keep, score, predicted]

    def apply(batches):
        for batch in small_batches(batches, "text"):
            if isinstance(model, float):
                p = np.full(batch.num_rows, model)
            else:
                z = mean_logits(model, *text_bytes(batch.column(batch.schema.get_field_index("text"))), SIZE, STRIDE)
                p = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names)

    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    return rows.mapInArrow(apply, with_fields(rows.schema, **{score: "double", predicted: "int"}))


def held_out(doc_id, parts: int = 3, part: int = 1):
    """True for documents whose crc32(doc_id as text) mod ``parts`` is ``part``; false for a null id."""
    return F.coalesce(remainder(doc_id, parts) == part, F.lit(False))
