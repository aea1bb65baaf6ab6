"""Counts over the places of many alignments at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters of a matrix that are compared in one step.
AT_ONCE = 1 << 20
PLACED = "mm int, runs int, mm_1_4 int, mm_5_8 int, mm_9_12 int, mm_13_16 int, mm_17_end int, {}, enthalpy double, flank_enthalpy double"


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of a string column as code points, a row for each string and 0 after its end, and the lengths (null: 0)."""
    column = pc.fill_null(column, "")
    size = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if pc.all(pc.string_is_ascii(column)).as_py() is False:
        flat = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32)
    else:
        flat = np.frombuffer(pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(column)]), column), "")[0].as_buffer(), np.uint8).astype(np.uint32)
    width = int(size.max(initial=0))
    if len(flat) == width * len(size):
        return flat.reshape(len(size), width), size
    inside = np.arange(width) < size[:, None]
    out = np.zeros(inside.shape, np.uint32)
    out[inside] = flat
    return out, size


def counter(pam: int, mispairs: dict[str, tuple[str, ...]], heats: dict[str, float]) -> tuple[Callable, str]:
    """A function of Arrow columns guide, dna, dna without gaps and flank, all in upper case, and the type of what it gives.

    Places are those of the guide without its last ``pam`` letters; a place without a letter of the DNA is neither equal
    nor different. ``crista_features`` says what is counted.
    """
    code = np.full(257, 4, np.uint8)
    code[[ord(x) for x in "ACGT"]] = range(4)
    table = np.array([heats.get(a + b, 0.0) for a in "ACGT?" for b in "ACGT?"])

    def heat(column: pa.Array) -> np.ndarray:
        letters, _ = _matrix(column)
        known = code[np.minimum(letters, 256)]
        total = np.zeros(len(known))
        for i in range(known.shape[1] - 1):
            total += table[known[:, i] * 5 + known[:, i + 1]]
        return total

    def some(guide: pa.Array, dna: pa.Array, plain: pa.Array, flank: pa.Array) -> list[pa.Array]:
        (g, lg), (d, ld) = _matrix(guide), _matrix(dna)
        n = np.maximum(lg - pam, 0)
        width = int(n.max(initial=0))
        g, d = g[:, :width], np.pad(d, ((0, 0), (0, max(0, width - d.shape[1]))))[:, :width]
        at = np.arange(width)
        there = at < np.minimum(n, ld)[:, None]
        differ = there & (g != d)
        bad = differ & (g != ord("-")) & (d != ord("-"))
        equal = there & ~differ
        rows = np.arange(len(n))
        counts = [bad.sum(1), (differ[:, :-1] & equal[:, 1:]).sum(1)]
        for k in range(4):
            has = n >= 4 * k + 4
            counts.append(has & bad[rows, np.where(has, n - 1 - 4 * k, 0)] if width else has)
        far = bad & (at >= 3) & (at <= n[:, None] - 17)
        counts.append(np.where(n >= 20, far.sum(1), 0))
        for kinds in mispairs.values():
            counts.append(sum((there & (g == ord(a)) & (d == ord(b))).sum(1) for a, b in kinds))
        none = np.asarray(pc.or_(guide.is_null(), dna.is_null()))
        quartets = range(2, 6)
        out = [pa.array(np.asarray(x).astype(np.int32), mask=None if i in quartets else none) for i, x in enumerate(counts)]
        return [*out, pa.array(heat(plain)), pa.array(heat(flank))]

    kind = PLACED.format(", ".join(f"{k} int" for k in mispairs))
    names = [x.split()[0] for x in kind.split(", ")]

    def run(guide: pa.Array, dna: pa.Array, plain: pa.Array, flank: pa.Array) -> pa.Array:
        longest = max(pc.max(pc.utf8_length(x)).as_py() or 0 for x in (guide, dna, plain, flank))
        step = max(1, AT_ONCE // max(1, longest))
        columns = (guide, dna, plain, flank)
        parts = [pa.StructArray.from_arrays(some(*(x.slice(i, step) for x in columns)), names) for i in range(0, len(guide), step)]
        return pa.concat_arrays(parts or [pa.StructArray.from_arrays(some(*columns), names)])

    return run, kind
