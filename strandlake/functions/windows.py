"""Windows cut out of many chunks of sequence at once, as bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .sequence import BY_MASK, COMPLEMENT_FROM, COMPLEMENT_TO, IUPAC

#: Letters that are cut in one step; letters of a sequence in one number of 4 bits each.
AT_ONCE, LETTERS = 1 << 18, 15

_BITS = np.zeros(256, np.uint8)
for _code, _bases in IUPAC.items():
    _BITS[[ord(_code), ord(_code.lower())]] = sum(1 << "ACGT".index(x) for x in _bases)
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[[ord(x) for x in COMPLEMENT_FROM]] = [ord(x) for x in COMPLEMENT_TO]
#: The code of a base set; any base is ``n``, so that it is not taken for an unknown one.
_CODES = np.frombuffer(("?" + BY_MASK[:14] + "n").encode(), np.uint8)
_PLAIN = np.isin(np.arange(256), [ord(x) for x in "ACGT"])


def strings(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as strings."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows)))


def numbers(bits: np.ndarray, first: int, spacer: int) -> list[np.ndarray]:
    """The base sets of ``spacer`` letters from column ``first`` on, 4 bits each, in numbers of LETTERS; columns that are not there have none."""
    out = []
    for at in range(0, spacer, LETTERS):
        x = np.zeros(len(bits), np.int64)
        for i in range(first + at, first + min(spacer, at + LETTERS)):
            x <<= 4
            if 0 <= i < bits.shape[1]:
                x |= bits[:, i]
        out.append(x)
    return out


def number_names(shifts: list[int], spacer: int) -> list[str]:
    return [f"_w{k}_{i}" for k in range(len(shifts)) for i in range(-(-spacer // LETTERS))]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of a string column one after another, and where each row begins there. Other than ASCII counts as one ``?``."""
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    cuts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if cuts[-1] > cuts[0] else np.zeros(0, np.uint8)
    if len(raw) and raw.max() > 127:
        rows = [x.encode("ascii", "replace") for x in column.to_pylist()]
        return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
    return raw, cuts - cuts[0]


def cutter(length: int, pam: str | None, five_prime: bool, widened: bool, site: tuple[int, int] | None, shifts: list[int], spacer: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches of chunks (chrom, start, n, seq and, if ``widened``, held: an array of pos, alts) that gives
    chrom, pos, strand and window of the ``n`` first windows of each on both strands, without N and with the PAM.

    ``widened``: letters at the places of ``held`` are the code of the reference base and the alternates; ``reference``
    is the window without them. With ``site`` (first and last + 1 letter of the window that is compared with a guide) also
    ``_plain``, whether it has but A, C, G and T, and its numbers from each of ``shifts`` on, as ``number_names`` calls them.
    """
    motif = (pam or "").upper()
    back = motif.translate(str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO))[::-1]
    near, far = 0, length - len(motif)
    strands = [("+", motif, near if five_prime else far), ("-", back, far if five_prime else near)]
    allowed = {c: (_BITS & _BITS[ord(c)]) != 0 for c in motif + back}
    names = ["chrom", "pos", "strand", "window", *(["reference"] if widened else []), *(["_plain", *number_names(shifts, spacer)] if site else [])]

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, cuts = _bytes(batch.column(3))
        most = len(raw) - length + 1
        if most <= 0:
            return
        starts, chroms = cuts[:-1], batch.column(0)
        first, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
        seq = raw
        if widened:
            held = batch.column(4)
            count = np.nan_to_num(np.asarray(held.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
            flat = held.flatten()
            row = np.repeat(np.arange(batch.num_rows), count)
            at = flat.field(0).to_numpy(zero_copy_only=False) - first[row] + starts[row]
            alts = flat.field(1).to_numpy(zero_copy_only=False)
            inside = (at >= starts[row]) & (at < cuts[1:][row])
            at, alts = at[inside], alts[inside]
            at, alts = at[raw[at] != ord("N")], alts[raw[at] != ord("N")]
            seq = raw.copy()
            seq[at] = _CODES[_BITS[raw[at]] | alts]
        change = np.zeros(len(raw) + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + np.maximum(n, 0), -1)
        unknown = np.concatenate([[0], np.cumsum(seq == ord("N"))])
        good = (np.cumsum(change)[:most] > 0) & (unknown[length:] == unknown[:most])
        for strand, pattern, at in strands:
            own = good
            for k, c in enumerate(pattern, at):
                if c != "N":
                    own = own & allowed[c][seq[k : k + most]]
            where = np.flatnonzero(own)
            if not len(where):
                continue
            row = np.searchsorted(starts, where, "right") - 1
            places = where[:, None] + np.arange(length)
            turn = (lambda x: x) if strand == "+" else (lambda x: _COMPLEMENT[x[:, ::-1]])
            window = turn(seq[places])
            out = [chroms.take(pa.array(row)), pa.array(first[row] + where - starts[row]), strings(np.full((len(row), 1), ord(strand), np.uint8)), strings(window)]
            if widened:
                out.append(strings(turn(raw[places])))
            if site:
                letters = window[:, site[0] : site[1]]
                bits = _BITS[letters]
                out += [pa.array(_PLAIN[letters].all(1)), *(pa.array(x) for s in shifts for x in numbers(bits, s, spacer))]
            yield pa.RecordBatch.from_arrays(out, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cuts = _bytes(batch.column(3))
            row = 0
            while row < batch.num_rows:
                stop = max(row + 1, int(np.searchsorted(cuts, cuts[row] + AT_ONCE, "right")) - 1)
                yield from cut(batch.slice(row, stop - row))
                row = stop

    return run
