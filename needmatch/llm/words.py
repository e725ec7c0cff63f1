"""Words of whole texts as dictionary codes, on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
SPACE = "\x20\x09-\x0D"


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_BYTES of text, one text at least; null texts become empty."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        batch = batch.set_column(at, column, pc.fill_null(batch.column(at).cast(pa.string()), ""))
        ends = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < len(ends):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


class Words:
    """Words of some texts: ``codes`` point into ``vocabulary``; text i has codes[starts[i]:starts[i + 1]]."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        offsets, flat = lists.offsets.to_numpy(), lists.values
        real = pc.greater(pc.binary_length(flat), 0)
        counted = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)])
        self.starts = counted[offsets]
        coded = flat.filter(real).dictionary_encode()
        self.codes, self.vocabulary = coded.indices.to_numpy(), coded.dictionary

    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    def owner(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), self.lengths())

    def hashes(self) -> np.ndarray:
        """64-bit hash of each entry of the vocabulary."""
        digest = xxhash.xxh3_64_intdigest
        return np.array([digest(w) for w in self.vocabulary.to_pylist()], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (finaliser of a multiply-xorshift generator)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hash of each run of ``width`` neighbours; one per start, len(values) - width + 1 in all."""
    count = max(0, len(values) - width + 1)
    out = np.zeros(count, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width if count else 0):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + values[k:k + count])
    return out


def summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of values of each text."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[starts])
