"""Vectorised work on the UTF-8 buffers of Arrow text columns.

Words are maximal runs of bytes other than space and U+0009 to U+000D. Bytes of multi-byte characters are never
white space in UTF-8, so this equals the split on code points.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one text may be longer.
CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240501)
_BYTE_VALUES = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
#: Random factors of the places in a window: no two arrangements of the same words share their sum.
WINDOW_FACTORS = _RANDOM.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_FACTOR = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return series(_FACTOR), series(pow(_FACTOR, -1, 1 << 64))


class Texts:
    """The texts of one block of rows: ``data`` holds their bytes, text ``i`` is ``data[offsets[i]:offsets[i+1]]``."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        self.n = len(column)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = raw[bounds[0] : bounds[-1]]
        self.offsets = bounds - bounds[0]
        if column.null_count:  # a null may own bytes in an odd producer; drop them
            lengths = np.diff(self.offsets) * np.asarray(column.is_valid())
            if lengths.sum() != len(self.data):
                return self.__init__(column.fill_null(""))

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> "Texts":
        out = object.__new__(cls)
        out.n, out.offsets, out.data = len(offsets) - 1, offsets, data
        return out

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def lower_ascii(self) -> "Texts":
        return Texts.of(_LOWER[self.data], self.offsets)

    def words(self) -> "Words":
        return Words(self, _SPACE)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


class Words:
    """Start, end and text number of every word of a block, with 64-bit hashes of words and of word windows."""

    def __init__(self, texts: Texts, separators: np.ndarray):
        self.texts = texts
        data, offsets = texts.data, texts.offsets
        solid = ~separators[data]
        before, after = np.zeros_like(solid), np.zeros_like(solid)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges] = False
        after[edges - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        #: word numbers of text i are first[i] to first[i + 1]
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(texts.n), np.diff(self.first))

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A polynomial hash over random byte values, from one running sum for the whole block."""
        n = len(self.texts.data)
        power, inverse = _powers(max(CHUNK_BYTES, 1 << n.bit_length()))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[self.texts.data] * power[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * inverse[self.start])

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word number and hash of every run of ``width`` words that lies in one text."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h += hashes[k : k + n] * WINDOW_FACTORS[k]
        at = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        return at, mix(h[at])


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut Arrow batches into blocks of about ``CHUNK_BYTES`` of text, a longer text being a block of its own."""
    for batch in batches:
        texts = Texts(batch.column(column))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(texts.offsets, texts.offsets[at] + CHUNK_BYTES, "right")) - 1
            upto = min(max(upto, at + 1), batch.num_rows)
            part = batch.slice(at, upto - at)
            yield part, Texts(part.column(column))
            at = upto


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
