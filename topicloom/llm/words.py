"""Word boundaries and word hashes of whole Arrow text columns, without Python strings.

A word is a longest run of bytes other than space and 0x09 to 0x0D.  UTF-8 bytes
of other characters never take these values, so words can be cut on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
BLOCK_BYTES = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(salt)) | np.uint64(1)


@dataclass
class Words:
    """The words of some texts: byte spans in ``raw``, text number, and the first word of every text."""

    raw: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sum of one value per word over each text."""
        return np.bincount(self.doc, weights=values, minlength=self.texts).astype(np.int64)


def text_pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``limit`` bytes of text, or one longer text; nulls become empty texts."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        filled = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
        batch = batch.set_column(at, column, filled)
        ends = np.cumsum(pc.binary_length(filled).to_numpy(zero_copy_only=False))
        row, done = 0, 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(row, stop - row)
            row, done = stop, int(ends[stop - 1])


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def find_words(texts: pa.Array) -> Words:
    """The words of a large_string array without nulls."""
    _, bounds, data = texts.buffers()
    offsets = np.frombuffer(bounds, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    solid = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) & ~edge[:-1]
    after = np.concatenate([solid[1:], [False]])[: len(raw)] & ~edge[1:]
    start = np.flatnonzero(solid & ~before)
    stop = np.flatnonzero(solid & ~after) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(raw, offsets, start, stop, doc, first)


class Hasher:
    """64-bit hashes of byte spans: a polynomial over random byte values, then a scramble.

    Spans are hashed from running sums, block by block, so a text of any length
    needs bounded extra memory.  ``lower`` folds A to Z.
    """

    def __init__(self, lower: bool = True):
        self.table = seeds(256, 77)
        if lower:
            self.table[65:91] = self.table[97:123]
        self._grow(BLOCK_BYTES + 1)

    def _grow(self, n: int) -> None:
        back = pow(_BASE, -1, 1 << 64)
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE & _MASK, dtype=np.uint64))])
        self.back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, back, dtype=np.uint64))])

    def spans(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the spans, which are ordered and do not overlap."""
        out = np.empty(len(start), dtype=np.uint64)
        i = 0
        while i < len(start):
            base = start[i]
            j = max(i + 1, int(np.searchsorted(stop, base + BLOCK_BYTES, side="right")))
            part = raw[base : stop[j - 1]]
            if len(part) > len(self.power):
                self._grow(len(part))
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(self.table[part] * self.power[: len(part)], out=sums[1:])
            s, e = start[i:j] - base, stop[i:j] - base
            out[i:j] = (sums[e] - sums[s]) * self.back[s]
            i = j
        return mix(out)


def windows(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of ``size`` words that lies within one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.doc[:n] == words.doc[size - 1 :])
    total = np.zeros(n, dtype=np.uint64)
    for k, odd in enumerate(seeds(size, 5)):
        total += hashes[k : k + n] * odd
    return at, mix(total[at])


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers as Spark's longs."""
    return x.astype(np.uint64).view(np.int64)


def chars_before(raw: np.ndarray) -> np.ndarray:
    """Number of code points that begin before each byte, and in all."""
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
