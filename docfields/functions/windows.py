"""Fingerprints of byte windows of 1, 2, 4 .. ``WIDEST`` bytes, for texts that are looked through for many others.

Equal windows have equal fingerprints; windows with equal ones may differ, so what is found by them is compared afterwards."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDEST = 64
# bytes of text in hand at once (eight bytes of fingerprints a byte, a few times over)
SLICE_BYTES = 2 << 20
_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = {1 << k: _rng.integers(1, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k in range(WIDEST.bit_length())}
_MIX = np.uint64(0x9E3779B97F4A7C15)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and where each text starts (n + 1); null = empty."""
    col = (col.fill_null("") if col.null_count else col).cast(pa.large_string())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def windows(data: np.ndarray, widths: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(width, the fingerprints of all its windows) for each of the widths that fits, each made of the one half as wide."""
    h, q = _BYTE[data], 1
    while len(h):
        if q in widths:
            mixed = h ^ (h >> np.uint64(32))
            yield q, (mixed * _MIX) ^ (mixed >> np.uint64(29))
        if q >= max(widths):
            return
        h = h[:-q] * _STEP[q] + h[q:]
        q *= 2


def width_of(n: np.ndarray) -> np.ndarray:
    """The widest window that fits into n bytes (1 at least)."""
    return np.int64(1) << np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), WIDEST.bit_length() - 1)


def end_windows(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Rows with ``q``, the widest width that fits into the text, and ``hs``, the fingerprints of its first and last window."""
    for batch in batches:
        data, off = text_bytes(batch.column(column))
        q = width_of(np.diff(off))
        ends = np.zeros((batch.num_rows, 2), np.int64)
        for width, h in windows(data, set(q.tolist())):
            i = np.flatnonzero((q == width) & (np.diff(off) > 0))
            ends[i, 0], ends[i, 1] = h[off[i]].view(np.int64), h[off[i + 1] - width].view(np.int64)
        hs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * batch.num_rows + 1, 2, dtype=np.int32)), pa.array(ends.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(q.astype(np.int32)), hs], [*batch.schema.names, "q", "hs"])


class Known:
    """Fingerprints by width: a bitmap of 16 to 32 bits each answers most questions, the sorted fingerprints the others."""

    def __init__(self, q: np.ndarray, h: np.ndarray):
        self.by_width = {}
        for width in np.unique(q).tolist():
            mine = np.unique(h[q == width].view(np.uint64))
            bits = max(10, int(16 * len(mine)).bit_length())
            marks = np.zeros(1 << bits, bool)
            marks[mine >> np.uint64(64 - bits)] = True
            self.by_width[width] = mine, np.packbits(marks, bitorder="little"), np.uint64(64 - bits)

    def found(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(texts, width, fingerprints): which known windows stand in which of the texts, each once a text."""
        for width, h in windows(data, set(self.by_width)):
            mine, marks, shift = self.by_width[width]
            at = h >> shift
            pos = np.flatnonzero((marks[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
            h = h[pos]
            k = np.minimum(np.searchsorted(mine, h), len(mine) - 1)
            text = np.searchsorted(off, pos, side="right") - 1
            keep = (mine[k] == h) & (pos + width <= off[text + 1])
            text, h = text[keep], h[keep]
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
            yield text[new], width, h[new].view(np.int64)

    def rows(self, batches: Iterator[pa.RecordBatch], column: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
        """The columns ``keep`` of every row and known window (``q``, ``h``) in its text."""
        for batch in batches:
            data, off = text_bytes(batch.column(column))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(off, off[a] + SLICE_BYTES, side="right")) - 1)
                for text, width, h in self.found(data[off[a]:off[b]], off[a:b + 1] - off[a]):
                    if len(text):
                        hit = batch.select(keep).take(pa.array(text + a))
                        yield pa.RecordBatch.from_arrays([*hit.columns, pa.array(np.full(len(h), width, np.int32)), pa.array(h)], [*keep, "q", "h"])
                a = b
