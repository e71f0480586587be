"""Vectorised word splitting and hashing over Arrow string arrays.

Words are found with byte tables on the UTF-8 buffer and hashed with a prefix sum of a random
polynomial, so that no Python object is made for a word. All functions work on slices of bounded size;
a slice always holds whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=np.uint64)

#: Separators of the two word patterns: ASCII white space, and all ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B)):
    NOT_ALNUM[_a:_b] = False
#: Byte table that lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes of text handled at a time; the tables that a slice needs take about 40 times as many.
SLICE_BYTES = 512 << 10


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about `limit` bytes of text (or of a list of longs) each, a row at least."""
    if batch.num_rows == 0:
        return
    col = batch.column(batch.schema.get_field_index(text))
    offsets = 8 * col.offsets.to_numpy() if pa.types.is_list(col.type) else buffer_of(col)[1]
    block = (offsets[:-1] - offsets[0]) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and each row's offsets into them; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    n = len(col)
    offsets = np.frombuffer(off, np.int64 if large else np.int32, n + 1 + col.offset)[col.offset :].astype(np.int64) if off is not None and off.size else np.zeros(n + 1, np.int64)
    if col.null_count:
        keep = np.asarray(col.is_valid())
        sizes = np.diff(offsets)
        if sizes[~keep].any():  # a null may hide bytes
            return buffer_of(pa.array(["" if x is None else x for x in col.to_pylist()], col.type))
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, hi)[lo:] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return raw, offsets - lo


class Words:
    """The words of some texts: byte bounds of each, and each text's first word."""

    def __init__(self, col: pa.Array, separators: np.ndarray = SPACE, lower: bool = False):
        raw, offsets = buffer_of(col)
        self.raw = LOWER[raw] if lower else raw
        n = len(self.raw)
        inside = ~separators[self.raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = offsets[:-1][(offsets[:-1] < n) & (np.diff(offsets) > 0)]
        first[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        tails = offsets[1:][np.diff(offsets) > 0] - 1
        last[tails] = inside[tails]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.offsets)
        self.text_start = offsets[:-1]

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.raw, self.start, self.end)

    def doc(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def position(self) -> np.ndarray:
        """The place of each word in its text."""
        return np.arange(len(self.start)) - np.repeat(self.offsets[:-1], self.counts)

    def text(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].tobytes()


_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        m = max(n, SLICE_BYTES + (1 << 16))
        for key, base in (("p", _P), ("i", _PINV)):
            x = np.full(m, base, U)
            x[:1] = 1
            _POW[key] = np.multiply.accumulate(x)
    return _POW["p"], _POW["i"]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    p, inv = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U)
    np.take(_BYTE, raw, out=total[1:], mode="clip")
    total[1:] *= p[: len(raw)]
    np.cumsum(total, out=total)
    out = mix((total[end] - total[start]) * inv[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))
    if len(_POW["p"]) > 4 * SLICE_BYTES:  # a very long text's tables aren't kept
        _POW.clear()
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` values, by doubling; run i starts at value i."""
    if len(h) < size:
        return np.zeros(0, U)
    part, width, out, done = h, 1, None, 0
    while True:
        if size & width:
            if out is None:
                out, done = part, width
            else:
                n = len(h) - done - width + 1
                out = out[:n] * U(pow(_P, width, 1 << 64)) + part[done : done + n]
                done += width
        if done == size:
            return mix(out[: len(h) - size + 1])
        n = len(h) - 2 * width + 1
        part = part[:n] * U(pow(_P, width, 1 << 64)) + part[width : width + n]
        width *= 2


def window_starts(counts: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """The flat places at which a run of `size` words of one text starts."""
    room = np.maximum(counts - size + 1, 0)
    return ranges(offsets[:-1], room)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for count[0] values, then those of the next, and so on."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(start - (ends - count), count)


def listed(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all entries of a list column; null lists are empty."""
    lists = lists.fill_null([]) if lists.null_count else lists
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False)


def signed(h: np.ndarray) -> pa.Array:
    """As Spark's long."""
    return pa.array(h.view(np.int64))


def mapped(function, text: str = "text"):
    """A mapInArrow function that applies `function` to bounded slices of each batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield from function(part)

    return run


def array_mapped(function, limit: int = SLICE_BYTES):
    """An arrow_udf body that applies `function` to bounded slices of a text column."""

    def run(col: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([col], ["text"])
        parts = [function(part.column(0)) for part in slices(batch, limit=limit)]
        return pa.concat_arrays(parts) if parts else function(col)

    return run
