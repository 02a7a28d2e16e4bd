"""Whole-batch word splitting and hashing on the UTF-8 bytes of an Arrow text column.

Every step is a numpy pass over a block of texts, so nothing is done word by word in Python.
Blocks are cut by bytes; a text longer than a block is a block of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multipliers of the rolling hashes, and their inverses modulo 2**64.
BASE_BYTES, BASE_WORDS, BASE_CHECK = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random 64-bit value for each byte.
BYTE_VALUES = splitmix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
#: Other values, and a base to go with them, for a second hash of words.
OTHER_VALUES, OTHER_BYTES = splitmix(np.arange(1, 257, dtype=np.uint64) * U64(0xD1342543DE82EF95) + U64(0x2545F4914F6CDD1D)), 0xC2B2AE3D27D4EB4F
#: True at the six ASCII white-space bytes.
ASCII_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: True at every ASCII byte that is neither a letter nor a digit.
ASCII_NON_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER_ASCII = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)



def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the upper-case letters of ASCII and Latin-1 made lower case."""
    out = LOWER_ASCII[data]
    if len(data) > 1:
        second = data[1:]
        out[1:][(data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
    return out


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n-1."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)

        def run(x: int) -> np.ndarray:
            a = np.full(size, x, dtype=np.uint64)
            a[0] = 1
            return np.cumprod(a, dtype=np.uint64)

        have = run(base), run(pow(base, -1, 1 << 64))
        if size <= 1 << 22:  # longer tables serve one outsized text only
            _powers[base] = have
    return have


class Words:
    """The words of a block of texts.

    data: the block's bytes; starts, ends: byte range of each word; bounds: document i has the words
    bounds[i]..bounds[i+1]-1; doc_bytes: byte range of each document.
    """

    def __init__(self, data: np.ndarray, doc_bytes: np.ndarray, is_space: np.ndarray = ASCII_SPACE, fold: bool = False):
        self.data = folded(data) if fold else data
        self.doc_bytes = doc_bytes
        n = len(data)
        space = is_space[data]
        before = np.empty(n + 1, dtype=bool)
        before[0], before[1:] = True, space
        before[doc_bytes[doc_bytes <= n]] = True
        begins = before[:n] & ~space
        after = np.empty(n, dtype=bool)
        after[:-1], after[-1:] = space[1:], True
        cut = doc_bytes[doc_bytes > 0] - 1
        after[cut] = True
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(after & ~space) + 1
        self.bounds = np.searchsorted(self.starts, doc_bytes)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, chunk: int = 1 << 20, base: int = BASE_BYTES, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
        """A 64-bit hash of each word, by prefix sums over the bytes, a chunk of bytes at a time; other bases and values give an independent one."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        first, total = 0, len(self.starts)
        while first < total:
            at = self.starts[first]
            last = max(first + 1, int(np.searchsorted(self.ends, at + chunk, side="right")))
            part = self.data[at : self.ends[last - 1]]
            up, down = powers(base, len(part) + 1)
            sums = np.empty(len(part) + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(values[part] * up[: len(part)], out=sums[1:])
            s, e = self.starts[first:last] - at, self.ends[first:last] - at
            out[first:last] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
            first = last
        return splitmix(out)

    def doc_of(self) -> np.ndarray:
        """The document index of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """The Rabin-Karp hash, modulo 2**64, of every `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(base, len(values) + 1)
    sums = np.empty(len(values) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return splitmix((sums[width:] - sums[:n]) * down[:n])


def window_starts(bounds: np.ndarray, width: int) -> np.ndarray:
    """Indexes of the words that begin a window of `width` words within one document."""
    if len(bounds) < 2 or bounds[-1] < width:
        return np.empty(0, dtype=np.int64)
    ok = np.zeros(bounds[-1] + 1, dtype=np.int8)
    lens = np.diff(bounds)
    has = lens >= width
    np.add.at(ok, bounds[:-1][has], 1)
    np.add.at(ok, bounds[1:][has] - width + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:-1], dtype=np.int8))


def trim() -> None:
    """Gives back what a task has freed: Python workers live on beside others, and each would keep its peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """A function of batches that ends with `trim`."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def column(batch: pa.RecordBatch, name: str | int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column, or of so many-eth field of the struct column `row`; null counts as empty."""
    arr = pc.struct_field(batch.column(batch.schema.get_field_index("row")), [name]) if isinstance(name, int) else batch.column(batch.schema.get_field_index(name))
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    if len(arr) == 0 or offsets is None:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return raw, off - off[0]


def blocks(batch: pa.RecordBatch, name: str | int, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about `size` bytes of text."""
    data, off = column(batch, name)
    row, rows = 0, len(off) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(off, off[row] + size, side="right")) - 1)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end
