"""Vectorised views of Arrow text batches: words, lines and their 64-bit hashes as numpy arrays.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes. Hashes are polynomials modulo 2**64 over random byte values, finished
by a mixer; two different words of one text collide with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = []
#: Byte table that lowers ASCII letters and turns other ASCII signs and digits into blanks.
FOLDED = np.array([c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 10 if c == 10 else 0x20 for c in range(256)], np.uint8)

#: The same, but digits stay.
FOLDED_WITH_DIGITS = np.array([c if chr(c).isdigit() and c < 128 else f for c, f in enumerate(FOLDED.tolist())], np.uint8)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        _POWERS[:] = []
        for b in (_BASE, _BASE_INV):
            p = np.full(size, b, U64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS.append(p)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each (a single longer text makes its own slice).

    At the end the worker gives freed memory back: it stays for later tasks, beside the executor's heap.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = np.cumsum(np.diff(offsets_of(col)))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = min(max(start + 1, int(np.searchsorted(size, base + most, side="right"))), start + 50_000)
            yield batch.slice(start, end - start)
            start = end
    give_back()


def give_back() -> None:
    """Return what this process has freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def offsets_of(col: pa.Array) -> np.ndarray:
    """Offsets of a (large) string column, nulls as empty texts."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    if col.null_count:
        size = np.diff(off).astype(np.int64)
        if size[np.asarray(col.is_null())].any():  # bytes below a null don't count
            raise ValueError("text below a null")
    return off.astype(np.int64)


class Words:
    """Words of a slice of texts.

    ``data`` the bytes; ``off`` bounds of the texts in it; ``start``, ``end`` of each word; ``per`` words of each text;
    ``first`` index of each text's first word.
    """

    def __init__(self, col: pa.Array, table: np.ndarray | None = None):
        """table: a byte table that the data is put through first."""
        off = offsets_of(col)
        buf = col.buffers()[2] if len(col) else None
        data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        data = data if table is None else table[data]
        self.data, self.off = data, off - off[0]
        self.ink = ~_SPACE[data]
        before = np.zeros(len(data), bool)
        before[1:] = self.ink[:-1]
        cuts = self.off[1:-1]
        before[cuts[cuts < len(data)]] = False
        self.start = np.flatnonzero(self.ink & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = self.ink[1:]
        inner = cuts[(cuts > 0) & (cuts <= len(data))] - 1
        after[inner] = False
        self.end = np.flatnonzero(self.ink & ~after) + 1
        self.first = np.searchsorted(self.start, self.off[:-1])
        self.per = np.searchsorted(self.start, self.off[1:]) - self.first
        self._sums: np.ndarray | None = None

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            up, _ = powers(len(self.data) + 1)
            s = np.zeros(len(self.data) + 1, U64)
            np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=s[1:])
            self._sums = s
        return self._sums

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for each pair."""
        _, down = powers(len(self.data) + 1)
        return mix((self.sums[end] - self.sums[start]) * down[start])

    def hashes(self) -> np.ndarray:
        return self.spans(self.start, self.end)

    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.per)), self.per)


def windows(h: np.ndarray, per: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n consecutive words within a text, and the index of the first word of each."""
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= U64(0xD6E8FEB86659FD93)
        out += h[k : len(h) - n + 1 + k]
    left = np.repeat(np.cumsum(per), per) - np.arange(len(h))  # words to the text's end
    at = np.flatnonzero(left[: len(out)] >= n)
    return mix(out[at]), at


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths."""
    s = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=s[1:])
    e = np.cumsum(counts)
    return s[e] - s[e - counts]
