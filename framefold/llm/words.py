"""Vectorised word arithmetic on Arrow text columns, shared by the operators.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Texts are handled
in slices of a few MB, so that memory does not follow the Arrow batch size; a
slice always holds whole texts. Words and windows of words are named by 64-bit
polynomial hashes over random byte weights (``salt`` picks the weights, so two
salts give 128 bits).
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SEPARATORS = b" \t\n\x0b\x0c\r"

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SEPARATORS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=16)
def _base(salt: int) -> tuple[np.uint64, np.uint64]:
    """An odd multiplier and its inverse modulo 2**64."""
    b = int(np.random.default_rng(1000 + salt).integers(1 << 62)) | 5
    return np.uint64(b), np.uint64(pow(b, -1, 1 << 64))


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(salt: int, n: int, inverse: bool) -> np.ndarray:
    have = _POWERS.get((salt, inverse))
    if have is None or len(have) < n:
        p = np.full(max(1, n + n // 8), _base(salt)[inverse], np.uint64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if n <= 2 * SLICE_BYTES:  # those of a single very long text are not kept
            _POWERS[salt, inverse] = have
    return have[:n]


_HELD: dict = {}


def held(key, make):
    """What a worker keeps between tasks: the state of one operator at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


@lru_cache(maxsize=32)
def _weights(salt: int, lower: bool) -> np.ndarray:
    w = np.random.default_rng(salt).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    return w[_LOWER] if lower else w


def _prefix(x: np.ndarray, salt: int) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * _powers(salt, len(x), False), out=out[1:])
    return out


class Words:
    """The words of the texts of one slice.

    ``starts``/``ends``: byte positions in ``data``; ``bounds``: word number at
    which each text begins (one more entry than texts); ``doc``: text of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        word = _IS_WORD[data]
        cut = offsets[(offsets > 0) & (offsets < n)]
        first = word.copy()
        first[1:] &= ~word[:-1]
        first[cut] = word[cut]
        last = word.copy()
        last[:-1] &= ~word[1:]
        last[cut - 1] = word[cut - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, salt: int = 1, lower: bool = False) -> np.ndarray:
        c = _prefix(_weights(salt, lower)[self.data], salt)
        return mix((c[self.ends] - c[self.starts]) * _powers(salt, len(self.data) + 1, True)[self.starts])

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return self.bounds[1:][self.doc] - np.arange(len(self))


def windows(h: np.ndarray, k: int, salt: int = 7) -> np.ndarray:
    """Hash of the ``k`` values from each position on; the last k-1 have none.

    Positions are over the whole array: the caller drops those that cross a text.
    """
    if len(h) < k:
        return np.zeros(0, np.uint64)
    c = _prefix(h, salt)
    return mix((c[k:] - c[:-k]) * _powers(salt, len(h), True)[:len(h) - k + 1])


def spans(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, salt: int = 7) -> np.ndarray:
    """Hash of ``h[lo:hi]`` for each pair of positions; equal to ``windows`` at equal lengths."""
    c = _prefix(h, salt)
    return mix((c[hi] - c[lo]) * _powers(salt, len(h) + 1, True)[lo])


def as_bytes(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as large_binary without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def slices(column, limit: int = SLICE_BYTES, translate: np.ndarray | None = None) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, Words) for runs of whole texts of about ``limit`` bytes.

    ``translate``: a byte for each byte, applied before words are found (positions stay).
    """
    a = as_bytes(column)
    if not len(a):
        return
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        part = data[off[lo]:off[hi]]
        yield lo, hi, Words(part if translate is None else translate[part], off[lo:hi + 1] - off[lo])
        lo = hi


def join_kept(w: Words, keep: np.ndarray) -> pa.Array:
    """Per text, the words marked in ``keep`` joined by one space."""
    starts, length = w.starts[keep], (w.ends - w.starts)[keep] + 1
    stop = np.cumsum(length)
    total = int(stop[-1]) if len(stop) else 0
    at = np.arange(total) + np.repeat(starts - (stop - length), length)
    out = w.data[np.minimum(at, len(w.data) - 1)] if total else np.zeros(0, np.uint8)
    out[stop - 1] = 32
    per_text = np.bincount(w.doc[keep], minlength=len(w.offsets) - 1)
    last = np.cumsum(per_text)[per_text > 0] - 1  # the last kept word of each text has no space after it
    body = np.ones(total, bool)
    body[stop[last] - 1] = False
    size = np.bincount(w.doc[keep], weights=length, minlength=len(per_text)).astype(np.int64) - (per_text > 0)
    offsets = np.concatenate([[0], np.cumsum(size)])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(out[body].tobytes())).cast(pa.string())
