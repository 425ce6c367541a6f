"""Vectorised word splitting and hashing over Arrow string buffers.

Texts never become Python strings here: the UTF-8 bytes of an Arrow batch are
viewed as one numpy array, and words are runs of bytes outside a separator class.
64-bit hashes of words depend on a key: a bijective mixer for words of up to eight bytes, SipHash-1-3
over the lanes of longer ones.  Operators draw a new key for every run (``new_key``), so no text can be made for which two words are
taken for one; by chance two different words are with a probability of about 2**-64.
``same_bytes`` compares what hashes call equal, wherever the bytes are at hand.  A batch is cut into pieces of about ``PIECE`` bytes (whole texts, never parts of one),
so memory is bounded by the piece or by the longest single text.

Null texts count as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once, unless one text alone is longer.
PIECE = 2 << 20

U64 = np.uint64


def _separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = False
    return table


#: True for bytes of ``[^\x20\x09-\x0D]+`` words.
WORD = _separators((0x20, 0x20), (0x09, 0x0D))
#: True for bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` words (after lower-casing).
ALNUM = _separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = U64(0x9E3779B97F4A7C15)
_Q = U64(0xD6E8FEB86659FD93)
#: Longer words are hashed and compared one by one.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def pieces(column, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of consecutive rows that hold about ``size`` bytes."""
    if not len(column):
        return
    raw, off = buffers(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """The words of several texts (``offsets`` in ``raw``): ``start``/``end`` in bytes, and ``first``: word offsets (texts + 1)."""

    __slots__ = ("raw", "offsets", "start", "end", "first", "key")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD, key: int = 0):
        self.raw, self.offsets, self.key = raw, offsets, key
        inside = table[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        if len(raw):
            bounds = offsets[(offsets > 0) & (offsets < len(raw))]
            before = np.empty(len(raw), dtype=bool)
            before[0] = False
            before[1:] = inside[:-1]
            before[bounds] = False
            edge[:-1] = inside & ~before
            self.start = np.flatnonzero(edge[:-1])
            after = np.empty(len(raw), dtype=bool)
            after[-1] = False
            after[:-1] = inside[1:]
            after[bounds - 1] = False
            self.end = np.flatnonzero(inside & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, by the key."""
        length = self.end - self.start
        wide = lanes(self.raw)
        h = mix(length.astype(np.uint64) * _P + (_Q ^ U64(self.key)))
        short = np.flatnonzero(length <= 8)
        h[short] = mix(h[short] ^ _lane(wide, self.start[short], length[short]))
        at = np.flatnonzero((length > 8) & (length <= LONG))
        if len(at):
            h[at] = _sip(wide, self.start[at], length[at], self.key)
        for i in np.flatnonzero(length > LONG).tolist():
            own = self.raw[self.start[i] : self.end[i]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(own, digest_size=8, key=self.key.to_bytes(8, "little")).digest(), "little")
        return h

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of each text's words joined by one space, and the offsets of the texts in them."""
        keep = np.zeros(len(self.raw) + 1, np.int8)
        keep[self.start] += 1
        np.add.at(keep, self.end, -1)
        keep = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
        last = np.zeros(len(self.start), bool)
        last[self.first[1:][self.first[1:] > self.first[:-1]] - 1] = True
        gap = self.end[~last]
        keep[gap] = True
        data = self.raw.copy()
        data[gap] = 0x20
        size = np.concatenate([[0], np.cumsum(self.end - self.start + ~last)])
        return data[keep], size[self.first]


def new_key() -> int:
    """A key for the hashes of one run; drawn on the driver, and the same in all its tasks."""
    return secrets.randbits(64)


def _sip(wide: np.ndarray, start: np.ndarray, length: np.ndarray, key: int) -> np.ndarray:
    """SipHash-1-3 of spans of up to ``LONG`` bytes, by the key and a second half made from it."""
    order = np.argsort(-length, kind="stable")  # those with a j-th lane come first
    start, length = start[order], length[order]
    k0, k1 = U64(key), mix(np.array([key], np.uint64) + _P)[0]
    v = [np.full(len(start), x) for x in (k0 ^ U64(0x736F6D6570736575), k1 ^ U64(0x646F72616E646F6D), k0 ^ U64(0x6C7967656E657261), k1 ^ U64(0x7465646279746573))]
    most = int(length[0]) + 7 >> 3
    for j in range(most):
        n = int(np.searchsorted(-length, -8 * j, side="left"))
        w = [x[:n] for x in v]
        m = _lane(wide, start[:n] + 8 * j, length[:n] - 8 * j)
        w[3] ^= m
        _sip_round(*w)
        w[0] ^= m
    last = length.astype(np.uint64) << U64(56)
    v[3] ^= last
    _sip_round(*v)
    v[0] ^= last
    v[2] ^= U64(0xFF)
    for _ in range(3):
        _sip_round(*v)
    out = np.empty(len(start), np.uint64)
    out[order] = v[0] ^ v[1] ^ v[2] ^ v[3]
    return out


def _turn(x: np.ndarray, by: int) -> None:
    high = x >> U64(64 - by)
    x <<= U64(by)
    x |= high


def _sip_round(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
    a += b
    _turn(b, 13)
    b ^= a
    _turn(a, 32)
    c += d
    _turn(d, 16)
    d ^= c
    a += d
    _turn(d, 21)
    d ^= a
    c += b
    _turn(b, 17)
    b ^= c
    _turn(c, 32)


def release() -> None:
    """Gives freed memory back to the system at the end of a task, since Python workers live on to run others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lanes(raw: np.ndarray) -> np.ndarray:
    """The bytes as little-endian 64-bit numbers, with room behind them."""
    out = np.zeros(len(raw) // 8 + 2, "<u8")
    out.view(np.uint8)[: len(raw)] = raw
    return out


def _lane(wide: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte offset on; those beyond ``left`` bytes are 0."""
    i, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
    x = (wide[i] >> shift) | ((wide[i + 1] << U64(1)) << (U64(63) - shift))
    return x & (~U64(0) >> ((8 - np.minimum(left, 8)) << 3).astype(np.uint64))


def _by_lane(length: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(j, spans of up to ``LONG`` bytes that have a j-th lane)."""
    at = np.flatnonzero((length > 0) & (length <= LONG))
    j = 0
    while len(at):
        yield j, at
        j += 1
        at = at[length[at] > 8 * j]


def same_bytes(raw: np.ndarray, start: np.ndarray, other: np.ndarray, other_start: np.ndarray, length: np.ndarray, other_lanes: np.ndarray | None = None) -> np.ndarray:
    """Whether the spans of two byte arrays are equal, byte by byte."""
    same = np.ones(len(length), bool)
    a = lanes(raw)
    b = a if other is raw else lanes(other) if other_lanes is None else other_lanes
    for j, at in _by_lane(length):
        left = length[at] - 8 * j
        same[at] &= _lane(a, start[at] + 8 * j, left) == _lane(b, other_start[at] + 8 * j, left)
    for i in np.flatnonzero(length > LONG).tolist():
        n = int(length[i])
        same[i] = np.array_equal(raw[start[i] : start[i] + n], other[other_start[i] : other_start[i] + n])
    return same


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _Q + b)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows that start at each position, over all texts joined; n - k + 1 values."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    out, done, block, size = None, 0, h, 1
    while True:
        if k & size:
            out = block if out is None else _pair(out[: len(block) - done], block[done:])
            done += size
            if done == k:
                return out
        block = _pair(block[:-size], block[size:])
        size *= 2


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """For each position up to n - k: whether a k-word window that starts there stays in its text."""
    n = int(first[-1])
    ok = np.ones(max(n - k + 1, 0), dtype=bool)
    if not len(ok):
        return ok
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    return text[: n - k + 1] == text[k - 1 :]


def text_of(first: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def slices(first: np.ndarray) -> list[slice]:
    return [slice(a, b) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] of them), start[1], ..."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    if len(x) < width:
        return x[:0]
    m, w = x, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - w :]) if w < width else m
