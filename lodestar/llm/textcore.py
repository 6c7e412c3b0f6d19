"""Vectorised word scanning over Arrow string columns.

Everything works on the UTF-8 buffer of an Arrow array: a 256-entry table says
which bytes separate words, another maps bytes before hashing (case folding of
A-Z). Words get 64-bit hashes and their byte spans; n-gram hashes are built
from the word hashes by doubling. No Python object is made per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE2 = 0xC2B2AE3D27D4EB4F
_BLOCK = 1 << 20

SPACE_SEP = np.zeros(256, dtype=bool)
SPACE_SEP[[0x20, *range(0x09, 0x0E)]] = True

#: Separators of letters, digits and non-ASCII bytes: [\x00-\x2F\x3A-\x60\x7B-\x7F] after folding.
ALNUM_SEP = np.zeros(256, dtype=bool)
ALNUM_SEP[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
ALNUM_SEP[ord("A") : ord("Z") + 1] = False

KEEP = np.arange(256, dtype=np.uint8)
FOLD = KEEP.copy()
FOLD[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=U64) * U64(_BASE))
_BYTE_VALUE2 = mix64(np.arange(1, 257, dtype=U64) * U64(_BASE2))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow_tables(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, _BLOCK + 1)
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, dtype=U64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[base] = (tables[0], tables[1])
    return _powers[base]


@dataclass
class Words:
    """Words of some documents: byte spans into buf, hashes, and first[d]..first[d+1] of document d."""

    buf: np.ndarray
    off: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def room(self) -> np.ndarray:
        """For each word, how many words its document has from it on."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.starts))


def second_hashes(w: Words, fold: np.ndarray = KEEP) -> np.ndarray:
    """64-bit hashes of the words that have nothing in common with those of scan()."""
    out, value = np.empty(len(w.starts), U64), _BYTE_VALUE2[fold]
    cuts = np.flatnonzero(np.diff(w.starts // _BLOCK)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(w.starts)], strict=True):
        if hi > lo:
            at, end = int(w.starts[lo]), int(w.ends[hi - 1])
            power, inverse = _pow_tables(end - at + 1, _BASE2)
            total = np.zeros(end - at + 1, dtype=U64)
            np.cumsum(value[w.buf[at:end]] * power[: end - at], out=total[1:])
            s, e = w.starts[lo:hi] - at, w.ends[lo:hi] - at
            out[lo:hi] = mix64((total[e] - total[s]) * inverse[s] + (e - s).astype(U64))
    return out


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    if offsets is None or len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def scan(arr: pa.Array, sep: np.ndarray = SPACE_SEP, fold: np.ndarray = KEEP, cuts=None) -> Words:
    """Words of every string; cuts(bytes) may give positions at which words are cut as well. Per-byte work is done in blocks of about a megabyte, so a very long text needs no more."""
    buf, off = utf8(arr)
    n = len(buf)
    brk = np.zeros(n + 1, dtype=bool)
    brk[off] = True
    if cuts is not None:
        brk[cuts(buf)] = True
    value = _BYTE_VALUE[fold]
    s_all, e_all, h_all, at = [], [], [], 0
    while at < n:
        end = min(n, at + _BLOCK)
        if end < n and not brk[end] and not sep[buf[end]]:
            gaps = np.flatnonzero(sep[buf[at:end]])
            while not len(gaps) and end < n:
                to = min(n, end + _BLOCK)
                gaps = np.flatnonzero(sep[buf[end:to]]) + (end - at)
                end = to
            end = at + int(gaps[-1]) + 1 if len(gaps) and (end < n or sep[buf[end - 1]]) else end
        part = buf[at:end]
        inside = ~sep[part]
        m = len(part)
        is_start, is_end = inside.copy(), inside.copy()
        is_start[1:] &= ~inside[:-1] | brk[at + 1 : end]
        is_end[:-1] &= ~inside[1:] | brk[at + 1 : end]
        s, e = np.flatnonzero(is_start), np.flatnonzero(is_end) + 1
        power, inverse = _pow_tables(m + 1)
        total = np.zeros(m + 1, dtype=U64)
        np.cumsum(value[part] * power[:m], out=total[1:])
        h = mix64((total[e] - total[s]) * inverse[s] + (e - s).astype(U64))
        s_all.append(s + at)
        e_all.append(e + at)
        h_all.append(h)
        at = end
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    starts = join(s_all, np.int64)
    return Words(buf, off, starts, join(e_all, np.int64), join(h_all, U64), np.searchsorted(starts, off))


def ngrams(h: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """Hashes of all runs of k values; element i covers i..i+k-1, and the last k-1 are missing."""
    if len(h) < k:
        return np.zeros(0, dtype=U64)
    out, done, part, size, rest = None, 0, h, 1, k
    while rest:
        if rest & 1:
            if out is None:
                out, done = part, size
            else:
                n = len(h) - (done + size) + 1
                out = out[:n] * U64(pow(base, size, 1 << 64)) + part[done : done + n]
                done += size
        rest >>= 1
        if rest:
            part = part[: len(part) - size] * U64(pow(base, size, 1 << 64)) + part[size:]
            size *= 2
    return mix64(out[: len(h) - k + 1])


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20):
    """Parts of a batch with about limit bytes of text, one row at least."""
    arr = batch.column(column)
    if len(arr) == 0:
        return
    _, off = utf8(arr)
    at = 0
    while at < len(arr):
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def segments_any(first: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """Sums of flag over first[d]..first[d+1]."""
    total = np.zeros(len(flag) + 1, dtype=np.int64)
    np.cumsum(flag, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words lie in a run of the given length that begins at one of starts."""
    delta = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + length, n), minlength=n + 1)
    return np.cumsum(delta[:n]) > 0
