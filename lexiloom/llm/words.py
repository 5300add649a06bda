"""NumPy kernels over the UTF-8 buffers of an Arrow column: word spans and hashes with no per-word Python.

A text's bytes b0 b1 ... get the prefix sums of T[b_i] * P^i modulo 2^64 (T: fixed random table, P: fixed odd
number); the difference of two prefix sums times P^-start is a hash of any span, so the hash of every word, affix or
n-gram of a batch costs two gathers and a product. White space is ASCII, so bytes split as code points would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240607))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PLAIN = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _PLAIN[97:123]
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = have = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= _MIX[0]
    x ^= x >> np.uint64(33)
    x *= _MIX[1]
    x ^= x >> np.uint64(33)
    return x


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about `most` bytes (at least one row); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more entry than texts)."""
    inside = ~_SPACE[data]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[first] = False
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[first[first > 0] - 1] = False
    if len(inside):
        before[0] = after[-1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Hasher:
    """Hashes of any byte spans of one buffer; lower: A-Z as a-z."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER if lower else _PLAIN)[data] * powers(_P, n), out=self.sums[1:])
        self.back = powers(_P_INV, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(raw + np.uint64((seed * 0xD6E8FEB86659FD93 + 1) % 2**64) + (ends - starts).astype(np.uint64))


_FIVE = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def shingles(word_hashes: np.ndarray, first: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a shorter text is one shingle of all its words, one without words has none."""
    n = len(word_hashes)
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size if len(rolled) else 0):
        rolled += word_hashes[k : n - size + 1 + k] * _FIVE[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(rolled[a : b - size + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]] if len(own) > 1 else own)
        elif b > a:
            out.append(mix((word_hashes[a:b] * _FIVE[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

_CLASS = np.full(256, 2, np.uint8)  # 0: space, 1: letters, digits, _ and all bytes of other characters, 2: the rest
_CLASS[_SPACE] = 0
_CLASS[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As spans(), for maximal runs of word characters and of punctuation."""
    kind = _CLASS[data]
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    full = kind[edges[:-1]] > 0 if len(data) else np.zeros(0, bool)
    starts, ends = edges[:-1][full], edges[1:][full]
    return starts, ends, np.searchsorted(starts, offsets)
