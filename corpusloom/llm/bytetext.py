"""Vectorised work on the UTF-8 bytes of Arrow string columns: words, word hashes and shingle sets without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _VALUES[_LOWER]
_powers: dict[str, np.ndarray] = {}
SLICE_BYTES = 1 << 18


def ascii_lower(raw: np.ndarray) -> np.ndarray:
    return _LOWER.astype(np.uint8)[raw]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, _STEP if which == "up" else _UNSTEP, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 8 * SLICE_BYTES:
            _powers[which] = have
    return have[:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null is as empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if column.null_count:
        column = column.fill_null("")
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row comes alone, whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (n+1 entries). ``between`` marks the bytes that no word holds."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~between[raw]
    first = np.empty(len(raw), bool)
    first[0] = True
    first[1:] = ~solid[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edges] = True
    starts = np.flatnonzero(first & solid)
    last = np.empty(len(raw), bool)
    last[-1] = True
    last[:-1] = first[1:] | ~solid[1:]
    ends = np.flatnonzero(last & solid) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of words from one running sum over the bytes; ``fold`` lower-cases A-Z first."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _VALUES)[raw] * _power("up", len(raw)), out=run[1:])
    return mix((run[ends] - run[starts]) * _power("down", len(raw))[starts] + (ends - starts).astype(np.uint64))


def chained(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbours in h."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    k = len(h) - n + 1
    out = h[:k].copy()
    for i in range(1, n):
        out ^= out >> np.uint64(29)
        out *= _STEP
        out += h[i : i + k]
    return mix(out)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Each row's sorted distinct n-word shingle hashes; a row of 1 to n-1 words has one, of the whole sequence; others none."""
    starts, ends, at = words(raw, offsets)
    h = word_hashes(raw, starts, ends)
    grams = chained(h, n)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(chained(h[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(grams[:0])
    return out
