"""Words of whole texts as 64-bit hashes, many documents at a time.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Its hash is a polynomial over
per-byte random numbers modulo 2^64, taken from prefix sums, so that a batch needs a few passes over its bytes.
"""

from __future__ import annotations

import numpy as np

from siftstone.llm.common import mix, stream

_BASE = 0x9E3779B97F4A7C15 | 1
_EXACT = stream(11, 256)
_BYTE = _EXACT.copy()
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes whose prefix sums are taken at once; tables of powers are no longer, however long a text.
SPAN = 1 << 19
_powers: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, SPAN + 1 of them."""
    if not _powers:
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(SPAN, b, np.uint64)))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of each word, and for each document (n + 1 entries) its first word."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = np.empty(len(raw) + 1, bool)
    inside[:-1] = ~_SPACE[raw]
    inside[-1] = False
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = off[1:-1]
    first[cut] |= inside[cut]
    starts = np.flatnonzero(first)
    last = inside[:-1].copy()
    last &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """One 64-bit hash a word; fold: A-Z as a-z. Stretches of SPAN bytes at a time; a longer word is taken in parts."""
    out = np.zeros(len(starts), np.uint64)
    value = _BYTE if fold else _EXACT
    power, inverse = powers()
    first = 0
    while first < len(starts):
        at = int(starts[first])
        end = int(np.searchsorted(ends, at + SPAN, "right"))
        if end <= first:
            total, scale = np.uint64(0), np.uint64(1)
            with np.errstate(over="ignore"):
                for a in range(at, int(ends[first]), SPAN):
                    part = raw[a : min(a + SPAN, int(ends[first]))]
                    total += scale * np.sum(value[part] * power[: len(part)], dtype=np.uint64)
                    scale *= power[SPAN]
            out[first] = total
            end = first + 1
        else:
            part = raw[at : int(ends[end - 1])]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(value[part] * power[: len(part)], out=sums[1:])
            a, z = starts[first:end] - at, ends[first:end] - at
            out[first:end] = (sums[z] - sums[a]) * inverse[a]
        first = end
    return mix(out + (ends - starts).astype(np.uint64))


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles.

    With 1 to k - 1 words the whole sequence is the one shingle; with none the set is empty.
    """
    starts, ends, doc = bounds(raw, off)
    h = hashes(raw, starts, ends)
    times = stream(23, k) | np.uint64(1)
    n = max(len(h) - k + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled += h[j : j + n] * times[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(doc[:-1].tolist(), doc[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.sum(h[a:b] * times[: b - a], keepdims=True) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out
