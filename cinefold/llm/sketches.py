"""Sets of word shingles and their fast similarity sketches."""

from __future__ import annotations

import numpy as np

#: Words of a shingle, seed of all hashes.
SHINGLE, SEED = 2, 42
#: Bands of a sketch and coordinates of a band. At similarity 0.8 no band agrees with a chance of (1 - 0.8^4)^48 = 1.0e-11.
BANDS, ROWS = 48, 4
COORDINATES = BANDS * ROWS
#: Words of 64 bits that hold one bit of each coordinate.
WORDS = COORDINATES // 64
#: Balls for each bin that are thrown before it is looked for empty bins.
THROWN = 5
#: Hashes made at a time.
AT_ONCE = 1 << 16

_RANDOM = np.random.default_rng(SEED)
_ROUNDS = 2 * COORDINATES  # any bin, then one round for every bin
_TIMES = _RANDOM.integers(0, 1 << 63, _ROUNDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, _ROUNDS, dtype=np.uint64)
_MIX = _RANDOM.integers(0, 1 << 63, ROWS + 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HIGH = np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all bits."""
    x = (x ^ (x >> np.uint64(31))) * _MIX[-1]
    x = (x ^ (x >> np.uint64(29))) * _MIX[-2]
    return x ^ (x >> _HIGH)


def shingles(text: str, words: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending; a shorter text is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()  # bytes: ASCII letters and white space alone
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter((xxh64_intdigest(w, SEED) for w in found), np.uint64, len(found))
    n = max(1, len(found) - words + 1)
    out = np.full(n, min(words, len(found)), np.uint64)
    for k in range(min(words, len(found))):
        out = mixed(out * _MIX[-3] + hashes[k : k + n])
    return np.unique(out)


def hashed(found: np.ndarray, rounds: slice) -> np.ndarray:
    """A row for each round, a column for each shingle."""
    return mixed(found * _TIMES[rounds, None] + _PLUS[rounds, None])


def sketch(found: np.ndarray) -> np.ndarray:
    """A value for every coordinate of a set that isn't empty: equal in two sets with a chance of their similarity.

    Each round throws every shingle into a bin. A bin's value is the least hash of the first round that reached it. From
    round ``COORDINATES`` on round i throws everything into bin i - COORDINATES, so no bin stays empty; work ends when
    all are full, after about n + t log t hashes. As each bin's shingle is drawn without others' influence but that they
    can't fall into two bins of a round, agreeing coordinates are at least as concentrated as independent ones.
    """
    t, out, full, at = COORDINATES, np.zeros(COORDINATES, np.uint64), np.zeros(COORDINATES, bool), 0
    while at < t and not full.all():
        rounds = slice(at, min(t, at + max(1, THROWN * t // len(found))))
        for k in range(0, len(found), AT_ONCE):
            values = hashed(found[k : k + AT_ONCE], rounds)
            values.sort(axis=1)  # the bin is the hash's high bits, so a bin's least comes first in it
            bins = ((values >> _HIGH) * np.uint64(t) >> _HIGH).astype(np.int64)
            new = np.ones(bins.shape, bool)
            new[:, 1:] = bins[:, 1:] != bins[:, :-1]
            bins, values = bins[new], values[new]
            if len(found) > AT_ONCE:  # one round in several parts
                if k == 0:
                    least = np.full(t, np.iinfo(np.uint64).max)
                np.minimum.at(least, bins, values)
                continue
            bins, first = np.unique(bins, return_index=True)
            fill = ~full[bins]
            out[bins[fill]], full[bins] = values[first[fill]], True
        if len(found) > AT_ONCE:
            fill = ~full & (least < np.iinfo(np.uint64).max)
            out[fill], full[fill] = least[fill], True
        at = rounds.stop
    for b in np.flatnonzero(~full):
        out[b] = hashed(found, slice(t + b, t + b + 1)).min()
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """One key a band: its coordinates and its number, mixed."""
    return mixed((mixed(values).reshape(BANDS, ROWS) * _MIX[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[-3])


def bits(values: np.ndarray) -> np.ndarray:
    """The lowest bit of every coordinate: they differ with a chance of half the distance."""
    return np.packbits((values & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
