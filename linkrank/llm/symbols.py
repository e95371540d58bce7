"""Vectorised words, word identities and window anchors of one text at a time.

A word's 64-bit identity is a sum of random numbers, one for each place and byte (tabulation), so that any two words agree with a chance of 2**-64
whatever their form; longer words have a keyed digest. Hashes of stretches are polynomial sums modulo 2**64 over prefix sums, so that any stretch's
hash is one subtraction and one product; those of bytes or of many words only choose groups and candidates."""

from __future__ import annotations

import hashlib

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)
THIRTY_TWO = np.uint64(32)
PLACES = 64
NUMBERS = np.random.Philox(key=20_240_501).random_raw(PLACES * 256)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**k modulo 2**64 for k < n at least."""
    if base not in _powers or len(_powers[base]) < n:
        size = max(1 << 14, 1 << (max(1, n) - 1).bit_length())
        steps = np.full(size, base & (2**64 - 1), np.uint64)
        steps[0] = 1
        out = np.multiply.accumulate(steps)
        if size > 1 << 22:  # not kept for the rare very long text
            return out
        _powers[base] = out
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> THIRTY_TWO)) * MIX
    h = (h ^ (h >> THIRTY_TWO)) * MIX
    return h ^ (h >> THIRTY_TWO)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of values[k] * BASE**k for k < i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(BASE, len(values))[: len(values)], out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64) * MIX)


def byte_table(separators: bytes, fold: bool = False) -> np.ndarray:
    """What each byte counts as in a word; 0 between words."""
    table = np.arange(1, 257, dtype=np.uint16)
    if fold:
        table[65:91] = table[97:123]
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


SPACES = b"\t\n\v\f\r "
SPACED = byte_table(SPACES)
SPACED_FOLDED = byte_table(SPACES, fold=True)
ALNUM_FOLDED = byte_table(bytes([*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]), fold=True)


SLICE = 1 << 17  # bytes of words that are looked up at a time


def words(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and its 64-bit identity."""
    counts = table[np.frombuffer(data, np.uint8)]
    inside = np.zeros(len(counts) + 2, np.int8)
    inside[1:-1] = counts > 0
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    ids = np.empty(len(starts), np.uint64)
    cuts = np.append(np.flatnonzero(np.diff(starts // SLICE, prepend=-1)), len(starts))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        sizes = (ends[a:b] - starts[a:b]).astype(np.int32)
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        here = counts[starts[a] : ends[b - 1]]
        at = here[here > 0].astype(np.int32) - 1  # bytes of words, and from here on their places in NUMBERS
        at += np.minimum(np.arange(len(at), dtype=np.int32) - np.repeat(first, sizes), PLACES - 1) * 256
        ids[a:b] = np.add.reduceat(NUMBERS[at], first)
        for i in np.flatnonzero(sizes > PLACES).tolist():
            word = (counts[starts[a + i] : ends[a + i]] - 1).astype(np.uint8).tobytes()
            ids[a + i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"word").digest(), "little")
    return starts, ends, ids


def grams(symbols: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive symbols from each place where so many are left."""
    if len(symbols) < n:
        return np.empty(0, np.uint64)
    at = np.arange(len(symbols) - n + 1)
    return stretch_hashes(prefix_sums(symbols), at, at + n)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each `width` consecutive ones, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def sliding_max(values: np.ndarray, width: int) -> np.ndarray:
    return ~sliding_min(~values, width)


BLOCK = 1 << 19


def anchored_runs(symbols: np.ndarray, window: int, gram: int, inner: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts the window starts 0..len-window into runs: anchor, first start, end of the starts; and the runs that may repeat inside.

    A window's anchor is the least gram hash inside it. It depends on the window's content alone, so equal windows have equal
    anchors wherever they stand, and each window start belongs to one run. Runs are also cut where a block of a very long text ends.
    With `inner`, the last result lists runs whose anchor stands at two places inside, so that two of their own windows may be equal."""
    anchors, firsts, ends, twice = [], [], [], []
    width, runs = window - gram + 1, 0
    for at in range(0, len(symbols) - window + 1, BLOCK):
        here = grams(symbols[at : at + BLOCK + window - 1], gram)
        least = sliding_min(here, width)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        end = np.append(first[1:], len(least))
        anchors.append(least[first])
        firsts.append(first + at)
        ends.append(end + at)
        if inner:
            edge = np.zeros(width - 1, np.uint64)
            place = np.flatnonzero(sliding_max(np.concatenate((edge, least, edge)), width) == here)  # those that are least in some window
            if len(place) > len(first) or len(np.unique(least[first])) < len(first):
                names, code = np.unique(here[place], return_inverse=True)
                held = np.sort((code << 32) + place)
                mine = np.searchsorted(names, least[first]) << 32
                count = np.searchsorted(held, mine + end + width - 1) - np.searchsorted(held, mine + first)
                twice.append(np.flatnonzero(count > 1) + runs)
        runs += len(first)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return join(anchors, np.uint64), join(firsts, np.int64), join(ends, np.int64), join(twice, np.int64)
