"""Word and shingle hashes of whole texts, worked out for an Arrow batch at a time with numpy.

A word is a run of bytes other than the ASCII white space 0x20 and 0x09-0x0D, with A-Z lower-cased;
UTF-8 never uses those bytes inside a character, so bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed odd 64-bit multipliers.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
#: Bytes that one step works on; a word or a step's arrays of eight bytes each stay small.
STEP = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the row offsets of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _words(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of raw; breaks are starts of rows, where a word can't go on."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    lower = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    first = ~space
    after = space[:-1].copy()
    after[breaks[(breaks > 0) & (breaks < len(raw))] - 1] = True
    first[1:] &= after
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    ends = np.append(starts[1:], len(raw))
    place = np.arange(len(raw), dtype=np.int64)
    place[starts[0] :] -= np.repeat(starts, ends - starts)
    powers = np.full(int((ends - starts).max()) + 1, BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    place[: starts[0]] = 0
    value = (lower.astype(np.uint64) + np.uint64(1)) * powers[place]
    value[space] = 0
    return mixed(np.add.reduceat(value, starts)), starts


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the batch, and the offsets of each row's words in them."""
    raw, at = buffers(texts)
    hashes, starts, low = [], [], 0
    while low < len(raw):
        high = min(low + STEP, len(raw))
        while high < len(raw) and not (raw[high - 1] == 32 or 9 <= raw[high - 1] <= 13):
            more = np.flatnonzero((raw[high : high + STEP] == 32) | ((raw[high : high + STEP] >= 9) & (raw[high : high + STEP] <= 13)))
            high = high + int(more[0]) + 1 if len(more) else min(high + STEP, len(raw))
        inside = at[np.searchsorted(at, low) : np.searchsorted(at, high)]
        h, s = _words(raw[low:high], inside - low)
        hashes.append(h)
        starts.append(s + low)
        low = high
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), at)


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words of the batch, with repeats, and each row's offsets in them.

    A row with fewer words, but one at least, has one shingle: all its words. A row without words has none.
    """
    words, at = word_hashes(texts)
    counts = np.diff(at)
    if not len(words):
        return words, at
    total = words * BASE
    for k in range(1, width):
        step = mixed(np.array([k + 1], np.uint64))[0] | np.uint64(1)
        total[:-k] += words[k:] * step
        # the last rows of words have no k-th successor; they are left out below or made anew
    row = np.repeat(np.arange(len(counts)), counts)
    whole = at[row + 1] - np.arange(len(words)) >= width
    short = np.flatnonzero((counts > 0) & (counts < width))
    for r in short:
        h = np.uint64(counts[r])
        for w in words[at[r] : at[r + 1]]:
            h = mixed(np.array([(int(h) * int(BASE) + int(w)) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]
        total[at[r]] = h
        whole[at[r]] = True
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    return mixed(total[whole]), np.concatenate([[0], np.cumsum(sizes)])


def distinct_sets(hashes: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Each row's distinct hashes, ascending."""
    for low, high in zip(at[:-1], at[1:], strict=True):
        yield np.unique(hashes[low:high])


def permutation_table(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin, the odd step and the start of its own tour of all bins (bins is a power of two)."""
    seed = mixed(np.arange(1, 2 * bins + 1, dtype=np.uint64) * BASE)
    return ((seed[:bins] % np.uint64(bins)) | np.uint64(1)).astype(np.int64), (seed[bins:] % np.uint64(bins)).astype(np.int64)


def one_permutation(hashes: np.ndarray, at: np.ndarray, bins: int, keep: int | None = None) -> np.ndarray:
    """One-permutation MinHash of each row: rows x bins of 32-bit minima, densified.

    The high bits of a hash choose its bin, the low 32 bits are its value there. An empty bin goes through
    its own fixed tour of the bins until it meets one that was filled from hashes, and takes that value, so
    that it agrees for two sets as often as the sets are alike. Rows without hashes are all ones.
    keep: the number of bins to densify and return, the first ones.
    """
    rows, keep = len(at) - 1, keep or bins
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    filled = np.full((rows, bins), empty, np.uint64)
    if len(hashes):
        row = np.repeat(np.arange(rows), np.diff(at))
        where = row * bins + (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
        np.minimum.at(filled.ravel(), where, hashes & np.uint64(0xFFFFFFFF))
    has = filled != empty
    step, start = permutation_table(bins)
    row, place = np.nonzero(~has[:, :keep] & has.any(axis=1)[:, None])
    out = filled[:, :keep].copy()
    turn = 0
    while len(row):
        look = (start[place] + step[place] * turn) % bins
        hit = has[row, look]
        out[row[hit], place[hit]] = filled[row[hit], look[hit]]
        row, place = row[~hit], place[~hit]
        turn += 1
    return (out & np.uint64(0xFFFFFFFF)).astype(np.uint32)
