"""Static binary-fuse filters over 64-bit keys, in numpy.

A key's hash picks one slot in each of three neighbouring segments; the filter holds a byte a slot, so that the three
bytes of a key of the set XOR to eight bits of its hash. A key outside the set passes with a chance of 1/256. A filter
is built once, by peeling keys that are alone in a slot, round by round, and never changes; it takes about nine bits a key.
"""

from __future__ import annotations

import math

import numpy as np

TRIES = 100


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each key and the seed."""
    h = keys.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Rows x 3 slots, one in each of three segments in a row, of which the first is one of segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    at = [(_mixed(h, k + 1) & np.uint64(segment - 1)).astype(np.int64) for k in range(3)]
    return np.stack([(first + k) * segment + a for k, a in enumerate(at)], axis=1)


def _bits(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(40))) & np.uint64(255)).astype(np.uint8)


def shape(n: int) -> tuple[int, int]:
    """Slots of a segment, a power of two, and how many segments a key's first slot can be in."""
    segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    space = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3))) + 16
    return segment, max(1, math.ceil(space / segment) - 2)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment, segments, bytes) of the filter of these keys, repeated ones counted once."""
    keys = np.unique(keys.astype(np.int64))
    segment, segments = shape(len(keys))
    for seed in range(1, TRIES):
        h = _mixed(keys, seed)
        slots = _slots(h, segment, segments)
        count = np.bincount(slots.ravel(), minlength=(segments + 2) * segment)
        # a slot's sum of keys is its key once it has one alone
        total = np.zeros(len(count), np.int64)
        np.add.at(total, slots.ravel(), np.repeat(np.arange(len(keys)), 3))
        alone, rounds, left = np.flatnonzero(count == 1), [], len(keys)
        while len(alone):
            which, first = np.unique(total[alone], return_index=True)
            rounds.append((which, alone[first]))
            left -= len(which)
            touched = slots[which].ravel()
            np.subtract.at(count, touched, 1)
            np.subtract.at(total, touched, np.repeat(which, 3))
            touched = np.unique(touched)
            alone = touched[count[touched] == 1]
        if left == 0:
            out, bits = np.zeros(len(count), np.uint8), _bits(h)
            for which, slot in reversed(rounds):
                out[slot] = bits[which] ^ np.bitwise_xor.reduce(out[slots[which]], axis=1)
            return seed, segment, segments, out.tobytes()
    raise RuntimeError(f"no filter of {len(keys)} keys in {TRIES} tries")


def holds(keys: np.ndarray, seed: int, segment: int, segments: int, held: bytes) -> np.ndarray:
    """Which keys pass: all of the set, and one in 256 of the others."""
    h = _mixed(keys.astype(np.int64), seed)
    return np.bitwise_xor.reduce(np.frombuffer(held, np.uint8)[_slots(h, segment, segments)], axis=1) == _bits(h)
