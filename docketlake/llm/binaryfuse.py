"""Static binary-fuse filters over 64-bit keys, built and probed in numpy.

A filter stores one 16-bit fingerprint per slot; a key is (perhaps) present when the three slots
it hashes to, in neighbouring segments, xor to its fingerprint. No false negatives; about 2**-16
false positives.
"""

from __future__ import annotations

import math
import struct

import numpy as np

from .wordblocks import mix

_HEAD = struct.Struct("<QIII")


def _slots(keys: np.ndarray, seed: int, segment: int, starts: int) -> np.ndarray:
    """Three slots of each key; the first segment is chosen by the hash, the others follow it."""
    h = mix(keys + np.uint64(seed))
    first = ((h >> np.uint64(32)) * np.uint64(starts)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    base = first.astype(np.int64) * segment
    out = np.empty((3, len(keys)), np.int64)
    for j, part in enumerate((h, h >> np.uint64(18), mix(h ^ np.uint64(0xA5A5A5A5)))):
        out[j] = base + j * segment + (part & mask).astype(np.int64)
    return out


def _fingerprints(keys: np.ndarray, seed: int) -> np.ndarray:
    return (mix(keys ^ np.uint64(seed ^ 0x5BD1E995)) >> np.uint64(48)).astype(np.uint16)


def build(keys: np.ndarray, attempts: int = 64) -> bytes:
    """Serialised filter of distinct 64-bit keys (repeated keys are merged); empty input is legal."""
    keys = np.unique(np.asarray(keys, np.uint64))
    n = len(keys)
    segment = 4 if n < 2 else 1 << max(2, min(18, int(math.log(n) / math.log(3.33) + 2.25)))
    factor = 1.125 if n < 2 else max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    for attempt in range(attempts):
        starts = max(1, math.ceil(n * factor / segment) - 2 + attempt // 4)
        seed = int(mix(np.array([attempt + 1], np.uint64))[0])
        order = _peel(slots := _slots(keys, seed, segment, starts), (starts + 2) * segment)
        if order is None:
            continue
        prints, values = _fingerprints(keys, seed), np.zeros((starts + 2) * segment, np.uint16)
        for chosen, slot in reversed(order):  # keys of one round do not touch each other's slot
            a, b, c = slots[:, chosen]
            values[slot] = 0
            values[slot] = prints[chosen] ^ values[a] ^ values[b] ^ values[c]
        return _HEAD.pack(seed, segment, starts, n) + values.tobytes()
    raise RuntimeError("no binary-fuse filter could be built")


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, their private slots); None if a core remains."""
    n = slots.shape[1]
    degree = np.bincount(slots.ravel(), minlength=size)
    owners = np.zeros(size, np.int64)  # xor of the key numbers in a slot
    for j in range(3):
        np.bitwise_xor.at(owners, slots[j], np.arange(n))
    ready, left, order = np.flatnonzero(degree == 1), n, []
    while len(ready):
        ready = ready[degree[ready] == 1]
        chosen, at = np.unique(owners[ready], return_index=True)
        if not len(chosen):
            break
        order.append((chosen, ready[at]))
        left -= len(chosen)
        touched = slots[:, chosen]
        np.subtract.at(degree, touched.ravel(), 1)
        for j in range(3):
            np.bitwise_xor.at(owners, touched[j], chosen)
        ready = np.unique(touched)
        ready = ready[degree[ready] == 1]
    return order if not left else None


def contains(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    seed, segment, starts, n = _HEAD.unpack_from(filter_bytes)
    keys = np.asarray(keys, np.uint64)
    if not n:
        return np.zeros(len(keys), bool)
    values = np.frombuffer(filter_bytes, np.uint16, offset=_HEAD.size)
    a, b, c = _slots(keys, seed, segment, starts)
    return values[a] ^ values[b] ^ values[c] == _fingerprints(keys, seed)
