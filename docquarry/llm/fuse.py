"""Static 3-wise binary-fuse filters with 16-bit fingerprints, built and probed with numpy.

A filter holds a fixed set of 64-bit keys: no false negatives, a false positive rate of about 2**-16, about 18 bits a key.
Construction peels all cells that hold a single key at once, round by round.
"""

from __future__ import annotations

import math
import struct

import numpy as np

from docquarry.llm.common import mix64

_HEAD = "<QII"


def _places(h: np.ndarray, seg: int, count: int) -> np.ndarray:
    """The three cells of each hash, one in each of three consecutive segments."""
    first = ((h >> np.uint64(32)) * np.uint64(seg * count)) >> np.uint64(32)
    mask = np.uint64(seg - 1)
    second = (first + np.uint64(seg)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * seg)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(40))) & np.uint64(0xFFFF)).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """A filter of the distinct uint64 keys."""
    keys = np.unique(np.asarray(keys, np.uint64))
    n = len(keys)
    if not n:
        return struct.pack(_HEAD, 0, 0, 0)
    seg = min(1 << 18, 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    room = int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))) + 8
    count = max(1, -(-room // seg) - 2)
    for seed in range(1, 200):
        with np.errstate(over="ignore"):
            h = mix64(keys ^ mix64(np.array([seed], np.uint64)))
        cells = _places(h, seg, count)
        size = (count + 2) * seg
        held = np.bincount(cells.ravel(), minlength=size)
        who = np.zeros(size, np.int64)  # xor of the key numbers in a cell
        for c in cells:
            np.bitwise_xor.at(who, c, np.arange(n))
        left, rounds = n, []
        while left:
            single = np.flatnonzero(held == 1)
            if not len(single):
                break
            key, at = np.unique(who[single], return_index=True)
            rounds.append((key, single[at]))
            for c in cells[:, key]:
                np.subtract.at(held, c, 1)
                np.bitwise_xor.at(who, c, key)
            left -= len(key)
        if left:
            if seed % 20 == 0:
                count += max(1, count // 10)
            continue
        prints, out = _prints(h), np.zeros(size, np.uint16)
        for key, cell in reversed(rounds):
            out[cell] = 0
            a, b, c = cells[:, key]
            out[cell] = prints[key] ^ out[a] ^ out[b] ^ out[c]
        return struct.pack(_HEAD, seed, seg, count) + out.tobytes()
    raise ValueError("no seed gives a filter")


def probe(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold."""
    seed, seg, count = struct.unpack_from(_HEAD, blob)
    keys = np.asarray(keys, np.uint64)
    if not seg:
        return np.zeros(len(keys), bool)
    cells = np.frombuffer(blob, np.uint16, offset=struct.calcsize(_HEAD))
    h = mix64(keys ^ mix64(np.array([seed], np.uint64)))
    a, b, c = _places(h, seg, count)
    return (cells[a] ^ cells[b] ^ cells[c]) == _prints(h)
