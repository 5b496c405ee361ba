"""Minimal perfect hashes over sets of strings, with the strings stored by slot.

Levels of bit arrays: a key that meets no other at its place of a level is
settled there, all others go on to the next level. A key's slot is the rank of
its bit, so n keys have the slots 0..n-1. Looking up a string that is no key may
give some key's slot; the stored string there tells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomlight.llm import flat

U64 = np.uint64
ROOM = 2  # places per key of a level
LEVELS = 40
_STEP = 0x9E3779B97F4A7C15


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of every string of an array."""
    data, starts, ends = flat.buffers(strings)
    if len(starts) == 0:
        return np.zeros(0, U64)
    low, high = int(starts[0]), int(ends[-1])
    out = flat.Hashes(flat.byte_values()[data[low:high]]).of(starts - low, ends - low)
    return flat.mix(out ^ (ends - starts).astype(U64))


def _places(names: np.ndarray, level: int, room: int) -> np.ndarray:
    return (flat.mix(names ^ U64(_STEP * (level + 1) % (1 << 64))) % U64(room)).astype(np.int64)


class PerfectHash:
    """Slots of the distinct strings it is built from."""

    def __init__(self, keys: pa.Array):
        names = string_hashes(keys)
        slot = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (set bits, slots before each byte)
        self.rooms: list[int] = []
        done = 0
        while len(left) and len(self.levels) < LEVELS:
            room = -(-ROOM * len(left) // 8) * 8
            place = _places(names[left], len(self.levels), room)
            alone = np.bincount(place, minlength=room)[place] == 1
            bits = np.zeros(room, np.uint8)
            bits[place[alone]] = 1
            before = done + np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
            slot[left[alone]] = before[place[alone]]
            self.levels.append((np.packbits(bits), before[:-1:8].astype(np.int32)))
            self.rooms.append(room)
            done += int(alone.sum())
            left = left[~alone]
        # Keys whose 64-bit hashes agree never part; they are kept by name.
        self.rest = {key: done + i for i, key in enumerate(keys.take(pa.array(left)).to_pylist())}
        slot[left] = done + np.arange(len(left))
        order = np.empty(len(keys), np.int64)
        order[slot] = np.arange(len(keys))
        self.keys = keys.take(pa.array(order))

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, strings: pa.Array, names: np.ndarray | None = None) -> np.ndarray:
        """The slot of each string, -1 where it is no key."""
        names = string_hashes(strings) if names is None else names
        slot = np.full(len(names), -1, np.int64)
        left = np.arange(len(names))
        for level, (bits, before) in enumerate(self.levels):
            if not len(left):
                break
            place = _places(names[left], level, self.rooms[level])
            byte = bits[place >> 3]
            hit = (byte >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
            found = place[hit]
            ahead = np.array([i.bit_count() for i in range(256)], np.int64)[
                byte[hit].astype(np.int64) >> (8 - (found & 7))
            ]
            slot[left[hit]] = before[found >> 3] + ahead
            left = left[~hit]
        if self.rest and len(left):
            given = strings.take(pa.array(left)).to_pylist()
            slot[left] = [self.rest.get(s, -1) for s in given]
        at = np.flatnonzero(slot >= 0)
        same = pc.equal(self.keys.take(pa.array(slot[at])), strings.take(pa.array(at)))
        slot[at[~same.to_numpy(zero_copy_only=False)]] = -1
        return slot
