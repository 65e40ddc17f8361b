"""Cuckoo filters over 128-bit keys, filled and asked in bulk."""

from __future__ import annotations

import numpy as np

_SLOTS = 4


class CuckooFilter:
    """16-bit marks in buckets of four; a key has two buckets.

    Supports insertion, deletion of inserted keys, and membership with false
    positives (about 1 in 8,000) but no false negatives.  A table that gets
    full is followed by one of twice the size, so a filter has no fixed
    capacity.  Keys come as two arrays of 64-bit integers.
    """

    def __init__(self, buckets: int = 1024):
        self.tables = [np.zeros((buckets, _SLOTS), np.uint16)]

    @staticmethod
    def load(data: bytes) -> CuckooFilter:
        out = CuckooFilter.__new__(CuckooFilter)
        out.tables, at = [], 0
        while at < len(data):
            buckets = int.from_bytes(data[at : at + 8], "little")
            size = buckets * _SLOTS * 2
            out.tables.append(np.frombuffer(data, np.uint16, buckets * _SLOTS, at + 8).reshape(buckets, _SLOTS).copy())
            at += 8 + size
        return out

    def dump(self) -> bytes:
        return b"".join(len(t).to_bytes(8, "little") + t.tobytes() for t in self.tables)

    @staticmethod
    def _marks(low: np.ndarray) -> np.ndarray:
        return (low.view(np.uint64) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)

    @staticmethod
    def _homes(high: np.ndarray, marks: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        first = (high.view(np.uint64) & np.uint64(buckets - 1)).astype(np.int64)
        return first, first ^ CuckooFilter._step(marks.astype(np.int64), buckets)

    @staticmethod
    def _step(marks, buckets: int):
        return (marks * 0x5BD1E995 >> 7) & (buckets - 1)

    def contains(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        marks = self._marks(low)
        found = np.zeros(len(marks), bool)
        for table in self.tables:
            for homes in self._homes(high, marks, len(table)):
                found |= (table[homes] == marks[:, None]).any(axis=1)
        return found

    def insert(self, high: np.ndarray, low: np.ndarray) -> None:
        """Insert keys; a key that is in already is put in once more."""
        while len(high):
            table = self.tables[-1]
            marks = self._marks(low)
            left = np.arange(len(marks))
            free = table.size - np.count_nonzero(table)
            if free > table.size // 5:  # beyond a load of 80 % a larger table follows
                take = left[: free - table.size // 5]
                rest = left[len(take) :]
                homes = self._homes(high, marks, len(table))
                pending = take
                for _ in range(2):
                    for home in homes:
                        for slot in range(_SLOTS):
                            if not len(pending):
                                break
                            empty = pending[table[home[pending], slot] == 0]
                            _, at = np.unique(home[empty], return_index=True)
                            chosen = empty[at]
                            table[home[chosen], slot] = marks[chosen]
                            pending = np.setdiff1d(pending, chosen, assume_unique=True)
                stuck = [i for i in pending if not self._kick(table, int(homes[0][i]), int(marks[i]))]
                left = np.concatenate([rest, np.array(stuck, np.int64)])
            if len(left):
                self.tables.append(np.zeros((2 * len(table), _SLOTS), np.uint16))
            high, low = high[left], low[left]

    def _kick(self, table: np.ndarray, home: int, mark: int) -> bool:
        """Move marks along until one finds an empty slot; undo it all if none does."""
        path = []
        for turn in range(200):
            empty = np.flatnonzero(table[home] == 0)
            if len(empty):
                table[home, empty[0]] = mark
                return True
            slot = turn % _SLOTS
            path.append((home, slot, int(table[home, slot])))
            mark, table[home, slot] = int(table[home, slot]), mark
            home ^= int(self._step(mark, len(table)))
        for home, slot, old in reversed(path):
            table[home, slot] = old
        return False

    def delete(self, high: np.ndarray, low: np.ndarray) -> None:
        """Delete one copy of each key; all must have been inserted."""
        marks = self._marks(low)
        for i, mark in enumerate(marks):
            for table in reversed(self.tables):
                homes = self._homes(high[i : i + 1], marks[i : i + 1], len(table))
                at = [(int(h[0]), int(s)) for h in homes for s in np.flatnonzero(table[h[0]] == mark)[:1]]
                if at:
                    table[at[0]] = 0
                    break
