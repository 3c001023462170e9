"""A cuckoo filter over 128-bit keys: set membership with deletion.

Buckets of four 16-bit fingerprints; a key's second bucket is its first one
XOR a hash of the fingerprint. Lookups are vectorised; inserts and deletes work
key by key. The caller holds the exact table and rebuilds a filter that is full.
"""

from __future__ import annotations

import numpy as np

SLOTS, MAX_KICKS = 4, 500


class FilterFull(Exception):
    pass


class CuckooFilter:
    def __init__(self, capacity: int = 64, slots: bytes | None = None):
        if slots is None:
            buckets = 1 << max(4, int(capacity / (0.8 * SLOTS)).bit_length())
            self.table = np.zeros((buckets, SLOTS), np.uint16)
        else:
            self.table = np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy()
        self.mask = len(self.table) - 1

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints (never 0) and both buckets of keys."""
        fp = (k2.astype(np.uint64) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (k1.astype(np.uint64) >> np.uint64(20)).astype(np.int64) & self.mask
        return fp, first, self._other(first, fp)

    def _other(self, bucket, fp):
        return bucket ^ ((fp.astype(np.int64) * 0x5BD1E995 >> 8) & self.mask)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(k1, k2)
        return (self.table[a] == fp[:, None]).any(axis=1) | (self.table[b] == fp[:, None]).any(axis=1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Insert keys that are not in the set yet."""
        fps, firsts, seconds = self.places(k1, k2)
        for fp, a, b in zip(fps, firsts.tolist(), seconds.tolist()):
            if not (self._put(a, fp) or self._put(b, fp)):
                self._kick(b, fp)

    def _put(self, bucket: int, fp) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free):
            self.table[bucket, free[0]] = fp
        return len(free) > 0

    def _kick(self, bucket: int, fp) -> None:
        for turn in range(MAX_KICKS):
            slot = turn % SLOTS
            fp, self.table[bucket, slot] = self.table[bucket, slot], fp
            bucket = int(self._other(bucket, fp))
            if self._put(bucket, fp):
                return
        raise FilterFull

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Take out keys that are in the set."""
        fps, firsts, seconds = self.places(k1, k2)
        for fp, a, b in zip(fps, firsts.tolist(), seconds.tolist()):
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == fp)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break


def filter_of(k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
    capacity = max(16, len(k1))
    while True:
        found = CuckooFilter(capacity)
        try:
            found.insert(k1, k2)
            return found
        except FilterFull:
            capacity *= 2
