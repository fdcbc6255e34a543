"""A cuckoo filter over 128-bit keys, for many keys at once.

A key has a fingerprint of 16 bits and two buckets of four slots; the second bucket follows from the first and the
fingerprint, so slots can be moved without their keys. Lookups of held keys always find them; others are
taken for held about once in 8,000 times. Only held keys may be removed: the caller's exact counts see to that.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
_ROUNDS = 400


def buckets_for(keys: int) -> int:
    """Buckets, a power of two, of a filter that so many keys fill by less than two thirds."""
    return 1 << max(2, int(np.ceil(np.log2(max(keys, 1) * 1.5 / SLOTS))))


def is_full(keys: int, buckets: int) -> bool:
    return keys > 0.85 * SLOTS * buckets


class Cuckoo:
    def __init__(self, buckets: int, cells: bytes | None = None):
        """cells: what to_bytes() gave; without it the filter is empty."""
        self.mask = np.int64(buckets - 1)
        whole = np.zeros(buckets * SLOTS, dtype=np.uint16) if cells is None else np.frombuffer(cells, dtype=np.uint16).copy()
        self.cells, rest = whole[: buckets * SLOTS].reshape(-1, SLOTS), whole[buckets * SLOTS :]
        #: Fingerprints that found no slot, with one of their buckets; hardly ever any.
        self.spare = rest.view(np.int64).reshape(-1, 2)

    def to_bytes(self) -> bytes:
        return self.cells.tobytes() + self.spare.tobytes()

    def _prints(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and first bucket of each key (two unsigned 64-bit numbers a row)."""
        prints = (keys[:, 0] >> np.uint64(48)).astype(np.int64)
        return np.where(prints == 0, 1, prints), (keys[:, 1] >> np.uint64(1)).astype(np.int64) & self.mask

    def _other(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ ((prints * 0x5BD1E995 >> 7) & self.mask)

    def _spare_matches(self, prints: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Positions in spare, by key; -1 for none."""
        found = np.full(len(prints), -1)
        for i, (p, b) in enumerate(self.spare):
            found[(found < 0) & (prints == p) & ((first == b) | (self._other(prints, first) == b))] = i
        return found

    def holds(self, keys: np.ndarray) -> np.ndarray:
        prints, first = self._prints(keys)
        there = (self.cells[first] == prints[:, None]).any(1) | (self.cells[self._other(prints, first)] == prints[:, None]).any(1)
        return there | (self._spare_matches(prints, first) >= 0) if len(self.spare) else there

    def add(self, keys: np.ndarray) -> None:
        """Add keys that are not held yet (equal fingerprints of different keys each get a slot)."""
        prints, at = self._prints(keys)
        for turn in range(_ROUNDS):
            if not len(prints):
                return
            for _ in range(2):  # a free slot in either bucket, a key a bucket at a time
                free = self.cells[at] == 0
                _, one = np.unique(np.where(free.any(1), at, -1 - np.arange(len(at))), return_index=True)
                one = one[free[one].any(1)]
                self.cells[at[one], free[one].argmax(1)] = prints[one]
                rest = np.ones(len(at), dtype=bool)
                rest[one] = False
                prints, at = prints[rest], at[rest]
                at = self._other(prints, at)
            full = ~(self.cells[at] == 0).any(1) & ~(self.cells[self._other(prints, at)] == 0).any(1)
            _, one = np.unique(np.where(full, at, -1 - np.arange(len(at))), return_index=True)
            one = one[full[one]]
            slot = (prints[one] + turn * 7 + at[one]) % SLOTS  # put one out, which goes on to its other bucket
            out = self.cells[at[one], slot].astype(np.int64)
            self.cells[at[one], slot] = prints[one]
            prints[one] = out
            at[one] = self._other(out, at[one])
        self.spare = np.concatenate([self.spare, np.stack([prints, at], 1)])

    def remove(self, keys: np.ndarray) -> None:
        """Take out one fingerprint for each key; all keys must be held."""
        prints, at = self._prints(keys)
        while len(prints):
            before = len(prints)
            for _ in range(2):
                match = self.cells[at] == prints[:, None]
                _, one = np.unique(np.where(match.any(1), at, -1 - np.arange(len(at))), return_index=True)
                one = one[match[one].any(1)]
                self.cells[at[one], match[one].argmax(1)] = 0
                rest = np.ones(len(at), dtype=bool)
                rest[one] = False
                prints, at = prints[rest], at[rest]
                at = self._other(prints, at)
            if len(prints) == before:  # what is left is among the spare ones
                for p, b in zip(prints, at):
                    hit = self._spare_matches(np.array([p]), np.array([b]))[0]
                    if hit < 0:
                        raise KeyError("a key to be removed is not in the filter")
                    self.spare = np.delete(self.spare, hit, axis=0)
                return
