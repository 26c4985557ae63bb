"""A minimal perfect hash of integer tuples that keeps its keys by slot."""

from __future__ import annotations

import io

import numpy as np

from rillflow.llm.wordhash import U64, mix64

#: Fixed value: an odd constant by which a tuple's hash is carried on to its next part (2^64 over the golden ratio).
STEP = U64(0x9E3779B97F4A7C15)
ONE, SIX, LOW = U64(1), U64(6), U64(63)


def tuple_hash(columns, seed: int = 0) -> np.ndarray:
    """One 64-bit hash for each row of equally long uint64 columns."""
    total = mix64(columns[0] + U64(seed))
    for column in columns[1:]:
        total = mix64(total * STEP + column)
    return total


class PerfectHash:
    """Slots 0 ... n - 1 of n distinct rows of `keys` (uint64, one column a part of the key).

    A cascade of bit arrays: keys alone at their place of a level get a bit there,
    the others go on to the next level; a slot is the number of bits before the
    key's own. As strangers find bits too, a found slot counts only if the key
    kept there is the one asked for.
    """

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray, seed: int = 0):
        self.levels, self.keys, self.seed = levels, keys, seed
        counts = [np.bitwise_count(bits).astype(np.int64) for bits in levels]
        self.bases = np.cumsum([0, *(int(c.sum()) for c in counts)])
        self.ranks = [np.cumsum(c) - c for c in counts]

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return mix64(hashes + U64((level * int(STEP)) % 2**64)) % U64(size * 64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """From the rows of `keys`; repeated rows raise ValueError, as no seed tells them apart."""
        for seed in range(4):
            made = cls._build(keys, seed)
            if made is not None:
                return made
        raise ValueError("keys that can't be told apart")

    @classmethod
    def _build(cls, keys: np.ndarray, seed: int):
        hashes, order, levels = tuple_hash(keys.T, seed), [], []
        left = np.arange(len(keys))
        while len(left):
            if len(levels) == 64:
                return None
            size = max(1, (2 * len(left) + 63) // 64)
            place = cls._place(hashes[left], len(levels), size)
            alone = np.bincount(place.astype(np.int64), minlength=size * 64)[place.astype(np.int64)] == 1
            bits = np.zeros(size, U64)
            own = place[alone]
            np.bitwise_or.at(bits, (own >> SIX).astype(np.int64), ONE << (own & LOW))
            order.append(left[alone][np.argsort(own)])
            levels.append(bits)
            left = left[~alone]
        return cls(levels, keys[np.concatenate(order)] if order else keys, seed)

    def slots(self, columns) -> np.ndarray:
        """The slot of each asked key, -1 for those that aren't kept here."""
        out = np.full(len(columns[0]), -1, np.int64)
        hashes, left = tuple_hash(columns, self.seed), np.arange(len(columns[0]))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            place = self._place(hashes[left], level, len(bits))
            word, bit = (place >> SIX).astype(np.int64), place & LOW
            found = (bits[word] >> bit) & ONE == ONE
            below = np.bitwise_count(bits[word] & ((ONE << bit) - ONE)).astype(np.int64)
            out[left[found]] = (self.bases[level] + self.ranks[level][word] + below)[found]
            left = left[~found]
        asked = np.flatnonzero(out >= 0)
        same = np.ones(len(asked), bool)
        for i, column in enumerate(columns):
            same &= self.keys[out[asked], i] == column[asked]
        out[asked[~same]] = -1
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, keys=self.keys, seed=np.int64(self.seed), **{f"level{i}": bits for i, bits in enumerate(self.levels)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        kept = np.load(io.BytesIO(data))
        return cls([kept[f"level{i}"] for i in range(len(kept.files) - 2)], kept["keys"], int(kept["seed"]))
