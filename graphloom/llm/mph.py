"""Minimal perfect hashing over 128-bit key hashes, as arrays of one shard.

A shard holds n distinct keys (h1, h2). Level by level, keys that are alone
at their place in a bit array of about twice their number stay there; the
rest go to the next level. The rank of a key's bit over all levels is its
number, 0 to n - 1, and indexes arrays of fingerprints (h2) and payload. A
lookup of a key that is not in the shard ends at a place without a bit or at
a fingerprint that differs. Keys that share h1 (2**-64 a pair) cannot be told
apart by level hashes; all but one of them sit in a sorted overflow list.
"""

from __future__ import annotations

import pickle

import numpy as np

GAMMA = 2.0


def _place(h: np.ndarray, level: int, m: int) -> np.ndarray:
    """Places 0 to m - 1 of the hashes at a level (a 64-bit finaliser, then multiply and shift)."""
    with np.errstate(over="ignore"):
        x = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)


class Shard:
    """The hash function and the arrays of one shard."""

    def __init__(self, levels, fingerprints, payload, extra):
        self.levels, self.fingerprints, self.payload, self.extra = levels, fingerprints, payload, extra

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, **payload: np.ndarray) -> Shard:
        """From distinct keys (h1, h2 as uint64) and arrays in the same order."""
        _, first = np.unique(h1, return_index=True)
        rest = np.setdiff1d(np.arange(len(h1)), first)
        extra = {(int(h1[i]), int(h2[i])): {k: v[i] for k, v in payload.items()} for i in rest}
        h, levels, base = h1[first], [], 0
        left = h
        while len(left):
            m = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = _place(left, len(levels), m)
            count = np.bincount(at.astype(np.int64), minlength=m)
            words = np.packbits(count == 1, bitorder="little").view(np.uint64)
            ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            levels.append((m, words, (ranks[:-1] + base).astype(np.uint32)))
            base += int(ranks[-1])
            left = left[count[at] != 1]
        out = cls(levels, np.zeros(len(h), np.uint64), {}, extra)
        number = out._numbers(h)
        out.fingerprints[number] = h2[first]
        for k, v in payload.items():
            out.payload[k] = np.empty(len(h), v.dtype)
            out.payload[k][number] = v[first]
        return out

    def _numbers(self, h: np.ndarray) -> np.ndarray:
        """The keys' numbers; -1 for those that have no bit at any level."""
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for level, (m, words, ranks) in enumerate(self.levels):
            if not len(left):
                break
            at = _place(h[left], level, m)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            got = words[word]
            has = ((got >> bit) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(got & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[has]] = (ranks[word] + below)[has]
            left = left[~has]
        return out

    def find(self, h1: np.ndarray, h2: np.ndarray, name: str, missing) -> np.ndarray:
        """``payload[name]`` of each key, ``missing`` for keys that aren't in the shard."""
        out = np.full(len(h1), missing, self.payload[name].dtype if self.payload else np.int64)
        if len(self.fingerprints):
            number = self._numbers(h1)
            ok = number >= 0
            ok[ok] = self.fingerprints[number[ok]] == h2[ok]
            out[ok] = self.payload[name][number[ok]]
        if self.extra:
            for i, key in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
                if key in self.extra:
                    out[i] = self.extra[key][name]
        return out

    def dumps(self) -> bytes:
        return pickle.dumps((self.levels, self.fingerprints, self.payload, self.extra), protocol=5)

    @classmethod
    def loads(cls, blob: bytes) -> Shard:
        return cls(*pickle.loads(blob))
