"""Minimal perfect hashing of 64-bit numbers, with arrays that it indexes."""

from __future__ import annotations

import io

import numpy as np

_M = np.uint64(0xFF51AFD7ED558CCD)
_K = np.uint64(0xC4CEB9FE1A85EC53)


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * _M
    x = (x ^ (x >> np.uint64(33))) * _K
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Levels of bit arrays: a key's place is the rank of the first bit that it has alone. ``index`` gives any number, known or not, a place or -1."""

    LEVELS = 48

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes = bits, sizes
        self.starts = np.cumsum(sizes) - sizes
        self._ranks()

    def _ranks(self) -> None:
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.ranks = np.cumsum(ones) - ones

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        left, words, sizes = np.unique(keys.astype(np.uint64)), [], []
        for level in range(cls.LEVELS):
            if not len(left):
                break
            size = max(64, -(-int(len(left) * gamma) // 64) * 64)
            at = (_level_hash(left, level) % np.uint64(size)).astype(np.int64)
            count = np.bincount(at, minlength=size)
            words.append(np.packbits(count == 1, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[count[at] != 1]
        if len(left):
            raise ValueError("keys that no level tells apart")
        return cls(np.concatenate(words) if words else np.empty(0, np.uint64), np.array(sizes, np.int64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, start) in enumerate(zip(self.sizes.tolist(), self.starts.tolist(), strict=True)):
            if not len(todo):
                break
            bit = start + (_level_hash(keys[todo], level) % np.uint64(size)).astype(np.int64)
            word, low = bit >> 6, (bit & 63).astype(np.uint64)
            here = (self.bits[word] >> low) & np.uint64(1) == 1
            mask = (np.uint64(1) << low[here]) - np.uint64(1)
            out[todo[here]] = self.ranks[word[here]] + np.bitwise_count(self.bits[word[here]] & mask)
            todo = todo[~here]
        return out


class Shard:
    """Fingerprints, counts and last holders of the keys of one shard, at the places of a perfect hash. Keys that share the half which is hashed, but for the
    first of them, are in a short list beside it."""

    FIELDS = ("fingerprint", "count", "last", "more")

    def __init__(self, hash_: PerfectHash, fingerprint: np.ndarray, count: np.ndarray, last: np.ndarray, more: np.ndarray):
        self.hash, self.fingerprint, self.count, self.last, self.more = hash_, fingerprint, count, last, more

    @classmethod
    def build(cls, place: np.ndarray, fingerprint: np.ndarray, count: np.ndarray, last: np.ndarray) -> Shard:
        rows = np.stack([place, fingerprint, count, last], axis=1).astype(np.int64).reshape(-1, 4)
        first = np.unique(rows[:, 0], return_index=True)[1]
        more = np.delete(rows, first, axis=0)
        rows = rows[first]
        h = PerfectHash.build(rows[:, 0])
        rows = rows[np.argsort(h.index(rows[:, 0]))]
        return cls(h, *(rows[:, i].copy() for i in (1, 2, 3)), more)

    def find(self, place: np.ndarray, fingerprint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0: unknown) and last holder of each probe."""
        if not len(self.count):
            return np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        at = self.hash.index(place)
        known = (at >= 0) & (self.fingerprint[at] == fingerprint)
        count, last = np.where(known, self.count[at], 0), self.last[at]
        for p, f, n, who in self.more.tolist():
            same = (place == p) & (fingerprint == f)
            count[same], last[same] = n, who
        return count, last

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, bits=self.hash.bits, sizes=self.hash.sizes, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        x = np.load(io.BytesIO(data))
        return cls(PerfectHash(x["bits"], x["sizes"]), *(x[f] for f in cls.FIELDS))
