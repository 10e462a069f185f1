"""Words of many texts at once, as positions and hashes, by numpy over bytes."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A 64-bit number for each byte.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Powers of the base and of its inverse, as far as they have been needed; _STEP bytes at a time share them.
_STEP = 1 << 16
_POWERS, _BACK = (np.multiply.accumulate(np.array([1] + [x] * _STEP, np.uint64)) for x in (_BASE, _INVERSE))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit hashes over all bits; 0 is left out, for free places of tables."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return np.maximum(h ^ (h >> np.uint64(32)), np.uint64(1))


class Words:
    """The words of texts that are joined with separators in ``data``: maximal runs of bytes not in ``gaps``.

    starts, ends: byte positions of the words. hash(a, b): a hash of the bytes from starts[a] to ends[b - 1], the same
    wherever these bytes stand. Sums of byte numbers times powers of the base make it, so any stretch costs the same.
    """

    def __init__(self, data: bytes, gaps: np.ndarray):
        raw = np.frombuffer(data, np.uint8)
        inside = np.concatenate(([False], ~gaps[raw], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.raw, self.starts, self.ends = raw, edge[::2], edge[1::2]
        self._sums = np.zeros(len(raw) + 1, np.uint64)
        upto, scale = np.uint64(0), 1
        for i in range(0, len(raw), _STEP):  # prefix sums; the power goes on from step to step
            part = raw[i : i + _STEP]
            with np.errstate(over="ignore"):
                s = np.cumsum(_BYTE[part] * (_POWERS[: len(part)] * np.uint64(scale)))
                self._sums[i + 1 : i + 1 + len(part)] = s + upto
                upto = self._sums[i + len(part)]
            scale = scale * pow(_BASE, len(part), 1 << 64) % (1 << 64)
        self._far = np.array([pow(_INVERSE, _STEP * k, 1 << 64) for k in range(len(raw) // _STEP + 1)], np.uint64)

    def __len__(self) -> int:
        return len(self.starts)

    def hash(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the stretches from word ``first`` to word ``last`` (included), by their bytes and lengths."""
        a, b = self.starts[first], self.ends[last]
        with np.errstate(over="ignore"):
            h = (self._sums[b] - self._sums[a]) * _BACK[a % _STEP] * self._far[a // _STEP]
            return mixed(h + (b - a).astype(np.uint64) * _MIX)

    def hashes(self) -> np.ndarray:
        at = np.arange(len(self))
        return self.hash(at, at)


class Table:
    """Values by 64-bit hash, in an open-addressed table that is half empty."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        """keys: different hashes, none of them 0."""
        size = 1 << max(4, int(len(keys) * 2).bit_length())
        self.keys, self.values = np.zeros(size, np.uint64), [np.zeros(size, v.dtype) for v in values]
        mask = np.uint64(size - 1)
        slot, left = keys & mask, np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == 0
            mine, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.keys[mine] = keys[put]
            for mine_values, v in zip(self.values, values, strict=True):
                mine_values[mine] = v[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + np.uint64(1)) & mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys in the values, -1 where a key is absent."""
        mask = np.uint64(len(self.keys) - 1)
        slot = keys & mask
        there = self.keys[slot]
        out = np.where(there == keys, slot.astype(np.int64), -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + np.uint64(1)) & mask
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = slot[left[hit]].astype(np.int64)
            left = left[~hit & (there != 0)]
        return out
