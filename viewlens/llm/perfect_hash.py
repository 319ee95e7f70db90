"""Minimal perfect hashes of term sets, in shards small enough to build in one step.

A shard's terms fall into buckets by their XXH64; each bucket, the largest first, gets the first
displacement that moves all its terms to free slots, and a bucket of one term gets a free slot
directly. So m terms have the slots 0 to m - 1. Any other term gets some slot too, so the terms are
stored in slot order and a find counts only where they agree. Terms of one shard with equal hashes,
which no displacement parts, are listed beside it.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import xxhash

#: Spark's own seed of ``xxhash64``.
SEED = 42
#: Terms of a bucket on average, and displacements tried at once.
PER_BUCKET, TRIES = 4, 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def hashes(terms: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(t, SEED) for t in terms), np.uint64, len(terms))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """As ``shiftrightunsigned(xxhash64(term), 40) % shards``."""
    return ((h >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def _slots(h: np.ndarray, displacement: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    mixed = (h ^ (displacement.astype(np.uint64) * _ODD)) * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(32)
    return (mixed % np.asarray(size, np.uint64)).astype(np.int64)


def buckets(size: int) -> int:
    return max(1, -(-size // PER_BUCKET))


def build(terms: list[bytes]) -> tuple[list[int], list[int], list[int]]:
    """Displacements by bucket (a slot s that is given directly as -s - 1), the terms' numbers in
    slot order, and the slots of terms that are to be listed."""
    m = len(terms)
    h = hashes(terms)
    listed = np.ones(m, bool)
    listed[np.unique(h, return_index=True)[1]] = False
    n = buckets(m)
    of = (h % np.uint64(n)).astype(np.int64)
    members = defaultdict(list)
    for i in np.flatnonzero(~listed):
        members[int(of[i])].append(i)
    taken = np.full(m, -1, np.int64)
    displacements = [0] * n
    by_size = sorted(members.items(), key=lambda b: (-len(b[1]), b[0]))
    singles = [b for b in by_size if len(b[1]) == 1]
    for bucket, rows in by_size[: len(by_size) - len(singles)]:
        first = 0
        while True:
            tried = np.arange(first, first + TRIES)
            slots = _slots(h[rows][None, :], tried[:, None], m)
            ordered = np.sort(slots, axis=1)
            fits = (taken[slots] < 0).all(axis=1) & (np.diff(ordered, axis=1) > 0).all(axis=1)
            if fits.any():
                k = int(fits.argmax())
                displacements[bucket] = int(tried[k])
                taken[slots[k]] = rows
                break
            first += TRIES
    free = iter(np.flatnonzero(taken < 0).tolist())
    for bucket, (row,) in singles:
        slot = next(free)
        taken[slot] = row
        displacements[bucket] = -slot - 1
    apart = []
    for row in np.flatnonzero(listed):
        slot = next(free)
        taken[slot] = row
        apart.append(slot)
    return displacements, taken.tolist(), apart


class Shards:
    """The shards of one language that are at hand, and where their terms' slots begin."""

    def __init__(self, shards: int, rows: list[tuple[int, list[int], list[bytes], list[int]]]):
        """``rows``: shard, displacements, terms in slot order, listed slots."""
        self.shards = shards
        self.size = np.zeros(shards, np.int64)
        self.first = np.zeros(shards, np.int64)
        self.bucket = np.zeros(shards, np.int64)
        self.listed: dict[bytes, int] = {}
        displacements: list[int] = []
        terms: list[bytes] = []
        for shard, moved, stored, apart in sorted(rows, key=lambda r: r[0]):
            self.size[shard], self.first[shard], self.bucket[shard] = len(stored), len(terms), len(displacements)
            self.listed.update((stored[s], len(terms) + s) for s in apart)
            displacements += moved
            terms += stored
        self.displacements = np.array(displacements, np.int64)
        self.terms = np.array(terms, object)

    def find(self, terms: list[bytes]) -> np.ndarray:
        """For each term its place among all that are stored here, or -1."""
        out = np.full(len(terms), -1, np.int64)
        if not len(self.terms):
            return out
        h = hashes(terms)
        shard = shard_of(h, self.shards)
        size = self.size[shard]
        at = np.flatnonzero(size)
        h, shard, size = h[at], shard[at], size[at]
        bucket = (h % (-(-size // PER_BUCKET)).astype(np.uint64)).astype(np.int64)
        moved = self.displacements[self.bucket[shard] + bucket]
        slot = np.where(moved < 0, -moved - 1, _slots(h, np.maximum(moved, 0), size))
        place = self.first[shard] + slot
        given = np.array(terms, object)[at]
        same = self.terms[place] == given
        out[at[same]] = place[same]
        if self.listed:
            for i in np.flatnonzero(out < 0):
                out[i] = self.listed.get(terms[i], -1)
        return out
