"""Approximate membership with placement: cuckoo and xor filters, in shards of bounded size.

A key's shard is a range of its hash, so shards grow in number with the keys, not in size; each is built in one task and
probed by its own keys, side by side.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.streams import M64, WyRand, bounded

SHARD = 1 << 16  # keys of a shard, about

#: The finaliser of splitmix64.
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def remixed(h: np.ndarray, salt: int) -> np.ndarray:
    x = h.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & M64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


class Cuckoo:
    """Buckets of four fingerprints; a fingerprint has two buckets, each the other's xor with its hash. Deletable.

    An insertion that ends its kicks without room leaves the last fingerprint in the victim's place; then the filter is full.
    """

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int, bits: int = 12, seed: int = 0):
        self.size = 1 << max(0, (-(-int(capacity / 0.95) // self.SLOTS) - 1).bit_length())
        self.bits, self.count, self.victim, self.random = bits, 0, None, WyRand(seed)
        self.table = np.zeros((self.size, self.SLOTS), np.uint32)

    def entry(self, h: int) -> tuple[int, int]:
        return (h >> (64 - self.bits)) or 1, int(h & (self.size - 1))

    def other(self, bucket: int, mark: int) -> int:
        return (bucket ^ int(remixed(np.array([mark], np.uint64), 1)[0])) & (self.size - 1)

    @property
    def full(self) -> bool:
        return self.victim is not None

    @property
    def load(self) -> float:
        return self.count / (self.size * self.SLOTS)

    def _put(self, bucket: int, mark: int) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free):
            self.table[bucket, free[0]] = mark
        return len(free) > 0

    def _place(self, bucket: int, mark: int) -> None:
        if self._put(bucket, mark) or self._put(self.other(bucket, mark), mark):
            return
        for _ in range(self.KICKS):
            slot = bounded(self.random, self.SLOTS)
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = self.other(bucket, mark)
            if self._put(bucket, mark):
                return
        self.victim = (bucket, mark)

    def add(self, h: int) -> bool:
        if self.full:
            return False
        mark, bucket = self.entry(h)
        self._place(bucket, mark)
        self.count += 1
        return True

    def _held(self, mark: int, bucket: int) -> bool:
        return self.victim is not None and self.victim[1] == mark and self.victim[0] in (bucket, self.other(bucket, mark))

    def contains(self, h: int) -> bool:
        mark, bucket = self.entry(h)
        return bool((self.table[bucket] == mark).any() or (self.table[self.other(bucket, mark)] == mark).any()) or self._held(mark, bucket)

    def remove(self, h: int) -> bool:
        mark, bucket = self.entry(h)
        for b in (bucket, self.other(bucket, mark)):
            at = np.flatnonzero(self.table[b] == mark)
            if len(at):
                self.table[b, at[0]] = 0
                self.count -= 1
                if self.victim is not None:
                    (where, left), self.victim = self.victim, None
                    self._place(where, left)
                return True
        if self._held(mark, bucket):
            self.victim = None
            self.count -= 1
            return True
        return False

    def union(self, other: Cuckoo) -> bool:
        """Take in all fingerprints of a filter of the same shape; False, and nothing changed, if they don't fit."""
        if (self.size, self.bits) != (other.size, other.bits):
            raise ValueError("filters of one shape only")
        before = self.table.copy(), self.count, self.victim
        marks = [(int(b), int(m)) for b, row in enumerate(other.table) for m in row if m] + ([other.victim] if other.full else [])
        for bucket, mark in marks:
            if self.full:
                self.table, self.count, self.victim = before
                return False
            self._place(bucket, mark)
            self.count += 1
        return True


class Xor:
    """Three cells a key, of eight bits each, whose xor is the key's fingerprint; built once by peeling. No false negatives."""

    def __init__(self, hashes: np.ndarray):
        keys = np.unique(hashes.astype(np.uint64))
        self.block = max(4, int(len(keys) * 1.23 / 3) + 11)
        for self.salt in range(1, 1000):
            order = self._peeled(keys)
            if order is not None:
                break
        else:
            raise ValueError("no salt peels these keys")
        self.cells = np.zeros(3 * self.block, np.uint8)
        places, marks = self._places(keys), self._marks(keys)
        for key, cell in reversed(order):
            a, b, c = places[key]
            self.cells[cell] ^= marks[key] ^ self.cells[a] ^ self.cells[b] ^ self.cells[c]

    def _places(self, h: np.ndarray) -> np.ndarray:
        return np.stack([(remixed(h, 3 * self.salt + k) % np.uint64(self.block)).astype(np.int64) + k * self.block for k in range(3)], axis=1)

    def _marks(self, h: np.ndarray) -> np.ndarray:
        return (remixed(h, 7777 + self.salt) >> np.uint64(56)).astype(np.uint8)

    def _peeled(self, keys: np.ndarray) -> list[tuple[int, int]] | None:
        """(key, its own cell) in the order in which cells of one key alone come free; None if some never do."""
        places = self._places(keys)
        n, held = np.bincount(places.ravel(), minlength=3 * self.block), np.zeros(3 * self.block, np.int64)
        for k in range(3):
            np.bitwise_xor.at(held, places[:, k], np.arange(len(keys)))
        alone, order = deque(np.flatnonzero(n == 1).tolist()), []
        while alone:
            cell = alone.popleft()
            if n[cell] != 1:
                continue
            key = int(held[cell])
            order.append((key, cell))
            for other in places[key].tolist():
                n[other] -= 1
                held[other] ^= key
                if n[other] == 1:
                    alone.append(other)
        return order if len(order) == len(keys) else None

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, bool)
        a, b, c = self._places(hashes.astype(np.uint64)).T
        return (self.cells[a] ^ self.cells[b] ^ self.cells[c]) == self._marks(hashes.astype(np.uint64))


def _shards(df: DataFrame, hash64: str, shards: int) -> DataFrame:
    return df.withColumn("shard_", F.pmod(F.xxhash64(hash64), F.lit(shards)))


def _probed(inserted: DataFrame, keys: DataFrame, hash64: str, answers) -> DataFrame:
    """keys with `found`, by answers(inserted hashes, asked hashes) of each shard. Equal keys are inserted once; null ones are in neither."""
    shards = max(1, -(-inserted.count() // SHARD))
    names, types = keys.columns, keys.schema

    def probed(have: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = answers(have[hash64].to_numpy(np.int64).view(np.uint64), asked[hash64].to_numpy(np.int64).view(np.uint64))
        return asked[names].assign(found=found)

    built = _shards(inserted.select(hash64).where(F.col(hash64).isNotNull()).distinct(), hash64, shards)
    asked = _shards(keys.where(F.col(hash64).isNotNull()), hash64, shards)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types) + ", found boolean"
    return built.groupBy("shard_").cogroup(asked.groupBy("shard_")).applyInPandas(probed, schema)


def xor_probe(inserted: DataFrame, keys: DataFrame, hash64: str) -> DataFrame:
    """keys with `found`: true for all inserted ones, and for about 1 in 256 others."""
    return _probed(inserted, keys, hash64, lambda have, asked: Xor(have).contains(asked))


def cuckoo_probe(inserted: DataFrame, removed: DataFrame, keys: DataFrame, hash64: str) -> DataFrame:
    """keys with `found` after inserting and then removing; a removed key may stay found through an equal fingerprint."""
    gone = removed.select(F.col(hash64).alias("gone_")).where("gone_ is not null").distinct()
    marked = inserted.select(hash64).where(F.col(hash64).isNotNull()).distinct().join(gone, F.col(hash64) == F.col("gone_"), "left").select(hash64, F.col("gone_").isNotNull().alias("removed_"))
    shards = max(1, -(-inserted.count() // SHARD))
    names, types = keys.columns, keys.schema

    def probed(have: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        have = have.sort_values(hash64)
        hashes = have[hash64].to_numpy(np.int64).view(np.uint64).tolist()
        one = Cuckoo(max(1, len(hashes)))
        while not all([one.add(h) for h in hashes]):
            one = Cuckoo(2 * one.size * Cuckoo.SLOTS)  # a full filter is built again at twice the size
        for h, out in zip(hashes, have["removed_"], strict=True):
            if out:
                one.remove(h)
        return asked[names].assign(found=[one.contains(h) for h in asked[hash64].to_numpy(np.int64).view(np.uint64).tolist()])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types) + ", found boolean"
    return _shards(marked, hash64, shards).groupBy("shard_").cogroup(_shards(keys.where(F.col(hash64).isNotNull()), hash64, shards).groupBy("shard_")).applyInPandas(probed, schema)
