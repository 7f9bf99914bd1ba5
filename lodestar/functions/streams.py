"""Seeded random streams: counter-based ones as functions of the position, sequential ones started at any position.

A stream's n-th value is computed from a state that is jumped to, not stepped to, so positions can be dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1

#: Increments and multipliers of the published generators.
WY_ADD, WY_XOR = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
PCG_MULTIPLIER, PCG_SEQUENCE = 6364136223846793005, 0xDA3E39CB94B95BDB
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

STEP = 1 << 16  # positions that one state is jumped to for


def rotated(x: int, n: int) -> int:
    return ((x << n) | (x >> (64 - n))) & M64


def splitmix(seed: int, n: int) -> list[int]:
    """The first n values of splitmix64."""
    out = []
    for k in range(1, n + 1):
        z = (seed + k * GOLDEN) & M64
        z = ((z ^ (z >> 30)) * MIX_A) & M64
        z = ((z ^ (z >> 27)) * MIX_B) & M64
        out.append(z ^ (z >> 31))
    return out


class WyRand:
    """Value k is the folded product of seed + (k + 1) * WY_ADD with itself, masked."""

    def __init__(self, seed: int, at: int = 0):
        self.state = (seed + at * WY_ADD) & M64

    def next(self) -> int:
        self.state = (self.state + WY_ADD) & M64
        product = self.state * (self.state ^ WY_XOR)
        return (product >> 64) ^ (product & M64)


class Pcg32:
    """A linear congruential state of 64 bits, xor-shifted and rotated to 32; a 64-bit value is two, the high half first."""

    def __init__(self, seed: int, sequence: int = PCG_SEQUENCE, at: int = 0):
        self.increment = ((sequence << 1) | 1) & M64
        self.state = 0
        self._jump(1)
        self.state = (self.state + seed) & M64
        self._jump(1 + 2 * at)

    def _jump(self, n: int) -> None:
        """n steps at once, by squaring the affine step."""
        a, c, mul, add = PCG_MULTIPLIER, self.increment, 1, 0
        while n:
            if n & 1:
                mul, add = mul * a & M64, (add * a + c) & M64
            c, a, n = (a + 1) * c & M64, a * a & M64, n >> 1
        self.state = (self.state * mul + add) & M64

    def next32(self) -> int:
        old = self.state
        self.state = (old * PCG_MULTIPLIER + self.increment) & M64
        x, n = (((old >> 18) ^ old) >> 27) & 0xFFFFFFFF, old >> 59
        return ((x >> n) | (x << (32 - n))) & 0xFFFFFFFF

    def next(self) -> int:
        high = self.next32()
        return high << 32 | self.next32()


class _Linear:
    """Generators whose step is linear over bits: a jump of n steps is a power of its matrix, built from the step itself."""

    words = 0

    def __init__(self, seed: int, at: int = 0):
        self.s = splitmix(seed, self.words)
        if at:
            self.s = self._jumped(at)

    def _pack(self, s: list[int]) -> int:
        return sum(w << 64 * k for k, w in enumerate(s))

    def _unpack(self, x: int) -> list[int]:
        return [(x >> 64 * k) & M64 for k in range(self.words)]

    def _jumped(self, n: int) -> list[int]:
        size = 64 * self.words
        columns = []
        for bit in range(size):  # where the step takes each single bit
            one = object.__new__(type(self))
            one.s = self._unpack(1 << bit)
            one.next()
            columns.append(self._pack(one.s))

        def apply(matrix, x):
            out = 0
            while x:
                low = x & -x
                out ^= matrix[low.bit_length() - 1]
                x ^= low
            return out

        state = self._pack(self.s)
        while n:
            if n & 1:
                state = apply(columns, state)
            columns, n = [apply(columns, c) for c in columns], n >> 1
        return self._unpack(state)


class Xoshiro256(_Linear):
    """xoshiro256**, its four words from splitmix64 of the seed."""

    words = 4

    def next(self) -> int:
        a, b, c, d = self.s
        out = rotated(b * 5 & M64, 7) * 9 & M64
        c, d, t = c ^ a, d ^ b, b << 17 & M64
        self.s = [a ^ d, b ^ c, c ^ t, rotated(d, 45)]
        return out


class Xoroshiro128(_Linear):
    """xoroshiro128+ with rotations 24, 16, 37, its two words from splitmix64 of the seed."""

    words = 2

    def next(self) -> int:
        a, b = self.s
        out, b = (a + b) & M64, a ^ b
        self.s = [rotated(a, 24) ^ b ^ (b << 16 & M64), rotated(b, 37)]
        return out


SOURCES: dict[str, Callable] = {"wyrand": WyRand, "pcg32": Pcg32, "xoshiro256": Xoshiro256, "xoroshiro128": Xoroshiro128}


def signed(u: int) -> int:
    return u - (1 << 64) if u >> 63 else u


def stream(spark: SparkSession, source: str, seed: int, n: int) -> DataFrame:
    """(n, u): the first n values as bit patterns. Positions are dealt in steps, each started by a jump, over as many tasks."""

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in batch["id"].tolist():
                of, many = SOURCES[source](seed, at=first * STEP), min(STEP, n - first * STEP)
                yield pd.DataFrame({"n": np.arange(first * STEP, first * STEP + many), "u": [signed(of.next()) for _ in range(many)]})

    return spark.range(-(-n // STEP)).mapInPandas(values, "n long, u long")


def high32(source) -> int:
    return source.next() >> 32


def bounded(source, range_: int) -> int:
    """Unbiased in [0, range_): the high half of a 32-bit draw's product, redrawn while the low half is in the biased part."""
    if not 0 < range_ < 1 << 32:
        raise ValueError("the range must be positive and below 2**32")
    product = high32(source) * range_
    if (product & 0xFFFFFFFF) < range_:
        least = (1 << 32) % range_
        while (product & 0xFFFFFFFF) < least:
            product = high32(source) * range_
    return product >> 32


def unit(column):
    """[0, 1) from the high 53 bits of a bit pattern."""
    return F.shiftrightunsigned(column, 11) * 2.0**-53
