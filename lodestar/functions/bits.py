"""Bit packing, variable-length integers, space-filling curves, counter-based random streams and GUIDs."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.mixers import GOLDEN64, add64, let, mul64, signed, splitmix


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n.cast("long") - 1))).cast("long"))


def count_digits(n: Column) -> Column:
    return F.length(F.abs(n.cast("decimal(20,0)")).cast("string"))


def align_up(n: Column, to: int) -> Column:
    return (n + (to - 1)).bitwiseAND(-to)


def align_down(n: Column, to: int) -> Column:
    return n.bitwiseAND(-to)


def zigzag(n: Column) -> Column:
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-n.bitwiseAND(1))


def varint_length(n: Column) -> Column:
    """Bytes of an unsigned LEB128 number."""
    return F.when(n == 0, 1).otherwise(F.ceil(F.length(F.bin(n)) / 7)).cast("int")


def varint_hex(n: Column) -> Column:
    """The LEB128 bytes in hexadecimal."""
    parts = []
    for k in range(10):
        rest = F.shiftrightunsigned(n, 7 * k) if 7 * k < 64 else F.lit(0).cast("long")
        more = F.shiftrightunsigned(n, 7 * (k + 1)) if 7 * (k + 1) < 64 else F.lit(0).cast("long")
        value = rest.bitwiseAND(127) + F.when(more != 0, 128).otherwise(0)
        parts.append(F.when((rest != 0) | F.lit(k == 0), F.lpad(F.hex(value), 2, "0")).otherwise(""))
    return F.concat(*parts)


#: Fixed values: (shift, mask) steps that spread 32 bits to every second, and 21 bits to every third place.
SPREAD2 = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]
SPREAD3 = [(32, 0x001F00000000FFFF), (16, 0x001F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)]


def _step(x: Column, shift: int, mask: int, shifted) -> Column:
    return let(x, lambda v: v.bitwiseOR(shifted(v, shift)).bitwiseAND(F.lit(signed(mask))))


def _spread(x: Column, steps) -> Column:
    for shift, mask in steps:
        x = _step(x, shift, mask, F.shiftleft)
    return x


def _gather(x: Column, steps, last: int) -> Column:
    masks = [m for _, m in steps]
    x = x.bitwiseAND(F.lit(signed(masks[-1])))
    for (shift, _), mask in zip(reversed(steps), [*reversed(masks[:-1]), last], strict=True):
        x = _step(x, shift, mask, F.shiftrightunsigned)
    return x


def _words(x: Column, bits: int, n: int) -> list[Column]:
    """The first n words of so many bits, lowest first."""
    return [F.shiftrightunsigned(x.cast("long"), bits * k).bitwiseAND((1 << bits) - 1) for k in range(n)]


def _joined(words: list[Column], bits: int) -> Column:
    return functools.reduce(Column.bitwiseOR, [F.shiftleft(w, bits * k) for k, w in enumerate(words)])


def morton2(x: Column, y: Column) -> Column:
    """Of the low 32 bits of both."""
    a, b = (_spread(_words(v, 32, 1)[0], SPREAD2) for v in (x, y))
    return a.bitwiseOR(F.shiftleft(b, 1))


def unmorton2(c: Column) -> tuple[Column, Column]:
    return _gather(c, SPREAD2, 0xFFFFFFFF), _gather(F.shiftrightunsigned(c, 1), SPREAD2, 0xFFFFFFFF)


def morton3(x: Column, y: Column, z: Column) -> Column:
    """Of the low 21 bits of each."""
    a, b, c = (_spread(v.cast("long"), SPREAD3) for v in (x, y, z))
    return a.bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(F.shiftleft(c, 2))


def unmorton3(c: Column) -> tuple[Column, Column, Column]:
    return tuple(_gather(F.shiftrightunsigned(c, k), SPREAD3, 0x1FFFFF) for k in range(3))


#: Bits of each axis that a word of the code holds, and words that hold 64 bits of it.
WORDS = {2: (32, 2), 3: (21, 4)}


def morton_words(*axes: Column) -> list[Column]:
    """The code of two or three axes' whole 64 bits, lowest word first."""
    width, n = WORDS[len(axes)]
    code = {2: morton2, 3: morton3}[len(axes)]
    return [code(*word) for word in zip(*(_words(x, width, n) for x in axes), strict=True)]


def unmorton_words(words: list[Column], axes: int) -> list[Column]:
    decode = {2: unmorton2, 3: unmorton3}[axes]
    return [_joined(list(w), WORDS[axes][0]) for w in zip(*map(decode, words), strict=True)]


def hilbert(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Skilling's transform of coordinates (first axis most significant), interleaved to one index."""
    x = [a.astype(np.uint64).copy() for a in axes]
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        p = q - np.uint64(1)
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        carry ^= np.where((x[-1] & q) != 0, q - np.uint64(1), np.uint64(0))
    out = np.zeros_like(x[0])
    for i in range(len(x)):
        x[i] ^= carry
        for b in range(bits):
            out |= ((x[i] >> np.uint64(b)) & np.uint64(1)) << np.uint64(b * len(x) + len(x) - 1 - i)
    return out


def hilbert_index(bits: int, *axes: Column) -> Column:
    @F.pandas_udf("long")
    def index(*s: pd.Series) -> pd.Series:
        return pd.Series(hilbert([v.to_numpy() for v in s], bits).view(np.int64))

    return index(*axes)


def unhilbert(index: np.ndarray, bits: int, axes: int) -> list[np.ndarray]:
    """The coordinates whose hilbert() is the index: the interleaving, the Gray code and the turns undone, in reverse order."""
    h = index.astype(np.uint64)
    x = [np.zeros_like(h) for _ in range(axes)]
    for i in range(axes):
        for b in range(bits):
            x[i] |= ((h >> np.uint64(b * axes + axes - 1 - i)) & np.uint64(1)) << np.uint64(b)
    last = x[-1] >> np.uint64(1)
    for i in range(axes - 1, 0, -1):
        x[i] ^= x[i - 1]
    x[0] ^= last
    for level in range(1, bits):
        q = np.uint64(1 << level)
        p = q - np.uint64(1)
        for i in range(axes - 1, -1, -1):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    return x


def hilbert_point(bits: int, axes: int, index: Column) -> Column:
    """An array of the coordinates."""

    @F.pandas_udf("array<long>")
    def point(s: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack([a.view(np.int64) for a in unhilbert(s.to_numpy(np.int64).view(np.uint64), bits, axes)], axis=1)))

    return point(index)


def splitmix_at(seed: int, n: Column) -> Column:
    """The n-th (from 0) output of splitmix64: a function of the counter alone."""
    return splitmix(add64(F.lit(signed(seed)), mul64(n.cast("long") + 1, GOLDEN64)))


def unit_double(u: Column) -> Column:
    return F.shiftrightunsigned(u, 11) * 2.0**-53


def _hex(u: Column) -> Column:
    return F.lower(F.lpad(F.hex(u), 16, "0"))


def guid4(a: Column, b: Column) -> Column:
    """A version 4 GUID from two 64-bit numbers, big-endian."""
    hi = a.bitwiseAND(F.lit(signed(0xFFFFFFFFFFFF0FFF))).bitwiseOR(F.lit(0x4000))
    lo = b.bitwiseAND(F.lit(0x3FFFFFFFFFFFFFFF)).bitwiseOR(F.lit(signed(1 << 63)))
    return _dashed(F.concat(_hex(hi), _hex(lo)))


def guid7(millis: Column, a: Column, b: Column) -> Column:
    """A version 7 GUID of a time in milliseconds and two random numbers."""
    hi = F.shiftleft(millis.cast("long"), 16).bitwiseOR(F.lit(0x7000)).bitwiseOR(a.bitwiseAND(0xFFF))
    lo = b.bitwiseAND(F.lit(0x3FFFFFFFFFFFFFFF)).bitwiseOR(F.lit(signed(1 << 63)))
    return _dashed(F.concat(_hex(hi), _hex(lo)))


def _dashed(h: Column) -> Column:
    return F.concat_ws("-", *(F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
