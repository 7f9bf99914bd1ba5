"""Integer mixers as column expressions: unsigned arithmetic modulo 2**32 and 2**64 on bigint bit patterns, safe under ANSI."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

M32 = 0xFFFFFFFF

#: Multipliers and increments of the published mixers.
GOLDEN64, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FMIX64_A, FMIX64_B = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
FMIX32_A, FMIX32_B = 0x85EBCA6B, 0xC2B2AE35
GOLDEN32, LOW32_A, LOW32_B = 0x9E3779B9, 0x7FEB352D, 0x846CA68B


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, whatever number of times the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signed(u: int) -> int:
    return u - (1 << 64) if u >= 1 << 63 else u


def xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def mul64(a: Column, constant: int) -> Column:
    """a * constant modulo 2**64 by 16-bit limbs of the constant: no partial product reaches 2**49."""
    c = [(constant >> 16 * k) & 0xFFFF for k in range(4)]

    def product(v: Column) -> Column:
        lo, hi = v.bitwiseAND(M32), F.shiftrightunsigned(v, 32)
        low = (lo * c[0]).bitwiseAND(M32) + F.shiftleft((lo * c[1]).bitwiseAND(0xFFFF), 16)
        high = F.shiftright(lo * c[0], 32) + F.shiftright(lo * c[1], 16) + F.shiftright(low, 32)
        high = high + (lo * c[2]).bitwiseAND(M32) + F.shiftleft((lo * c[3]).bitwiseAND(0xFFFF), 16) + (hi * c[0]).bitwiseAND(M32) + F.shiftleft((hi * c[1]).bitwiseAND(0xFFFF), 16)
        return F.shiftleft(high.bitwiseAND(M32), 32).bitwiseOR(low.bitwiseAND(M32))

    return let(a.cast("long"), product)


def add64(a: Column, b: Column) -> Column:
    """a + b modulo 2**64."""
    def total(v: Column) -> Column:
        low = v["a"].bitwiseAND(M32) + v["b"].bitwiseAND(M32)
        high = F.shiftrightunsigned(v["a"], 32) + F.shiftrightunsigned(v["b"], 32) + F.shiftright(low, 32)
        return F.shiftleft(high.bitwiseAND(M32), 32).bitwiseOR(low.bitwiseAND(M32))

    return let(F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), total)


def _xorshift(x: Column, n: int) -> Column:
    return let(x, lambda v: xor(v, F.shiftrightunsigned(v, n)))


def splitmix(z: Column) -> Column:
    """The finaliser of splitmix64, without its increment."""
    return _xorshift(mul64(_xorshift(mul64(_xorshift(z.cast("long"), 30), MIX_A), 27), MIX_B), 31)


def mix64(x: Column) -> Column:
    return splitmix(add64(x, F.lit(signed(GOLDEN64))))


def fmix64(x: Column) -> Column:
    return _xorshift(mul64(_xorshift(mul64(_xorshift(x.cast("long"), 33), FMIX64_A), 33), FMIX64_B), 33)


def low32(x: Column) -> Column:
    return x.bitwiseAND(M32)


def int32(u: Column) -> Column:
    """An unsigned 32-bit value as a signed int."""
    return let(u, lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)).cast("int")


def mul32(a: Column, constant: int) -> Column:
    return let(a, lambda v: low32(F.shiftleft(low32(v * (constant >> 16)).bitwiseAND(0xFFFF), 16) + v * (constant & 0xFFFF)))


def fmix32(x: Column) -> Column:
    return _xorshift(mul32(_xorshift(mul32(_xorshift(low32(x.cast("long")), 16), FMIX32_A), 13), FMIX32_B), 16)


def wang32(x: Column) -> Column:
    def step(v: Column, n: int) -> Column:
        return low32(v + F.shiftleft(v, n))

    u = let(low32(x.cast("long")), lambda v: low32(xor(v, F.lit(M32)) + F.shiftleft(v, 15)))
    u = let(_xorshift(u, 12), lambda v: step(v, 2))
    u = let(_xorshift(u, 4), lambda v: low32(low32(v + F.shiftleft(v, 3)) + F.shiftleft(v, 11)))
    return _xorshift(u, 16)


def wang64(x: Column) -> Column:
    u = let(x.cast("long"), lambda v: add64(F.bitwise_not(v), F.shiftleft(v, 21)))
    u = let(_xorshift(u, 24), lambda v: add64(add64(v, F.shiftleft(v, 3)), F.shiftleft(v, 8)))
    u = let(_xorshift(u, 14), lambda v: add64(add64(v, F.shiftleft(v, 2)), F.shiftleft(v, 4)))
    return let(_xorshift(u, 28), lambda v: add64(v, F.shiftleft(v, 31)))


def naive32(x: Column, unsigned: bool = False) -> Column:
    """x ^ (x >> 16): arithmetic shift for int, logical for unsigned."""
    return xor(low32(x.cast("long")), F.shiftright(low32(x.cast("long")), 16)) if unsigned else xor(x.cast("int"), F.shiftright(x.cast("int"), 16))


def naive64(x: Column) -> Column:
    v = x.cast("long")
    return int32(low32(xor(xor(v, F.shiftrightunsigned(v, 32)), F.shiftrightunsigned(v, 16))))


def avalanche32(h: Column) -> Column:
    """The 32-bit finaliser that routing uses."""
    return _xorshift(mul32(_xorshift(mul32(_xorshift(low32(h.cast("long")), 16), LOW32_A), 15), LOW32_B), 16)


def unsigned_key(x: Column) -> Column:
    """Orders bit patterns as unsigned numbers."""
    return xor(x, F.lit(signed(1 << 63)))
