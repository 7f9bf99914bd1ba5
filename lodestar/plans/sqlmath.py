"""SQL texts of the unsigned mixers, for the oracles."""

from __future__ import annotations

from lodestar.functions import mixers as m

TWO64 = "18446744073709551616::UHUGEINT"


def mul_sql(x: str, c: int, bits: int = 64) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * {c}::UHUGEINT) % {1 << bits}::UHUGEINT AS UBIGINT)"


def add_sql(x: str, c: str, bits: int = 64) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) + CAST({c} AS UHUGEINT)) % {1 << bits}::UHUGEINT AS UBIGINT)"


def shift_sql(x: str, n: int) -> str:
    return f"xor({x}, ({x}) >> {n})"


def splitmix_sql(x: str) -> str:
    return shift_sql(mul_sql(shift_sql(mul_sql(shift_sql(x, 30), m.MIX_A), 27), m.MIX_B), 31)


def mix64_sql(x: str) -> str:
    return splitmix_sql(add_sql(x, f"{m.GOLDEN64}::UHUGEINT"))


def fmix64_sql(x: str) -> str:
    return shift_sql(mul_sql(shift_sql(mul_sql(shift_sql(x, 33), m.FMIX64_A), 33), m.FMIX64_B), 33)


def fmix32_sql(x: str) -> str:
    return shift_sql(mul_sql(shift_sql(mul_sql(shift_sql(f"CAST({x} AS UBIGINT)", 16), m.FMIX32_A, 32), 13), m.FMIX32_B, 32), 16)


def avalanche32_sql(x: str) -> str:
    return shift_sql(mul_sql(shift_sql(mul_sql(shift_sql(f"CAST({x} AS UBIGINT)", 16), m.LOW32_A, 32), 15), m.LOW32_B, 32), 16)


def signed_sql(x: str) -> str:
    """A UBIGINT's bit pattern as BIGINT."""
    return f"CAST(CASE WHEN {x} >= 9223372036854775808 THEN CAST({x} AS HUGEINT) - 18446744073709551616 ELSE CAST({x} AS HUGEINT) END AS BIGINT)"
