"""Sketches as relational cell tables: merge is a union and one aggregation, so partial aggregation does the work of lanes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.mixers import let, low32


def leading_zeros(x: Column) -> Column:
    """Of a 64-bit pattern; 64 for zero."""
    return let(x, lambda v: F.when(v == 0, 64).otherwise(64 - F.length(F.bin(v))).cast("long"))


def hll_registers(hashes: DataFrame, hash64: str, precision: int) -> DataFrame:
    """(register, rank): the top bits choose a register, which keeps the largest rank of the rest."""
    h = F.col(hash64)
    rest = F.shiftleft(h, precision).bitwiseOR(F.lit(1 << (precision - 1)))
    return hashes.select(F.shiftrightunsigned(h, 64 - precision).alias("register"), (leading_zeros(rest) + 1).alias("rank")).groupBy("register").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, precision: int) -> DataFrame:
    """One row: estimate. Linear counting while few registers are filled."""
    m = 1 << precision
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    sums = registers.agg(F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("s"), F.count(F.lit(1)).alias("n"))
    raw = F.lit(alpha * m * m) / (F.col("s") + m - F.col("n"))
    zeros = F.lit(float(m)) - F.col("n")
    return sums.select(F.when((raw <= 2.5 * m) & (zeros > 0), F.bround(m * F.log(F.lit(float(m)) / zeros))).otherwise(F.bround(raw)).cast("long").alias("estimate"))


def cms_shape(epsilon: float, delta: float) -> tuple[int, int]:
    """(width, depth): the next power of two from e / epsilon, and ln(1 / delta) rounded up."""
    return 1 << max(0, math.ceil(math.log2(min(math.ceil(math.e / epsilon), 1 << 30)))), max(1, math.ceil(math.log(1 / delta)))


def _column(h: Column, row: Column, width: int) -> Column:
    odd = F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return low32(low32(h) + row * odd).bitwiseAND(width - 1)


def cms_cells(hashes: DataFrame, hash64: str, epsilon: float, delta: float) -> DataFrame:
    """(row, cell, n) of a count-min sketch; counts of equal keys are summed first."""
    width, depth = cms_shape(epsilon, delta)
    counts = hashes.groupBy(hash64).agg(F.count(F.lit(1)).alias("n")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    return counts.groupBy("row", _column(F.col(hash64), F.col("row").cast("long"), width).alias("cell")).agg(F.sum("n").alias("n"))


def cms_estimate(cells: DataFrame, keys: DataFrame, hash64: str, epsilon: float, delta: float) -> DataFrame:
    """Each key with its estimate: the least of its cells, 0 if one is empty."""
    width, depth = cms_shape(epsilon, delta)
    asked = keys.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))).withColumn("cell", _column(F.col(hash64), F.col("row").cast("long"), width))
    return asked.join(cells, ["row", "cell"], "left").groupBy(*keys.columns).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def bloom_shape(n: int, p: float) -> tuple[int, int]:
    """(bits, hashes)."""
    m = max(64, 1 << max(0, math.ceil(math.log2(math.ceil(-n * math.log(p) / math.log(2) ** 2)))))
    return m, max(1, round(m / n * math.log(2)))


def bloom_positions(hash64: Column, m: int, k: int) -> Column:
    odd = F.shiftrightunsigned(hash64, 32).bitwiseOR(F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: low32(low32(hash64) + i.cast("long") * odd).bitwiseAND(m - 1))


def bloom_bits(hashes: DataFrame, hash64: str, m: int, k: int) -> DataFrame:
    """(bit): the set bits; a union of filters is a union of rows."""
    return hashes.select(F.explode(bloom_positions(F.col(hash64), m, k)).alias("bit")).distinct()


def bloom_probe(bits: DataFrame, keys: DataFrame, hash64: str, m: int, k: int) -> DataFrame:
    """Each key with `found`: whether all its bits are set."""
    asked = keys.withColumn("bit", F.explode(F.array_distinct(bloom_positions(F.col(hash64), m, k))))
    hit = asked.join(bits.withColumn("set", F.lit(1)), "bit", "left")
    return hit.groupBy(*keys.columns).agg((F.count("set") == F.count(F.lit(1))).alias("found"))


ACCURACY, MAX_BINS = 0.01, 2048


def dd_buckets(values: DataFrame, value: str, accuracy: float = ACCURACY, max_bins: int = MAX_BINS) -> DataFrame:
    """(sign, bucket, n) of a relative-error quantile sketch; beyond max_bins the lowest values of a sign fold into one.

    Those are the least magnitudes above zero, and the greatest below.
    """
    gamma = math.log((1 + accuracy) / (1 - accuracy))
    v = F.col(value)
    index = F.when(v == 0, 0).otherwise(F.ceil(F.round(F.log(F.abs(v)) / gamma, 9))).cast("long")
    cells = values.where(v.isNotNull()).groupBy(F.signum(v).cast("int").alias("sign"), index.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    ends = cells.groupBy("sign").agg(F.min("bucket").alias("low"), F.max("bucket").alias("top"))  # three rows at most
    kept = F.when(F.col("sign") < 0, F.least("bucket", F.col("low") + (max_bins - 1))).otherwise(F.greatest("bucket", F.col("top") - (max_bins - 1)))
    return cells.join(F.broadcast(ends), "sign").groupBy("sign", kept.alias("bucket")).agg(F.sum("n").alias("n"))


def dd_quantiles(buckets: DataFrame, quantiles: list[float], low: float, high: float, accuracy: float = ACCURACY) -> DataFrame:
    """(q, value): the value of the bucket in which rank floor(q * (n - 1)) falls, within [low, high]."""
    gamma = math.log((1 + accuracy) / (1 - accuracy))
    place = F.col("sign") * F.col("bucket")
    ordered = buckets.withColumn("cum", F.sum("n").over(W.orderBy("sign", place)))  # at most 2 * MAX_BINS + 1 rows
    total = buckets.agg(F.sum("n").alias("total"))
    asked = buckets.sparkSession.createDataFrame([(float(q),) for q in quantiles], "q double").crossJoin(F.broadcast(total)).withColumn("rank", F.floor(F.col("q") * (F.col("total") - 1)))
    hit = asked.join(F.broadcast(ordered), F.col("cum") > F.col("rank")).groupBy("q").agg(F.min_by(F.struct("sign", "bucket"), "cum").alias("b"))
    value = F.when(F.col("b.sign") == 0, 0.0).otherwise(F.col("b.sign") * F.exp(F.col("b.bucket") * gamma + math.log(1 - accuracy)))
    return hit.select("q", F.least(F.greatest(value, F.lit(low)), F.lit(high)).alias("value"))


def space_saving(counts: pd.Series, k: int) -> pd.DataFrame:
    """The k monitors after a stream of keys: key, n, error; a new key takes the least monitor, ties to the smallest key."""
    n: dict = {}
    error: dict = {}
    for x in counts:
        if x in n:
            n[x] += 1
        elif len(n) < k:
            n[x], error[x] = 1, 0
        else:
            least = min(n, key=lambda m: (n[m], m))
            taken = n.pop(least)
            error.pop(least)
            n[x], error[x] = taken + 1, taken
    return pd.DataFrame({"key": list(n), "n": list(n.values()), "error": [error[x] for x in n]})
