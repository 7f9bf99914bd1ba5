"""A uniform sample of k rows of a stream by skips: which positions enter depends on the stream's length, k and the seed alone.

So the positions are drawn first, k * (1 + ln(n / k)) of them, and the rows at the last one of each place are joined: no task
sees the stream in order, and nothing but the positions is ever in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.streams import Pcg32, bounded

CHUNK = 1 << 16


def sampled_positions(n: int, k: int, seed: int) -> list[int]:
    """The position, in the stream, of the row that each of the k places holds after n rows (fewer places if n < k)."""
    if k < 1:
        raise ValueError("the capacity must be positive")
    places = list(range(min(n, k)))
    if n <= k:
        return places
    source = Pcg32(seed)

    def unit() -> float:
        return ((source.next() >> 12) + 0.5) * 2.0**-52

    log_weight, at = math.log(unit()) / k, k - 1
    while True:
        # log(1 - exp(x)) without cancellation on either side
        rest = math.log(-math.expm1(log_weight)) if log_weight > -math.log(2) else math.log1p(-math.exp(log_weight))
        skip = math.log(unit()) / rest if rest else math.inf
        if skip >= n - at:
            return places
        at += 1 + math.floor(skip)
        if at >= n:
            return places
        places[bounded(source, k)] = at
        log_weight += math.log(unit()) / k


def positioned(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with their position in ascending order of a unique whole-number key. Counts of CHUNK-wide key ranges come first."""
    chunked = rows.withColumn("chunk_", F.floor(F.col(key) / CHUNK))
    counts = chunked.groupBy("chunk_").agg(F.count(F.lit(1)).alias("n_")).withColumn("far_", F.floor(F.col("chunk_") / CHUNK))
    # two levels: within ranges of ranges side by side, and over their totals
    totals = counts.groupBy("far_").agg(F.sum("n_").alias("m_"))
    over = F.coalesce(F.sum("m_").over(W.orderBy("far_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum("n_").over(W.partitionBy("far_").orderBy("chunk_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("in_", inner).join(totals.select("far_", over.alias("over_")), "far_").select("chunk_", (F.col("in_") + F.col("over_")).alias("start_"))
    place = F.row_number().over(W.partitionBy("chunk_").orderBy(key)) - 1
    return chunked.withColumn("k_", place).join(starts, "chunk_").withColumn(name, F.col("start_") + F.col("k_")).drop("chunk_", "k_", "start_")


def reservoir(rows: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """`place` and the row that it holds, over the rows in ascending order of a unique whole-number key."""
    spark = rows.sparkSession
    places = sampled_positions(rows.count(), k, seed)
    chosen = spark.createDataFrame(list(enumerate(places)), "place int, position_ long")
    return positioned(rows, key, "position_").join(F.broadcast(chosen), "position_").drop("position_")  # k rows
