"""Best-fit packing of tokenised documents into sequences of bounded length.

Packing depends on lengths alone, so it runs on the histogram of piece lengths: at most `capacity` counts, whatever
the corpus holds. Large-item matching first: pieces above a third of the capacity go at most two to a sequence, each
largest one with the largest other that fits. Smaller pieces, longest first, then go where they leave the least gap;
new sequences open only when no gap is left. Pieces find their places by their rank among pieces of equal length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, shuffle_partitions, spread
from lodestar.llm.tokens import byte_bpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequence patterns (piece lengths in order) and how many sequences have each.

    The number of patterns is bounded by the capacity, never by the number of pieces: every step uses up a
    length or a group of equal gaps. Lengths outside 1..capacity are an error.
    """
    left = {s: n for s, n in counts.items() if n}
    if left and not 1 <= min(left) <= max(left) <= capacity:
        raise ValueError("lengths must lie in 1..capacity")
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    open_gaps: list[int] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(pattern)
        if not gaps[gap] and gap:
            insort(open_gaps, gap)
        gaps[gap].append((pattern, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        fits = bisect_left(large, capacity - s + 1)  # pieces of up to capacity - s
        t = large[fits - 1] if fits else None
        if t == s and left[s] == 1:
            t = large[fits - 2] if fits > 1 else None
        n = left[s] if t is None else left[s] // 2 if t == s else min(left[s], left[t])
        put((s,) if t is None else (s, t), n)
        for x in (s,) if t is None else (s, t):
            left[x] -= n
        large = [x for x in large if left[x]]

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(open_gaps, s)
            if at == len(open_gaps):
                each = capacity // s
                if n // each:
                    put((s,) * each, n // each)
                if n % each:
                    put((s,) * (n % each), 1)
                break
            gap = open_gaps[at]
            pattern, bins = gaps[gap].pop()
            if not gaps[gap]:
                del open_gaps[at]
            each = min(gap // s, n)
            filled = min(bins, n // each)
            if bins > filled:
                put(pattern, bins - filled)
            put(pattern + (s,) * each, filled)
            n -= each * filled
    return [p for g in gaps.values() for p in g]


def placements(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Rank intervals by length: rank k in [lo, hi) goes to sequence base + k - lo, at the given offset."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for pattern, n in patterns:
        at = 0
        for s in pattern:
            rows.append((s, used[s], used[s] + n, base, at))
            used[s] += n
            at += s
        base += n
    return pd.DataFrame(rows, columns=["p_length", "lo", "hi", "base", "offset"]).astype("int64")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole, or full pieces after a first one that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenise_pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece: where it starts in its document's ids (end id included), its length and the crc32 of its ids."""

    def pieces(batches):
        bpe = byte_bpe(path)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = bpe.ids(text)
                ids.append(end_id)
                view = memoryview(ids.tobytes())
                for k, (at, n) in enumerate(cut(len(ids), capacity)):
                    out.append((doc_id, k, at, n, zlib.crc32(view[4 * at : 4 * (at + n)])))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Every piece with its sequence and its offset there.

    Null and empty texts are documents of the end id alone. Repeated rows and doc_ids are packed each for itself.
    An empty table gives no rows. Other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(tokenise_pieces(docs, tokenizer, end_id, capacity), "pieces")
    # ranks in two steps, so that a length that many pieces share is counted over many tasks
    salted = pieces.withColumn("salt", spread(4 * shuffle_partitions(spark), "doc_id", "piece"))
    counts = scratch.write(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    bases = counts.select(F.col("length").alias("b_length"), F.col("salt").alias("b_salt"), F.coalesce(before, F.lit(0)).alias("before"))
    order = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("k", F.row_number().over(order) - 1)
    ranked = ranked.join(bases, (F.col("length") == F.col("b_length")) & (F.col("salt") == F.col("b_salt")))
    ranked = ranked.withColumn("rank", F.col("k") + F.col("before")).drop("b_length", "b_salt")
    # bounded by the capacity, not by the corpus: a few intervals for each length
    table = spark.createDataFrame(placements(pack_histogram(histogram, capacity)), "p_length long, lo long, hi long, base long, offset long")
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: by tokens, and by pieces above half the capacity."""
    return max(-(-sum(s * n for s, n in histogram.items()) // capacity), sum(n for s, n in histogram.items() if 2 * s > capacity), int(np.sign(len(histogram))))
