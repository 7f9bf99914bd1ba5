"""Vectors in blocks: rows of packed ids and values, so that a search is a grid of (query block, candidate block) cells.

A cell is one joined row: memory depends on the block sizes, not on either table. Cells are pairs of rows of two written
tables, which each task reads again, so that no block is copied into a shuffle for each block it meets. A task keeps the
best found for each of its queries, and so its bounds grow tighter from cell to cell.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import shuffle_partitions, spread

CANDIDATES = 4096  # vectors of a candidate block
QUERIES = 2048  # of a query block
AT_ONCE = 64  # queries whose scores with a candidate block are held at a time: they stay in a core's cache


def usable(zero: bool) -> Column:
    """Vectors that are not null and hold no null or non-finite component; with `zero`, nor are they all zero."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    some = F.exists(x, lambda v: v != 0) if zero else F.lit(True)
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & fine & some, F.lit(False))


def prepared(embeddings: DataFrame, zero: bool) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the rows that take part, and their number: usable vectors with an id, of the table's usual length.

    The usual length is the most frequent one among them, the larger of equally frequent ones. Where ids repeat, the
    smallest vector of an id, by its components in order, stands for all its rows.
    """
    rows = embeddings.where(usable(zero) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    size = F.size("embedding").alias("size")
    usual = rows.groupBy(size).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if usual is None:
        return rows, 0
    rows = rows.where(F.size("embedding") == usual["size"])
    for ids_of in (embeddings.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null"), rows):  # reads no vectors, unless some id repeats
        if ids_of.groupBy("vec_id").count().where("count > 1").isEmpty():
            return rows, usual["n"]
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return rows, rows.count()


def block_count(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same values as int16 or float32 where these hold them exactly."""
    with np.errstate(all="ignore"):
        return next((y for y in (x.astype(kind) for kind in ("<i2", "<f4")) if np.array_equal(y, x)), x)


def blocks(rows: DataFrame, n: int, prefix: str, values: Column) -> DataFrame:
    """n blocks of rows with unique ids, by a hash of the id: (<prefix>_block, <prefix>_ids, <prefix>_values, <prefix>_kind, <prefix>_n): little-endian int64 ids in ascending order and values in the narrowest kind that holds them."""

    def packed(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        lists = table["v"].combine_chunks()
        flat = _narrow(lists.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(ids), -1)[order])
        columns = {"block": table["b"].slice(0, 1), "ids": [ids[order].astype("<i8").tobytes()], "values": [flat.tobytes()], "kind": [flat.dtype.str], "n": pa.array([len(ids)], pa.int32())}
        return pa.table({f"{prefix}_{c}": x for c, x in columns.items()})

    chosen = rows.select(F.col("vec_id").cast("long"), values.alias("v"), spread(n, F.col("vec_id").cast("long")).alias("b"))
    dealt = chosen.repartition(min(n, shuffle_partitions(rows.sparkSession)), "b")  # so many files are read side by side, however small
    return dealt.groupBy("b").applyInArrow(packed, schema(prefix))


def schema(prefix: str) -> str:
    return ", ".join(f"{prefix}_{c}" for c in ("block int", "ids binary", "values binary", "kind string", "n int"))


def cells(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every query block beside every candidate block; a task's cells come candidate block by candidate block."""
    return candidates.crossJoin(queries)


def probed(candidates: DataFrame, n: int) -> DataFrame:
    """The first n candidate blocks, apart from the others; in few parts, since each part has a best of its own for every query."""
    return candidates.where(F.col("c_block") < n).repartition(min(n, 16), "c_block")


def with_cutoffs(queries: DataFrame, kth: DataFrame, query_blocks: int, kind: str, none: float) -> DataFrame:
    """Query blocks with the cutoff of each query, of (query_id, cutoff) rows; a query without a row has none."""

    def attached(table: pa.Table, cut: pa.Table) -> pa.Table:
        known = dict(zip(cut["query_id"].to_pylist(), cut["cutoff"].to_pylist(), strict=True))
        cuts = [np.array([known.get(i, none) for i in ids(x).tolist()], kind).tobytes() for x in table["q_ids"].to_pylist()]
        return table.append_column("cutoffs", pa.array(cuts, pa.binary()))

    dealt = kth.withColumn("k_block", spread(query_blocks, "query_id"))
    return queries.groupBy("q_block").cogroup(dealt.groupBy("k_block")).applyInArrow(attached, f"{schema('q')}, cutoffs binary")


class Best:
    """The k highest scores of each query of a block so far, ties to the smaller id; cut: the k-th of them, or what was given."""

    def __init__(self, q_ids: np.ndarray, k: int, cut: np.ndarray):
        self.q_ids, self.k, self.cut, self.size = q_ids, k, cut.copy(), 0
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, cut.dtype))]

    def add(self, i: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        """Of query number i, beside those that the cut rules out."""
        self.found.append((i, vec, score))
        self.size += len(i)
        if self.size > 2 * self.k * len(self.q_ids):
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, vec, score = (np.concatenate(c) for c in zip(*self.found, strict=True))
        order = np.lexsort((vec, -score, i))
        place = np.arange(len(i)) - np.searchsorted(i[order], i[order])
        i, vec, score = (c[order[place < self.k]] for c in (i, vec, score))
        last = place[place < self.k] == self.k - 1
        self.cut[i[last]] = np.maximum(self.cut[i[last]], score[last])
        self.found, self.size = [(i, vec, score)], len(i)
        return i, vec, score

    def rows(self) -> pa.RecordBatch:
        i, vec, score = self.prune()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.q_ids[i], vec, score)], names=["query_id", "vec_id", "score"])


@lru_cache(maxsize=16)
def room(name: str, rows: int, columns: int, kind: str) -> np.ndarray:
    """An array that each use fills anew: asking the system for fresh memory takes as long as a product."""
    return np.empty((rows, columns), kind)


def own(q_ids: np.ndarray, x_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of queries among the candidates, whose ids ascend."""
    at = np.minimum(np.searchsorted(x_ids, q_ids), len(x_ids) - 1)
    i = np.flatnonzero(x_ids[at] == q_ids)
    return i, at[i]


def matrix(values: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(values, kind).reshape(n, -1).astype("<f8")


def ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def best(score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        cut = np.partition(score, k - 1)[k - 1]
        at = np.flatnonzero(score <= cut)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((vec[at], score[at]))[:k]]
