"""Exact top-k inner products by the three-phase uniform threshold method.

Dimensions are dealt into LISTS lists; a list knows only its own part of every score. 1. In PROBES candidate blocks, each
list gathers its best k vectors per query; the exact totals of these give a safe cutoff, a lower bound of the k-th best total.
2. The cutoffs are sent along with the queries. In every block each list collects all vectors whose part reaches cutoff / LISTS:
a vector that reaches it in no list cannot reach the cutoff in total. A query is not multiplied with a block whose largest
norms rule that out in every list. 3. The collected vectors' totals are resolved exactly, and those that reach the cutoff
compete; the cutoffs rise with the best that a task has found.

Lists and queries are in blocks, worked on in (query block, candidate block) cells; no cell's products are kept. Products are
taken in the narrowest kind in which every partial sum is exact: by Cauchy-Schwarz none exceeds the product of the norms.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm import vectors
from lodestar.llm.common import Scratch

LISTS = 2
PROBES = 8  # candidate blocks that the cutoffs come from, or one in SHARE if these are more
SHARE = 64
EXACT = ((np.float32, float(1 << 24)), (np.float64, float(1 << 53)))  # kinds and the whole numbers they hold
NONE = np.iinfo(np.int64).min


def scaled() -> Column:
    """floor(256 * x), x as double."""
    return F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 256.0).cast("double"))


def in_range() -> Column:
    """Whether every product with another such vector stays within 64 bits."""
    return F.forall(F.col("embedding"), lambda x: F.abs(x.cast("double")) * 256 + 1 <= F.sqrt(F.lit(2.0**63 - 2.0**11) / F.size("embedding")))


def products_kind(q: np.ndarray, x: np.ndarray) -> type:
    """The kind in which inner products of these whole numbers are exact, whatever the order of their sums."""
    most = np.sqrt((q**2).sum(1).max(initial=0)) * np.sqrt((x**2).sum(1).max(initial=0)) * (1 + 1e-9)
    largest = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0))
    return next((kind for kind, whole in EXACT if max(most, largest) < whole), np.int64)


def _parts(x: np.ndarray, kind: type) -> list[np.ndarray]:
    return [np.ascontiguousarray(x[:, part::LISTS], kind) for part in range(LISTS)]


class Block:
    """A candidate block's lists, in each kind that a query block asks for."""

    def __init__(self, x: np.ndarray, x_ids: np.ndarray):
        self.x, self.ids, self.kinds = x, x_ids, {}
        self.longest = [np.sqrt((x[:, part::LISTS] ** 2).sum(1).max(initial=0)) for part in range(LISTS)]

    def lists(self, kind: type) -> list[np.ndarray]:
        if kind not in self.kinds:
            self.kinds[kind] = _parts(self.x, kind)
        return self.kinds[kind]


def _products(q: list[np.ndarray], x: list[np.ndarray]) -> list[np.ndarray]:
    """Each list's part of every score, to be used before the next call."""
    return [np.matmul(a, b.T, out=vectors.room(f"list {n}", len(a), len(b), a.dtype.str)) for n, (a, b) in enumerate(zip(q, x, strict=True))]


def gathered(q: list[np.ndarray], q_ids: np.ndarray, x: list[np.ndarray], x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, total): for each query, the k vectors of each list's best parts, itself left out."""
    scores = _products(q, x)
    seen, most = np.zeros(scores[0].shape, bool), min(k + 1, len(x_ids))  # one more, for the query itself
    for score in scores:
        np.put_along_axis(seen, np.argpartition(score, len(x_ids) - most, axis=1)[:, len(x_ids) - most :], True, axis=1)
    seen[vectors.own(q_ids, x_ids)] = False
    at = np.flatnonzero(seen)
    return *np.divmod(at, len(x_ids)), sum(s.ravel()[at].astype(np.int64) for s in scores)


def collected(q: list[np.ndarray], q_ids: np.ndarray, x: list[np.ndarray], x_ids: np.ndarray, longest: list[float], cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, total): for each query, every vector but its own whose part in some list reaches the query's share of the cutoff, and whose total reaches the cutoff."""
    share = np.where(cutoff == NONE, NONE, -(-cutoff // LISTS))  # whole parts: at least cutoff / LISTS, rounded up
    may = np.zeros(len(q_ids), bool)
    for a, most in zip(q, longest, strict=True):
        may |= np.sqrt((a.astype(np.float64) ** 2).sum(1)) * most * (1 + 1e-9) + 1 >= share.astype(np.float64)
    rows = np.flatnonzero(may)
    scores = _products([a[rows] for a in q], x)
    least = share[rows, None].astype(scores[0].dtype)  # what is too large to be exact here is beyond every product
    seen, more = (vectors.room(name, *scores[0].shape, "?") for name in ("seen", "more"))
    seen[:] = False
    for score in scores:
        seen |= np.greater_equal(score, least, out=more)
    total = vectors.room("total", *scores[0].shape, scores[0].dtype.str)
    total[:] = scores[0]
    for score in scores[1:]:
        total += score
    seen &= np.greater_equal(total, cutoff[rows, None].astype(total.dtype), out=more)
    i, j = vectors.own(q_ids[rows], x_ids)
    seen[i, j] = False
    at = np.flatnonzero(seen)
    i, j = np.divmod(at, len(x_ids))
    return rows[i], j, total.ravel()[at].astype(np.int64)


def _searched(cells: DataFrame, k: int, cutoffs: bool) -> DataFrame:
    """query_id, vec_id, score: each task's k best exact totals per query, among gathered or collected vectors."""

    def searched(batches):
        best: dict[int, vectors.Best] = {}
        last, block = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch[c][row] for c in batch.schema.names}
                if one["c_block"].as_py() != last:
                    last = one["c_block"].as_py()
                    block = Block(vectors.matrix(one["c_values"].as_buffer(), one["c_kind"].as_py(), one["c_n"].as_py()), vectors.ids(one["c_ids"].as_py()))
                q, q_ids = vectors.matrix(one["q_values"].as_buffer(), one["q_kind"].as_py(), one["q_n"].as_py()), vectors.ids(one["q_ids"].as_py())
                known = best.get(one["q_block"].as_py())
                if known is None:
                    cut = np.frombuffer(one["cutoffs"].as_py(), "<i8") if cutoffs else np.full(len(q), NONE)
                    known = best[one["q_block"].as_py()] = vectors.Best(q_ids, k, cut)
                kind = products_kind(q, block.x)
                q, x = _parts(q, kind), block.lists(kind)
                for at in range(0, len(q_ids), vectors.AT_ONCE):
                    part = slice(at, at + vectors.AT_ONCE)
                    lists = [a[part] for a in q]
                    i, j, total = collected(lists, q_ids[part], x, block.ids, block.longest, known.cut[part]) if cutoffs else gathered(lists, q_ids[part], x, block.ids, k)
                    reach = total >= known.cut[part][i]
                    known.add(i[reach] + at, block.ids[j[reach]], total[reach])
        for known in best.values():
            yield known.rows()

    return cells.mapInArrow(searched, "query_id long, vec_id long, score long")


def top_products(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all rows but its own.

    Queries are the rows whose vec_id is divisible by `every`. Components become floor(256 * x). Vectors that are null or
    hold null or non-finite components take no part, nor do rows without an id, vectors of another length than most, and
    vectors with a component so large that a product may leave 64 bits (see in_range); zero vectors do take part. Where ids
    repeat, one row stands for all (see vectors.prepared). Ties go to the smaller vec_id. Fewer candidates than k give
    fewer rows; an empty table gives none.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "topk")
    fine, total = vectors.prepared(embeddings.where(F.coalesce(in_range(), F.lit(False))), zero=False)
    n = vectors.block_count(total, vectors.CANDIDATES)
    candidates = scratch.write(vectors.blocks(fine, n, "c", scaled()), "candidates")
    asked = fine.where(F.col("vec_id") % every == 0)
    query_blocks = vectors.block_count(embeddings.where(F.col("vec_id") % every == 0).count(), vectors.QUERIES)  # with those that take no part: it reads ids only
    queries = scratch.write(vectors.blocks(asked, query_blocks, "q", scaled()), "queries")

    probes = min(n, max(PROBES, n // SHARE))
    first = _searched(vectors.cells(queries, vectors.probed(candidates, probes)), k, False)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kth = first.withColumn("place", place).where(F.col("place") == k).select("query_id", F.col("score").alias("cutoff"))
    # a query that met fewer than k candidates has no cutoff yet and takes all
    with_cuts = scratch.write(vectors.with_cutoffs(queries, kth, query_blocks, "<i8", NONE), "cut_queries")
    last = _searched(vectors.cells(with_cuts, candidates), k, True)
    return last.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
