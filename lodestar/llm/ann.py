"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one word from each of several full-dimensional codebooks, trained on residuals of a bounded sample and
refitted by least squares to beam-search codes. Every vector x is indexed: codes by beam search, the squared norm of its
reconstruction y and that of the residual r = x - y. In cells of blocks, words are looked up and summed, and queries score
the sums. With g = x.y / |x|^2 and s the part of r across x, q.x = (q.y + q.s) / g, so
|q|^2 + |x|^2 - 2 q.y / g = |q - x|^2 + 2 q.s / g, and |q.s| <= t |q - x| |s|, where t bounds the cosine of q - x and s: both
lie in part across x, and only those parts meet. Every vector that may so be as near as the k-th found is ranked by exact
distance on the original vectors. The default for t is SIGMAS / sqrt(dimension), so many standard deviations of a random
cosine; t = 1 makes the search exact. No depth is fixed. Where a block is met without a k-th distance, that of its best codes
serves; PROBES blocks give all queries one before the others are met, and it falls within a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm import vectors
from lodestar.llm.common import Scratch

CODEBOOKS, WORDS, BEAM = 16, 128, 8
SAMPLE = 8192  # vectors that codebooks are trained on
RERANK = 32  # best codes of each candidate block whose exact distances are taken first
SIGMAS = 4.0
PROBES, SHARE = 8, 64  # blocks that the first k-th distances come from, or one in SHARE if these are more
LEAST = 0.1  # below this g, a code says too little: the vector is ranked exactly


def _lloyd(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    words = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((words**2).sum(1)[None, :] - 2 * x @ words.T).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return words


def train(x: np.ndarray, codebooks: int = CODEBOOKS, words: int = WORDS, rounds: int = 2, seed: int = 0) -> np.ndarray:
    """(codebooks, words, dimension): residual codebooks, then refits to beam-search codes."""
    rng = np.random.default_rng(seed)
    words = min(words, len(x))
    books, rest = [], x.astype(np.float64)
    for _ in range(codebooks):
        book = _lloyd(rest, words, rng)
        books.append(book)
        rest = rest - book[((book**2).sum(1)[None, :] - 2 * rest @ book.T).argmin(1)]
    out = np.stack(books)
    for _ in range(rounds):
        codes = encode(x, out)
        chosen = np.zeros((len(x), codebooks * words))
        chosen[np.arange(len(x))[:, None], codes + np.arange(codebooks) * words] = 1
        gram = chosen.T @ chosen + 1e-3 * np.eye(codebooks * words)
        fitted = np.linalg.solve(gram, chosen.T @ x + 1e-3 * out.reshape(codebooks * words, -1))
        out = fitted.reshape(out.shape)
    return out


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM, batch: int = 512) -> np.ndarray:
    """The codes (one byte-sized number per codebook) of the best sum that a beam search finds for each vector."""
    m, k, d = books.shape
    scale = np.abs(books).max() or 1.0
    with np.errstate(all="ignore"):  # codes of vectors far beyond the sample's may be poor, but all distances are exact
        x, books = (x / scale).astype(np.float32), (books / scale).astype(np.float32)
    norms = (books**2).sum(2)
    out = np.zeros((len(x), m), np.int64)
    for at in range(0, len(x), batch):
        rest = x[at : at + batch][:, None, :]  # of each vector, what each sum in its beam leaves
        n = len(rest)
        codes, error = np.zeros((n, 1, m), np.int64), np.zeros((n, 1), np.float32)
        for j in range(m):
            # adding word w: |w|^2 - 2 w.rest
            cost = np.matmul(rest.reshape(-1, d), (-2 * books[j]).T).reshape(n, -1, k)
            cost += norms[j]
            cost += error[:, :, None]
            keep = min(beam if j < m - 1 else 1, cost.shape[1] * k)
            few = min(keep, k)  # the best pairs have words among the `few` whose best pairs are best
            words = np.argpartition(cost.min(1), few - 1, axis=1)[:, :few]
            cost = np.take_along_axis(cost, words[:, None, :], 2).reshape(n, -1)
            top = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
            error = np.take_along_axis(cost, top, 1)
            parent, word = top // few, np.take_along_axis(words, top % few, 1)
            codes = np.take_along_axis(codes, parent[:, :, None], 1)
            codes[:, :, j] = word
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - books[j][word]
        out[at : at + n] = codes[:, 0]
    return out


def build_index(rows: DataFrame, total: int, books: np.ndarray, scratch: Scratch) -> DataFrame:
    """Candidate blocks with codes, reconstruction norms and residual norms of every vector."""
    held = rows.sparkSession.sparkContext.broadcast(books)  # CODEBOOKS x WORDS vectors

    def coded(batches):
        books = held.value
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                x = vectors.matrix(one["c_values"][0].as_py(), one["c_kind"][0].as_py(), one["c_n"][0].as_py())
                codes = encode(x, books)
                sums = sum(books[j][codes[:, j]] for j in range(len(books)))
                norms, rest = (((v**2).sum(1)).astype("<f8").tobytes() for v in (sums, x - sums))
                yield pa.RecordBatch.from_arrays([*one.columns, *(pa.array([c], pa.binary()) for c in (codes.astype(np.uint8).tobytes(), norms, rest))], names=[*one.schema.names, "codes", "norms", "rest"])

    packed = vectors.blocks(rows, vectors.block_count(total, vectors.CANDIDATES), "c", F.col("embedding").cast("array<double>"))
    return scratch.write(packed.mapInArrow(coded, f"{vectors.schema('c')}, codes binary, norms binary, rest binary"), "index")


class Block:
    """A candidate block with its reconstructions: columns y / g, |x|^2 and 2 t |s| / g of each vector."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, rest: np.ndarray, books: np.ndarray, t: float):
        self.x, self.ids, self.kinds = x, ids, {}
        xx = (x**2).sum(1)
        xy = (xx + norms - rest) / 2
        with np.errstate(all="ignore"):
            g = xy / xx
            across = np.sqrt(np.maximum(rest - (xx - xy) ** 2 / xx, 0) + 1e-12 * xx)
            self.columns = np.column_stack([sum(books[j][codes[:, j]] for j in range(len(books))) / g[:, None], xx, 2 * t * across / g])
        self.poor = ~((g >= LEAST) & np.isfinite(self.columns).all(1))
        self.columns[self.poor] = 0
        self.most = np.sqrt((self.columns[:, :-2] ** 2).sum(1).max()), self.columns[:, -2].max(), self.columns[:, -1].max()
        self.largest = np.sqrt(max(xx.max(), self.most[1]))

    def transposed(self, kind: type) -> np.ndarray:
        if kind not in self.kinds:
            self.kinds[kind] = columns = self.columns.astype(kind)
            columns[self.poor, -2] = -np.finfo(kind).max / 4  # whatever the bound, these are ranked
        return self.kinds[kind].T

    def distances(self, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for at in range(0, len(i), 8192):
            part = slice(at, at + 8192)
            out[part] = np.sqrt(((self.x[j[part]] - q[i[part]]) ** 2).sum(1))
        return out

    def near(self, q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, distance) of each vector found no farther from a query than its bound; infinite bounds are lowered first, in place."""
        qq, known = (q**2).sum(1), np.where(np.isfinite(bound), bound, 0)
        sizes = [self.largest, np.sqrt(qq.max()), known.max()]
        kind = np.float32 if max(sizes) < 1e15 and min(self.largest, sizes[1]) > 1e-12 else np.float64
        columns = self.transposed(kind)
        new = np.flatnonzero(np.isinf(bound))
        if len(new):
            most = min(max(rerank, k) + 1, len(self.ids))  # one more, for the query itself
            rough = np.column_stack([-2 * q[new], np.ones(len(new)), np.zeros(len(new))]).astype(kind) @ columns
            j = np.argpartition(rough, most - 1, axis=1)[:, :most]
            far = self.distances(q, np.repeat(new, most), j.ravel()).reshape(-1, most)
            far[self.ids[j] == q_ids[new, None]] = np.inf
            if most >= k:
                bound[new] = np.partition(far, k - 1, axis=1)[:, k - 1]
            known = np.where(np.isfinite(bound), bound, 0)
        score = np.matmul(np.column_stack([-2 * q, np.ones(len(q)), -known]).astype(kind), columns, out=vectors.room("score", len(q), len(self.ids), np.dtype(kind).str))
        rounding = (q.shape[1] + 8) * 2 * np.finfo(kind).eps * (2 * np.sqrt(qq) * self.most[0] + self.most[1] + known * self.most[2] + known**2 + qq)
        limit = np.where(np.isfinite(bound), known**2 * (1 + 1e-9) - qq + rounding, np.inf).astype(kind)
        seen = np.less_equal(score, limit[:, None], out=vectors.room("seen", *score.shape, "?"))
        seen[vectors.own(q_ids, self.ids)] = False
        i, j = np.divmod(np.flatnonzero(seen), len(self.ids))
        far = self.distances(q, i, j)
        reach = far <= bound[i]
        return i[reach], j[reach], far[reach]


def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, rest: np.ndarray, books: np.ndarray, k: int, rerank: int, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, vector ids, distances): the k nearest of one candidate block, whose ids ascend, for each query, nearest first."""
    best = vectors.Best(q_ids, k, np.full(len(q), -np.inf))
    i, j, far = Block(x, x_ids, codes, norms, rest, books, t).near(q, q_ids, np.full(len(q), np.inf), k, rerank)
    best.add(i, x_ids[j], -far)
    i, vec, score = best.prune()
    return q_ids[i], vec, -score


def nearest(embeddings: DataFrame, queries: DataFrame | None = None, k: int = 10, every: int = 100, rerank: int = RERANK, cosine: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found among all vectors but its own, by exact Euclidean distance.

    Without `queries`, rows whose vec_id is divisible by `every` are the queries. `cosine` is t above. Vectors that are null, zero or
    hold null or non-finite components take no part, nor do rows without an id or vectors of another length than most.
    Where ids repeat, one row stands for all (see vectors.prepared). Ties go to the smaller vec_id; copies of a vector
    under other ids are candidates like any other. Fewer candidates than k give fewer rows; empty tables give none.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "ann")
    fine, total = vectors.prepared(embeddings, zero=True)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not total:
        return empty
    share = F.pmod(F.xxhash64("vec_id", F.lit(23)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / total))
    sample = fine.where(share).select(F.col("embedding").cast("array<double>").alias("v")).collect()  # SAMPLE rows, within chance: ids are unique
    books = train(np.array([r["v"] for r in sample] or [fine.first()["embedding"]], np.float64))
    index = build_index(fine, total, books, scratch)
    if queries is None:
        asked = fine.where(F.col("vec_id") % every == 0)
    else:
        asked = vectors.prepared(queries, zero=True)[0].where(F.size("embedding") == books.shape[2])
    query_blocks = vectors.block_count(asked.count(), vectors.QUERIES)
    packed = scratch.write(vectors.blocks(asked, query_blocks, "q", F.col("embedding").cast("array<double>")), "queries")
    held = spark.sparkContext.broadcast(books)
    t = min(1.0, SIGMAS / math.sqrt(books.shape[2])) if cosine is None else cosine

    def searched(batches):
        books, best = held.value, {}
        last, block = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch[c][row] for c in batch.schema.names}
                if one["c_block"].as_py() != last:
                    last = one["c_block"].as_py()
                    x, x_ids = vectors.matrix(one["c_values"].as_buffer(), one["c_kind"].as_py(), one["c_n"].as_py()), vectors.ids(one["c_ids"].as_py())
                    codes = np.frombuffer(one["codes"].as_py(), np.uint8).reshape(len(x), -1)
                    block = Block(x, x_ids, codes, *(np.frombuffer(one[c].as_py(), "<f8") for c in ("norms", "rest")), books, t)
                q, q_ids = vectors.matrix(one["q_values"].as_buffer(), one["q_kind"].as_py(), one["q_n"].as_py()), vectors.ids(one["q_ids"].as_py())
                known = best.get(one["q_block"].as_py())
                if known is None:
                    cut = np.frombuffer(one["cutoffs"].as_py(), "<f8") if "cutoffs" in one else np.full(len(q), -np.inf)
                    known = best[one["q_block"].as_py()] = vectors.Best(q_ids, k, cut)
                for at in range(0, len(q), vectors.AT_ONCE):
                    part = slice(at, at + vectors.AT_ONCE)
                    bound = -known.cut[part]
                    i, j, far = block.near(q[part], q_ids[part], bound, k, rerank)
                    known.cut[part] = -bound
                    known.add(i + at, block.ids[j], -far)
        for known in best.values():
            yield known.rows()

    def found(asked: DataFrame, among: DataFrame) -> DataFrame:
        return vectors.cells(asked, among).mapInArrow(searched, "query_id long, vec_id long, score double").withColumn("score", -F.col("score"))

    place = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    n = vectors.block_count(total, vectors.CANDIDATES)
    probes = min(n, max(PROBES, n // SHARE))
    if probes < n:
        kth = found(packed, vectors.probed(index, probes)).withColumn("place", place).where(F.col("place") == k).select("query_id", (-F.col("score")).alias("cutoff"))
        packed = scratch.write(vectors.with_cutoffs(packed, kth, query_blocks, "<f8", -np.inf), "cut_queries")
    return found(packed, index).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
