"""Toxicity by non-negative positive-unlabelled learning.

Features of a text are its distinct words and their first letters (prefixes of several lengths), hashed. Those that
stand out in confirmed toxic examples against unlabelled text make up the model: a linear score, trained in numpy on
positives and unlabelled rows alone with the class-prior-corrected, non-negative risk estimate
    prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]).
How many confirmed and unlabelled texts hold a feature is counted over all of them; only the fit itself reads bounded samples
(MAX_POSITIVE confirmed and MAX_UNLABELLED unlabelled texts, by a hash of id and text). The model has at most MAX_FEATURES
features, the strongest ones. Scoring reads every text, on the executors, with that table.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6, 7)
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 4000, 16000, 8192
WORDS_KEPT = 300_000
COUNTED = 200_000  # features whose counts a task holds before it passes them on
FEW = 1 << 20  # ids of confirmed rows that are broadcast; more are joined
HELD_OUT = 2  # remainder of crc32(doc_id) modulo 4 whose labels are never read


def word_features(word: str) -> list[int]:
    """Signed 64-bit hashes of a lower-cased word and of its prefixes."""
    import xxhash

    parts = [f"w {word}", *(f"p {word[:k]}" for k in PREFIXES if len(word) >= k)]
    return [xxhash.xxh3_64_intdigest(p) - (1 << 63) for p in parts]


class Features:
    """The model's features that occur in a text; words repeat, so theirs are kept in a bounded table."""

    def __init__(self, index: dict[int, int] | None = None):
        self.index, self.known = index, {}

    def of(self, text: str | None) -> set[int]:
        found: set[int] = set()
        for word in set(WORD.findall((text or "").lower())):
            here = self.known.get(word)
            if here is None:
                hashed = word_features(word)
                here = tuple(hashed) if self.index is None else tuple(self.index[h] for h in hashed if h in self.index)
                if len(self.known) >= WORDS_KEPT:
                    self.known.clear()
                self.known[word] = here
            if here:
                found.update(here)
        return found


@dataclass
class Model:
    features: np.ndarray  # hashes, in the order of the weights
    weights: np.ndarray
    bias: float

    def score(self, found: set[int]) -> float:
        z = self.bias + float(self.weights[list(found)].sum()) if found else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the sigmoid loss (bounded, so that
    no single example outweighs the correction), by Adam over all rows at once."""
    rows = positive + unlabelled
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    p, n = len(positive), len(rows)
    theta, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    theta[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    for step in range(1, steps + 1):
        z = np.bincount(at, theta[column], n) + theta[-1]
        loss = 1 / (1 + np.exp(-np.clip(z, -500, 500)))  # of a negative; that of a positive is 1 - loss
        steep = loss * (1 - loss)
        slope = np.zeros(n)
        if loss[p:].mean() < prior * loss[:p].mean():  # the correction: only undo what makes the estimate negative
            slope[:p] = prior * steep[:p] / p
            slope[p:] = -steep[p:] / (n - p)
        else:
            slope[:p] = -2 * prior * steep[:p] / p
            slope[p:] = steep[p:] / (n - p)
        g = np.append(np.bincount(column, slope[at], size), slope.sum()) + decay * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def held_out(column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == HELD_OUT


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from `labels.toxic` of rows that are not held out. Without a confirmed toxic row the model scores all 0."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic is not null").where(~held_out())
    count = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p")).first()
    if not count["p"]:
        return Model(np.zeros(0, np.int64), np.zeros(0), -500.0)
    prior = min(max(count["p"] / count["n"], 1e-4), 0.9)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").where(~held_out())
    confirmed = known.where("toxic = 1").select("doc_id").distinct().withColumn("p", F.lit(1))
    confirmed = F.broadcast(confirmed) if count["p"] <= FEW else confirmed
    marked = texts.join(confirmed, "doc_id", "left").withColumn("p", F.coalesce("p", F.lit(0)))

    def counted(batches):
        both, features = (Counter(), Counter()), Features()

        def flush():
            keys = list(both[0])
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([both[1][k] for k in keys], pa.int64()), pa.array(list(both[0].values()), pa.int64())], names=["h", "p", "u"])
            both[0].clear()
            both[1].clear()
            return batch

        for batch in batches:
            for text, p in zip(batch["text"].to_pylist(), batch["p"].to_pylist(), strict=True):
                found = features.of(text)
                both[0].update(found)
                if p:
                    both[1].update(found)
                if len(both[0]) > COUNTED:
                    yield flush()
        yield flush()

    # every text is unlabelled text; the confirmed ones are counted once more
    counts = marked.select("text", "p").mapInArrow(counted, "h long, p long, u long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    total = marked.agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p")).first()
    n1, n0 = max(total["p"] or 0, 1), max(total["n"], 1)

    def some(rows: DataFrame, most: int, of: int) -> DataFrame:
        """About `most` of `of` rows, by a hash of id and text; equal rows count once, so that repeated ones add nothing."""
        mark = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 30))
        return rows.where(mark < int((1 << 30) * min(1.0, most / of))).dropDuplicates(["doc_id", "text"])

    sample = some(marked.where("p = 1"), MAX_POSITIVE, n1).select("text", F.lit(1).alias("p")).unionAll(some(marked, MAX_UNLABELLED, n0).select("text", F.lit(0).alias("p")))
    p, u = (F.col("p") + 0.5) / (n1 + 1), (F.col("u") + 0.5) / (n0 + 1)
    lift = F.log(p / u)
    # unlabelled text holds its share of positives, so a sure sign has a lift of about -log(prior)
    apart = counts.where((F.col("p") >= max(3, 0.004 * n1)) & (lift > 0.6 * -np.log(prior))).withColumn("strength", F.col("p") * lift)
    chosen = np.array([r["h"] for r in apart.orderBy(F.desc("strength"), "h").limit(MAX_FEATURES).collect()], np.int64)
    index = {int(h): k for k, h in enumerate(chosen)}

    def indexed(batches):
        features = Features(index)
        for batch in batches:
            found = [np.array(sorted(features.of(t)), "<i4").tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["p"], pa.array(found, pa.binary())], names=["p", "f"])

    rows = sample.mapInArrow(indexed, "p int, f binary").collect()  # both samples are bounded, a few features a row
    by = {k: [np.frombuffer(r["f"], "<i4") for r in rows if r["p"] == k] for k in (0, 1)}
    if not by[1] or not by[0]:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    weights, bias = fit_nnpu(by[1], by[0], len(chosen), prior)
    return Model(chosen, weights, bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`; null and empty texts get the score of no features."""
    held = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))

    def scored(batches):
        hashes, weights, bias = held.value
        features, one = Features({int(h): k for k, h in enumerate(hashes)}), Model(hashes, weights, bias)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array([one.score(features.of(t)) for t in batch["text"].to_pylist()], pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    out = rows.mapInArrow(scored, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on `labels` and score every row of `docs` by its text alone.

    Null and empty texts, repeated rows and null ids (never held out) are scored like any other. Labels of unknown documents
    only enter the class prior. An empty table gives no rows. Other columns are not read.
    """
    return score(docs, train(docs, labels))
