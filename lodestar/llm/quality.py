"""Quality by the perplexity of a modified Kneser-Ney model of character n-grams, trained on trusted text.

Grams of ORDER UTF-16 units are counted by hashed groups of documents and summed; continuation counts, discounts and
interpolation weights are tables derived from those counts, sharded by gram. The distinct grams of each group of
documents are joined with the tables, order by order, and the probabilities return to the group, where each document's
perplexity is taken over its whole text. Documents above their language's threshold are rejected: a high quantile of
perplexity among trusted documents that were kept out of the counts. It is that of a log-normal fit, since a sample of a
hundred has no 0.999 quantile of its own but its maximum, which a single odd document moves. MARGIN is left above it for
clean text that holds a little of what no trusted text has, such as a key or an address.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import GROUP_BYTES, Scratch, shuffle_partitions, spread, text_bytes

ORDER = 4
CALIBRATION = 5  # one in so many trusted documents sets thresholds instead of training
QUANTILE, MARGIN = 0.999, 1.1
FEW = 1 << 16  # languages whose thresholds are broadcast; more are joined
PART = 1 << 19  # grams sorted at a time


def grams(text: str | None) -> np.ndarray:
    """Each unit with the ORDER - 1 before it, as one 64-bit number; digits count as one, so does white space."""
    units = np.frombuffer((text or "").encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    if not len(units):
        return np.zeros(0, np.int64)
    units = np.where((units >= 48) & (units <= 57), np.uint64(48), np.where((units >= 9) & (units <= 13), np.uint64(32), units))
    padded = np.concatenate([np.full(ORDER - 1, 2, np.uint64), units])
    out = np.zeros(len(units), np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(16)) | padded[k : k + len(units)]
    return out.view(np.int64)


def tally(texts: list[str | None], counted: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of all texts, ascending, and how often each occurs in the counted ones; PART grams are sorted at a time."""
    found, held, size = [], [], 0

    def flush():
        each = np.concatenate([g for g, _ in held])
        keys, inverse = np.unique(each, return_inverse=True)
        found.append((keys, np.bincount(inverse, np.repeat([c for _, c in held], [len(g) for g, _ in held]), len(keys))))

    for text, c in zip(texts, counted, strict=True):
        held.append((grams(text), c))
        size += len(held[-1][0])
        if size >= PART:
            flush()
            held, size = [], 0
    if held:
        flush()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)


def _suffix(column, order: int):
    """The last `order` units of a gram."""
    return column if order == ORDER else column.bitwiseAND(F.lit((1 << 16 * order) - 1))


def counts_by_order(trained: DataFrame, scratch: Scratch) -> dict[int, DataFrame]:
    """For each order (g, c): counts of the longest grams, and for shorter ones how many different units precede them."""
    tables = {ORDER: scratch.write(trained.groupBy("g").agg(F.sum("c").alias("c")), f"count{ORDER}")}
    for order in range(ORDER - 1, 0, -1):
        shorter = tables[order + 1].select(_suffix(F.col("g"), order).alias("g"))
        tables[order] = scratch.write(shorter.groupBy("g").agg(F.count(F.lit(1)).alias("c")), f"count{order}")
    return tables


def discounts(table: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney from the counts of counts."""
    n = [0, 0, 0, 0, 0]
    for r in table.where("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect():  # four rows
        n[r["c"]] = r["n"]
    if not n[1] or not n[2]:
        return [0.5, 0.75, 0.9]
    y = n[1] / (n[1] + 2 * n[2])
    found = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k * 0.5 for k in (1, 2, 3)]
    return [min(max(d, 0.05), k - 0.05) for d, k in zip(found, (1, 2, 3), strict=True)]


def probabilities(wanted: DataFrame, tables: dict[int, DataFrame]) -> DataFrame:
    """(g, logp) of each wanted gram: sharded joins with the counts and their contexts, lowest order first."""
    out = wanted.select("g")
    low = None
    for order in range(1, ORDER + 1):
        d = discounts(tables[order])
        taken = F.when(F.col("c") >= 3, d[2]).when(F.col("c") == 2, d[1]).otherwise(d[0])
        context = F.shiftrightunsigned("g", 16)
        totals = tables[order].withColumn("context", context).groupBy("context").agg(F.sum("c").alias("total"), F.sum(taken).alias("mass"))
        out = out.withColumn("key", _suffix(F.col("g"), order)).withColumn("context", F.shiftrightunsigned("key", 16))
        if order == 1:
            r = tables[1].agg(F.sum("c").alias("total"), F.sum(taken).alias("mass"), F.count(F.lit(1)).alias("n")).first()
            out = out.withColumn("total", F.lit(r["total"])).withColumn("mass", F.lit(r["mass"]))
            base = F.lit(1.0 / (r["n"] + 1))  # one more for any unit not seen
        else:
            out = out.join(totals, "context", "left")
            base = low
        counted = tables[order].select(F.col("g").alias("key"), "c")
        out = out.join(counted, "key", "left")
        p = F.coalesce(F.greatest(F.col("c") - taken, F.lit(0.0)) / F.col("total"), F.lit(0.0)) + F.coalesce(F.col("mass") / F.col("total"), F.lit(1.0)) * base
        out = out.withColumn("p", p).drop("c", "total", "mass", "key", "context")
        low = F.col("p")
    return out.select("g", F.log("p").cast("float").alias("logp"))


def student(quantile: float, freedom: Column) -> Column:
    """Student's quantile by its expansion about the normal one, in powers of 1 / degrees of freedom."""
    z = NormalDist().inv_cdf(quantile)
    terms = [z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    return sum((F.lit(t) / F.pow(freedom, F.lit(float(k))) for k, t in enumerate(terms)), F.lit(0.0))


def limit(perplexity: Column, quantile: float) -> Column:
    """Aggregate: MARGIN times the quantile of a further draw from the log-normal distribution that the values come from; null of fewer than two."""
    log = F.log(perplexity)
    n = F.count(log)
    return F.when(n > 1, MARGIN * F.exp(F.avg(log) + student(quantile, n - 1) * F.stddev_samp(log) * F.sqrt(1 + 1 / n)))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, perplexity, threshold, keep for every row of `docs`, and row_hash to tell rows of one id apart.

    Trusted are documents that `labels` gives quality 1. Null and empty texts have no perplexity and are kept; so is everything
    if nothing is trusted. Null languages count as one language; one with fewer than two calibration documents takes the
    threshold over all. A document on its threshold is kept. Rows of one doc_id share its label. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    groups = max(2 * shuffle_partitions(spark), math.ceil(text_bytes(docs.select(F.col("text").cast("string").alias("text"))) / (2 * GROUP_BYTES)))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    text = F.col("text").cast("string")
    group = F.when(F.col("doc_id").isNull(), spread(groups, text)).otherwise(spread(groups, F.col("doc_id").cast("long")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), lang.alias("lang"), group.alias("part"))
    trusted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null")
    trusted = trusted.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(CALIBRATION)) == 0
    training = trusted.where(~calibrates).select(F.col("doc_id").alias("t_id"), spread(groups, F.col("doc_id")).alias("t_part"))

    def counted(texts: pd.DataFrame, ids: pd.DataFrame) -> pd.DataFrame:
        chosen = set(ids["t_id"].tolist())
        keys, counts = tally(texts["text"].tolist(), [i in chosen for i in texts["doc_id"].tolist()])
        part = texts["part"].iloc[0] if len(texts) else 0
        return pd.DataFrame({"part": np.full(len(keys), part, np.int32), "g": keys, "c": counts})

    seen = rows.select("doc_id", "text", "part").groupBy("part").cogroup(training.groupBy("t_part")).applyInPandas(counted, "part int, g long, c long")
    seen = scratch.write(seen, "seen")
    tables = counts_by_order(seen.where("c > 0").select("g", "c"), scratch)
    if tables[ORDER].isEmpty():
        return rows.select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("keep"), F.xxhash64("text").alias("row_hash"))
    known = scratch.write(probabilities(seen.select("g").distinct(), tables), "known")
    returned = seen.select(F.col("part").alias("k_part"), "g").join(known, "g").select("k_part", "g", "logp")

    def scored(texts: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(table["g"].to_numpy(), kind="stable")
        keys, logp = table["g"].to_numpy()[order], table["logp"].to_numpy()[order].astype(np.float64)
        out = []
        for t in texts["text"]:
            g = grams(t)
            out.append(float(np.exp(-logp[np.searchsorted(keys, g)].mean())) if len(g) else None)
        found = texts[["doc_id", "lang", "row_hash"]].assign(perplexity=pd.array(out, "Float64"))
        return found.assign(doc_id=found["doc_id"].astype("Int64"))

    scores = rows.withColumn("row_hash", F.xxhash64("text")).groupBy("part").cogroup(returned.groupBy("k_part"))
    scores = scratch.write(scores.applyInPandas(scored, "doc_id long, lang string, row_hash long, perplexity double"), "scores")
    scratch.drop("seen", "known", *(f"count{k}" for k in tables))
    calibration = scores.join(trusted.where(calibrates), "doc_id", "left_semi").where("perplexity is not null")
    limits = scratch.write(calibration.groupBy(F.col("lang").alias("l_lang")).agg(limit(F.col("perplexity"), quantile).alias("limit")), "limits")
    overall = calibration.agg(limit(F.col("perplexity"), quantile).alias("t")).first()["t"]
    out = scores.join(F.broadcast(limits) if limits.count() <= FEW else limits, F.col("lang") == F.col("l_lang"), "left")
    out = out.withColumn("threshold", F.coalesce("limit", F.lit(overall).cast("double")))
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "perplexity", "threshold", keep.alias("keep"), "row_hash")
