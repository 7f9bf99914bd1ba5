"""Aggregation, sketches, statistics, and folds over ranges of a sequence."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.mixers import fmix64, mix64, unsigned_key
from lodestar.operators import sketches
from lodestar.plans.registry import query
from lodestar.plans.sqlmath import fmix64_sql, mix64_sql


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def multiset_counts(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, CAST(sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END) AS BIGINT) AS n FROM events GROUP BY user_id HAVING n > 0")
def multiset_signed(t):
    return t.events.groupBy("user_id").agg(F.sum(F.when(F.col("event_type").isin("view", "click"), 1).otherwise(-1)).alias("n")).where("n > 0")


def _registers_sql(hash64: str, table: str, precision: int) -> str:
    return f"SELECT CAST(h >> {64 - precision} AS BIGINT) AS register, max(CAST(1 + 63 - floor(log2((h << {precision}) % 18446744073709551616::UHUGEINT | {1 << (precision - 1)}::UHUGEINT)) AS BIGINT)) AS rank FROM (SELECT CAST({hash64} AS UHUGEINT) AS h FROM {table}) GROUP BY 1"


def _estimate_sql(registers: str, precision: int) -> str:
    m = 1 << precision
    return f"SELECT CAST(CASE WHEN r <= 2.5 * {m} AND n < {m} THEN round_even({m} * ln({m}.0 / ({m} - n)), 0) ELSE round_even(r, 0) END AS BIGINT) AS estimate FROM (SELECT 0.7213 / (1 + 1.079 / {m}) * {m} * {m} / (sum(pow(2.0, -rank)) + {m} - count(*)) AS r, count(*) AS n FROM ({registers}))"


PARTS_SQL = _estimate_sql(_registers_sql(mix64_sql("CAST(l_partkey AS UBIGINT)"), "lineitem", 14), 14)


@query(f"SELECT CASE WHEN d <= 2048 THEN d ELSE (SELECT estimate FROM ({PARTS_SQL})) END AS n, d <= 2048 AS exact FROM (SELECT count(DISTINCT l_partkey) AS d FROM lineitem)")
def distinct_exact_or_hll(t):
    """Exact up to 2048 distinct values; an estimate of registers beyond."""
    hashed = t.lineitem.select(mix64(F.col("l_partkey")).alias("h"))
    few = t.lineitem.select("l_partkey").distinct().limit(2049).agg(F.count(F.lit(1)).alias("few"))
    both = few.crossJoin(F.broadcast(sketches.hll_estimate(sketches.hll_registers(hashed, "h", 14), 14)))  # one row each
    return both.select(F.when(F.col("few") <= 2048, F.col("few")).otherwise(F.col("estimate")).alias("n"), (F.col("few") <= 2048).alias("exact"))


H = "CAST(o_orderkey AS UBIGINT)"
P = 10
REG_SQL = _registers_sql(fmix64_sql(H), "orders", P)


@query(REG_SQL)
def hll_registers(t):
    return sketches.hll_registers(t.orders.select(fmix64(F.col("o_orderkey")).alias("h")), "h", P)


EST_SQL = _estimate_sql(REG_SQL, P)


@query(EST_SQL)
def hll_estimate(t):
    return sketches.hll_estimate(hll_registers(t), P)


@query(EST_SQL)
def hll_union(t):
    parts = [sketches.hll_registers(t.orders.where(c).select(fmix64(F.col("o_orderkey")).alias("h")), "h", P) for c in ("o_orderkey % 2 = 0", "o_orderkey % 2 = 1")]
    return sketches.hll_estimate(parts[0].unionAll(parts[1]).groupBy("register").agg(F.max("rank").alias("rank")), P)


WIDTH, DEPTH = sketches.cms_shape(0.01, 0.01)
UH = mix64_sql("CAST(user_id AS UBIGINT)")
CMS_SQL = f"SELECT row, (h % 4294967296 + row * ((h >> 32) | 1)) % 4294967296 % {WIDTH} AS cell, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST({UH} AS UHUGEINT) AS h, count(*) AS n FROM events GROUP BY user_id), (SELECT unnest(range({DEPTH}))::UHUGEINT AS row) GROUP BY 1, 2"


@query(f"SELECT CAST(row AS INTEGER) AS row, CAST(cell AS BIGINT) AS cell, n FROM ({CMS_SQL})")
def cms_cells(t):
    return sketches.cms_cells(t.events.select(mix64(F.col("user_id")).alias("h")), "h", 0.01, 0.01)


CMS_EST = f"WITH cells AS ({CMS_SQL}), k AS (SELECT DISTINCT user_id, CAST({UH} AS UHUGEINT) AS h FROM events), a AS (SELECT user_id, row, (h % 4294967296 + row * ((h >> 32) | 1)) % 4294967296 % {WIDTH} AS cell FROM k, (SELECT unnest(range({DEPTH}))::UHUGEINT AS row)) SELECT user_id, min(n) AS estimate FROM a JOIN cells USING (row, cell) GROUP BY user_id"


def _keys(t):
    return t.events.select("user_id").distinct().withColumn("h", mix64(F.col("user_id")))


@query(CMS_EST)
def cms_estimate(t):
    return sketches.cms_estimate(cms_cells(t), _keys(t), "h", 0.01, 0.01).select("user_id", "estimate")


@query(CMS_EST)
def cms_union(t):
    parts = [sketches.cms_cells(t.events.where(c).select(mix64(F.col("user_id")).alias("h")), "h", 0.01, 0.01) for c in ("event_id % 2 = 0", "event_id % 2 = 1")]
    return sketches.cms_estimate(parts[0].unionAll(parts[1]).groupBy("row", "cell").agg(F.sum("n").alias("n")), _keys(t), "h", 0.01, 0.01).select("user_id", "estimate")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def topk_exact(t):
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query()
def topk_space_saving(t):
    """32 monitors per lane of the key's hash, each over its keys in stream order; 8 lanes."""
    def lane(rows: pd.DataFrame) -> pd.DataFrame:
        return sketches.space_saving(rows.sort_values("event_id")["user_id"], 32)

    return t.events.select("event_id", "user_id", F.pmod(F.xxhash64("user_id"), F.lit(8)).alias("lane")).groupBy("lane").applyInPandas(lane, "key long, n long, error long")


M, K = sketches.bloom_shape(2000, 0.01)
CH = mix64_sql("CAST(c_custkey AS UBIGINT)")
BLOOM_SQL = f"SELECT DISTINCT (h % 4294967296 + i * ((h >> 32) | 1)) % 4294967296 % {M} AS bit FROM (SELECT CAST({CH} AS UHUGEINT) AS h FROM customer WHERE c_custkey % 2 = 0), (SELECT unnest(range({K}))::UHUGEINT AS i)"


def _bloom(t):
    return sketches.bloom_bits(t.customer.where("c_custkey % 2 = 0").select(mix64(F.col("c_custkey")).alias("h")), "h", M, K)


@query(f"SELECT CAST(bit AS BIGINT) AS bit FROM ({BLOOM_SQL})")
def bloom_bits(t):
    return _bloom(t)


@query(f"WITH b AS ({BLOOM_SQL}), a AS (SELECT c_custkey, (h % 4294967296 + i * ((h >> 32) | 1)) % 4294967296 % {M} AS bit FROM (SELECT c_custkey, CAST({CH} AS UHUGEINT) AS h FROM customer), (SELECT unnest(range({K}))::UHUGEINT AS i)) SELECT c_custkey, bool_and(b.bit IS NOT NULL) AS found FROM a LEFT JOIN b ON a.bit = b.bit GROUP BY c_custkey")
def bloom_probe(t):
    keys = t.customer.select("c_custkey", mix64(F.col("c_custkey")).alias("h"))
    return sketches.bloom_probe(_bloom(t), keys, "h", M, K).select("c_custkey", "found")


@query()
def cuckoo_membership(t):
    """Fingerprint and bucket pair as a multiset: what a deletable filter answers, without the placement."""
    def entry(h):
        fp = h.bitwiseAND(1023)
        return F.struct(F.when(fp == 0, 1).otherwise(fp).alias("fp"), F.shiftrightunsigned(h, 32).bitwiseAND(511).alias("i"))

    inserted = t.customer.where("c_custkey % 2 = 0").select(entry(mix64(F.col("c_custkey"))).alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    keys = t.customer.select("c_custkey", entry(mix64(F.col("c_custkey"))).alias("e"))
    return keys.join(inserted, "e", "left").select("c_custkey", (F.coalesce("n", F.lit(0)) > 0).alias("found"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def dedup_first_seen(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")).select("event_id")


GAMMA = math.log(1.01 / 0.99)
DD_SQL = f"SELECT CAST(sign(value) AS INTEGER) AS sign, CASE WHEN value = 0 THEN 0 ELSE CAST(ceil(round(ln(abs(value)) / {GAMMA!r}, 9)) AS BIGINT) END AS bucket, count(*) AS n FROM events GROUP BY 1, 2"


@query(DD_SQL)
def ddsketch_buckets(t):
    return sketches.dd_buckets(t.events, "value")


QS = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
DDQ_SQL = f"WITH b AS ({DD_SQL}), c AS (SELECT *, sum(n) OVER (ORDER BY sign, sign * bucket) AS cum FROM b), a AS (SELECT unnest({QS}) AS q), r AS (SELECT q, floor(q * ((SELECT sum(n) FROM b) - 1)) AS rank FROM a), h AS (SELECT q, arg_min(sign, cum) AS s, arg_min(bucket, cum) AS i FROM r, c WHERE cum > rank GROUP BY q) SELECT CAST(q AS DOUBLE) AS q, round(least(greatest(CASE WHEN s = 0 THEN 0 ELSE s * exp(i * {GAMMA!r} + {math.log(0.99)!r}) END, (SELECT min(value) FROM events)), (SELECT max(value) FROM events)), 6) AS value FROM h"


def _dd_quantiles(t, buckets):
    r = t.events.agg(F.min("value").alias("a"), F.max("value").alias("b")).first()
    return sketches.dd_quantiles(buckets, QS, r["a"], r["b"]).select("q", F.round("value", 6).alias("value"))


@query(DDQ_SQL)
def ddsketch_quantiles(t):
    return _dd_quantiles(t, ddsketch_buckets(t))


@query(DDQ_SQL)
def ddsketch_merge(t):
    parts = [sketches.dd_buckets(t.events.where(c), "value") for c in ("event_id % 2 = 0", "event_id % 2 = 1")]
    return _dd_quantiles(t, parts[0].unionAll(parts[1]).groupBy("sign", "bucket").agg(F.sum("n").alias("n")))


@query("SELECT count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events")
def ddsketch_summary(t):
    return t.events.agg(F.count("value").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


MOMENTS = """count(x) AS n, round(avg(x), 4) AS mean, min(x) AS low, max(x) AS high, round(var_samp(x), 2) AS variance, round(stddev_pop(x), 4) AS deviation,
round(CASE WHEN count(x) < 3 THEN 'NaN'::DOUBLE ELSE (avg(x ** 3) - 3 * avg(x) * avg(x ** 2) + 2 * avg(x) ** 3) / pow(var_pop(x), 1.5) END, 4) AS skewness,
round(CASE WHEN count(x) < 4 THEN 'NaN'::DOUBLE ELSE (avg(x ** 4) - 4 * avg(x) * avg(x ** 3) + 6 * avg(x) ** 2 * avg(x ** 2) - 3 * avg(x) ** 4) / pow(var_pop(x), 2) - 3 END, 4) AS kurtosis"""


def _moments(x):
    n, nan = F.count(x), F.lit(float("nan"))
    return [
        n.alias("n"), F.round(F.avg(x), 4).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), F.round(F.coalesce(F.var_samp(x), nan), 2).alias("variance"), F.round(F.stddev_pop(x), 4).alias("deviation"),
        F.round(F.when(n < 3, nan).otherwise(F.skewness(x)), 4).alias("skewness"), F.round(F.when(n < 4, nan).otherwise(F.kurtosis(x)), 4).alias("kurtosis"),
    ]


X = "l_quantity"


@query(f"SELECT {MOMENTS} FROM (SELECT {X} AS x FROM lineitem)")
def moments(t):
    return t.lineitem.agg(*_moments(F.col(X)))


@query(f"SELECT l_returnflag, {MOMENTS} FROM (SELECT l_returnflag, {X} AS x FROM lineitem) GROUP BY l_returnflag")
def moments_by_group(t):
    return t.lineitem.groupBy("l_returnflag").agg(*_moments(F.col(X)))


@query("SELECT count(*) AS n, round(avg(x), 4) AS mean, round(var_samp(x), 4) AS variance FROM (SELECT l_quantity AS x FROM lineitem)")
def moments_merge(t):
    """Summaries of parts combined pairwise-free: counts, means and squared deviations add up around the joint mean."""
    parts = t.lineitem.groupBy("l_returnflag").agg(F.count(X).alias("n"), F.avg(X).alias("m"), (F.var_pop(X) * F.count(X)).alias("m2"))
    sums = parts.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum("m2").alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"))
    return sums.select("n", F.round("mean", 4).alias("mean"), F.round((F.col("within") + F.col("sq") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("n") - 1), 4).alias("variance"))


@query(f"SELECT o_orderkey FROM orders ORDER BY {fmix64_sql(H)}, o_orderkey LIMIT 50")
def reservoir_bottom_k(t):
    return t.orders.select("o_orderkey").orderBy(unsigned_key(fmix64(F.col("o_orderkey"))), "o_orderkey").limit(50)


@query("SELECT min(l_linenumber) AS low, max(l_linenumber) AS high, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def simd_minmax_sum(t):
    return t.lineitem.agg(F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high"), F.sum("l_linenumber").alias("total"))


@query("SELECT event_id, row_number() OVER w = 1 AS first_seen, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def abuse_observe(t):
    w = W.partitionBy("user_id").orderBy("event_id")
    return t.events.select("event_id", (F.row_number().over(w) == 1).alias("first_seen"), F.count(F.lit(1)).over(w).alias("n"))


@query("SELECT user_id, count(*) AS n, (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT count(*) FROM events) AS total FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 5")
def abuse_report(t):
    counts = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("total"))  # one row
    return counts.orderBy(F.desc("n"), "user_id").limit(5).crossJoin(F.broadcast(totals))


@query(f"WITH b AS (SELECT {fmix64_sql(H)} % 16384 AS b, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT CAST(sum(n) AS BIGINT) AS keys, count(*) AS occupied, max(n) AS longest, sum(n * n) AS sq FROM b) SELECT keys, occupied, 16384 - occupied AS empty, keys - occupied AS collisions, longest, round(sq * 16384.0 / keys - keys, 4) AS chi_square FROM s")
def hash_quality(t):
    loads = t.orders.groupBy(fmix64(F.col("o_orderkey")).bitwiseAND(16383).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    s = loads.agg(F.sum("n").alias("keys"), F.count(F.lit(1)).alias("occupied"), F.max("n").alias("longest"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    return s.select("keys", "occupied", (16384 - F.col("occupied")).alias("empty"), (F.col("keys") - F.col("occupied")).alias("collisions"), "longest", F.round(F.col("sq") * 16384.0 / F.col("keys") - F.col("keys"), 4).alias("chi_square"))


@query("SELECT i, round(coalesce(sum(v) OVER (PARTITION BY i // 1024 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + coalesce(b, 0), 2) AS prefix FROM (SELECT o_orderkey AS i, o_totalprice AS v FROM orders) LEFT JOIN (SELECT c, sum(s) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT o_orderkey // 1024 AS c, sum(o_totalprice) AS s FROM orders GROUP BY 1)) ON c = i // 1024")
def prefix_sum(t):
    """Sums before each position in two levels: within chunks of positions, and over the chunks' totals."""
    rows = t.orders.select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v"), F.expr("o_orderkey div 1024").alias("c"))
    within = F.coalesce(F.sum("v").over(W.partitionBy("c").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    before = rows.groupBy("c").agg(F.sum("v").alias("s")).withColumn("b", F.coalesce(F.sum("s").over(W.orderBy("c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))  # one row per chunk
    return rows.withColumn("w", within).join(before.select("c", "b"), "c").select("i", F.round(F.col("w") + F.col("b"), 2).alias("prefix"))


RANGES = "SELECT r * 500 AS s, r * 500 + 700 AS e FROM range(0, 30) t(r)"


def _ranges(t):
    return t.spark.range(0, 30).select((F.col("id") * 500).alias("s"), (F.col("id") * 500 + 700).alias("e"))


def _range_fold(t, ranges, folds):
    """Each query range joined with the chunks of positions it covers, then folded by its number."""
    q = ranges.withColumn("c", F.explode(F.sequence(F.expr("s div 256"), F.expr("(e - 1) div 256"))))
    rows = t.orders.withColumn("c", F.expr("o_orderkey div 256"))
    return q.join(rows, "c").where("o_orderkey >= s and o_orderkey < e").groupBy("s", "e").agg(*folds)


@query(f"SELECT s, e, round(sum(o_totalprice), 2) AS total FROM ({RANGES}) JOIN orders ON o_orderkey >= s AND o_orderkey < e GROUP BY s, e")
def range_sum(t):
    return _range_fold(t, _ranges(t), [F.round(F.sum("o_totalprice"), 2).alias("total")])


@query(f"SELECT s, e, min(o_custkey) AS low, max(o_custkey) AS high, bit_and(o_custkey) AS conj, bit_or(o_custkey) AS disj FROM ({RANGES}) JOIN orders ON o_orderkey >= s AND o_orderkey < e GROUP BY s, e")
def segment_range_min_max_and_or(t):
    return _range_fold(t, _ranges(t), [F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high"), F.bit_and("o_custkey").alias("conj"), F.bit_or("o_custkey").alias("disj")])


WHOLE_RANGES = "SELECT r * 500 AS s, r * 500 + 700 AS e FROM (SELECT unnest(range((SELECT min(o_orderkey) // 500 FROM orders), (SELECT max(o_orderkey) // 500 + 1 FROM orders))) AS r)"


def _whole_ranges(t):
    """The same ranges over all the keys that the table has."""
    ends = t.orders.agg(F.expr("min(o_orderkey) div 500").alias("first"), F.expr("max(o_orderkey) div 500").alias("last")).where("last is not null")
    return ends.select(F.explode(F.sequence("first", "last")).alias("r")).selectExpr("r * 500 as s", "r * 500 + 700 as e")


@query(f"SELECT s, e, round(sum(o_totalprice), 2) AS total FROM ({WHOLE_RANGES}) JOIN orders ON o_orderkey >= s AND o_orderkey < e GROUP BY s, e")
def range_sum_whole(t):
    return _range_fold(t, _whole_ranges(t), [F.round(F.sum("o_totalprice"), 2).alias("total")])


@query(f"SELECT s, e, min(o_custkey) AS low, max(o_custkey) AS high, bit_and(o_custkey) AS conj, bit_or(o_custkey) AS disj FROM ({WHOLE_RANGES}) JOIN orders ON o_orderkey >= s AND o_orderkey < e GROUP BY s, e")
def segment_range_min_max_and_or_whole(t):
    return _range_fold(t, _whole_ranges(t), [F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high"), F.bit_and("o_custkey").alias("conj"), F.bit_or("o_custkey").alias("disj")])


@query("SELECT q.event_id, CAST(count(*) AS BIGINT) AS n, round(sum(u.value), 4) AS total FROM events q JOIN events u ON u.user_id = q.user_id AND u.event_id < q.event_id AND u.event_type = 'purchase' WHERE q.event_type = 'error' GROUP BY q.event_id")
def interleaved_updates(t):
    """A trace of updates and queries: each query sums the updates before it on its key."""
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    paid = F.when(F.col("event_type") == "purchase", F.col("value"))
    return t.events.select("event_id", "event_type", F.count(paid).over(w).alias("n"), F.round(F.sum(paid).over(w), 4).alias("total")).where("event_type = 'error' and n > 0").drop("event_type")


@query("SELECT o_custkey, list_reduce(list(o_orderkey ORDER BY o_orderkey), lambda a, b: gcd(a, b)) AS g FROM orders GROUP BY o_custkey")
def custom_monoid_fold(t):
    """An ordered fold under a given monoid: the greatest common divisor, with identity 0."""
    def gcd(a, b):
        pair = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(a.alias("a"), b.alias("b")), lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), F.try_mod(p["a"], p["b"]).alias("b"))))
        return pair["a"]

    return t.orders.groupBy("o_custkey").agg(F.aggregate(F.sort_array(F.collect_list("o_orderkey")), F.lit(0).cast("long"), gcd).alias("g"))


@query("WITH b AS (SELECT o_orderkey AS pos, o_orderstatus = 'F' AS bit FROM orders), r AS (SELECT pos, bit, CAST(coalesce(sum(bit::INT) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rank FROM b) SELECT pos, bit, rank FROM r")
def rank_select(t):
    """Set bits below each position; a set bit of rank k is the answer of select(k)."""
    b = t.orders.select(F.col("o_orderkey").alias("pos"), (F.col("o_orderstatus") == "F").alias("bit"), F.expr("o_orderkey div 4096").alias("c"))
    ones = F.col("bit").cast("long")
    before = b.groupBy("c").agg(F.sum(ones).alias("s")).withColumn("b", F.coalesce(F.sum("s").over(W.orderBy("c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row per chunk
    within = F.coalesce(F.sum(ones).over(W.partitionBy("c").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return b.withColumn("w", within).join(before.select("c", "b"), "c").select("pos", "bit", (F.col("w") + F.col("b")).alias("rank"))
