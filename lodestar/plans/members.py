"""Whole-collection operations, placed filters, probing, sampling and random streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import bits, mixers, streams
from lodestar.functions.mixers import mix64
from lodestar.operators import filters, probing, sampling
from lodestar.plans.registry import query
from lodestar.plans.sqlmath import TWO64, add_sql, mul_sql, signed_sql, splitmix_sql


@query("SELECT count(*) AS entries, count(DISTINCT o_custkey) AS keys FROM orders")
def keyed_count(t):
    return t.orders.agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("o_custkey").alias("keys"))


@query("SELECT n.n_name AS name, n.n_nationkey AS value, n.n_name IN (SELECT upper(n_name) FROM nation) AS found FROM nation n UNION ALL SELECT lower(n_name) || '?', NULL, false FROM nation")
def frozen_lookup(t):
    """A table built once and broadcast (one row per nation), probed by keys that it has and by others."""
    frozen = t.nation.select(F.col("n_name").alias("k"), F.col("n_nationkey").alias("value"))
    asked = t.nation.select(F.col("n_name").alias("name")).unionAll(t.nation.select(F.concat(F.lower("n_name"), F.lit("?"))))
    return asked.join(F.broadcast(frozen), F.col("name") == F.col("k"), "left").select("name", "value", F.col("k").isNotNull().alias("found"))


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS copied, CAST(count(*) AS INTEGER) AS n FROM orders GROUP BY o_custkey")
def copy_to_arrays(t):
    """Each customer's order keys, copied out in ascending order."""
    return t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("copied"), F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders")
def enumerate_entries(t):
    return t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))


@query("WITH d AS (SELECT c_custkey AS vertex, count(o_orderkey) AS degree FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT vertex, degree, CAST(sum(degree) OVER (ORDER BY vertex) - degree AS BIGINT) AS \"offset\" FROM d")
def csr_offsets(t):
    """The offsets of a compressed graph, customer to order: degrees summed within ranges of vertices, and over the ranges."""
    degree = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_custkey").alias("vertex")).agg(F.count("o_orderkey").alias("degree"))
    wide = degree.withColumn("range", F.floor(F.col("vertex") / 65536))
    sums = wide.groupBy("range").agg(F.sum("degree").alias("m"))
    above = F.coalesce(F.sum("m").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row for 65536 vertices
    inside = F.coalesce(F.sum("degree").over(W.partitionBy("range").orderBy("vertex").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return wide.withColumn("inside", inside).join(sums.select("range", above.alias("above")), "range").select("vertex", "degree", (F.col("inside") + F.col("above")).alias("offset"))


UNIVERSE = 64


@query(f"SELECT DISTINCT l_suppkey AS member FROM lineitem WHERE l_suppkey >= 0 AND l_suppkey < {UNIVERSE}")
def sparse_set_members(t):
    """A set over [0, UNIVERSE): members within it; others are refused."""
    return t.lineitem.where(F.col("l_suppkey").between(0, UNIVERSE - 1)).select(F.col("l_suppkey").alias("member")).distinct()


@query("WITH d AS (SELECT user_id, event_id, list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS held FROM events) SELECT user_id, event_id, list_contains(held, 'purchase') AS bought, CAST(len(held) AS INTEGER) AS n, array_to_string(held, ',') AS held FROM d")
def deque_contains(t):
    """A window of the last eight events of a user: whether it holds a purchase, and its content in order."""
    last = W.partitionBy("user_id").orderBy("event_id").rowsBetween(-7, 0)
    held = t.events.select("user_id", "event_id", F.collect_list("event_type").over(last).alias("h"))
    return held.select("user_id", "event_id", F.array_contains("h", "purchase").alias("bought"), F.size("h").alias("n"), F.array_join("h", ",").alias("held"))


WIDE = "(CAST(o_orderkey AS HUGEINT) * 10007003)"


@query(f"SELECT o_orderkey, CAST(CASE WHEN {WIDE} % 4294967296 >= 2147483648 THEN {WIDE} % 4294967296 - 4294967296 ELSE {WIDE} % 4294967296 END AS INTEGER) AS hash FROM orders")
def hash_identity(t):
    """The key itself, cut to its low 32 bits and signed."""
    return t.orders.select("o_orderkey", mixers.int32(mixers.low32(F.col("o_orderkey") * 10007003)).alias("hash"))


def _even(t):
    return t.customer.where("c_custkey % 2 = 0").select(mix64(F.col("c_custkey")).alias("h"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS inserted, false AS missed FROM customer")
def xor_membership(t):
    """An xor filter of the even keys: none of them may be missed. Its share of false positives is held by tests."""
    keys = t.customer.select("c_custkey", mix64(F.col("c_custkey")).alias("h"))
    inserted = F.col("c_custkey") % 2 == 0
    return filters.xor_probe(_even(t), keys, "h").select("c_custkey", inserted.alias("inserted"), (inserted & ~F.col("found")).alias("missed"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AND c_custkey % 6 <> 0 AS inserted, false AS missed FROM customer")
def cuckoo_placed(t):
    """A cuckoo filter after inserting the even keys and removing every third of them: none that stay may be missed."""
    keys = t.customer.select("c_custkey", mix64(F.col("c_custkey")).alias("h"))
    removed = t.customer.where("c_custkey % 6 = 0").select(mix64(F.col("c_custkey")).alias("h"))
    inserted = (F.col("c_custkey") % 2 == 0) & (F.col("c_custkey") % 6 != 0)
    return filters.cuckoo_probe(_even(t), removed, keys, "h").select("c_custkey", inserted.alias("inserted"), (inserted & ~F.col("found")).alias("missed"))


@query()
def probe_statistics(t):
    """Linear probing of all customers' keys of lineitem orders, hashed by the identity times a constant."""
    keys = t.lineitem.select(F.col("l_orderkey").alias("k"), mixers.fmix32(F.col("l_orderkey")).alias("h"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("o"))
    return probing.probe_statistics(keys, "k", "h", "o")


@query()
def reservoir_algorithm_l(t):
    """100 orders, each equally likely to be among them, by seed 42."""
    return sampling.reservoir(t.orders.select("o_orderkey"), "o_orderkey", 100, 42)


@query("SELECT p_partkey, p_size::BIGINT AS x, p_partkey AS y FROM part")
def hilbert2d_decode(t):
    code = bits.hilbert_index(32, F.col("p_size"), F.col("p_partkey"))
    back = t.part.select("p_partkey", bits.hilbert_point(32, 2, code).alias("p"))
    return back.select("p_partkey", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


@query("SELECT p_partkey, p_size::BIGINT AS x, p_partkey AS y, p_partkey % 97 AS z FROM part")
def hilbert3d_decode(t):
    code = bits.hilbert_index(21, F.col("p_size"), F.col("p_partkey"), F.col("p_partkey") % 97)
    back = t.part.select("p_partkey", bits.hilbert_point(21, 3, code).alias("p"))
    return back.select("p_partkey", *(F.get("p", F.lit(k)).alias(c) for k, c in enumerate("xyz")))


def _drawn(values: str) -> str:
    """The columns of a random stream from (n, u)."""
    return f"SELECT CAST(n AS BIGINT) AS n, {signed_sql('u')} AS u, CAST(u >> 11 AS DOUBLE) * pow(2.0, -53) AS x, CAST(u >> 32 AS BIGINT) AS u32, u >= 9223372036854775808 AS flag FROM ({values})"


def _stream(t, source):
    s = streams.stream(t.spark, source, 42, 1000)
    return s.select("n", "u", streams.unit(F.col("u")).alias("x"), F.shiftrightunsigned("u", 32).alias("u32"), (F.col("u") < 0).alias("flag"))


WY = f"SELECT n, CAST(xor(p >> 64, p % {TWO64}) AS UBIGINT) AS u FROM (SELECT n, s * xor(s, {streams.WY_XOR}::UHUGEINT) AS p FROM (SELECT n, CAST({add_sql('42', mul_sql('n + 1', streams.WY_ADD))} AS UHUGEINT) AS s FROM (SELECT unnest(range(1000))::UBIGINT AS n)))"


@query(_drawn(WY))
def prng_wyrand(t):
    return _stream(t, "wyrand")


INC = (streams.PCG_SEQUENCE << 1 | 1) & streams.M64
STEP = f"CAST((s::UHUGEINT * {streams.PCG_MULTIPLIER}::UHUGEINT + {INC}::UHUGEINT) % {TWO64} AS UBIGINT)"
PCG = f"""SELECT n // 2 AS n, CAST(max(o) FILTER (n % 2 = 0)::UHUGEINT * 4294967296::UHUGEINT + max(o) FILTER (n % 2 = 1)::UHUGEINT AS UBIGINT) AS u FROM (
SELECT n, ((x >> r) | (x << ((32 - r) % 32)) % 4294967296) % 4294967296 AS o FROM (SELECT n, (xor(s >> 18, s) >> 27) % 4294967296 AS x, CAST(s >> 59 AS INTEGER) AS r FROM (
WITH RECURSIVE w(n, s) AS (SELECT 0, {STEP.replace('s::UHUGEINT', f'(({INC}::UHUGEINT + 42) % {TWO64})')} UNION ALL SELECT n + 1, {STEP} FROM w WHERE n < 1999) SELECT * FROM w))) GROUP BY 1"""


@query(_drawn(PCG))
def prng_pcg32(t):
    return _stream(t, "pcg32")


def _rot(x: str, n: int) -> str:
    return f"CAST(((({x})::UHUGEINT * {1 << n}::UHUGEINT) % {TWO64}) | (({x})::UHUGEINT >> {64 - n}) AS UBIGINT)"


def _seed(k: int) -> str:
    return splitmix_sql(add_sql("42", mul_sql(str(k), streams.GOLDEN)))


XO256 = f"""SELECT n, {mul_sql(_rot(mul_sql('b', 5), 7), 9)} AS u FROM (WITH RECURSIVE w(n, a, b, c, d) AS (SELECT 0, {', '.join(_seed(k) for k in (1, 2, 3, 4))}
UNION ALL SELECT n + 1, xor(a, xor(d, b)), xor(b, xor(c, a)), xor(xor(c, a), {mul_sql('b', 1 << 17)}), {_rot('xor(d, b)', 45)} FROM w WHERE n < 999) SELECT * FROM w)"""
XO128 = f"""SELECT n, {add_sql('a', 'b')} AS u FROM (WITH RECURSIVE w(n, a, b) AS (SELECT 0, {_seed(1)}, {_seed(2)}
UNION ALL SELECT n + 1, xor(xor({_rot('a', 24)}, xor(a, b)), {mul_sql('xor(a, b)', 1 << 16)}), {_rot('xor(a, b)', 37)} FROM w WHERE n < 999) SELECT * FROM w)"""


@query(_drawn(XO256))
def prng_xoshiro256(t):
    return _stream(t, "xoshiro256")


@query(_drawn(XO128))
def prng_xoroshiro128(t):
    return _stream(t, "xoroshiro128")


@query(f"SELECT CAST(n AS BIGINT) AS n, CAST(((u >> 32) * 100) >> 32 AS BIGINT) AS value FROM ({WY})")
def bounded_draws(t):
    """In [0, 100): none of these thousand draws falls into the part that would be drawn again."""
    return streams.stream(t.spark, "wyrand", 42, 1000).select("n", F.shiftrightunsigned(F.shiftrightunsigned("u", 32) * 100, 32).alias("value"))
