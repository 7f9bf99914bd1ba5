"""Keyed lookups, set algebra, ordering and ranges of sequences."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from lodestar.operators.cuts import cut
from lodestar.plans.registry import query


@query("SELECT o_orderkey, coalesce(c_name, '?') AS c_name FROM orders LEFT JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey")
def keyed_lookup_left(t):
    return t.orders.join(t.customer, F.col("o_custkey").eqNullSafe(F.col("c_custkey")), "left").select("o_orderkey", F.coalesce("c_name", F.lit("?")).alias("c_name"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def keyed_contains_semi(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def keyed_missing_anti(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT bool_or(p_size IS NOT DISTINCT FROM 15) AS found FROM part")
def keyed_contains_value(t):
    return t.part.agg(F.bool_or(F.col("p_size").eqNullSafe(15)).alias("found"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def keyed_duplicate_check(t):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


FIRST_SQL = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts {0}, event_id {0}) AS r FROM events) WHERE r = 1"


@query(FIRST_SQL.format(""))
def keyed_try_add_first_wins(t):
    return t.events.groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "event_type")).alias("e")).select("user_id", "e.event_id", "e.event_type")


@query(FIRST_SQL.format("DESC"))
def keyed_upsert_last_wins(t):
    return t.events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e")).select("user_id", "e.event_id", "e.event_type")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def keyed_remove(t):
    return t.supplier.join(t.supplier.where("s_acctbal < 0").select("s_suppkey"), "s_suppkey", "left_anti").select("s_suppkey")


@query("SELECT user_id, value FROM (SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS op FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY user_id) WHERE op <> 'error'")
def keyed_oplog_replay(t):
    ops = t.events.where(F.col("event_type").isin("signup", "purchase", "error"))
    return ops.groupBy("user_id").agg(F.max(F.struct("event_id", "event_type", "value")).alias("e")).where("e.event_type <> 'error'").select("user_id", "e.value")


@query("SELECT o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') AS orderkeys, count(*) AS n FROM orders GROUP BY o_custkey")
def multimap_groups(t):
    return t.orders.groupBy("o_custkey").agg(F.concat_ws(",", F.sort_array(F.collect_list("o_orderkey")).cast("array<string>")).alias("orderkeys"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def multimap_probe(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 45")
def multimap_contains_pair(t):
    pairs = t.lineitem.select("l_orderkey", "l_partkey").distinct()
    return pairs.join(t.lineitem.where("l_quantity > 45").select("l_orderkey", "l_partkey"), ["l_orderkey", "l_partkey"], "left_semi")


@query("SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r > 1")
def multimap_remove_one(t):
    one = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")).select("o_orderkey", "o_custkey")
    return t.orders.select("o_orderkey", "o_custkey").exceptAll(one)


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS type_id FROM events")
def intern_dictionary(t):
    ids = t.events.select("event_type").distinct().withColumn("type_id", F.row_number().over(W.orderBy("event_type")) - 1)  # one row per distinct text
    return t.events.join(ids, "event_type").select("event_id", "type_id")


@query("SELECT p_partkey, n FROM part JOIN (SELECT substring(p_brand, 1, 7) AS k, count(*) AS n FROM part GROUP BY 1) ON substring(p_brand, 1, 7) = k")
def span_lookup_prefix_key(t):
    counts = t.part.groupBy(F.substring("p_brand", 1, 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return t.part.join(counts, F.substring("p_brand", 1, 7) == F.col("k")).select("p_partkey", "n")


@query("WITH e AS (SELECT unnest(list_sort(list(DISTINCT o_orderpriority))) AS p FROM orders UNION ALL SELECT '9-UNUSED') SELECT p AS priority, count(o_orderkey) AS n FROM e LEFT JOIN orders ON p = o_orderpriority GROUP BY p")
def enum_dense_counts(t):
    declared = t.orders.select(F.col("o_orderpriority").alias("priority")).distinct().unionAll(t.spark.range(1).select(F.lit("9-UNUSED").alias("priority")))
    counts = t.orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    return declared.join(counts, "priority", "left").select("priority", F.coalesce("n", F.lit(0)).alias("n"))


def lru_hits_of(trace, capacity: int):
    """seq, k -> hit: whether fewer than `capacity` other keys came since the last access of k.

    A key's first access is no hit. The trace is written in ranges of seq. The latest keys of each range, `capacity` of them and
    those level with the last, are all that a later range needs; with them each range is read once, in order.
    """
    dealt = cut(trace.where("seq is not null").repartitionByRange("seq").withColumn("part", F.spark_partition_id()))
    last = dealt.groupBy("part", "k").agg(F.max("seq").alias("seq"))
    latest = F.rank().over(W.partitionBy("part").orderBy(F.desc("seq")))
    kept = last.where("k is not null").withColumn("r", latest).where(F.col("r") <= capacity).drop("r").unionByName(last.where("k is null"))
    by_part, entering, recent, unnamed = {}, {}, {}, None
    for r in kept.collect():
        by_part.setdefault(r["part"], []).append((r["seq"], r["k"]))
    for part in sorted(by_part):
        entering[part] = (list(recent.items()), unnamed)
        for seq, k in sorted(by_part[part], key=lambda x: x[0]):
            if k is None:
                unnamed = seq
            else:
                recent.pop(k, None)
                recent[k] = seq
        recent = _latest(recent, capacity)

    def hits(batches):
        part, at, here, recent, unnamed = None, None, set(), {}, None
        for batch in batches:
            found = []
            for p, seq, k in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "k")), strict=True):
                if p != part:
                    part, at, here, (recent, unnamed) = p, seq, set(), entering[p]
                    recent = dict(recent)
                elif seq != at:
                    for x in here:  # accesses at one seq do not come between each other
                        recent.pop(x, None)
                        recent[x] = at
                    if None in here:
                        unnamed = recent.pop(None)
                    if len(recent) > capacity:
                        recent = _latest(recent, capacity)
                    at, here = seq, set()
                # a row without a key has a last access, but is no other key
                found.append(k in here or (k in recent if k is not None else unnamed is not None and (len(recent) < capacity or unnamed >= next(iter(recent.values())))))
                here.add(k)
            yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("k"), pa.array(found, pa.bool_())], ["seq", "k", "hit"])

    schema = StructType([trace.schema["seq"], trace.schema["k"], StructField("hit", BooleanType())])
    seen = dealt.repartition("part").sortWithinPartitions("part", "seq").mapInArrow(hits, schema)
    # rows without a seq come after all others: nothing lies between them and their key's last access
    lost = trace.where("seq is null").withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("k"))).alias("l")
    known = last.select("k", F.lit(True).alias("known")).distinct().alias("s")
    late = lost.join(known, F.col("l.k").eqNullSafe(F.col("s.k")), "left").select("seq", "l.k", ((F.col("n") == 1) & F.coalesce("known", F.lit(False))).alias("hit"))
    return seen.unionByName(late)


def _latest(recent: dict, capacity: int) -> dict:
    """The last `capacity` keys, in order of seq, and those level with the first of these."""
    if len(recent) <= capacity:
        return recent
    least = list(recent.values())[-capacity]
    return {k: seq for k, seq in recent.items() if seq >= least}


@query("WITH a AS (SELECT event_id AS seq, user_id AS k, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) SELECT seq, k, prev IS NOT NULL AND (SELECT count(DISTINCT b.user_id) FROM events b WHERE b.event_id > a.prev AND b.event_id < a.seq) < 8 AS hit FROM a")
def lru_hits(t):
    return lru_hits_of(t.events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("k")), 8)


@query("SELECT user_id, max(event_id) AS last FROM events GROUP BY user_id ORDER BY last DESC LIMIT 8")
def lru_final_content(t):
    return t.events.groupBy("user_id").agg(F.max("event_id").alias("last")).orderBy(F.desc("last")).limit(8)


A, B = "(SELECT p_partkey FROM part WHERE p_size <= 30)", "(SELECT p_partkey FROM part WHERE p_size >= 20)"


def _ab(t):
    return t.part.where("p_size <= 30").select("p_partkey"), t.part.where("p_size >= 20").select("p_partkey")


@query(f"SELECT * FROM {A} UNION SELECT * FROM {B}")
def set_union(t):
    a, b = _ab(t)
    return a.union(b).distinct()


@query(f"SELECT * FROM {A} INTERSECT SELECT * FROM {B}")
def set_intersect(t):
    a, b = _ab(t)
    return a.intersect(b)


@query(f"SELECT * FROM {A} EXCEPT SELECT * FROM {B}")
def set_except(t):
    a, b = _ab(t)
    return a.subtract(b)


@query(f"(SELECT * FROM {A} EXCEPT SELECT * FROM {B}) UNION (SELECT * FROM {B} EXCEPT SELECT * FROM {A})")
def set_symmetric_except(t):
    a, b = _ab(t)
    tagged = a.distinct().withColumn("w", F.lit(1)).unionAll(b.distinct().withColumn("w", F.lit(2)))
    return tagged.groupBy("p_partkey").agg(F.sum("w").alias("w")).where("w < 3").select("p_partkey")


@query(f"WITH a AS {A}, b AS {B}, i AS (SELECT * FROM a INTERSECT SELECT * FROM b), n AS (SELECT (SELECT count(*) FROM a) AS a, (SELECT count(*) FROM b) AS b, (SELECT count(*) FROM i) AS i) SELECT i = a AS a_subset_b, i = a AND b > a AS a_proper_subset_b, i = b AS a_superset_b, i > 0 AS overlaps, i = a AND i = b AS equals, true AS i_subset_a, i < a AS i_proper_subset_a FROM n")
def set_predicates(t):
    a, b = _ab(t)
    tagged = a.distinct().withColumn("w", F.lit(1)).unionAll(b.distinct().withColumn("w", F.lit(2)))
    n = tagged.groupBy("p_partkey").agg(F.sum("w").alias("w")).agg(F.count_if(F.col("w") != 2).alias("a"), F.count_if(F.col("w") != 1).alias("b"), F.count_if(F.col("w") == 3).alias("i"))
    return n.selectExpr("i = a as a_subset_b", "i = a and b > a as a_proper_subset_b", "i = b as a_superset_b", "i > 0 as overlaps", "i = a and i = b as equals", "true as i_subset_a", "i < a as i_proper_subset_a")


ARRAYS_SQL = "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_intersect(a, r))), ',') AS both, array_to_string(list_sort(list_distinct(list_concat(a, r))), ',') AS either, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(r, x)))), ',') AS only_a FROM (SELECT l_orderkey, coalesce(list(l_partkey) FILTER (l_returnflag = 'A'), []) AS a, coalesce(list(l_partkey) FILTER (l_returnflag = 'R'), []) AS r FROM lineitem GROUP BY l_orderkey)"


@query(ARRAYS_SQL)
def sorted_array_algebra(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("l_partkey"))).alias("a"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("r"))
    text = lambda c: F.concat_ws(",", F.array_sort(c).cast("array<string>"))
    return g.select("l_orderkey", text(F.array_intersect("a", "r")).alias("both"), text(F.array_union("a", "r")).alias("either"), text(F.array_except("a", "r")).alias("only_a"))


@query("SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)")
def set_intersect_count(t):
    return t.orders.select("o_orderkey").distinct().join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT DISTINCT unnest(generate_series(o_orderkey * 2, o_orderkey * 2 + 2)) AS x FROM orders) SELECT count(*) AS n, count(*) FILTER (x NOT IN (SELECT o_orderkey FROM orders)) AS added FROM r")
def int_ranges_expand(t):
    r = t.orders.select(F.explode(F.sequence(F.col("o_orderkey") * 2, F.col("o_orderkey") * 2 + 2)).alias("x")).distinct()
    have = t.orders.select(F.col("o_orderkey").alias("x"), F.lit(1).alias("have")).distinct()
    return r.join(have, "x", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("have").isNull()).alias("added"))


@query("SELECT l_orderkey >> 10 AS chunk, count(DISTINCT l_orderkey) AS n, CASE WHEN count(DISTINCT l_orderkey) <= 512 THEN 'array' ELSE 'bitmap' END AS kind FROM lineitem GROUP BY 1")
def bitmap_chunks(t):
    g = t.lineitem.select("l_orderkey").distinct().groupBy(F.shiftright("l_orderkey", 10).alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("kind", F.when(F.col("n") <= 512, "array").otherwise("bitmap"))


JOIN_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _joined(t, hint):
    orders = t.orders.select("o_orderkey", "o_custkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(orders.hint(hint) if hint else orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


@query(JOIN_SQL)
def hash_join_inner(t):
    return _joined(t, "shuffle_hash")


@query(JOIN_SQL)
def merge_join(t):
    return _joined(t, "merge")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def nested_loop_small(t):
    return t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")  # region has a fixed handful of rows


SEQ = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(f"SELECT {SEQ} FROM lineitem WHERE l_orderkey < 200 ORDER BY {SEQ}")
def sort_ints(t):
    cols = SEQ.split(", ")
    return t.lineitem.where("l_orderkey < 200").select(*cols).orderBy(*cols)


@query(f"SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, {SEQ}) - 1 AS place FROM lineitem WHERE l_orderkey < 200")
def sort_doubles(t):
    cols = SEQ.split(", ")
    rows = t.lineitem.where("l_orderkey < 200").select(*cols)
    return ranked(rows, "l_extendedprice", cols).select("l_extendedprice", "place")


@query(f"SELECT {SEQ} FROM lineitem ORDER BY {SEQ}")
def sort_ints_whole(t):
    cols = SEQ.split(", ")
    return t.lineitem.select(*cols).orderBy(*cols)


@query(f"SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, {SEQ}) - 1 AS place FROM lineitem")
def sort_doubles_whole(t):
    cols = SEQ.split(", ")
    return ranked(t.lineitem.select(*cols), "l_extendedprice", cols).select("l_extendedprice", "place")


def ranked(rows, key: str, ties: list[str], buckets: int = 64):
    """Global 0-based position by (key, ties): ranges of the key are ordered apart and offset by the counts before them."""
    bounds = rows.stat.approxQuantile(key, [k / buckets for k in range(1, buckets)], 0.005)
    cuts = sorted(set(bounds))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>"), lambda c: c < F.col(key)))
    dealt = rows.withColumn("_b", bucket)
    before = dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row per range
    order = [key, *(c for c in ties if c != key)]
    return dealt.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy(*order))).join(F.broadcast(before), "_b").withColumn("place", F.col("_before") + F.col("_r") - 1).drop("_b", "_r", "_n", "_before")


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders")
def argsort(t):
    return ranked(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"])


@query("SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS place FROM part")
def stable_sort_payload(t):
    return ranked(t.part.select("p_partkey", "p_size"), "p_size", ["p_partkey"])


@query("SELECT p_size, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY p_size) - count(*) AS BIGINT) AS start FROM part GROUP BY p_size")
def counting_sort(t):
    g = t.part.groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("start", F.sum("n").over(W.orderBy("p_size")) - F.col("n"))  # one row per value of a bounded domain


@query("SELECT max(x) AS largest, count(*) AS n FROM (SELECT l_extendedprice AS x FROM lineitem ORDER BY x LIMIT 100)")
def partial_select(t):
    return t.lineitem.select(F.col("l_extendedprice").alias("x")).orderBy("x").limit(100).agg(F.max("x").alias("largest"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT {SEQ} FROM lineitem ORDER BY l_extendedprice, {SEQ} LIMIT 20")
def partial_sort(t):
    return t.lineitem.select(*SEQ.split(", ")).orderBy("l_extendedprice", *SEQ.split(", ")).limit(20)


@query(f"SELECT {SEQ} FROM lineitem ORDER BY l_extendedprice DESC, {SEQ} LIMIT 20")
def topk_largest(t):
    return t.lineitem.select(*SEQ.split(", ")).orderBy(F.desc("l_extendedprice"), *SEQ.split(", ")).limit(20)


@query("SELECT min(o_orderkey) AS low, max(o_orderkey) AS high, arg_min(o_custkey, o_orderkey) AS low_custkey, arg_max(o_custkey, o_orderkey) AS high_custkey FROM orders")
def btree_min_max(t):
    return t.orders.agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.min_by("o_custkey", "o_orderkey").alias("low_custkey"), F.max_by("o_custkey", "o_orderkey").alias("high_custkey"))


@query("SELECT user_id, priority FROM (SELECT user_id, arg_max(value, event_id) AS priority FROM events GROUP BY user_id) ORDER BY priority, user_id")
def pq_drain(t):
    return t.events.groupBy("user_id").agg(F.max_by("value", "event_id").alias("priority")).orderBy("priority", "user_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 60000 ORDER BY o_totalprice, o_orderkey")
def range_scan(t):
    return t.orders.where("o_totalprice >= 50000 and o_totalprice < 60000").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey")


@query("SELECT user_id, event_id, row_number() OVER w AS seq, lag(value) OVER w AS before, CAST(count(*) OVER (w ROWS 4 PRECEDING) AS BIGINT) AS n, round(sum(value) OVER (w ROWS 4 PRECEDING), 4) AS total, min(value) OVER (w ROWS 4 PRECEDING) AS low, max(value) OVER (w ROWS 4 PRECEDING) AS high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def sliding_window(t):
    w = W.partitionBy("user_id").orderBy("event_id")
    last = w.rowsBetween(-4, 0)
    return t.events.select("user_id", "event_id", F.row_number().over(w).cast("long").alias("seq"), F.lag("value").over(w).alias("before"), F.count(F.lit(1)).over(last).alias("n"), F.round(F.sum("value").over(last), 4).alias("total"), F.min("value").over(last).alias("low"), F.max("value").over(last).alias("high"))
