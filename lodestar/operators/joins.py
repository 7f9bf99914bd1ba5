"""Join shapes Spark has no operator for, as bucketed equi-joins with a residual predicate.

Every function declares a plan of stock operators: both sides are dealt to buckets, joined on them and filtered by the exact
predicate; a pair that meets in several buckets counts in one. Bucket widths bound how many buckets a row enters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.operators.cuts import cut

CHUNKS = 4096  # chunks of keys that one row of a last window stands for


def interval_stab(intervals: DataFrame, points: DataFrame, start: str, end: str, point: str, width: float) -> DataFrame:
    """Pairs with start <= point < end. Empty intervals never match."""
    i = intervals.where(F.col(start) < F.col(end)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    return p.join(i, "_b").where((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end))).drop("_b")


def interval_overlap(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], width: float) -> DataFrame:
    """Pairs of half-open intervals that overlap. Empty ones never do. A pair counts in the bucket where the later starts."""
    def dealt(df: DataFrame, s: str, e: str, name: str) -> DataFrame:
        return df.where(F.col(s) < F.col(e)).withColumn(name, F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))

    both = dealt(left, *a, "_b").join(dealt(right, *b, "_c"), F.col("_b") == F.col("_c"))
    first = F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / width)
    return both.where((F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])) & (F.col("_b") == first)).drop("_b", "_c")


def successor(probes: DataFrame, keys: DataFrame, probe: str, key: str, strict: bool, chunk: float) -> DataFrame:
    """Each probe with the first key >= it (> it if strict), null if there is none: `found`.

    Keys are condensed per chunk of the key range; a probe looks in its own chunk, then at the first key of the next
    non-empty one. Sorting is within chunks, so no task holds the whole range.
    """
    k = keys.select(F.col(key).alias("key_")).where("key_ is not null").distinct().withColumn("chunk_", F.floor(F.col("key_") / chunk))
    asked = probes.select(F.col(probe).alias("key_")).where("key_ is not null").distinct().withColumn("chunk_", F.floor(F.col("key_") / chunk))
    # one row per chunk of either side, in two levels: within ranges of chunks side by side, and over the ranges
    firsts = k.groupBy("chunk_").agg(F.min("key_").alias("first_"))
    firsts = firsts.unionByName(asked.select("chunk_").distinct().withColumn("first_", F.lit(None).cast(firsts.schema["first_"].dataType))).groupBy("chunk_").agg(F.min("first_").alias("first_"))
    firsts = firsts.withColumn("far_", F.floor(F.col("chunk_") / CHUNKS))
    inside = F.min("first_").over(W.partitionBy("far_").orderBy(F.col("chunk_").desc()).rowsBetween(W.unboundedPreceding, -1))
    beyond = F.min("low_").over(W.orderBy(F.col("far_").desc()).rowsBetween(W.unboundedPreceding, -1))  # one row for CHUNKS chunks
    ranges = firsts.groupBy("far_").agg(F.min("first_").alias("low_")).select("far_", beyond.alias("beyond_"))
    later = firsts.withColumn("inside_", inside).join(ranges, "far_").select("chunk_", F.coalesce("inside_", "beyond_").alias("next_"))
    # keys sort after probes of the same value where equality counts
    marked = asked.withColumn("kind_", F.lit(0 if strict else 1)).unionByName(k.withColumn("kind_", F.lit(1 if strict else 0)))
    position = W.partitionBy("chunk_").orderBy(F.col("key_").desc(), F.col("kind_")).rowsBetween(W.unboundedPreceding, -1)
    is_key = F.col("kind_") == (1 if strict else 0)
    seen = marked.withColumn("found_", F.last(F.when(is_key, F.col("key_")), ignorenulls=True).over(position)).where(~is_key)
    answers = seen.join(later, "chunk_", "left").select("key_", F.coalesce("found_", "next_").alias("found"))
    return probes.join(answers, F.col(probe) == F.col("key_"), "left").drop("key_")


def _cells(x: Column, y: Column, cell: float, reach: float) -> Column:
    xs = F.sequence(F.floor((x - reach) / cell), F.floor((x + reach) / cell))
    return F.explode(F.flatten(F.transform(xs, lambda i: F.transform(F.sequence(F.floor((y - reach) / cell), F.floor((y + reach) / cell)), lambda j: F.struct(i.alias("i"), j.alias("j"))))))


def within_radius(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """points(id, x, y), queries(q, qx, qy): pairs in the closed disc, with their squared distance d2."""
    if not radius >= 0:
        raise ValueError("radius must be a non-negative number")
    cell = radius or 1.0
    p = points.withColumn("_c", F.struct(F.floor(F.col("x") / cell).alias("i"), F.floor(F.col("y") / cell).alias("j")))
    q = queries.where(~F.isnan("qx") & ~F.isnan("qy")).withColumn("_c", _cells(F.col("qx"), F.col("qy"), cell, radius))
    d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    return q.join(p, "_c").withColumn("d2", d2).where(F.col("d2") <= radius * radius).drop("_c")


def in_rectangle(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """points(id, x, y) in closed boxes(q, min_x, min_y, max_x, max_y)."""
    p = points.withColumn("_c", F.struct(F.floor(F.col("x") / cell).alias("i"), F.floor(F.col("y") / cell).alias("j")))
    q = boxes.withColumn("_c", box_cells("min_x", "min_y", "max_x", "max_y", cell))
    return q.join(p, "_c").where(F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))).drop("_c")


def box_cells(x0: str, y0: str, x1: str, y1: str, cell: float) -> Column:
    xs = F.sequence(F.floor(F.col(x0) / cell), F.floor(F.col(x1) / cell))
    return F.explode(F.flatten(F.transform(xs, lambda i: F.transform(F.sequence(F.floor(F.col(y0) / cell), F.floor(F.col(y1) / cell)), lambda j: F.struct(i.alias("i"), j.alias("j"))))))


def box_overlap(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Closed boxes (id, min_x, ...) and (q, q_min_x, ...) that touch or overlap; a pair counts in its first common cell."""
    a = left.withColumn("_a", box_cells("min_x", "min_y", "max_x", "max_y", cell))
    b = right.withColumn("_b", box_cells("q_min_x", "q_min_y", "q_max_x", "q_max_y", cell))
    meet = (F.col("min_x") <= F.col("q_max_x")) & (F.col("q_min_x") <= F.col("max_x")) & (F.col("min_y") <= F.col("q_max_y")) & (F.col("q_min_y") <= F.col("max_y"))
    first = (F.col("_a.i") == F.floor(F.greatest("min_x", "q_min_x") / cell)) & (F.col("_a.j") == F.floor(F.greatest("min_y", "q_min_y") / cell))
    return a.join(b, F.col("_a") == F.col("_b")).where(meet & first).drop("_a", "_b")


def nearest(points: DataFrame, queries: DataFrame, k: int, cell: float, max_distance: float | None = None) -> DataFrame:
    """queries(q, qx, qy) with their k nearest points(id, x, y): q, id, d2, rank; ties to the smaller id.

    Of points at one place only the k smallest ids can be among the nearest, and queries at one place have the same ones: places
    meet, not rows. Rings of cells around a place widen fourfold until it has k points that no farther ring can beat. Each round is
    written, and only places that are not settled enter the next.
    """
    by_place = F.row_number().over(W.partitionBy("x", "y").orderBy("id"))
    p = points.where(~F.isnan("x") & ~F.isnan("y")).withColumn("_n", by_place).where(F.col("_n") <= k).drop("_n")
    p = cut(p).withColumn("_c", F.struct(F.floor(F.col("x") / cell).alias("i"), F.floor(F.col("y") / cell).alias("j")))
    places = cut(queries.select("qx", "qy").where(~F.isnan("qx") & ~F.isnan("qy")).distinct())
    bounds = p.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if bounds["x0"] is None:
        return queries.limit(0).select("q", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("d2"), F.lit(1).alias("rank"))
    far = places.agg(F.max(F.greatest(F.abs(F.col("qx") - bounds["x0"]), F.abs(F.col("qx") - bounds["x1"]), F.abs(F.col("qy") - bounds["y0"]), F.abs(F.col("qy") - bounds["y1"]))).alias("m")).first()["m"] or 0.0
    reach, left, done = cell, places, None
    d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    rank = F.row_number().over(W.partitionBy("qx", "qy").orderBy("d2", "id"))
    while True:
        last = reach > far or (max_distance is not None and reach >= max_distance)
        limit = reach if max_distance is None else min(reach, max_distance)
        near = left.withColumn("_c", _cells(F.col("qx"), F.col("qy"), cell, reach)).join(p, "_c").withColumn("d2", d2)
        if not last or max_distance is not None:
            near = near.where(F.col("d2") <= limit * limit)
        found = cut(near.withColumn("rank", rank).where(F.col("rank") <= k).select("qx", "qy", "id", "d2", "rank"))
        if last:
            done = found if done is None else done.unionByName(found)
            break
        full = found.where(F.col("rank") == k).select("qx", "qy")
        part = found.join(full, ["qx", "qy"], "left_semi")
        done = part if done is None else done.unionByName(part)
        left = cut(left.join(full, ["qx", "qy"], "left_anti"))
        if left.isEmpty():
            break
        reach *= 4
    each = queries.join(done.drop("rank"), ["qx", "qy"])
    return each.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("d2", "id"))).where(F.col("rank") <= k).select("q", "id", "d2", "rank")


def tally(things: DataFrame, queries: DataFrame, place: list[str], asked: list[str], pairs: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """q, n, ids: number and sum of ids of the things that `pairs` joins to each query. Things at one place, and queries that ask the same, meet once."""
    places = things.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
    found = pairs(places, queries.select(*asked).distinct()).groupBy(*asked).agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))
    return queries.join(found, asked).groupBy("q").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))


def prefix_join(keys: DataFrame, prefixes: DataFrame, key: str, prefix: str) -> DataFrame:
    """Pairs in which the key starts with the prefix: an equi-join for each length of prefix that there is."""
    p = prefixes.withColumn("_n", F.length(prefix)).withColumnRenamed(prefix, "_p")
    lengths = p.select("_n").distinct().agg(F.sort_array(F.collect_set("_n")).alias("n"))  # as many as lengths of prefixes
    k = keys.crossJoin(F.broadcast(lengths)).withColumn("_l", F.explode("n")).where(F.col("_l") <= F.length(key))
    k = k.withColumn("_p", F.substring(F.col(key), F.lit(1), F.col("_l"))).drop("n")
    return k.join(p, "_p").withColumnRenamed("_p", prefix).drop("_n", "_l")


def longest_prefix(keys: DataFrame, prefixes: DataFrame, key: str, prefix: str) -> DataFrame:
    """Each key with its longest stored prefix: key, prefix; keys without one are absent."""
    return prefix_join(keys, prefixes, key, prefix).groupBy(key).agg(F.max_by(F.col(prefix), F.length(prefix)).alias(prefix))
