"""Interval, as-of, spatial, box and prefix joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import joins
from lodestar.plans.registry import query

IV = "SELECT o_orderkey AS id, d AS s, d + o_orderkey % 30 AS e FROM (SELECT o_orderkey, CAST(date_diff('day', TIMESTAMP '1970-01-01', o_orderdate) AS BIGINT) AS d FROM orders)"
DAYS = "SELECT DISTINCT CAST(date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) AS BIGINT) AS p FROM lineitem WHERE l_orderkey % 50 = 0"


def _day(c):
    return F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


def _intervals(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), _day("o_orderdate").alias("s")).withColumn("e", F.col("s") + F.col("id") % 30)


def _days(t, rows="l_orderkey % 50 = 0"):
    return t.lineitem.where(rows).select(_day("l_shipdate").alias("p")).distinct()


@query(f"SELECT p, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM ({DAYS}) JOIN ({IV}) ON s <= p AND p < e AND s < e GROUP BY p")
def interval_stab(t):
    return _stab(t, _days(t))


def _stab(t, days):
    return joins.interval_stab(_intervals(t), days, "s", "e", "p", 16).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(f"SELECT w, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT p AS w, p AS a, p + 7 AS b FROM ({DAYS})) JOIN ({IV}) ON s < b AND a < e AND s < e GROUP BY w")
def interval_overlap(t):
    return _overlap(t, _days(t))


def _overlap(t, days):
    windows = days.select(F.col("p").alias("w"), F.col("p").alias("a"), (F.col("p") + 7).alias("b"))
    return joins.interval_overlap(_intervals(t), windows, ("s", "e"), ("a", "b"), 16).groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


ALL_DAYS = "SELECT DISTINCT CAST(date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) AS BIGINT) AS p FROM lineitem"


@query(f"SELECT p, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM ({ALL_DAYS}) JOIN ({IV}) ON s <= p AND p < e AND s < e GROUP BY p")
def interval_stab_whole(t):
    return _stab(t, _days(t, "true"))


@query(f"SELECT w, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT p AS w, p AS a, p + 7 AS b FROM ({ALL_DAYS})) JOIN ({IV}) ON s < b AND a < e AND s < e GROUP BY w")
def interval_overlap_whole(t):
    return _overlap(t, _days(t, "true"))


ASOF = "SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_orderkey {0} c_custkey * 3 AND o_orderkey % 7 = 0) AS found FROM customer"


def _successor(t, strict, rows="o_orderkey % 7 = 0"):
    probes = t.customer.select("c_custkey", (F.col("c_custkey") * 3).alias("p"))
    return joins.successor(probes, t.orders.where(rows), "p", "o_orderkey", strict, 1000).select("c_custkey", "found")


@query(ASOF.format(">="))
def asof_lower_bound(t):
    return _successor(t, False)


@query(ASOF.format(">"))
def asof_upper_bound(t):
    return _successor(t, True)


ASOF_WHOLE = "SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_orderkey {0} c_custkey * 3) AS found FROM customer"


@query(ASOF_WHOLE.format(">="))
def asof_lower_bound_whole(t):
    return _successor(t, False, "true")


@query(ASOF_WHOLE.format(">"))
def asof_upper_bound_whole(t):
    return _successor(t, True, "true")


PT = "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part"
QP = f"SELECT id AS q, x + 0.25 AS qx, y + 0.25 AS qy FROM ({PT}) WHERE id % 40 = 0"
CORNERS = ["min_x", "min_y", "max_x", "max_y"]
D2 = "(x - qx) * (x - qx) + (y - qy) * (y - qy)"


def _points(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


def _queries(t):
    return _points(t).where("id % 40 = 0").select(F.col("id").alias("q"), (F.col("x") + 0.25).alias("qx"), (F.col("y") + 0.25).alias("qy"))


@query(f"SELECT q, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM ({QP}), ({PT}) WHERE {D2} <= 9 GROUP BY q")
def spatial_radius(t):
    return joins.tally(_points(t), _queries(t), ["x", "y"], ["qx", "qy"], lambda p, q: joins.within_radius(p, q, 3.0))


@query(f"SELECT q, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM ({QP}), ({PT}) WHERE x BETWEEN qx - 2.25 AND qx + 2 AND y BETWEEN qy - 1.25 AND qy + 3 GROUP BY q")
def spatial_rectangle(t):
    boxes = _queries(t).select("q", (F.col("qx") - 2.25).alias("min_x"), (F.col("qy") - 1.25).alias("min_y"), (F.col("qx") + 2).alias("max_x"), (F.col("qy") + 3).alias("max_y"))
    return joins.tally(_points(t), boxes, ["x", "y"], CORNERS, lambda p, b: joins.in_rectangle(p, b, 4.0))


KNN = f"SELECT q, id, round(d2, 9) AS d2, CAST(r AS INTEGER) AS rank FROM (SELECT q, id, {D2} AS d2, row_number() OVER (PARTITION BY q ORDER BY {D2}, id) AS r FROM ({QP}), ({PT})) WHERE r <= "


def _near(t, k, most=None):
    return joins.nearest(_points(t), _queries(t), k, 2.0, most).withColumn("d2", F.round("d2", 9))


@query(KNN + "1")
def spatial_nearest(t):
    return _near(t, 1)


@query(f"SELECT * FROM ({KNN}1) WHERE d2 <= 0.25")
def spatial_nearest_bounded(t):
    return _near(t, 1, 0.5)


@query(KNN + "5")
def spatial_knn(t):
    return _near(t, 5)


BX = "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS min_x, p_retailprice AS min_y, p_size + 3.0::DOUBLE AS max_x, p_retailprice + 2.0::DOUBLE AS max_y FROM part"


def _boxes(t):
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice")
    return t.part.select(F.col("p_partkey").alias("id"), x.alias("min_x"), y.alias("min_y"), (x + 3.0).alias("max_x"), (y + 2.0).alias("max_y"))


@query(f"WITH b AS ({BX}) SELECT q.id AS q, count(*) AS n, CAST(sum(b.id) AS BIGINT) AS ids FROM b, b q WHERE q.id % 40 = 0 AND b.min_x <= q.max_x AND q.min_x <= b.max_x AND b.min_y <= q.max_y AND q.min_y <= b.max_y GROUP BY q.id")
def box_overlap(t):
    b = _boxes(t)
    q = b.where("id % 40 = 0").select(F.col("id").alias("q"), *(F.col(c).alias(f"q_{c}") for c in CORNERS))
    return joins.tally(b, q, CORNERS, [f"q_{c}" for c in CORNERS], lambda x, y: joins.box_overlap(x, y, 4.0))


@query(f"SELECT q, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM ({BX}), ({QP}) WHERE qx BETWEEN min_x AND max_x AND qy BETWEEN min_y AND max_y GROUP BY q")
def box_at_point(t):
    points = _queries(t).select("q", F.col("qx").alias("x"), F.col("qy").alias("y"))
    return joins.tally(_boxes(t), points, CORNERS, ["x", "y"], lambda b, p: joins.in_rectangle(p, b, 4.0))


@query(f"SELECT min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM ({BX})")
def box_bounds(t):
    return _boxes(t).agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


@query("WITH l AS (SELECT user_id, arg_max(value, event_id) AS x, CAST(arg_max(event_id % 100, event_id) AS DOUBLE) AS y FROM events GROUP BY user_id) SELECT user_id, x, y FROM l WHERE (x - 20) * (x - 20) + (y - 50) * (y - 50) <= 900")
def grid_move_latest(t):
    """The last position of each moving point, then those in a disc."""
    last = t.events.groupBy("user_id").agg(F.max_by(F.struct(F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y")), "event_id").alias("p"))
    return last.select("user_id", "p.x", "p.y").where("(x - 20) * (x - 20) + (y - 50) * (y - 50) <= 900")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small') OR starts_with(p_name, 'red w') ORDER BY p_name, p_partkey")
def prefix_scan(t):
    return t.part.where(F.col("p_name").startswith("small") | F.col("p_name").startswith("red w")).select("p_partkey", "p_name").orderBy("p_name", "p_partkey")


PFX = "SELECT DISTINCT substring(url, 1, n) AS prefix FROM pages, (SELECT unnest([12, 16, 20]) AS n) WHERE page_id % 5 = 0 AND length(url) >= n"


def _prefixes(t):
    n = t.pages.where("page_id % 5 = 0").select("url", F.explode(F.array(*map(F.lit, (12, 16, 20)))).alias("n"))
    return n.where("length(url) >= n").select(F.substring("url", F.lit(1), F.col("n")).alias("prefix")).distinct()


@query(f"SELECT page_id, prefix FROM pages, ({PFX}) WHERE starts_with(url, prefix)")
def prefix_join(t):
    return joins.prefix_join(t.pages.select("page_id", "url"), _prefixes(t), "url", "prefix").select("page_id", "prefix")


@query(f"SELECT url, arg_max(prefix, length(prefix)) AS prefix FROM (SELECT DISTINCT url FROM pages), ({PFX}) WHERE starts_with(url, prefix) GROUP BY url")
def longest_prefix_match(t):
    return joins.longest_prefix(t.pages.select("url").distinct(), _prefixes(t), "url", "prefix")


ROUTES = "SELECT DISTINCT unnest(list_transform(range(3, len(p)), lambda n: array_to_string(p[1:n], '/') || '/')) AS prefix FROM (SELECT string_split(url, '/') AS p FROM pages)"


def _routes(t):
    """Every leading part of every page's url that ends in a slash, from the host's on."""
    parts = t.pages.select(F.split("url", "/").alias("p")).where(F.size("p") > 3)
    each = F.transform(F.sequence(F.lit(3), F.size("p") - 1), lambda n: F.concat(F.array_join(F.slice("p", F.lit(1), n), "/"), F.lit("/")))
    return parts.select(F.explode(each).alias("prefix")).distinct()


@query(f"SELECT page_id, prefix FROM pages, ({ROUTES}) WHERE starts_with(url, prefix)")
def prefix_join_whole(t):
    return joins.prefix_join(t.pages.select("page_id", "url"), _routes(t), "url", "prefix").select("page_id", "prefix")


@query(f"SELECT url, arg_max(prefix, length(prefix)) AS prefix FROM (SELECT DISTINCT url FROM pages), ({ROUTES}) WHERE starts_with(url, prefix) GROUP BY url")
def longest_prefix_match_whole(t):
    return joins.longest_prefix(t.pages.select("url").distinct(), _routes(t), "url", "prefix")
