"""Steps whose work must grow no faster than their input, against brute force."""

import random

import duckdb
from pyspark.sql import functions as F

from lodestar.operators import cuts, graph, joins
from lodestar.plans import catalogue, keyed


def test_lru_hits_at_equal_and_missing_keys(spark):
    """As the SQL has it: no seq sorts last, and rows without a key are no other key."""
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(300)]) if rng.random() < 0.1 else i // 2 * 10**9, rng.choice([None, *range(9)])) for i in range(400)]
    got = keyed.lru_hits_of(spark.createDataFrame(rows, "seq long, k long").repartition(5), 3)
    want, last = [], {}
    for seq, k in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        prev = last.get(k)
        others = set() if None in (seq, prev) else {b for a, b in rows if a is not None and prev < a < seq and b is not None}
        want.append((seq, k, prev is not None and len(others) < 3))
        last[k] = seq
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert len({h for *_, h in want}) == 2


def test_lru_hits_rows_do_not_grow_with_the_gaps(spark):
    """Every key comes again after all 3,000 others, gaps of 10**12 apart: no step may list what lies between."""
    trace = spark.range(6000).select((F.col("id") * 10**12).alias("seq"), (F.col("id") % 3000).alias("k"))
    assert keyed.lru_hits_of(trace, 8).where("hit").count() == 0
    assert keyed.lru_hits_of(trace, 3000).where("hit").count() == 3000


def test_morton_codes_of_keys_past_20_bits(spark, tmp_path):
    keys = [5, 2**20 - 1, 2**20, 1_200_000, 7_199_999, 2**31, 2**40 + 12345, 3 * 2**59 + 99, -7]
    spark.createDataFrame([(k, 1 + i) for i, k in enumerate(keys)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    for name in ("morton2d", "morton3d", "morton2d_whole", "morton3d_whole"):
        df = catalogue.queries()[name](spark, str(tmp_path))
        want = duck.execute(catalogue.oracles()[name])
        columns = [d[0] for d in want.description]
        rows = want.fetchall()
        assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(rows) and len(rows) == len(keys)
        if name.endswith("whole"):
            assert len({r[1:5] for r in rows}) == len(keys)


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(300)] + [(1000 - i % 2 * 400 - i, 999 - (i + 1) % 2 * 400 - i) for i in range(200)]
    star = [(5000, 2000 + i) for i in range(200)] + [(7000, 7000), (8001, 8000), (8000, 8001), (8001, 8000), (None, 3)]
    edges = chain + star + [(10_000 + rng.randrange(400), 10_000 + rng.randrange(400)) for _ in range(260)]
    ids = sorted({v for e in edges for v in e if v is not None} | {20_000})
    label = {v: v for v in ids}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in edges:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            label[b] = a
    want = {v: root(v) for v in ids}
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    rows = graph.components(spark.createDataFrame([(v,) for v in ids], "id long"), spark.createDataFrame(edges, "src long, dst long")).collect()
    assert sorted(map(tuple, rows)) == sorted((v, c, sizes[c]) for v, c in want.items())


def test_components_take_few_rounds(spark, monkeypatch):
    """A chain of 2,000 is contracted at once; passing labels on took a written table for each doubling of their reach and each edge anew."""
    written, cut = [], graph._cut
    monkeypatch.setattr(graph, "_cut", lambda df: (written.append(df.columns), cut(df))[1])
    chain = spark.range(1999).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.components(spark.range(2000), chain).where("component = 0 and size = 2000").count() == 2000
    assert written.count(["src", "dst"]) == 1


def test_levels_and_cycles_with_repeated_edges(spark):
    edges = [(1, 2), (1, 2), (2, 3), (1, 3), (3, 4), (9, 4), (9, 4), (None, 5), (6, None)]
    df = spark.createDataFrame(edges, "src long, dst long")
    levels, cyclic = graph.topological_levels(df)
    assert {tuple(r) for r in levels.collect()} == {(1, 0), (9, 0), (2, 1), (3, 2), (4, 3), (5, 1), (6, 0)} and not cyclic
    looped = df.union(spark.createDataFrame([(4, 2), (4, 7)], "src long, dst long"))
    levels, cyclic = graph.topological_levels(looped)
    assert {tuple(r) for r in levels.collect()} == {(1, 0), (9, 0), (5, 1), (6, 0)} and cyclic  # 2, 3, 4 are on the cycle and 7 behind it
    assert graph.reaches(df, 1, 4) and not graph.reaches(df, 4, 1) and not graph.reaches(df, 1, 1) and graph.reaches(looped, 2, 2)


def test_levels_read_edges_once_a_level(spark, monkeypatch):
    """Edges that occur often are neither sorted out first nor written more than once a level."""
    written, cut = [], graph._cut
    monkeypatch.setattr(graph, "_cut", lambda df: (written.append(df.columns), cut(df))[1])
    chain = spark.createDataFrame([(i, i + 1) for i in range(4)] * 50, "src long, dst long")
    levels, cyclic = graph.topological_levels(chain)
    assert {tuple(r) for r in levels.collect()} == {(i, i) for i in range(5)} and not cyclic
    assert written.count(["src", "dst"]) == 4 and written.count(["vertex"]) == 5 and len(written) == 9


def test_cycle_query_peels_the_graph_once(spark, monkeypatch):
    seen, peel = [], graph.topological_levels
    monkeypatch.setattr(graph, "topological_levels", lambda e: (seen.append(1), peel(e))[1])
    (row,) = catalogue.queries()["graph_has_cycle"](spark, "/root/testdata/sf0.001").collect()
    assert tuple(row) == (True, False) and len(seen) == 1


def test_tasks_of_whole_graphs_grow_with_the_rows(spark, monkeypatch):
    """So that the memory of one does not: 500,000 rows each, here 500."""
    monkeypatch.setattr(cuts, "TASK_ROWS", 500)
    rows = sum(spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").count() * n for t, n in (("orders", 1), ("lineitem", 2)))
    for name in ("graph_degree_whole", "graph_contains_edge_whole", "graph_neighbors_whole"):
        assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == -(-rows // 500), name


def test_rows_at_one_place_meet_once(spark):
    """400 points and 40 queries at each of two places: as many pairs as places, and the smallest ids."""
    points = spark.range(800).select("id", (F.col("id") % 2 * 5.0).alias("x"), F.lit(0.0).alias("y"))
    queries = spark.range(80).select(F.col("id").alias("q"), (F.col("id") % 2 * 5.0 + 0.25).alias("qx"), F.lit(0.25).alias("qy"))
    met = []

    def pairs(p, q):
        met.append(joins.within_radius(p, q, 3.0))
        return met[-1]

    want = {(q, 400, sum(range(q % 2, 800, 2))) for q in range(80)}
    assert {tuple(r) for r in joins.tally(points, queries, ["x", "y"], ["qx", "qy"], pairs).collect()} == want
    assert met[0].count() == 2
    near = joins.nearest(points, queries, 3, 2.0)
    assert {(r["q"], r["rank"]): r["id"] for r in near.collect()} == {(q, n): q % 2 + 2 * n - 2 for q in range(80) for n in (1, 2, 3)}


def test_nearest_joins_places(spark, monkeypatch):
    written, cut = [], joins.cut
    monkeypatch.setattr(joins, "cut", lambda df: (written.append(cut(df)), written[-1])[1])
    points = spark.range(800).select("id", (F.col("id") % 2 * 5.0).alias("x"), F.lit(0.0).alias("y"))
    queries = spark.range(80).select(F.col("id").alias("q"), (F.col("id") % 2 * 5.0 + 0.25).alias("qx"), F.lit(0.25).alias("qy"))
    odd = queries.union(spark.createDataFrame([(99, float("nan"), 0.0)], "q long, qx double, qy double"))
    assert joins.nearest(points, odd, 3, 2.0).count() == 240
    assert max(df.count() for df in written) == 6
