import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import ann, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double"


def table(spark, n=700, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[300:350] = x[299]  # copies: ties go to smaller ids
    rows = [(i * 10, [float(v) for v in x[i]], 1, 2, 3.0) for i in range(n)]
    bad = [(50001, None), (50050, [0.0] * d), (50100, [float("nan")] * d), (50200, [float("inf")] + [1.0] * (d - 1)), (50300, [None] + [1.0] * (d - 1)), (None, [1.0] * d),
           (50400, [1.0] * (d - 1)), (50500, [1.0] * (d + 1)), (50600, []), (50700, [])]
    return x, spark.createDataFrame(rows + [(i, v, None, None, None) for i, v in bad], SCHEMA).repartition(3)


def true_nearest(x, ids, q, k):
    far = np.sqrt(((x - x[q]) ** 2).sum(1))
    far[q] = np.inf
    return ids[np.lexsort((ids, far))[:k]].tolist()


def recall(rows, x, ids, every, k=10):
    got, hits, place = {}, 0, {int(v): n for n, v in enumerate(ids)}
    for r in rows:
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == sorted(i for i in ids.tolist() if i % every == 0)
    for q, found in got.items():
        assert sorted(found) == list(range(1, k + 1))
        pairs = [found[n] for n in range(1, k + 1)]
        assert pairs == sorted(pairs, key=lambda p: (p[1], p[0])) and q not in [v for v, _ in pairs]
        far = np.sqrt(((x - x[place[q]]) ** 2).sum(1))
        assert all(np.isclose(s, far[place[v]], rtol=1e-12) for v, s in pairs)
        hits += len({v for v, _ in pairs} & set(true_nearest(x, ids, place[q], k)))
    return hits / (k * len(got))


@pytest.mark.parametrize("d", [16, 64, 200])
def test_nearest_against_brute_force(spark, monkeypatch, d):
    monkeypatch.setattr(vectors, "CANDIDATES", 256)
    monkeypatch.setattr(vectors, "QUERIES", 16)
    x, df = table(spark, d=d)
    ids = np.arange(len(x)) * 10
    assert recall(ann.nearest(df, k=10, every=100).collect(), x.astype(np.float64), ids, 100) >= 0.99
    if d == 16:
        assert recall(ann.nearest(df, k=10, every=100, rerank=1, cosine=1.0).collect(), x.astype(np.float64), ids, 100) == 1
        assert ann.nearest(df.limit(0)).count() == 0
        assert ann.nearest(df.where("vec_id in (0, 100, 10)"), k=10).count() == 4


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_registered_table(spark, sf):
    """Random unit vectors, where quantisation helps least; no two are near."""
    from lodestar.llm.queries import op5_additive_quantisation

    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([r["embedding"] for r in rows], np.float64), np.array([r["vec_id"] for r in rows])
    assert recall(op5_additive_quantisation(spark, f"/root/testdata/{sf}").collect(), x, ids, 100) >= 0.98


def test_the_bound_keeps_all_that_may_be_nearer():
    """With t = 1 the search is exact however bad the codes are."""
    rng = np.random.default_rng(2)
    x, ids = rng.normal(size=(500, 8)), np.arange(500)
    books = rng.normal(size=(2, 3, 8))
    codes = rng.integers(0, 3, (500, 2))
    y = sum(books[j][codes[:, j]] for j in range(2))
    got = ann.search(x[:40], ids[:40], x, ids, codes, (y**2).sum(1), ((x - y) ** 2).sum(1), books, 5, 5, 1.0)
    for q in range(40):
        assert got[1][got[0] == q].tolist() == true_nearest(x, ids, q, 5)


def test_beam_codes_beat_greedy_ones():
    x = np.random.default_rng(1).normal(size=(600, 12))
    books = ann.train(x, codebooks=4, words=16)

    def error(beam):
        codes = ann.encode(x, books, beam=beam)
        return ((x - sum(books[j][codes[:, j]] for j in range(4))) ** 2).sum()

    assert error(8) < error(1)


def brute_products(y, ids, every, k):
    want = set()
    for q in np.flatnonzero(ids % every == 0):
        s = y @ y[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
        want |= {(int(ids[q]), n + 1, int(ids[i]), int(s[i])) for n, i in enumerate(order)}
    return want


def test_top_products_are_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CANDIDATES", 128)
    monkeypatch.setattr(vectors, "QUERIES", 8)
    for scale, probes in ((1.0, 1), (1e4, 2), (2e5, 8)):  # the last ones' sums pass 2**53
        monkeypatch.setattr(topk, "PROBES", probes)
        x, df = table(spark, seed=3)
        df = df.withColumn("embedding", F.transform("embedding", lambda v: (v * scale).cast("float")))
        x = x * np.float32(scale)
        y = np.floor(256 * x.astype(np.float64)).astype(np.int64)
        y = np.vstack([y, np.zeros((1, y.shape[1]), np.int64)])
        ids = np.append(np.arange(len(x)) * 10, 50050)
        got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_products(df).collect()}
        assert got == brute_products(y, ids, 50, 5)
    assert topk.top_products(df.limit(0)).count() == 0
    assert topk.top_products(df.where("vec_id in (0, 50, 10)")).count() == 4


def test_ties_at_the_cutoff_and_negative_scores(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CANDIDATES", 16)
    rng = np.random.default_rng(5)
    x = -np.abs(rng.integers(0, 2, (120, 4))).astype(np.float32)
    x[::2] *= -1
    df = spark.createDataFrame([(i * 5, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {tuple(r) for r in topk.top_products(df).collect()}
    assert got == brute_products(np.floor(256 * x.astype(np.float64)).astype(np.int64), np.arange(120) * 5, 50, 5)


def test_repeated_and_hot_ids(spark, monkeypatch):
    """All rows of one vec_id are one row, however many: the smallest vector."""
    monkeypatch.setattr(vectors, "CANDIDATES", 64)
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(200)]
    hot = spark.range(70000).select(F.lit(7).cast("long").alias("vec_id"), F.array(F.lit(9.0), F.lit(9.0), F.col("id").cast("double") + 9.0).cast("array<float>").alias("embedding"))
    df = spark.createDataFrame([r for r in rows if r[0] != 7], "vec_id long, embedding array<float>").unionAll(hot)
    x = np.array([[9.0, 9.0, 9.0] if i == 7 else v for i, v in rows])
    ids = np.arange(200)
    assert {tuple(r) for r in topk.top_products(df).collect()} == brute_products((256 * x).astype(np.int64), ids, 50, 5)
    assert recall(ann.nearest(df, k=3).collect(), x, ids, 100, 3) == 1


def test_vectors_beyond_64_bits_take_no_part(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (50, [3e30, 1.0]), (1, [2.0, 0.0]), (2, [-3e38, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_products(df).collect()] == [(0, 1, 1, 2 * 256 * 256)]


def test_products_are_exact_in_the_kind_chosen():
    rng = np.random.default_rng(8)
    for scale, kind in ((250, np.float32), (1e6, np.float64), (5e8, np.int64)):
        q, x = np.floor(rng.normal(size=(20, 64)) * scale), np.floor(rng.normal(size=(300, 64)) * scale)
        assert topk.products_kind(q, x) is kind
        exact = q.astype(np.int64) @ x.astype(np.int64).T
        cutoff = np.sort(exact, axis=1)[:, -5]
        lists, ids = topk.Block(x, np.arange(300)), np.arange(300)
        i, j, total = topk.collected(topk._parts(q, kind), np.arange(1000, 1020), lists.lists(kind), ids, lists.longest, cutoff)
        assert set(zip(i.tolist(), j.tolist(), total.tolist(), strict=True)) == {(a, b, exact[a, b]) for a, b in zip(*np.nonzero(exact >= cutoff[:, None]), strict=True)}


def test_no_block_is_copied_for_each_block_it_meets(spark, monkeypatch, capsys):
    """Query blocks shuffled once for each candidate block, 1 MB each, were over 500 GB at 6 GB of vectors."""
    monkeypatch.setattr(vectors, "CANDIDATES", 64)
    monkeypatch.setattr(vectors, "QUERIES", 4)
    x, df = table(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for found in (topk.top_products(df), ann.nearest(df)):
            capsys.readouterr()
            found.explain()
            plan = capsys.readouterr().out
            assert "CartesianProduct" in plan and "explode" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_few_vectors_are_ranked_exactly_and_none_that_is_near_is_lost(monkeypatch):
    """Random vectors and near copies: with a k-th distance known, codes rule out nearly all others."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1000:1500] = x[:500] + rng.normal(size=(500, 64)) * 0.02
    books = ann.train(x, codebooks=16, words=64, rounds=1)
    codes = ann.encode(x, books)
    y = sum(books[j][codes[:, j]] for j in range(16))
    block = ann.Block(x, np.arange(3000), codes, (y**2).sum(1), ((x - y) ** 2).sum(1), books, ann.SIGMAS / 8)
    q, ids = np.concatenate([x[:100], rng.normal(size=(100, 64)) / 8]), np.arange(5000, 5200)
    true = np.sqrt(((q[:, None, :] - x[None]) ** 2).sum(2))
    ranked, distances = [], ann.Block.distances
    monkeypatch.setattr(ann.Block, "distances", lambda self, q, i, j: (ranked.append(len(i)), distances(self, q, i, j))[1])
    bound = np.full(200, 0.9)
    i, j, far = block.near(q, ids, bound, 10, 32)
    want = set(zip(*(c.tolist() for c in np.nonzero(true <= 0.9)), strict=True))
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    assert got <= want and len(got) >= 0.99 * len(want) and np.allclose(far, true[i, j], rtol=1e-12)
    assert sum(ranked) < 0.02 * true.size
