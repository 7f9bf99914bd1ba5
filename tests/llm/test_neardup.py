import random

import numpy as np

from lodestar.llm import neardup


def brute(rows, width, percent):
    """[(doc_id, n, component)] by comparing every pair of rows."""
    sets = [(i, neardup.shingles(t, width)) for i, t in rows]
    of = list(range(len(sets)))

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for k, (_, p) in enumerate(sets):
        for j, (_, q) in enumerate(sets[:k]):
            if p and q and 100 * len(p & q) >= percent * len(p | q):
                of[find(k)] = find(j)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min(i, low.get(find(k), i))
    return [(i, len(s), low[find(k)]) for k, (i, s) in enumerate(sets)]


def corpus(seed=0):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = []

    def put(w):
        rows.append((len(rows), " ".join(w)))

    for base in range(12):
        w = [rng.choice(words) for _ in range(rng.choice([3, 6, 12, 40, 150]))]
        put(w)
        for _ in range(rng.choice([0, 2, 30])):
            v = list(w)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                v[rng.randrange(len(v))] = rng.choice(words)
            put(v)
    for _ in range(20):
        put(["same", "text", "again", "and", "again", "here"])
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", " \n ", "one", "ONE", "one two three four", "One two three four", None])]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(order[i], t) for i, t in rows]


def test_groups_equal_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, i, None) for i, t in rows], "doc_id long, text string, component long, b string")
    for width, small, chunk, cell, block in ((4, 2, 5, 7, 9), (5, 32, 1 << 20, 1024, 512), (5, 8, 40, 3, 30), (4, 8, 1 << 20, 1024, 512)):
        for name, value in (("SMALL", small), ("CHUNK", chunk), ("CELL", cell), ("BLOCK", block)):
            monkeypatch.setattr(neardup, name, value)
        got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, width).collect()]
        assert sorted(got) == sorted(brute(rows, width, 80))


def test_repeated_ids_are_documents_of_their_own(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(30)) for _ in range(12)]
    # 3 has a copy of 1 and a text of its own, which 9 copies; 5 has three texts; 8 has the same row twice and a blank one
    rows = [(1, base[0]), (3, base[0]), (3, base[1]), (9, base[1]), (2, base[2]), (6, base[3]), (7, base[4]), (5, base[2]), (5, base[3]), (5, base[4] + " more"), (8, base[5]), (8, base[5]), (8, " "), (4, None), (4, base[6]), (-4, base[6])]
    docs = spark.createDataFrame([*rows, (None, base[0]), (None, base[0]), (None, None)], "doc_id long, text string").repartition(3)
    got = neardup.near_duplicates(docs, 4).collect()
    assert len(got) == len(rows) + 3 and all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert sorted(tuple(r)[:4] for r in got if r["doc_id"] is not None) == sorted((*w, w[0] == w[2]) for w in brute(rows, 4, 80))
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] == 3} == {(3, 1), (3, 3)}


def test_components_of_hot_and_long_graphs(spark, monkeypatch):
    from lodestar.llm.common import Scratch

    rng = random.Random(8)
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000 + i, 5000 + i // 3) for i in range(90)] + [(rng.randint(7000, 7099), rng.randint(7000, 7099)) for _ in range(120)] + [(9999, i) for i in range(9000, 9100)]
    of = {i: i for e in edges for i in e}

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        of[y] = x
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    for chunk in (40, 1 << 20):
        monkeypatch.setattr(neardup, "CHUNK", chunk)
        got = {r["doc_id"]: r["component"] for r in neardup.star_components(df, Scratch(spark, "test"), f"c{chunk}").collect()}
        assert all(got.get(i, i) == find(i) for i in of) and set(got) <= set(of)


def test_defined_cases(spark, odd):
    rows = neardup.near_duplicates(odd, 4).collect()
    assert len(rows) == odd.count()
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None], 4, 80)
    assert sorted(tuple(r)[:4] for r in rows if r["doc_id"] is not None) == sorted((*w, w[0] == w[2]) for w in want)
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    got = {r["doc_id"]: r for r in rows}
    assert got[10]["component_id"] == 7 and not got[10]["kept"] and got[0]["n_shingles"] == 0
    assert neardup.near_duplicates(odd.limit(0), 4).count() == 0


def test_estimates_are_close():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.8, 0.95):
        n = 4000
        common = {f"c{i}" for i in range(int(n * share))}
        a = common | {f"a{i}" for i in range((n - len(common)) // 2)}
        b = common | {f"b{i}" for i in range((n - len(common)) // 2)}
        x, y = (neardup.sketches(neardup.hashes(["\n".join(s)], 1)) for s in (a, b))
        got = neardup.estimate(x, y, np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - len(a & b) / len(a | b)) < 0.1
    del rng


def test_chance_collisions_match_the_correction():
    hits = total = 0
    for k in range(20):
        x, y = (neardup.sketches(neardup.hashes([" ".join(f"{s}{k}-{i}" for i in range(5000))], 1))[0] for s in "ab")
        hits += int((x == y).sum())
        total += len(x)
    assert hits / total < 5 / 2**neardup.MANTISSA


def test_hashes_count_distinct_shingles(odd):
    for r in odd.collect():
        for width in (1, 4, 5):
            assert len(neardup.hashes([r["text"]], width)[0]) == len(neardup.shingles(r["text"], width))


def test_densified_registers_agree_as_the_sets_do():
    hits = []
    for k in range(60):
        common, a, b = ([f"{s}{k}-{i}" for i in range(m)] for s, m in (("c", 12), ("a", 2), ("b", 1)))
        x, y = (neardup.densify(neardup.sketches(neardup.hashes([" ".join(w)], 1)))[0] for w in (common + a, common + b))
        assert (x != 0).all()
        hits.append((x == y).mean())
    assert abs(np.mean(hits) - 12 / 15) < 0.05
