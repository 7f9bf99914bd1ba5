"""Queries over whole tables against brute force on small ones."""

from lodestar.plans import catalogue


def run(spark, folder, name):
    return catalogue.queries()[name](spark, str(folder))


def test_suffixes_of_whole_texts(spark, tmp_path):
    texts = {1: "".join(map(chr, range(48, 112))) + "a repeat past sixty, a repeat past sixty.", 2: "banana", 3: "q"}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    order, lcps, longest = {}, {}, {}
    for k, x in texts.items():
        starts = sorted(range(len(x)), key=lambda i: x[i:])
        for place, i in enumerate(starts):
            before = x[starts[place - 1] :] if place else ""
            n = next((j for j, (a, b) in enumerate(zip(x[i:], before, strict=False)) if a != b), min(len(x) - i, len(before)))
            order[k, place], lcps[k, place] = i, n
            if place == 0 or n > longest[k][0]:
                longest[k] = (n, x[i : i + n])
    assert {(r["item_id"], r["place"]): r["start"] for r in run(spark, tmp_path, "suffix_order_whole").collect()} == order
    assert {(r["item_id"], r["place"]): r["lcp"] for r in run(spark, tmp_path, "suffix_lcp_whole").collect()} == lcps
    assert {r["item_id"]: (r["n"], r["repeat"]) for r in run(spark, tmp_path, "longest_repeat_whole").collect()} == longest
    assert longest[1] == (19, "a repeat past sixty")


def test_graphs_of_whole_tables(spark, tmp_path):
    orders = [(k, 1 + k * k % 5) for k in range(40) if k % 20] + [(2000, 6), (2001, 6)]
    lines = [(o, o % 7, o % 3 + 10 * (c == 6)) for o, c in orders if o % 4]
    for name, rows, schema in (
        ("orders", orders, "o_orderkey long, o_custkey long"), ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long"),
        ("customer", [(k,) for k in range(1, 9)], "c_custkey long"), ("part", [(k,) for k in range(7)], "p_partkey long"), ("supplier", [(k,) for k in range(14)], "s_suppkey long"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    edges = {(c * 4, o * 4 + 1) for o, c in orders} | {(o * 4 + 1, p * 4 + 2) for o, p, _ in lines} | {(p * 4 + 2, s * 4 + 3) for _, p, s in lines}
    ids = {c * 4 for c in range(1, 9)} | {o * 4 + 1 for o, _ in orders} | {p * 4 + 2 for p in range(7)} | {s * 4 + 3 for s in range(14)}

    def got(name):
        return run(spark, tmp_path, name).collect()

    assert {(r["src"], r["dst"]) for r in got("graph_edges_whole")} == edges == {(r["dst"], r["src"]) for r in got("graph_reverse_whole")}
    assert {r["id"]: r["degree"] for r in got("graph_degree_whole")} == {v: sum(a == v for a, _ in edges) for v in ids}
    assert {(r["src"], tuple(map(int, r["targets"].split(",")))) for r in got("graph_neighbors_whole")} == {(v, tuple(sorted(b for a, b in edges if a == v))) for v, _ in edges}
    probes = {(c * 4, (o + 1) * 4 + 1) for o, c in orders}
    assert {(r["src"], r["dst"]) for r in got("graph_contains_edge_whole")} == probes & edges != set()
    levels, level, front = {}, 0, {min(edges)[0]}
    while front:
        levels |= dict.fromkeys(front, level)
        front, level = {b for a, b in edges if a in front} - set(levels), level + 1
    assert {r["vertex"]: r["level"] for r in got("graph_bfs_levels_whole")} == levels
    longest = {v: 0 for e in edges for v in e}
    for _ in range(4):
        for a, b in edges:
            longest[b] = max(longest[b], longest[a] + 1)
    assert {r["vertex"]: r["level"] for r in got("graph_topo_levels_whole")} == longest
    label = {v: v for v in ids}
    for _ in ids:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    sizes = {c: list(label.values()).count(c) for c in label.values()}
    assert {(r["vertex"], r["component"], r["size"]) for r in got("graph_components_whole")} == {(v, c, sizes[c]) for v, c in label.items()}
    assert len(sizes) > 2


def test_sorts_and_ranges_of_whole_tables(spark, tmp_path):
    rows = [(k * 37 % 20011, k % 4, k % 11, k % 5, float(k * 7919 % 101)) for k in range(600)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(r[0], r[2] + 1, r[4]) for r in rows], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert max(rows)[0] > 15_200
    assert [tuple(r) for r in run(spark, tmp_path, "sort_ints_whole").collect()] == sorted(rows)
    places = run(spark, tmp_path, "sort_doubles_whole").collect()
    assert [r["l_extendedprice"] for r in sorted(places, key=lambda r: r["place"])] == sorted(r[4] for r in rows)
    assert sorted(r["place"] for r in places) == list(range(len(rows)))
    sums, bits = {}, {}
    for s in range(0, 20_011, 500):
        held = [r for r in rows if s <= r[0] < s + 700]
        if held:
            sums[s] = round(sum(r[4] for r in held), 2)
            low, high, both, any_ = min(r[2] + 1 for r in held), max(r[2] + 1 for r in held), -1, 0
            for r in held:
                both, any_ = both & (r[2] + 1), any_ | (r[2] + 1)
            bits[s] = (low, high, both, any_)
    assert {r["s"]: r["total"] for r in run(spark, tmp_path, "range_sum_whole").collect()} == sums
    assert {r["s"]: (r["low"], r["high"], r["conj"], r["disj"]) for r in run(spark, tmp_path, "segment_range_min_max_and_or_whole").collect()} == bits


def test_searches_in_whole_tables(spark, tmp_path):
    from datetime import datetime, timedelta

    keys, customers, first = [0, 1, 3, 4, 6, 8, 11, 13, 1500, 2990], [0, 1, 2, 3, 5, 400, 996, 997], datetime(2024, 1, 1)
    urls = ["https://a.org/en/1", "https://a.org/en/long/and/deep/page", "https://a.org/en/long/and/other", "https://b.org", "https://b.org/x?u=1/2", "https://a.org/"]
    starts, ships = {k: k % 23 for k in keys}, [(1, 5), (7, 9), (50, 12), (51, 14), (99, 300)]
    for name, rows, schema in (
        ("orders", [(k, first + timedelta(starts[k])) for k in keys], "o_orderkey long, o_orderdate timestamp"), ("customer", [(c,) for c in customers], "c_custkey long"),
        ("pages", [(k, u) for k, u in enumerate(urls)], "page_id long, url string"), ("lineitem", [(k, first + timedelta(d)) for k, d in ships], "l_orderkey long, l_shipdate timestamp"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, reached in (("asof_lower_bound_whole", lambda k, p: k >= p), ("asof_upper_bound_whole", lambda k, p: k > p)):
        assert {r["c_custkey"]: r["found"] for r in run(spark, tmp_path, name).collect()} == {c: min((k for k in keys if reached(k, c * 3)), default=None) for c in customers}
    routes = {u[: i + 1] for u in urls for i in range(8, len(u)) if u[i] == "/"}
    pairs = {(k, p) for k, u in enumerate(urls) for p in routes if u.startswith(p)}
    assert {tuple(r) for r in run(spark, tmp_path, "prefix_join_whole").collect()} == pairs
    assert {(r["url"], r["prefix"]) for r in run(spark, tmp_path, "longest_prefix_match_whole").collect()} == {(urls[k], max((p for j, p in pairs if j == k), key=len)) for k, _ in pairs}
    day = (first - datetime(1970, 1, 1)).days
    stabs, overlaps = {}, {}
    for d in {d for _, d in ships}:
        for found, width in ((stabs, 1), (overlaps, 7)):
            ids = [k for k in keys if k % 30 and starts[k] < d + width and d < starts[k] + k % 30]
            if ids:
                found[day + d] = (len(ids), sum(ids))
    assert {r["p"]: (r["n"], r["ids"]) for r in run(spark, tmp_path, "interval_stab_whole").collect()} == stabs
    assert {r["w"]: (r["n"], r["ids"]) for r in run(spark, tmp_path, "interval_overlap_whole").collect()} == overlaps


def test_cycles_are_sought_in_the_whole_graph(spark, monkeypatch):
    from lodestar.operators import graph

    seen, peel = [], graph.topological_levels
    monkeypatch.setattr(graph, "topological_levels", lambda e: (seen.append(e.count()), peel(e))[1])
    (row,) = run(spark, "/root/testdata/sf0.001", "graph_has_cycle").collect()
    assert (row["cyclic"], row["dag_cyclic"]) == (True, False)
    assert min(seen) >= run(spark, "/root/testdata/sf0.001", "graph_edges_whole").count()
