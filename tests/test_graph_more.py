"""Communities, PageRank and merges against plain versions of them."""

import random

from sparkloom.operators import graph
from sparkloom.sources import sinks


def modularity(pairs, label):
    m = len(pairs)
    degree, inside, total = {}, 0, {}
    for a, b in pairs:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
        inside += label[a] == label[b]
    for n, k in degree.items():
        total[label[n]] = total.get(label[n], 0) + k
    return inside / m - sum((t / (2 * m)) ** 2 for t in total.values())


def test_communities_of_cliques(spark):
    """Four cliques on a ring of bridges: they are the best communities, and modularity is as by hand."""
    pairs = [(f"{c}{i}", f"{c}{j}") for c in "abcd" for i in range(5) for j in range(i)] + [("a0", "b1"), ("b0", "c1"), ("c0", "d1"), ("d0", "a1")]
    edges = spark.createDataFrame([(a, "R", b) for a, b in pairs], "src string, rel string, dst string")
    got = {r["name"]: r["community_id"] for r in graph.communities(edges).collect()}
    best = modularity(pairs, {n: n[0] for p in pairs for n in p})
    assert modularity(pairs, got) >= best - 1e-9
    links = graph._weighted(edges)
    label = spark.createDataFrame([(n, n[0]) for n in got], "name string, c string")
    total = 2.0 * len(pairs)
    assert abs(graph.modularity_of(links, label, total) - best) < 1e-12
    assert abs(graph.modularity_of(links, None, total) - modularity(pairs, {n: n for n in got})) < 1e-12


def test_pagerank_with_cycles_and_loose_ends(spark):
    rng = random.Random(1)
    names = [f"n{i}" for i in range(30)]
    pairs = [(rng.choice(names[:25]), rng.choice(names)) for _ in range(90)]
    rank = dict.fromkeys(names, 1 / 30)
    for _ in range(300):
        loose = sum(rank[n] for n in names if not any(a == n for a, _ in pairs))
        after = {n: 0.15 / 30 + 0.85 * loose / 30 for n in names}
        for a, b in pairs:
            after[b] += 0.85 * rank[a] / sum(x == a for x, _ in pairs)
        rank = after
    top = max(rank.values())
    edges = spark.createDataFrame([(a, "R", b) for a, b in pairs], "src string, rel string, dst string")
    got = {r["name"]: r["score"] for r in graph.pagerank(spark.createDataFrame([(n,) for n in names], "name string"), edges).collect()}
    assert got.keys() == rank.keys() and all(abs(got[n] - rank[n] / top) < 1e-7 for n in names)


def test_a_path_carries_its_names(spark):
    edges = spark.createDataFrame([("a", "SIMILAR_TO", "b"), ("c", "SIMILAR_TO", "b"), ("c", "REQUIRES", "d"), ("a", "X", "e"), ("e", "X", "c")], "src string, rel string, dst string")
    assert graph.shortest_path(edges, "a", "d") == ["a", "b", "c", "d"]
    assert graph.shortest_path(edges, "c", "d") == ["c", "d"]
    assert graph.shortest_path(edges, "a", "nowhere") == ["a", "nowhere"]


def test_of_equal_keys_the_same_row_stays_however_rows_are_dealt(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, "x", 1), (1, "a", 3)], "k int, v string, n int")
    for parts in (1, 3, 7):
        dealt = rows.repartition(parts)
        assert sorted(map(tuple, sinks.upsert(rows.limit(0), dealt, ["k"]).collect())) == [(1, "b", 2), (2, "x", 1)]
        assert sorted(map(tuple, sinks.new_rows(dealt, rows.limit(0), "k").collect())) == [(1, "a", 3), (2, "x", 1)]
    nodes = spark.createDataFrame([("n", 1, "old"), ("n", 2, "new"), ("m", 1, "m")], "name string, ord int, label string")
    assert sorted((r["name"], r["label"]) for r in graph.upserted(nodes, "ord").collect()) == [("m", "m"), ("n", "new")]
    merged, linked = graph.merged(nodes.where("ord = 1").drop("ord"), spark.createDataFrame([("n", "R", "m")], "src string, rel string, dst string"), spark.createDataFrame([("n", "newest")], "name string, label string"), spark.createDataFrame([("n", "R", "m"), ("m", "R", "n")], "src string, rel string, dst string"))
    assert sorted(map(tuple, merged.collect())) == [("m", "m"), ("n", "newest")] and linked.count() == 2


def test_names_that_clash_with_temporary_ones(spark):
    rows = spark.createDataFrame([(1, 5, 6, 7), (1, 4, 6, 7)], "k int, new int, place int, row int")
    assert [tuple(r) for r in sinks.upsert(rows.limit(0), rows, ["k"]).collect()] == [(1, 5, 6, 7)]
    assert [tuple(r) for r in sinks.new_rows(rows, rows.limit(0).select("k"), "k").collect()] == [(1, 4, 6, 7)]
