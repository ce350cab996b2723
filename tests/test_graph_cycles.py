"""Cycles, long chains and communities against plain versions."""

import random

import pytest

from sparkloom.operators import graph
from sparkloom.sources import tables


def made(spark, pairs, rel="REQUIRES"):
    return spark.createDataFrame([(a, rel, b) for a, b in pairs], "src string, rel string, dst string")


def parts_of(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in out[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    far = {a: reach(a) for a in out}
    return {a: min(b for b in out if b in far[a] and a in far[b]) for a in out if any(b != a and a in far[b] for b in far[a])}


@pytest.mark.parametrize("seed", [1, 2])
def test_strongly_connected_parts(spark, seed):
    draw = random.Random(seed)
    pairs = [(f"n{draw.randrange(24):02d}", f"n{draw.randrange(24):02d}") for _ in range(30)] + [("x", "x")]
    got = {r["name"]: r["part"] for r in graph.strongly_connected(made(spark, pairs)).collect()}
    assert got == parts_of(pairs)


def test_cycles_stand_together_at_their_level(spark):
    pairs = [("goal", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "e"), ("e", "d"), ("e", "leaf"), ("goal", "goal")]
    got = {r["name"]: r["level"] for r in graph.curriculum(made(spark, pairs), spark.createDataFrame([("goal",)], "name string")).collect()}
    assert got["leaf"] < got["d"] == got["e"] < got["a"] == got["b"] == got["c"] < got["goal"]


def test_target_on_a_cycle(spark):
    got = {r["name"]: r["level"] for r in graph.curriculum(made(spark, [("a", "b"), ("b", "a"), ("b", "c")]), spark.createDataFrame([("a",)], "name string")).collect()}
    assert got["c"] < got["b"] < got["a"]


def test_communities_of_the_whole_graph_beat_a_greedy_run(spark):
    """At sf0.01: rows, and a modularity at least that of moving one node after another."""
    edges = tables.concept_edges(spark, "/root/testdata/sf0.01")
    links = graph._weighted(edges).cache()
    total = float(sum(r["w"] for r in links.select("w").collect()))
    found = graph.communities(edges)
    assert found.count() > 2000
    name = found.select("name", found["community_id"].cast("string").alias("c"))
    greedy = graph.in_turn([tuple(r) for r in links.collect()], total)
    other = spark.createDataFrame(list(greedy.items()), "name string, c string")
    assert graph.modularity_of(links, name, total) >= graph.modularity_of(links, other, total) - 0.002


def test_every_parallel_round_raises_modularity(spark):
    draw = random.Random(7)
    pairs = {(f"n{a}", f"n{b}") for a, b in ((draw.randrange(60), draw.randrange(60)) for _ in range(300)) if a != b and (a % 3 == b % 3 or draw.random() < 0.2)}
    edges = made(spark, pairs)
    links = graph._weighted(edges).cache()
    total = float(links.groupBy().sum("w").first()[0])
    with graph.Scratch(spark) as scratch:
        alone = links.selectExpr("a AS name", "a AS c").distinct()
        last = graph.modularity_of(links, alone, total)
        for rounds in (1, 2, 4):
            label, moves = graph._moved(links, total, alone, 1.0, 0.0, scratch.kept, rounds)
            now = graph.modularity_of(links, label, total)
            assert moves and now > last
            last = now
