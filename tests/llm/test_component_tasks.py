"""Rounds of ``components``: right for any number of partitions, and few tasks for few edges."""

import random

import pytest

from sparkloom.llm import simhash

SETTINGS = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def many(spark):
    """As many shuffle partitions as are set, however few rows there are."""
    old = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def edges():
    """A chain, a star and random edges with repeats and loops, under shuffled numbers; and the smallest reachable node of each."""
    rng = random.Random(5)
    names = rng.sample(range(10**6), 900)
    pairs = [(i, i + 1) for i in range(200)] + [(300, i) for i in range(301, 400)] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(260)]
    pairs = [(names[a], names[b]) for a, b in [*pairs, *pairs[::7]]]
    parent = {n: n for p in pairs for n in p if p[0] != p[1]}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        if a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    return pairs, {n: root(n) for n in parent if root(n) != n}


@pytest.mark.parametrize("rows", [40, 100, 20_000])
def test_components_of_any_partitions(many, monkeypatch, rows):
    monkeypatch.setattr(simhash, "ROUND_ROWS", rows)
    pairs, want = edges()
    got = simhash.components(many.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


def test_few_edges_take_few_tasks(many):
    context, tracker = many.sparkContext, many.sparkContext.statusTracker()
    pairs, want = edges()
    context.setJobGroup("component-tasks", "components of few edges")
    try:
        assert simhash.components(many.createDataFrame(pairs, "a long, b long")).count() == len(want)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for job in tracker.getJobIdsForGroup("component-tasks") for s in tracker.getJobInfo(job).stageIds}
    assert 0 < sum(s.numCompletedTasks for s in map(tracker.getStageInfo, stages) if s) < 6 * 48


def test_no_edges(many):
    assert simhash.components(many.createDataFrame([(4, 4)], "a long, b long")).collect() == []
