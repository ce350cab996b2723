"""Rows without a doc_id link others, as brute force over all fingerprints has it."""

import random

import pytest

from sparkloom.llm import simhash


def plain(rows, bits=2):
    """Component of each row: the smallest doc_id reachable over fingerprints, null if there is none."""
    fps = sorted({f for _, f in rows})
    part = {f: f for f in fps}

    def root(f):
        while part[f] != f:
            f = part[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                part[root(a)] = root(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return sorted(((i, f, least.get(root(f))) for i, f in rows), key=str)


@pytest.mark.parametrize("rows", [[(1, 0), (None, 3), (2, 15)], [(None, 0), (None, 1), (5, 1 << 40)], [(7, 0), (None, 1), (None, 7), (3, 31), (9, 127)], [(None, 5)], []])
def test_null_ids_are_bridges(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "fingerprints", lambda df: df)
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    assert sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str) == plain(rows)


def test_random_chains_with_nulls(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprints", lambda df: df)
    draw, rows, fp = random.Random(6), [], 0
    for i in range(150):
        fp = draw.getrandbits(62) if draw.random() < 0.15 else fp ^ (1 << draw.randrange(62)) ^ (1 << draw.randrange(62))
        rows.append((None if draw.random() < 0.4 else draw.randrange(10_000), fp))
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    assert sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str) == plain(rows)
