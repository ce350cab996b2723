"""Near-duplicates of the pipeline's stage against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from sparkloom.llm import mixing, overlap, quality, simhash

from .test_pipeline import blanked
from .test_queries import brute_components


def brute_kept(rows):
    def grams(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {d: grams(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sorted(d for d in sets if root(d) == d)


def test_edited_copies_count_as_one(spark):
    """Copies with a few words changed lie many bits apart in their fingerprints."""
    rng = random.Random(11)
    rows, n = [], 0
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for edits in (0, 1, 2, 2, 3, 5, 12):
            own = list(words)
            for _ in range(edits):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((n, " ".join(own)))
            n += 1
    rng.shuffle(rows)
    want = brute_kept(rows)
    got = sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want
    assert len(want) < len(set(brute_components({r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}).values()))


def test_same_documents_stay_as_by_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == brute_kept(rows)


def test_a_large_group_is_checked_once_per_row():
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([*words[:100], f"x{i}", *words[100:]]).encode() for i in range(400)]
    assert overlap.linked(list(range(400)), [overlap.shingles(t) for t in texts]) == [0] * 400


def brute_component(rows):
    sets = {d: set(overlap.shingles(t.encode()).tolist()) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: root(d) for d in sets}


def chains(rng):
    """Texts that drift away from their start step by step, and copies of it, in groups that also share much of their text."""
    rows = []
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    for _ in range(4):
        words = base[:90] + [f"g{rng.randrange(10**6)}" for _ in range(30)]
        for step in range(25):
            if step < 12:
                words = list(words)
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            own = list(words)
            own[rng.randrange(len(own))] = f"y{rng.randrange(10**6)}"
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("unit_rows", "unit_bytes"), [(6, 10**9), (20, 10**9), (10**6, 4000), (10**6, 10**9)])
def test_units_of_any_size_give_the_same(spark, unit_rows, unit_bytes):
    rows = chains(random.Random(3))
    want = brute_component(rows)
    assert 4 <= len(set(want.values())) < len(rows)
    got = overlap.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), unit_rows, unit_bytes).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(rows)


def test_blocks_leave_nothing_open_unchecked(spark):
    """Rows of one key in known components: every two rows of different components meet in some block."""
    rng = random.Random(6)
    members = [(n, rng.choice((0, 0, 0, 1, 2, n)), 10, np.full(overlap.BANDS, 7, np.int64).tobytes()) for n in range(200)]
    blocks = {}
    for r in overlap._open_keys(spark.createDataFrame(members, "node long, known long, size long, bands binary"), 16, 10**9).collect():
        blocks.setdefault((r["i"], r["j"]), []).append((r["node"], r["known"]))
    assert max(map(len, blocks.values())) < 100
    met = {(a, b) for own in blocks.values() for a, _ in own for b, _ in own}
    assert all((a, b) in met for a, x, *_ in members for b, y, *_ in members if x != y)


def test_pipeline_with_this_rule(spark, sf, docs):
    """All stages by brute force, with this rule for near-duplicates."""
    kept = {r["doc_id"] for r in quality.assess(docs).where("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in kept}
    first = set(brute_kept(list(texts.items())))
    rows = [(r["doc_id"], blanked(r["text"]), r["source"]) for r in docs.collect() if r["doc_id"] in first]
    placed = mixing.place(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    times = {r["doc_id"]: r["epochs"] for r in placed.collect() if r["epochs"]}
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()) == times
