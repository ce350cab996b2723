"""Repeats in fragments longer than the depth to which suffixes are sorted."""

import random

import numpy as np

from sparkloom.llm import repeats

from .test_queries import brute_repeats


def test_repeats_longer_than_the_sort_depth(spark):
    """List-like passages stay in one fragment: a gram that is the least recurs on every line."""
    rng = random.Random(5)
    grams = ["".join(rng.choice("abcdefgh ") for _ in range(16)) for _ in range(20_000)]
    least = grams[int(np.argmin(repeats._anchors(np.frombuffer("".join(grams).encode(), np.uint8), 16, 16)[::16]))]
    rows = []
    for n in range(12):
        lines = "".join(f"{rng.randrange(10**6):06} {least}\n" for _ in range(30))
        for k in range(3):
            cut = lines[rng.randrange(20) : len(lines) - rng.randrange(20)]
            rows.append((3 * n + k, f"{rng.random()} {cut}{rng.random()}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in repeats.remove_repeats(df, keep_text=False).collect()) == brute_repeats(rows)
