"""Links between hashed names: summed where they are packed, and numbered by name where hashes clash."""

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import graph, packed
from sparkloom.session import Scratch


def test_packing_sums_links_and_knows_their_weights(spark, monkeypatch):
    monkeypatch.setattr(packed, "BUCKET_LINKS", 3)
    draw = np.random.default_rng(3)
    ends = [(int(a) * 2**58 - 5, int(b) * 2**58 - 5) for a, b in draw.integers(-9, 9, (60, 2))]
    links = spark.createDataFrame([(a, b, 1.0) for x, y in ends for a, b in ((x, y), (y, x))], "a long, b long, w double")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    with Scratch(spark) as scratch:
        level = packed.pack(links, 120, scratch.kept)
        summed = links.groupBy("a", "b").agg(F.sum("w").alias("w"))
        assert level.size() == (120.0, summed.count()) and level.parts == 40
        assert key(level.degrees()) == key(links.groupBy("a").agg(F.sum("w")))
        assert key(packed.lifted(level, links.select(F.col("a").alias("name"), F.col("a").alias("c")).distinct())) == key(summed)


def test_clashing_hashes_change_nothing(spark, monkeypatch):
    names = ["ab", "ac", "ad", "ba", "bb", "bc", "ca", "cb", "cc"]
    pairs = [(x, y) for i in (0, 3, 6) for x in names[i : i + 3] for y in names[i : i + 3] if x < y] * 2 + [("ab", "ba"), ("ba", "ca"), ("ab", "ab"), (None, "ab")]
    edges = spark.createDataFrame(pairs, "src string, dst string").withColumn("rel", F.lit("r"))
    found = lambda: sorted(tuple(r) for r in graph.communities(edges).collect())
    want = found()
    assert want == [(i, 3, n) for i in range(3) for n in names[3 * i : 3 * i + 3]] or want == [(i + 1, 3, n) for i in range(3) for n in names[3 * i : 3 * i + 3]]
    monkeypatch.setattr(graph, "_hash", lambda name: F.ascii(name).cast("long"))
    assert found() == want


def test_no_edges_no_communities(spark):
    assert graph.communities(spark.createDataFrame([("a", "r", "a")], "src string, rel string, dst string")).count() == 0
