"""Nearest vectors by matrix products against the score of every pair, one by one."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import cosines, retrieval


def one_by_one(rows, asked, k):
    both = rows.join(asked).select("q_id", "vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("q")), 5).alias("similarity"))
    return both.withColumn("rn", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("similarity"), "vec_id"))).where(F.col("rn") <= k)


def test_nearest_scores_no_pair_by_itself(spark, monkeypatch):
    """Copies, near ties, slices and queries of several blocks: the rows of scoring each pair, without doing so."""
    draw = random.Random(8)
    vecs = [[draw.choice([-1.0, 0.5, 1.0, draw.gauss(0, 1)]) for _ in range(6)] for _ in range(40)]
    rows = [(i, vecs[0] if i % 4 == 0 else [x * draw.choice([1.0, 2.0, 3.0]) for x in vecs[i % 40]]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    want = sorted(map(tuple, one_by_one(df, asked, 3).collect()))
    for name, value in (("ROWS", 16), ("QUERIES", 7), ("MAX_BROADCAST_ROWS", 11)):
        monkeypatch.setattr(cosines, name, value)
    got = retrieval.nearest(df, asked, 3)
    assert "zip_with" not in str(cosines.nearest(df, "embedding", "vec_id", asked, "q", 3)._jdf.queryExecution().optimizedPlan())
    assert sorted(map(tuple, got.collect())) == want


def test_odd_vectors_are_scored_too(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, None]), (3, None), (4, [1.0, 2.0, 3.0]), (None, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 2.0, 3.0]), (2, [0.2, 0.7])], "q_id long, q array<double>")
    key = lambda d: sorted(map(repr, d.collect()))
    assert key(retrieval.nearest(df, asked, 6)) == key(one_by_one(df, asked, 6))
