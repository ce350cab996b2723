"""Names in questions without all pairs, approximate neighbours, and the exact median, against plain versions."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from sparkloom import columns
from sparkloom.functions.scoring import entity_score
from sparkloom.operators import dialogue, matching, retrieval, vectors
from sparkloom.plans import queries


def test_pairs_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "NAMES_AT_ONCE", 3)
    asked = [(0, "What is a Vector Database?"), (1, "vector"), (2, ""), (3, None), (4, "the red widget of brand"), (5, "İstanbul red-widget"), (6, "what is the")]
    names = [(0, "Vector Database"), (1, "vector"), (2, "red widget"), (3, ""), (4, None), (5, "the"), (6, "İstanbul"), (7, "tor data"), (8, "Red"), (9, "vector")]
    q = spark.createDataFrame(asked, "qid int, question string")
    n = spark.createDataFrame(names, "ord int, name string")
    want = q.crossJoin(n).select("qid", "ord", F.round(entity_score(F.col("question"), F.col("name")), 9).alias("score")).where("score > 0")
    got = matching.scored(q, n).select("qid", "ord", F.round("score", 9).alias("score"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert matching.scored(q.limit(0), n).count() == 0 and matching.scored(q, n.limit(0)).count() == 0


def test_question_blocks_change_nothing(spark, sf, monkeypatch):
    q, n = queries._asked(spark, sf), queries._labels(spark, sf)
    whole = sorted(map(tuple, matching.contained(q, n).collect()))
    monkeypatch.setattr(matching, "MAX_BROADCAST_ROWS", 7)
    assert whole and sorted(map(tuple, matching.contained(q, n).collect())) == whole


def test_questions_from_tables_find_names(spark, sf):
    best = [r for r in queries.entity_best(spark, sf).collect() if r["qid"] >= 0]
    assert len(best) > 10 and all(r["confidence"] > 0.5 for r in best if r["name"] is not None)


@pytest.mark.parametrize("size", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_indexed_search_finds_most_neighbours(spark, size):
    found, exact = queries.cosine_topk_indexed(spark, size), queries.cosine_topk(spark, size)
    assert vectors.recall(found, exact) >= 0.9
    assert found.count() == exact.count()


def test_index_holds_every_usable_vector(spark, tmp_path):
    draw = random.Random(4)
    rows = [(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [1.0] * 5), (5, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = vectors.build(df, 10)
    assert index.rows.count() == 301
    # All lists probed: the exact answer.
    asked = df.where("vec_id % 100 = 0 AND vec_id < 900").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    found = vectors.search(index, asked, 3, probes=10)
    exact = retrieval.nearest(df.where("vec_id < 900"), asked, 3)
    key = lambda d: sorted((r["q_id"], r["rn"], r["vec_id"]) for r in d.collect())
    assert key(found) == key(exact)
    vectors.write(index, str(tmp_path / "index"))
    again = vectors.Index(spark.read.parquet(str(tmp_path / "index")), index.centres)
    assert key(vectors.search(again, asked, 3, probes=10)) == key(exact)
    assert vectors.search(vectors.build(df.limit(0)), asked).count() == 0
    assert vectors.search(index, asked.limit(0)).count() == 0


@pytest.mark.parametrize("values", [[], [None], [3.0], [1.0, 2.0], [2.0, 2.0, 2.0], [1e300, -1e300, 0.0, 5.0], [1.0, 1.0 + 2**-52, 1.0 + 2**-51], [float(i * i % 997) for i in range(2001)], [0.1 * i for i in range(1000)] + [1e9] * 999])
def test_median_is_exact(spark, values, monkeypatch):
    monkeypatch.setattr(columns, "MEDIAN_BINS", 16)
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    own = [v for v in values if v is not None]
    assert columns.median(df, F.col("v")) == (statistics.median(own) if own else None)


def test_sequence_stats_of_nothing(spark):
    df = spark.createDataFrame([], "t int")
    assert dialogue.sequence_stats(df, F.col("t")).first()["median_tokens"] is None
