"""The topic model over packed counts against Spark's own stages and plain iteration."""

import numpy as np
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from sparkloom.functions.text import clean_text
from sparkloom.operators import mixtures, topics

ODD = ["Red cats, red CATS http://x.y/Z?q=1 redécats a b", "the red cats and the red dogs; cats", None, "", "123 !! 你好", "red\tcats\x0bdogs\nred", "dogs dogs dogs", "Dogs of httpred cats xhttp red"] * 3


def test_vocabulary_and_counts_are_those_of_the_stages(spark, sf):
    texts = spark.createDataFrame([(t,) for t in ODD], "text string").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("text")).repartition(5)
    texts = spark.createDataFrame(texts.collect(), "text string")
    for most in (4, 300):
        stages = topics.topic_pipeline(vocabulary=most).getStages()[:-1]
        clean = texts.select(clean_text(F.coalesce(F.col("text"), F.lit(""))).alias("clean"))
        model = Pipeline(stages=stages).fit(clean)
        terms = mixtures.vocabulary(texts, topics._stop_words(), most, 5.0, 0.9)
        assert terms == model.stages[-1].vocabulary
        want = [{int(i): int(v) for i, v in zip(r["features"].indices, r["features"].values, strict=True)} for r in model.transform(clean).collect()]
        starts, ids, counts = mixtures._counter(terms, topics._stop_words())(texts.toArrow().column("text").combine_chunks())
        assert [dict(zip(ids[a:b].tolist(), counts[a:b].tolist(), strict=True)) for a, b in zip(starts[:-1], starts[1:], strict=True)] == want


def test_rows_come_to_rest_where_plain_steps_do():
    draw = np.random.default_rng(1)
    beta, alpha = draw.dirichlet(np.full(40, 0.1), 3) + 1e-6, np.array([0.1, 0.5, 0.3])
    starts = np.array([0, 0, 1, 31, 71])
    ids, counts = np.concatenate([[7], np.arange(30), np.arange(40)]), draw.integers(1, 30, 71)
    got = mixtures.at_rest(starts, ids, counts, beta, alpha)
    assert got[0].tolist() == alpha.tolist()
    for row in range(1, 4):
        own, c = ids[starts[row] : starts[row + 1]], counts[starts[row] : starts[row + 1]]
        g = np.ones(3)
        for _ in range(20_000):
            t = np.exp(mixtures.digamma(g))
            g = alpha + t * (beta[:, own] @ (c / (t @ beta[:, own])))
        assert np.abs(got[row] - g).max() < 0.5 and got[row].argmax() == g.argmax()
        assert abs(got[row].sum() - alpha.sum() - c.sum()) < 1e-6


def test_topics_do_not_depend_on_how_rows_are_dealt_and_find_planted_ones(spark):
    own = [("cat dog bird fish " * 5,), ("iron zinc lead gold " * 5,)] * 40 + [(None,), ("",)]
    texts = spark.createDataFrame(own, "text string")
    terms = mixtures.vocabulary(texts, [], 100, 2.0, 0.9)
    one, four = (mixtures.fit(texts.repartition(n), terms, [], 2, 30, 5, offset=1.0) for n in (1, 4))
    assert np.allclose(one.weights, four.weights, rtol=1e-3) and np.allclose(one.alpha, four.alpha, rtol=1e-3)
    animals = [{w for t in words for w in t.split()} <= {"cat", "dog", "bird", "fish"} for words in one.top_terms(4)]
    assert sorted(animals) == [False, True]


def test_special_functions():
    x = np.array([0.01, 0.5, 1.0, 7.0, 1e4])
    step = 1e-5 * x
    assert np.allclose(mixtures.digamma(np.array([1.0, 0.5])), [-0.5772156649015329, -1.9635100260214235], rtol=1e-9)
    assert np.allclose((mixtures.digamma(x + step) - mixtures.digamma(x - step)) / (2 * step), mixtures.trigamma(x), rtol=1e-5)
