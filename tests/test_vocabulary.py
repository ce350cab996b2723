"""The topics' vocabulary against Spark's own."""

from pyspark.ml.feature import CountVectorizer

from sparkloom.operators import topics


def test_vocabulary_is_that_of_the_vectorizer(spark):
    rows = spark.createDataFrame([(["a", "a", "b", "c"],), (["b", "a", "a"],), (["b", "a", "d", "d", "d", "d"],), (["b", "a", "d"],), (["b", "e"],), ([],)], "terms array<string>")
    want = CountVectorizer(inputCol="terms", outputCol="f", vocabSize=3, minDF=2.0, maxDF=0.8).fit(rows).vocabulary
    got = topics.Vocabulary("terms", "f", 3, 2.0, 0.8).fit(rows)
    assert sorted(got.vocabulary) == sorted(want) == ["a", "d"]
    assert got.transform(rows).first()["f"].toArray().tolist() == [2.0 if w == "a" else 0.0 for w in got.vocabulary]
