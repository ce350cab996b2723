"""Nearest documents of questions, by products: ties, a question without words, another dimension."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import cosines, retrieval


def test_hits_come_from_products(spark, monkeypatch):
    seen, real = [], cosines.nearest
    monkeypatch.setattr(cosines, "nearest", lambda *a: seen.append(1) or real(*a))
    concepts = spark.createDataFrame([(f"Name {i}", "red steel" if i % 2 else "blue brass", "c", "e", ["u"]) for i in range(9)], "name string, definition string, category string, difficulty string, example_use_cases array<string>")
    asked = spark.createDataFrame([(0, "Name 1", "red steel"), (1, None, "red steel"), (2, None, "")], "qid int, name string, question string")
    index = retrieval.indexed(None, concepts)
    got = sorted((r["qid"], r["rn"], r["name"], r["similarity"]) for r in retrieval.vector_hits(asked, index).collect())
    both = index.join(retrieval.embed(asked.select("qid", F.col("name").alias("own"), "question"), "question").withColumnRenamed("embedding", "q"))
    score = F.round(F.coalesce(F.try_divide(retrieval._dot("embedding", "q"), F.sqrt(retrieval._dot("embedding", "embedding")) * F.sqrt(retrieval._dot("q", "q"))), F.lit(0.0)), 5)
    rn = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "id"))
    want = sorted((r["qid"], r["rn"], r["name"], r["s"]) for r in both.withColumn("s", score).withColumn("rn", rn).where("rn <= 3 AND (own IS NULL OR name <> own)").collect())
    assert seen and got == want and [g[3] for g in got if g[0] == 2] == [0.0] * 3
