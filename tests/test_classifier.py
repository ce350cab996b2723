"""The label model learns every label and is better than the commonest one on rows it hasn't seen."""

from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.operators import topics
from sparkloom.plans import queries


def test_all_labels_can_be_learned(spark):
    words = dict(zip(schemas.SENTIMENT_LABELS, ("sun warm", "wow stars", "plain desk", "doubt fake", "storm risk", "dark fear"), strict=True))
    rows = [(i, f"{w} number {i}", label) for label, w in words.items() for i in range(6)] + [(99, None, None), (98, "", None)]
    df = spark.createDataFrame(rows, "own_words int, text string, label string").withColumn("clean", F.lit("clash"))
    fitted = topics.fit_labels(df, "text", "label")
    asked = spark.createDataFrame([(1, f"a {w} day", label) for label, w in words.items()] + [(2, None, None)], "own_words int, text string, label string").withColumn("clean", F.lit("clash"))
    got = topics.classify(asked, "text", fitted)
    assert got.columns == [*asked.columns, "sentiment"]
    rows = got.collect()
    assert all(r["sentiment"]["label"] == r["label"] for r in rows if r["label"]) and all(0 < r["sentiment"]["score"] <= 1 for r in rows)


def test_held_out_accuracy(spark):
    rows = queries._labelled(spark, "/root/testdata/sf0.01").where("sentiment_label IS NOT NULL").withColumn("out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    fitted = topics.fit_labels(rows.where("NOT out"), "text", "sentiment_label")
    seen = topics.classify(rows.where("out"), "text", fitted).select("sentiment_label", "sentiment.label").collect()
    share = sum(r[0] == r[1] for r in seen) / len(seen)
    counts = [sum(r[0] == x for r in seen) / len(seen) for x in {r[0] for r in seen}]
    print("held-out accuracy", share, "commonest label", max(counts), len(seen))
    assert share > max(counts)
