"""The vectors of a new index: the words' hashes, made once a row is kept."""

from pyspark.sql import functions as F

from sparkloom.operators import retrieval


def test_slots_are_those_of_the_hash(spark):
    texts = spark.createDataFrame([("Red steel, red BRASS",), ("",), (None,), ("ÄÖ x_1 x_1",)], "t string")
    got = [list(r["embedding"]) for r in retrieval.embed(texts, "t", 8).collect()]
    slots = F.transform(F.filter(retrieval.tokens(F.lower("t")), lambda w: w != ""), lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % 8).cast("int"))
    want = texts.select(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float")).alias("v"))
    assert got == [list(r["v"]) for r in want.collect()]


def test_a_new_index_sends_no_vectors(spark):
    concepts = spark.createDataFrame([("A b", "d", "c", "e", ["u"]), ("a B", "d2", "c", "e", [])], "name string, definition string, category string, difficulty string, example_use_cases array<string>")
    made = retrieval.indexed(None, concepts)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "to_json" not in plan and made.count() == 1
