import json

from pyspark.sql import functions as F

from sparkloom.sources import files, sinks
from sparkloom.streaming import ingest


def test_corpus(spark, tmp_path):
    (tmp_path / "b_wiki.txt").write_text("  text b \n")
    (tmp_path / "a_seed.md").write_bytes(b"caf\xc3\xa9")
    (tmp_path / "skip.csv").write_text("x")
    got = sorted(tuple(r) for r in files.corpus(spark, str(tmp_path)).collect())
    assert got == [("a_seed.md", "café"), ("b_wiki.txt", "text b")]
    stats = files.corpus_stats(spark, str(tmp_path)).first()
    assert (stats["files"], stats["bytes"]) == (2, 15)
    assert [r["source_file"] for r in files.corpus_files(spark, str(tmp_path)).collect()] == ["a_seed.md", "b_wiki.txt"]


def test_seed_defaults(spark, tmp_path):
    path = tmp_path / "seed.json"
    path.write_text(json.dumps({"concepts": [{"name": "A", "definition": "d"}], "relationships": [{"source": "A", "rel_type": "IS_A", "target": "B"}]}, indent=1))
    concepts, relationships = files.seed(spark, str(path))
    row = concepts.first()
    assert (row["category"], row["difficulty"], row["related_tools"]) == ("Concept", "intermediate", [])
    assert relationships.first()["target"] == "B"


def test_dialogue_order_and_profiles(spark, tmp_path):
    (tmp_path / "2.json").write_text(json.dumps([{"character": "A", "dialogue": "z", "source": "2"}]))
    (tmp_path / "1.json").write_text(json.dumps([{"character": "A", "dialogue": x, "source": "1"} for x in "xy"]))
    assert [r["dialogue"] for r in files.dialogue(spark, str(tmp_path)).orderBy("file", "pos").collect()] == ["x", "y", "z"]
    folder = tmp_path / "p"
    folder.mkdir()
    for name, style in (("a", "old"), ("b", "new")):
        (folder / f"{name}.json").write_text(json.dumps({"character": "C", "speech_style": style}))
    assert files.profiles(spark, str(folder)).first()["speech_style"] == "new"


def test_documents_and_feeds(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"ok \xff")
    (tmp_path / "y.pdf").write_bytes(b"%PDF")
    texts = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.documents(spark, str(tmp_path)).where("path LIKE '%.txt'").collect()}
    assert texts["x.txt"] == "ok �"
    feed = spark.createDataFrame([("<feed><title>F</title><entry><title>T\n 1</title><summary> S  1</summary></entry></feed>",)], "xml string")
    assert [tuple(r) for r in files.feed_entries(feed).collect()] == [("T 1", "S 1")]


def test_upsert_and_append(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2), ("c", 2)], "k string, v int")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    assert sorted(map(tuple, sinks.new_rows(new, old, "k").collect())) == [("c", 2)]
    sinks.append_new(new, old, "k", str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    sinks.write_csv(old, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["k", "v"]
    sinks.write_json(old, str(tmp_path / "json"), by="k")
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_streams_are_idempotent(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = tmp_path / "in"
    events.where("event_id % 2 = 0").write.parquet(str(folder))
    target, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):
        ingest.append_unseen(ingest.stream(spark, str(folder), events.schema), "event_id", target, check).awaitTermination()
        events.where("event_id % 3 = 0").write.mode("append").parquet(str(folder))
    ingest.append_unseen(ingest.stream(spark, str(folder), events.schema), "event_id", target, check).awaitTermination()
    got = spark.read.parquet(target)
    want = events.where("event_id % 2 = 0 OR event_id % 3 = 0").count()
    assert got.count() == want == got.select("event_id").distinct().count()


def test_streamed_trend_matches_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = tmp_path / "in"
    events.write.parquet(str(folder))
    live = ingest.daily_trend(ingest.deduplicated(ingest.timed(ingest.stream(spark, str(folder), events.schema, 100), late="60 days"), "event_id"))
    query = live.writeStream.format("memory").queryName("trend").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    late = {(r["period"], r["event_type"]): r["cnt"] for r in spark.table("trend").collect()}
    batch = {(r["p"], r["event_type"]): r["n"] for r in events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("p"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(batch[k] == n for k, n in late.items())


def test_upsert_versions(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int").coalesce(1).write.parquet(folder)
    rows = ingest.stream(spark, folder, "k string, v int")
    ingest.upsert_versions(rows, ["k"], "v", str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([("a", 2)], "k string, v int").coalesce(1).write.mode("append").parquet(folder)
    ingest.upsert_versions(ingest.stream(spark, folder, "k string, v int"), ["k"], "v", str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/v=1")).collect())) == [("a", 2), ("b", 1)]
