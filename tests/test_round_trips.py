"""What the sinks write is what the sources read."""

import json

from sparkloom.sources import files, sinks


def test_one_character_is_replaced_and_the_others_stay(spark, tmp_path):
    path = str(tmp_path / "lines")
    both = spark.createDataFrame([("bob", "hi"), ("ann", "yo")], "character string, line string")
    sinks.write_json(both, path, "character")
    sinks.write_json(spark.createDataFrame([("bob", "new")], "character string, line string"), path, "character")
    assert sorted((r["character"], r["line"]) for r in spark.read.json(path).collect()) == [("ann", "yo"), ("bob", "new")]


def test_communities_come_back(spark, tmp_path):
    rows = [(i, [f"n{i}", "m"], f"summary {i}", []) for i in range(6)]
    path = str(tmp_path / "communities")
    sinks.write_json(spark.createDataFrame(rows, "community_id int, node_names array<string>, summary string, key_concepts array<string>"), path)
    got = sorted((r["community_id"], list(r["node_names"]), r["summary"]) for r in files.communities(spark, path).collect())
    assert got == [(i, [f"n{i}", "m"], f"summary {i}") for i in range(6)]
    (tmp_path / "array.json").write_text(json.dumps([{"community_id": 3, "node_names": ["x"], "summary": "s"}], indent=1))
    assert [(r["community_id"], r["summary"]) for r in files.communities(spark, str(tmp_path / "array.json")).collect()] == [(3, "s")]
    (tmp_path / "broken.json").write_text("[{nothing")
    assert files.communities(spark, str(tmp_path / "broken.json")).collect() == []
    assert files.communities(spark, str(tmp_path / "absent.json")).collect() == []


def test_ids_that_are_done(spark, tmp_path):
    path = str(tmp_path / "done")
    assert sinks.done_ids(spark, path).count() == 0
    chunks = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    sinks.mark_done(chunks, path)
    sinks.mark_done(chunks.limit(1), path)
    assert sorted(r[0] for r in sinks.done_ids(spark, path).collect()) == ["a", "b"]


def test_rich_text_without_a_parser():
    source = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\gen x;}\f0 Caf\'e9 \{one\}\par two\tab\u8364?\line end\par}"
    assert files.rtf_text(source) == "Café {one}\ntwo\t€\nend\n"
