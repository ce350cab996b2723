"""Paths, plans, reports and corpus coverage as flows; small operators that no query reaches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.columns import first_rows
from sparkloom.functions import text
from sparkloom.operators import content, dialogue, graph, retrieval, topics
from sparkloom.plans import flows
from sparkloom.sources import files, sinks


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture
def concepts(spark):
    made = [(n, f"{n} is a thing. More.", "Concept", "intermediate") for n in ("Attention", "Transformer", "BERT", "Island")]
    return spark.createDataFrame(made, "name string, definition string, category string, difficulty string")


@pytest.fixture
def edges(spark):
    return spark.createDataFrame([("BERT", "IS_A", "Transformer"), ("Transformer", "REQUIRES", "Attention"), ("Attention", "REQUIRES", "Vectors")], "src string, rel string, dst string")


def test_learning_path(spark, concepts, edges):
    way = flows.learning_path(concepts, edges, "bert", "ATTENTION").orderBy("place").collect()
    assert [(r["place"], r["name"], r["category"]) for r in way] == [(0, "BERT", "Concept"), (1, "Transformer", "Concept"), (2, "Attention", "Concept")]
    assert rows(flows.learning_path(concepts, edges, "BERT", "Island"), "place", "name") == [(0, "BERT"), (1, "Island")]
    assert flows.learning_path(concepts, edges, "BERT", "Vectors").count() == 0  # no concept of that name
    assert flows.learning_path(concepts.limit(0), edges, "BERT", "Attention").count() == 0


def test_study_plan(spark, concepts, edges):
    plan = flows.study_plan(concepts, edges, "bert")
    assert [r["name"] for r in plan.orderBy("level").collect()] == ["Attention", "Transformer", "BERT"]  # Vectors has no card
    assert rows(flows.study_plan(concepts, edges, "bert", " attention , "), "name") == [("BERT",), ("Transformer",)]
    assert flows.study_plan(concepts, edges, "nothing").count() == 0


def test_validated(spark):
    made = spark.createDataFrame([("x", "one", "a b c d e"), ("x", "one", None), ("y", None, "abcdefgh"), (None, "two", "abcd")], "character string, assistant string, whole string")
    got = {(r["section"], r["name"], r["measure"]): r["value"] for r in flows.validated(made, low=2).collect()}
    assert got["class", "x", "cnt"] == 2 and got["class", "x", "low"] == 0 and got["class", "y", "low"] == 1 and got["class", None, "cnt"] == 1
    assert got["class", "y", "avg_tokens"] is None
    assert got["duplicates", None, "groups"] == 1 and [v for (s, n, m), v in got.items() if s == "duplicates" and n] == [2]
    assert (got["sequence", None, "max_tokens"], got["sequence", None, "median_tokens"], got["sequence", None, "too_long"]) == (2, 2, 0)
    assert (got["balance", None, "most"], got["balance", None, "ratio"]) == (2, 2)
    none = {(r["section"], r["measure"]): r["value"] for r in flows.validated(made.limit(0)).collect()}
    assert none["duplicates", "groups"] == 0 and none["sequence", "too_long"] == 0 and none["balance", "most"] is None


def test_covered_and_seeded(spark):
    names = spark.createDataFrame([("Graph",), ("Big Model",), ("Other",), ("Other",), ("Bare",), (None,)], "name string")
    have = spark.createDataFrame([("Graph_RAG_wiki.txt",), ("Big_Model_a.md",), ("Big_Model.txt",), (None,)], "source_file string")
    assert rows(retrieval.covered(names, have), "name", "covered") == sorted([("Graph", True), ("Big Model", False), ("Other", False), ("Other", False), ("Bare", False), (None, False)], key=str)
    known = spark.createDataFrame([("Other", "What it is.", ["u"]), ("Big Model", "Big.", []), ("Bare", "", None), ("Graph", "Has a file.", [])], "name string, definition string, example_use_cases array<string>")
    got = dict(rows(retrieval.seeded(names, have, known), "source_file", "text"))
    assert sorted(got) == ["Big_Model_seed.txt", "Other_seed.txt"]
    assert got["Other_seed.txt"].startswith("# Other\n") and "What it is." in got["Other_seed.txt"] and "- u" in got["Other_seed.txt"]
    again = spark.createDataFrame([(n,) for n in got], "source_file string")
    assert retrieval.seeded(names, have.union(again), known).count() == 0


def test_first_rows_with_every_kind_of_column(spark):
    schema = "k int, s string, a array<int>, m map<string,int>, `d.t` double"
    made = [(1, "b", [2], {"x": 1}, 1.0), (1, "a", [3], None, None), (1, "a", [1], {"y": 2}, 2.0), (None, None, None, None, None), (None, "z", [], {}, 0.0)]
    df = spark.createDataFrame(made, schema)
    got = sorted(map(tuple, first_rows(df, ["k"]).collect()), key=str)
    assert got == sorted([(1, "a", [1], {"y": 2}, 2.0), (None, None, None, None, None)], key=str)
    assert first_rows(df, ["k"]).columns == df.columns
    flat = df.select("k", "s", "`d.t`")
    assert sorted(map(tuple, first_rows(flat, ["k"], "s").collect()), key=str) == sorted([(1, "a", None), (None, None, None)], key=str)
    assert first_rows(flat.limit(0), ["k"]).count() == 0


# Operators that no registered query reaches


def test_seed_document_and_profile_text(value):
    doc = value(lambda n, d: text.seed_document(n, F.lit("Concept"), F.lit(None), d, F.array(F.lit("u")), F.array().cast("array<string>"), F.lit(None).cast("array<string>")), "Name", "What it is.")
    assert doc.startswith("# Name\n") and "Category: Concept | Difficulty: " in doc and "- u" in doc and "Related Tools" not in doc
    assert value(lambda n, d: text.seed_document(n, d, d, d, F.array(d), F.array(d), F.array(d)), "Name", None) is None
    said = value(lambda t, d, x: text.profile_text(t, d, x), [f"t{i}" for i in range(9)], "x" * 600, ["l1", "l2"])
    assert said == "Personality: " + ", ".join(f"t{i}" for i in range(8)) + "\nBackground: " + "x" * 500 + "\nLines: l1 | l2"
    assert value(lambda t, d, x: text.profile_text(t, d, x), [], "", []) == ""


def test_from_epoch_and_usable_extract(spark, value):
    assert value(lambda s: text.from_epoch(s).cast("timestamp_ntz"), 86_400) == dt.datetime(1970, 1, 2)
    assert value(lambda s: text.usable_extract(s), "x" * 200) is not False
    assert not value(lambda s: text.usable_extract(s), "x")


def test_listing_by_time_and_limit(spark):
    day = 86_400
    posts = spark.createDataFrame([("a", 5, 99 * day), ("b", 9, 60 * day), ("c", 7, 98 * day), ("d", 1, 99 * day)], "id string, score long, created_utc long")
    comments = spark.createDataFrame([("a", 0, "[deleted]"), ("a", 1, "x"), ("a", 2, "y"), ("b", 0, "z"), ("d", 0, "w")], "post_id string, turn int, body string")
    top, said = content.listing(posts, comments, "1970-04-11 00:00:00", "month", 2, 2)
    assert rows(top, "id") == [("a",), ("c",)] and rows(said, "post_id", "body") == [("a", "x")]
    top, said = content.listing(posts, comments, "1970-04-11 00:00:00", "all", 1, 2)
    assert rows(top, "id") == [("b",)] and rows(said, "body") == [("z",)]


def test_enriched_at_hop_and_similar(spark, concepts, edges):
    reach = graph.depths(edges, spark.createDataFrame([("BERT",)], "name string"), 2)
    assert rows(graph.at_hop(reach, 2), "name") == [("Attention",)]
    assert rows(graph.enriched(reach, concepts), "name", "category", "depth") == [("Attention", "Concept", 2), ("BERT", "Concept", 0), ("Transformer", "Concept", 1)]
    alike = spark.createDataFrame([("A", "SIMILAR_TO", "B"), ("A", "REQUIRES", "C")], "src string, rel string, dst string").unionByName(edges)
    nodes, touching = graph.similar(alike, spark.createDataFrame([("A",)], "name string"))
    assert "C" not in [r["name"] for r in nodes.collect()]


def test_graph_and_line_round_trips(spark, edges, tmp_path):
    nodes = spark.createDataFrame([("BERT", "Model")], "name string, category string")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    back, links = graph.read(spark, str(tmp_path / "g"))
    assert rows(back, "*") == rows(nodes, "*") and rows(links, "src", "rel", "dst") == rows(edges, "src", "rel", "dst")
    (tmp_path / "t.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    assert rows(files.json_lines(spark, str(tmp_path / "t.jsonl"), "a int, b string"), "a", "b") == [(1, "x"), (2, None)]


def test_related_names_and_comparison(spark, value):
    names = spark.createDataFrame([(0, "Vector Search"), (1, "Graph"), (2, "Search")], "ord int, name string")
    assert [tuple(r) for r in retrieval.related_names(names, "what is vector search", 2).collect()] == [("Vector Search", 2), ("Search", 1)]
    assert [r["name"] for r in retrieval.related_names(names, "none of it", 2).collect()] == ["Vector Search", "Graph"]
    assert value(retrieval.comparison_context, "ca", "A", "cb", "B") == "=== A ===\nca\n\n=== B ===\ncb"


def test_reactions_without_a_reply_go(spark):
    pitches = spark.createDataFrame([("a", "sys", "p1"), ("a", "sys", "p2"), ("b", "sys", None)], "character string, system string, value string")
    said = dialogue.reactions(pitches, lambda system, pitch: {"p1": "yes", "p2": None}.get(pitch, ""))
    assert rows(said, "character", "value", "reply") == [("a", "p1", "yes")]


def test_topic_keywords_join_their_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    model = topics.fit_topics(docs, "text", topics=3, max_iter=2, min_df=2.0)
    words = {r["topic_id"]: r["topic_keywords"] for r in topics.keywords(model, 4).collect()}
    assert sorted(words) == [0, 1, 2] and all(len(w.split(", ")) == 4 for w in words.values())
    placed = topics.assign(model, docs, "text")
    named = topics.labelled(placed, model, 4)
    assert named.count() == docs.count()
    assert all(r["topic_keywords"] == words[r["topic_id"]] for r in named.select("topic_id", "topic_keywords").distinct().collect())
    pivot = topics.topic_pivot(placed, "source", 3).collect()
    assert sum(sum(v or 0 for v in list(r)[1:]) for r in pivot) == docs.count()
