"""Flows with model hooks, resumed runs and file dispatch on hand-made cases."""

from sparkloom.operators import dialogue, graph, retrieval
from sparkloom.plans import flows

CONCEPTS = [(0, "Vector Database", "Stores vectors. Fast.", "Tool", "beginner", ["search"]), (1, "Search", "Finds things. Always.", "Concept", "beginner", []), (2, "Model", "Maps. In to out.", "Model", "expert", ["answers"])]
EDGES = [("Vector Database", "REQUIRES", "Search"), ("Model", "USED_IN", "Search"), ("Model", "SIMILAR_TO", "Vector Database")]


def frames(spark):
    concepts = spark.createDataFrame(CONCEPTS, "ord int, name string, definition string, category string, difficulty string, example_use_cases array<string>")
    return concepts, spark.createDataFrame(EDGES, "src string, rel string, dst string")


def test_a_model_is_asked_where_the_match_is_weak(spark):
    concepts, _ = frames(spark)
    names = concepts.select("ord", "name")
    questions = spark.createDataFrame([(1, "what is a vector database"), (2, "that thing which maps"), (3, "no idea")], "qid int, question string")
    model = lambda q, listed: '{"concept": "MODEL"}' if "maps" in q else '{"concept": "nothing known"}'
    got = {r["qid"]: (r["name"], r["confidence"]) for r in retrieval.asked_entities(retrieval.entities(questions, names), names, model).collect()}
    assert got[1][0] == "Vector Database" and got[1][1] >= 0.8
    assert got[2] == ("Model", 0.85) and got[3] == (None, 0.0)


def test_a_model_breaks_ties_of_the_route(spark):
    questions = spark.createDataFrame([(1, "overview of the field of search"), (2, "something neutral"), (3, "something else")], "qid int, question string")
    model = lambda kind, q: "This is GLOBAL." if "neutral" in q else "local"
    assert {r["qid"]: r["route"] for r in retrieval.routed(questions, model).collect()} == {1: "global", 2: "global", 3: "local"}
    assert {r["qid"]: r["route"] for r in retrieval.routed(questions).collect()} == {1: "global", 2: "local", 3: "local"}


def test_contexts_hold_neighbours_hops_and_similar_texts(spark):
    concepts, edges = frames(spark)
    edges = edges.union(spark.createDataFrame([("Search", "PART_OF", "Far")], "src string, rel string, dst string"))
    index = retrieval.indexed(None, concepts)
    questions = spark.createDataFrame([(1, "What is Vector Database?"), (2, "zzz")], "qid int, question string")
    got = {r["qid"]: r["context"] for r in flows.local_answers(questions, concepts, edges, None, index).collect()}
    assert got[2] is None
    assert got[1].startswith("[CONCEPT: Vector Database]\nDefinition: Stores vectors. Fast.\nCategory: Tool | Difficulty: beginner\nExample uses: search\n\n[DIRECT RELATIONSHIPS]\n  - REQUIRES → Search: Finds things.\n  - SIMILAR_TO ← Model: Maps.\n\n[RELATED CONCEPTS - HOP 2]\n  - Far\n\n[SUPPORTING TEXT - semantic search]\n")
    assert "[Vector Database |" not in got[1] and " | similarity: 0." in got[1]


def test_vectors_with_one_id_overwrite_each_other(spark):
    concepts, _ = frames(spark)
    more = spark.createDataFrame([(9, "vector database", "Newer.", "Tool", "expert", [])], concepts.schema)
    index = retrieval.indexed(retrieval.indexed(None, concepts), more)
    assert {r["id"]: r["name"] for r in index.collect()} == {"vector_database": "vector database", "search": "Search", "model": "Model"}


def test_an_ingest_goes_on_where_it_ended(spark, tmp_path):
    concepts, edges = frames(spark)
    nodes, ledger = concepts.select("name"), str(tmp_path / "done")
    docs = spark.createDataFrame([("a.txt", "one"), ("b.txt", "two")], "file string, text string")
    model = lambda kind, text: '{"triples": [{"source": "Search", "relation": "IS_A", "target": "' + text + '"}]}'
    grown, linked, counts = flows.resumed_ingest(docs, "file", nodes, edges, model, ledger)
    assert counts.first().asDict() == {"chunks_processed": 2, "chunks_skipped": 0, "triples": 2, "new_relationships": 2, "new_concepts": 2}
    assert grown.count() == 5 and linked.count() == 5
    more = docs.union(spark.createDataFrame([("c.txt", "three")], docs.schema))
    _, _, counts = flows.resumed_ingest(more, "file", grown, linked, model, ledger)
    assert counts.first().asDict() == {"chunks_processed": 1, "chunks_skipped": 2, "triples": 1, "new_relationships": 1, "new_concepts": 1}


def test_prompts_tell_the_best_members(spark):
    concepts, _ = frames(spark)
    members = spark.createDataFrame([(0, "Model"), (0, "Search"), (0, "Stub")], "community_id int, name string")
    scores = spark.createDataFrame([("Search", 1.0), ("Model", 0.5)], "name string, score double")
    r = graph.summary_prompts(members, scores, concepts, 2).first()
    assert list(r["node_names"]) == ["Model", "Search", "Stub"] and r["details"] == "- Search: Finds things. Always.\n- Model: Maps. In to out."


def test_files_go_to_the_parser_of_their_kind(spark):
    said = "ANN: This is a line that is long enough.\n" * 6
    quotes = "\n".join(f'{i}. "A quote that is number {i} and long"' for i in range(6))
    life = 'Character Overview\nIconic Moments\n"I am the one who speaks here"\nPersonality Traits\nBrave - never ever afraid of things\nSpeech Style\nShort.'
    files = spark.createDataFrame([("s.txt", "some scene", said), ("q.txt", "bob quotes", quotes), ("p.txt", "bob life", life), ("m.txt", "miranda quotes", "A line without any label at all, long enough."), ("e.txt", "empty", "")], "source string, stem string, content string")
    aliases = spark.createDataFrame([("ann", "Ann")], "alias string, character string")
    hints = spark.createDataFrame([(0, "bob_life", "Bob"), (1, "bob", "Robert"), (2, "miranda", "Miranda")], "ord int, hint string, character string")
    lines, profiles = dialogue.parse_files(files, aliases, hints)
    got = {}
    for r in lines.collect():
        got.setdefault((r["source"], r["character"]), []).append(r["dialogue"])
    assert len(got["s.txt", "Ann"]) == 6 and len(got["q.txt", "Robert"]) == 6 and len(got["m.txt", "Miranda"]) == 1
    assert got["p.txt", "Bob"] == ["I am the one who speaks here"]
    assert [r["character"] for r in profiles.collect()] == ["Bob"]
