import pytest

from sparkloom.plans import flows


@pytest.fixture(scope="module")
def world(spark):
    concepts = spark.createDataFrame([(0, "Vector Database", "Stores vectors. Fast.", "Tool", "beginner"), (1, "Search", "Finds things.", "Technique", "beginner")], "ord int, name string, definition string, category string, difficulty string")
    edges = spark.createDataFrame([("Search", "REQUIRES", "Vector Database")], "src string, rel string, dst string")
    told = spark.createDataFrame([(0, "about search methods and trends in the field"), (1, "nothing to see")], "community_id int, summary string")
    asked = spark.createDataFrame([(0, "What is a Vector Database?"), (1, "Give an overview of search trends"), (2, "zzz")], "qid int, question string")
    return asked, concepts, edges, told


def test_answers_without_a_model(world):
    got = {r["qid"]: r for r in flows.answers(*world).collect()}
    assert (got[0]["route"], got[1]["route"]) == ("local", "global")
    assert got[0]["answer"] == "Context about Vector Database:\n\n[CONCEPT: Vector Database]\nDefinition: Stores vectors. Fast.\nCategory: Tool | Difficulty: beginner\n\n[DIRECT RELATIONSHIPS]\n  - REQUIRES ← Search: Finds things..\n"
    assert got[1]["answer"] == "about search methods and trends in the field"
    assert got[2]["answer"] is None


def test_answers_with_a_model(world):
    got = {r["qid"]: r["answer"] for r in flows.answers(*world, model=lambda q, c: f"A long enough answer to {q}" if c else None).collect()}
    assert got[0] == "A long enough answer to What is a Vector Database?"
    assert got[1] == "A long enough answer to Give an overview of search trends"


def test_ingest_resumes(spark, world):
    _, concepts, edges, _ = world
    docs = spark.createDataFrame([("f", "one two three"), ("g", "four")], "file string, text string")
    reply = '{"triples": [{"source": "Search", "relation": "USED_IN", "target": "New"}]}'
    taken, nodes, grown, counts = flows.ingest(docs, "file", concepts, edges, lambda _, text: reply if "one" in text else "none")
    assert taken.count() == 2 and nodes.count() == 3 and grown.count() == 2
    assert counts.first()["new_concepts"] == 1
    assert flows.ingest(docs, "file", concepts, edges, lambda *_: "", done=taken.where("source_file = 'f'"))[0].count() == 1


def test_debate(spark):
    pitches = spark.createDataFrame([(1, "sell ice")], "pitch_id int, pitch string")
    seats = spark.createDataFrame([(0, "A", "sa"), (1, "B", "sb")], "ord int, character string, system string")
    messages, tally = flows.debate(pitches, seats, lambda system, text: "Fine [VOTE: yes]" if "\n" in text and system == "sa" else "I say no")
    assert messages.count() == 4 and messages.where("vote IS NOT NULL").count() == 2
    got = tally.first()
    assert (got["yes"], got["no"], got["verdict"]) == (1, 1, "SPLIT")


def test_collected(spark):
    posts = spark.createDataFrame([("a",), ("b",)], "id string")
    comments = spark.createDataFrame([("c1", "a", 0, "x"), ("c2", "a", 1, "[removed]")], "id string, post_id string, turn int, body string")
    p, c, totals = flows.collected(posts, comments, posts.limit(1), comments.limit(0))
    assert p.count() == 1 and [r["id"] for r in c.collect()] == ["c1"]
    assert {r["name"]: r["cnt"] for r in totals.collect()} == {"posts": 1, "comments": 1}
