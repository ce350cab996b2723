import pytest
from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.operators import content, dialogue, graph, retrieval, topics


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# Chunks and dialogue


@pytest.mark.parametrize(("n", "want"), [(0, 0), (1, 1), (300, 1), (301, 2), (550, 2), (551, 3)])
def test_chunk_boundaries(spark, n, want):
    df = spark.createDataFrame([("f", " ".join(f"w{i}" for i in range(n)))], "file string, text string")
    got = dialogue.chunks(df, "file").orderBy("chunk_index").collect()
    assert len(got) == want
    if want:
        assert got[0]["chunk_id"] == "f::0"
        assert got[-1]["text"].split()[-1] == f"w{n - 1}"


def test_context_window(spark):
    df = spark.createDataFrame([("s", i, "ab"[i % 2], f"l{i}") for i in range(5)], "source string, pos int, character string, dialogue string")
    got = dict(rows(dialogue.context_window(df).select("pos", "context")))
    assert got[0] == "" and got[4] == "b: l1\na: l2\nb: l3"


def test_deleted_comments_use_a_slot(spark):
    df = spark.createDataFrame([("p", i, "[deleted]" if i == 1 else f"c{i}") for i in range(6)], "post_id string, turn int, body string")
    assert content.top_comments(df, 5).count() == 4


def test_split_is_stable_and_disjoint(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    once = dict(rows(dialogue.split(df, F.col("k"))))
    again = dict(rows(dialogue.split(df.repartition(7), F.col("k"))))
    assert once == again
    assert 0.06 < sum(v == "val" for v in once.values()) / 2000 < 0.14


def test_class_balance_and_gap(spark):
    df = spark.createDataFrame([("a",)] * 12 + [("b",)] * 2, "c string")
    assert dialogue.class_balance(df, "c").first()["verdict"] == "imbalanced"
    wanted = schemas.dimension(spark, ["a", "b", "z"], "c").select("c")
    assert rows(dialogue.gap_plan(df, wanted, "c", 5), "c") == [("b", 2, 3), ("z", 0, 5)]
    assert rows(dialogue.missing(wanted, df, "c")) == [("z",)]


def test_tally(spark):
    df = spark.createDataFrame([("x [VOTE: YES]",), ("no",), ("yes",)], "t string")
    got = dialogue.tally(dialogue.votes(df, "t")).first()
    assert (got["yes"], got["no"], got["abstain"], got["verdict"]) == (2, 1, 0, "APPROVED")
    assert dialogue.votes(df, "t").first()["content"] == "x"


def test_parsers(spark):
    aliases = spark.createDataFrame([("harvey", "Harvey Specter"), ("bob", "Bob the Builder")], "alias string, character string")
    script = spark.createDataFrame([("s", "HARVEY: I do not play the odds (grins)\nMike: who cares about that\nBob: can we build it today?")], "source string, content string")
    assert [r["character"] for r in dialogue.parse_script(script, aliases).orderBy("pos").collect()] == ["Harvey Specter", "Bob the Builder"]
    blocks = spark.createDataFrame([("s", "Harvey\nI never lose\nnot even once\n\nnoise here\nBob\nYes we certainly can")], "source string, content string")
    assert rows(dialogue.parse_blocks(blocks, aliases).select("character", "dialogue"), "character") == [("Bob the Builder", "Yes we certainly can"), ("Harvey Specter", "I never lose not even once")]
    quotes = spark.createDataFrame([("s", "Ross Geller", 'x "We were on a  break, I said" and "short"')], "source string, character string, content string")
    assert rows(dialogue.parse_quotes(quotes).select("dialogue")) == [("We were on a break, I said",)]
    hints = spark.createDataFrame([(0, "logan_roy", "Logan Roy"), (1, "roy", "Other")], "ord int, hint string, character string")
    assert dialogue.hinted(spark.createDataFrame([("logan_roy_2",), ("none",)], "stem string"), hints).where("stem = 'logan_roy_2'").first()["character"] == "Logan Roy"


def test_classify_file(value):
    assert value(lambda c: dialogue.classify_file(F.lit("x"), c), "Character overview ... personality traits") == "profile"
    assert value(lambda c: dialogue.classify_file(F.lit("my_quotes"), c), '"this is a long quotation" ' * 5) == "quotes"
    assert value(lambda c: dialogue.classify_file(F.lit("x"), c), "BOB: hello there\n" * 5) == "script"


def test_merge_profiles(spark):
    df = spark.createDataFrame([("A", ["x"], "", ["l1"], "r1", "1"), ("A", ["y"], "dry", ["l2"], "r2", "2")], schemas.PROFILE)
    got = dialogue.merge_profiles(df).first()
    assert (got["personality_traits"], got["speech_style"], got["raw_description"]) == (["x", "y"], "dry", "r1\n\nr2")


def test_cycle_pick(spark):
    wanted = spark.createDataFrame([("a", 5)], "c string, need int")
    got = dialogue.cycle_pick(wanted, "need", schemas.dimension(spark, ["s0", "s1"]))
    assert sorted(r["value"] for r in got.collect()) == ["s0", "s0", "s0", "s1", "s1"]


def test_share_and_week(spark):
    df = spark.sql("SELECT 'g' AS subreddit, 'L' AS sentiment_label, TIMESTAMP_NTZ '2024-01-07 10:00:00' AS created_dt")
    got = content.share(content.trend(df, "week"), "period").first()
    assert str(got["period"]) == "2024-01-01 00:00:00" and got["share"] == 1.0


def test_collect_sources_keeps_going(spark):
    got, errors = content.collect_sources({"a": lambda: spark.range(3), "b": lambda: spark.read.parquet("/no/such/path"), "c": lambda: spark.range(2)}, "id")
    assert got.count() == 5 and set(errors) == {"b"}


# Graph


@pytest.fixture(scope="module")
def net(spark):
    edges = [("A", "REQUIRES", "B"), ("B", "REQUIRES", "C"), ("C", "IS_A", "D"), ("X", "SIMILAR_TO", "A"), ("B", "REQUIRES", "D")]
    return spark.createDataFrame(edges, "src string, rel string, dst string")


def start(spark, name):
    return spark.createDataFrame([(name,)], "name string")


def test_neighbours(spark, net):
    nodes, edges = graph.neighbours(net, start(spark, "A"), 1)
    assert rows(nodes, "depth", "name") == [("A", 0), ("B", 1), ("X", 1)]
    assert edges.count() == 2
    assert graph.retrieve(net, start(spark, "A"), "similarity")[0].count() == 2
    assert graph.neighbours(net, start(spark, "A"), 3, most=2)[0].count() == 2


def test_closure_and_curriculum(spark, net):
    assert {r["name"] for r in graph.closure(net, start(spark, "A")).collect()} == {"B", "C", "D"}
    order = [r["name"] for r in graph.curriculum(net, start(spark, "A")).orderBy("level", "name").collect()]
    assert order == ["D", "C", "B", "A"]
    assert [r["name"] for r in graph.curriculum(net, start(spark, "A"), known=["c", "a"]).orderBy("level").collect()] == ["D", "B", "A"]


def test_curriculum_of_a_cycle(spark):
    ring = spark.createDataFrame([("A", "REQUIRES", "B"), ("B", "REQUIRES", "C"), ("C", "REQUIRES", "A")], "src string, rel string, dst string")
    order = [r["name"] for r in graph.curriculum(ring, start(spark, "A")).orderBy("level", "name").collect()]
    assert sorted(order) == ["A", "B", "C"] and order[-1] == "A"


def test_paths(spark, net):
    assert graph.shortest_path(net, "A", "D") == ["A", "B", "D"]
    assert graph.shortest_path(net, "X", "B") == ["X", "A", "B"]
    assert graph.shortest_path(net, "A", "nowhere") == ["A", "nowhere"]


def test_build_and_stubs(spark, net):
    nodes = spark.createDataFrame([("A",), ("B",), ("A",), ("C",)], "name string")
    known, kept, skipped = graph.build(nodes, net.unionByName(net))
    assert (known.count(), kept.count(), skipped.first()["skipped"]) == (3, 2, 3)
    assert {r["name"] for r in graph.stubs(net, nodes).collect()} == {"D", "X"}
    assert graph.canonical(spark.createDataFrame([("Auto memory",), ("auto memory",)], "name string"), "AUTO MEMORY").first()["name"] == "Auto memory"


def test_pagerank_sums_to_one_before_scaling(spark, net):
    nodes = start(spark, "A").unionByName(spark.createDataFrame([(n,) for n in "BCDX"], "name string"))
    got = dict(rows(graph.pagerank(nodes, net, rounds=60, tolerance=1e-10)))
    assert max(got.values()) == 1.0
    rank = dict.fromkeys("ABCDX", 0.2)
    out = {"A": ["B"], "B": ["C", "D"], "C": ["D"], "X": ["A"], "D": []}
    for _ in range(60):
        loose = sum(rank[n] for n in rank if not out[n])
        rank = {n: 0.15 / 5 + 0.85 * (loose / 5 + sum(rank[m] / len(out[m]) for m in rank if n in out[m])) for n in rank}
    assert sum(rank.values()) == pytest.approx(1)
    assert got == pytest.approx({n: r / max(rank.values()) for n, r in rank.items()}, abs=1e-6)


def test_communities_find_two_cliques(spark):
    edges = [(f"{g}{i}", "IS_A", f"{g}{j}") for g in "ab" for i in range(5) for j in range(i)] + [("a0", "IS_A", "b0")]
    got = graph.communities(spark.createDataFrame(edges, "src string, rel string, dst string"))
    groups = {}
    for r in got.collect():
        groups.setdefault(r["community_id"], set()).add(r["name"][0])
    assert sorted(map(tuple, groups.values())) == [("a",), ("b",)]
    assert graph.summaries(got).where("community_id = 0").first()["summary"].startswith("Community of 5 AI concepts: ")


def test_extracted_drops_unknown_types(spark):
    reply = '{"triples": [{"source": "a", "relation": "IS_A", "target": "b"}, {"source": "a", "relation": "LIKES", "target": "c"}]}'
    assert rows(graph.extracted(spark.createDataFrame([("Sure! " + reply,), ("nothing",)], "reply string"))) == [("a", "IS_A", "b")]


# Retrieval


def test_acronym_beats_exact(spark):
    names = spark.createDataFrame([(0, "LLM"), (1, "Large Language Model")], "ord int, name string")
    got = retrieval.entities(spark.createDataFrame([(0, "llm")], "qid int, question string"), names).first()
    assert (got["name"], got["confidence"]) == ("Large Language Model", 0.92)


def test_exclusion_comes_after_top_k(spark):
    vectors = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(6)], "vec_id int, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "q_id int, q array<double>")
    assert retrieval.nearest(vectors, asked, 3, exclude=[1]).count() == 2


def test_zero_scores_fall_back_to_first_ids(spark):
    told = spark.createDataFrame([(i, f"text {i} here") for i in range(9)], "community_id int, summary string")
    got = retrieval.ranked_summaries(spark.createDataFrame([(0, "zzz")], "qid int, question string"), told)
    assert [r["community_id"] for r in got.orderBy("rn").collect()] == [0, 1, 2, 3, 4]


def test_queries_beyond_the_bound_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_ROWS", 3)
    got = retrieval.against(spark.range(4).withColumnRenamed("id", "a"), spark.range(10).withColumnRenamed("id", "b"))
    assert got.distinct().count() == 40


def test_answers(spark):
    df = spark.createDataFrame([(0, "q", "N", "ctx")], "qid int, question string, name string, context string")
    assert retrieval.answered(df).first()["answer"] == "Context about N:\n\nctx"
    assert retrieval.answered(df, lambda q, c: q + c).first()["answer"] == "qctx"
    assert retrieval.useful_answers(spark.createDataFrame([("irrelevant",), ("short",), ("a long enough answer here",)], "answer string")).count() == 1


def test_embed_and_coverage(spark):
    df = spark.createDataFrame([("the cat the",)], "t string")
    assert sum(retrieval.embed(df, "t").first()["embedding"]) == 2.0
    assert retrieval.embed(df, "t", model=lambda xs: [[1.0, 2.0] for _ in xs]).first()["embedding"] == [1.0, 2.0]
    names = spark.createDataFrame([("Big Model",), ("Other",)], "name string")
    files = spark.createDataFrame([("Big_Model_wiki.txt",)], "source_file string")
    assert rows(retrieval.covered(names, files), "name") == [("Big Model", True), ("Other", False)]


# Topics


def test_topics(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    model = topics.fit_topics(df, "text", topics=3, max_iter=2)
    got = topics.assign(model, df, "text")
    assert got.count() == df.count()
    assert got.where("topic_id < 0 OR topic_id > 2 OR topic_confidence < 0.33 OR topic_confidence > 1").count() == 0
    assert topics.keywords(model, 4).count() == 3
    assert len(topics.topic_pivot(got, "source", 3).columns) == 4


def test_classifier_hook(spark):
    df = spark.createDataFrame([("good hope",), ("fear danger",)], "text string")
    got = topics.classify(df, "text", lambda: lambda texts: [("x", 0.123456)] * len(texts)).first()["sentiment"]
    assert (got["label"], got["score"]) == ("x", 0.1235)


def test_profiles_and_quotes_by_form(spark):
    bio = "Intro\nPersonality Traits\nProud - always certain of himself\nx - short\nSpeech Style\nShort and sharp.\nTwo lines.\nIconic Moments\n\"This is the one line\" he said"
    got = dialogue.parse_profile(spark.createDataFrame([("f", "Logan Roy", bio), ("g", "Noddy", "only text")], "source string, character string, content string"))
    row = {r["character"]: r for r in got.collect()}
    assert row["Logan Roy"]["personality_traits"] == ["Proud: always certain of himself"]
    assert (row["Logan Roy"]["speech_style"], row["Logan Roy"]["iconic_lines"]) == ("Short and sharp.\nTwo lines.", ["This is the one line"])
    assert row["Noddy"]["personality_traits"] == ["General description: only text"]
    files = spark.createDataFrame([("f", "Ross Geller", 'Ross: (sighs) "We were on a break!"\n1. "Chandler says something"\n2. "We were on a break!" "unnumbered one here"')], "source string, character string, content string")
    assert [r["dialogue"] for r in dialogue.parse_quotes(files).orderBy("pos").collect()] == ["We were on a break!", "Chandler says something"]


def test_cached_summaries_follow_their_members(spark):
    now = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["x", "y", "z"])], "community_id int, node_names array<string>")
    cached = spark.createDataFrame([(0, ["z", "y", "x"], "about x")], "community_id int, node_names array<string>, summary string")
    assert dict((r["community_id"], r["summary"]) for r in graph.with_summaries(now, cached).collect()) == {0: "Community of 3 AI concepts: a, b, c.", 1: "about x"}


def test_ingest_and_resume(spark, net):
    nodes = spark.createDataFrame([("A",), ("B",)], "name string")
    grown, edges, counts = graph.ingest(nodes, net.limit(0), net.unionByName(net.limit(1)))
    assert grown.count() == 5 and edges.count() == 5
    assert counts.first().asDict() == {"triples": 6, "new_relationships": 6, "new_concepts": 3}
    chunks = spark.createDataFrame([("f::0",), ("f::1",)], "chunk_id string")
    assert [r["chunk_id"] for r in graph.unprocessed(chunks, chunks.limit(1)).collect()] == ["f::1"]
