import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scoring, text


@pytest.mark.parametrize(
    ("make", "args", "want"),
    [
        (text.clean_text, ["See http://x.y/z NOW, ok 3!\n"], "see   now  ok"),
        (text.first_sentence, ["One sentence."], "One sentence.."),
        (text.first_sentence, ["One. Two. Three."], "One."),
        (text.acronym, ["Retrieval-Augmented Generation"], "rag"),
        (text.acronym, ["Search"], None),
        (text.clean_dialogue, ["[[Harvey|He]] won"], "He won"),
        (text.clean_dialogue, ["[[File:a.png]] hi (waves)  there [3]"], "hi there"),
        (text.safe_name, ["_Größe (x)/y-z_"], "Größe__x__y-z"),
        (text.slug, ["Vector Data Base"], "vector_data_base"),
        (text.token_estimate, ["123456789"], 2),
        (text.strip_quotes, ['  "quoted" '], "quoted"),
        (text.comma_list, ["a, ,b ,"], ["a", "b"]),
        (lambda c: text.lighten(c, 0.5), ["#000080"], "#7f7fbf"),
        (lambda t: text.truncate_words(t, 2), ["a b c"], "a b..."),
        (lambda t: text.truncate_chars(t, 3), ["Größe"], "Grö…"),
        (lambda t: text.xml_elements(t, "title"), ["<title>a</title><title>b\nc</title>"], ["a", "b\nc"]),
        (text.character_of, ["You are Logan Roy from the show."], "Logan Roy"),
        (text.character_of, ["You are Bob. Hello."], "Bob"),
        (text.html_to_text, ["<p>short</p>"], None),
        (text.url_name, ["Large Model"], "Large_Model"),
        (text.fetchable, ["A/B test"], False),
    ],
)
def test_text(value, make, args, want):
    assert value(make, *args) == want


def test_null_titles(value):
    assert value(text.joined_text, None, "x") is None
    assert value(text.build_text, None, "x") == "x"
    assert value(text.build_text, None, None) == "no content"


def test_html_keeps_words_and_numeric_entities(value):
    html = "<script>var a='<b>';</script><STYLE x>p{}</STYLE><p>Hello&amp;world &#39;s</p>" + "word " * 40
    got = value(text.html_to_text, html)
    assert got.startswith("Hello world &#39;s") and "var a" not in got and "p{}" not in got


def test_json_object(value):
    schema = "triples array<struct<source:string,relation:string,target:string>>"
    assert value(lambda t: text.json_object(t, schema), 'x {"triples": [{"source": "a", "relation": "IS_A", "target": "b"}]} y')["triples"][0]["target"] == "b"
    assert value(lambda t: text.json_object(t, schema), "none here") is None


@pytest.mark.parametrize(
    ("reply", "want"),
    [("so … [VOTE: yes]", "yes"), ("Fine. You know it", "no"), ("I say yes.", "abstain"), ("I abstain, yes", "abstain"), ("Good. Yes", "yes"), ("", "abstain")],
)
def test_vote(value, reply, want):
    assert value(scoring.vote, reply) == want


@pytest.mark.parametrize(
    ("question", "want"),
    [("Give an overview of the landscape", "global"), ("What is RAG?", "local"), ("hello", "local"), ("What are the main approaches to retrieval?", "global")],
)
def test_route(value, question, want):
    assert value(scoring.route, question) == want


@pytest.mark.parametrize(("question", "want"), [("What to know before X, compared", "prerequisite"), ("Is it like Y?", "similarity"), ("where is it", "usage"), ("tell me", "standard")])
def test_mode(value, question, want):
    assert value(scoring.mode, question) == want


def test_entity_score(value):
    assert value(scoring.entity_score, "Vector Database", "vector database") == 1.0
    assert value(scoring.entity_score, "the vector database is big", "Vector Database") == pytest.approx(0.85)
    assert value(scoring.entity_score, "which database", "Vector Database") == pytest.approx(0.4)


def test_relevance_counts_phrases(value):
    assert value(scoring.relevance, "vector search engine", "A vector search tool") == pytest.approx(2 / 3 + 0.2)
    assert value(scoring.relevance, "", "text") == 0.0


def test_clean_text_like_python(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", text.clean_text(F.col("text")).alias("got")).collect()
    for r in rows:
        assert r["got"] == re.sub(r"[^a-zA-Z\s]", " ", re.sub(r"http\S+", " ", r["text"])).lower().strip()
