"""The registered queries over the standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..columns import numbered
from ..functions import scoring, text
from ..operators import content, dialogue, graph, retrieval, topics, vectors
from ..session import Scratch, cut_lineage
from ..sources import listing, sinks, tables
from ..sources.tables import table
from ..streaming import ingest
from . import flows

#: Questions to route, match and rank; the words are those of the test texts where that matters.
QUESTIONS = [
    (0, "What are the main approaches to retrieval?"),
    (1, "What is the thion of erthe?"),
    (2, "Compare the brand to the other type"),
    (3, "How has the field of search changed in general?"),
    (4, "What does it require before you start with it?"),
    (5, "Give an example of the use case"),
    (6, "overview and landscape of that with the"),
    (7, "LLM"),
    (8, "what is large language model"),
    (9, ""),
]
NAMES = [(0, "Large Language Model"), (1, "Retrieval-Augmented Generation"), (2, "Search"), (3, "Brand"), (4, "Vector Database"), (5, "type system"), (6, "Use Case"), (7, "Key-Value Cache")]
SOURCE, TARGET = "S:1", "S:2"


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "qid int, question string")


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NAMES, "ord int, name string")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Questions: each benchmark passage, with a question about a part behind it, and the literal ones (ids below 0)."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.concat(F.lit(" What is the "), "p_name", F.lit(" of "), "p_brand", F.lit("?")).alias("about"))
    told = table(spark, d, "benchmark").join(part, "item_id", "left").select(F.col("item_id").cast("int").alias("qid"), F.concat("text", F.coalesce("about", F.lit(""))).alias("question"))
    return told.unionByName(_questions(spark).select((-1 - F.col("qid")).alias("qid"), "question"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """Names: the labels of all concept nodes, in order, behind the literal ones."""
    own = numbered(tables.concept_nodes(spark, d).select(F.col("label").alias("name")).distinct(), ["name"], "place")
    return _names(spark).unionByName(own.select((F.col("place") + len(NAMES)).cast("int").alias("ord"), "name"))


def _node(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([(name,)], "name string")


def _unified(spark: SparkSession, d: str) -> DataFrame:
    return content.unified(tables.posts(spark, d), tables.comments(spark, d), tables.results(spark, d))


def _prompts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, f"You are {r}. Answer briefly.") for r in ("assistant", "user")], "character string, system string")


def _concepts(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.select(F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("name"), F.concat("p_name", F.lit(". Made by "), "p_brand").alias("definition"), F.lit("Model").alias("category"), F.lit("intermediate").alias("difficulty"), F.array("p_type", "p_brand").alias("example_use_cases"))


# Content


def content_union(spark, d):
    return _unified(spark, d)


def label_counts_pivot(spark, d):
    return content.label_pivot(_unified(spark, d), schemas.SENTIMENT_LABELS)


def label_counts_long(spark, d):
    return content.label_counts(_unified(spark, d))


def trend_day(spark, d):
    return content.trend(tables.timed_content(spark, d), "day")


def trend_week(spark, d):
    return content.trend(tables.timed_content(spark, d), "week")


def trend_month(spark, d):
    return content.trend(tables.timed_content(spark, d), "month")


def label_share(spark, d):
    return content.share(content.label_counts(_unified(spark, d)), "subreddit")


def weekly_share(spark, d):
    return content.share(content.trend(tables.timed_content(spark, d), "week"), "period")


def kpi_row(spark, d):
    return content.kpis(_unified(spark, d))


def top_posts(spark, d):
    own = content.filtered(_unified(spark, d), groups=["src0"], types=["post"])
    return content.top_by_score(own, 10).select("id", "score", "sentiment_label")


def recent_500(spark, d):
    return content.recent(tables.timed_content(spark, d), 500).select("id", "created_dt", "sentiment_label")


def filtered_content(spark, d):
    return content.filtered(tables.timed_content(spark, d), start="2024-01-05", end="2024-01-12", labelled=True)


def date_bounds(spark, d):
    return content.date_bounds(tables.timed_content(spark, d))


def label_value_counts(spark, d):
    return content.label_counts(content.filtered(_unified(spark, d), groups=["src1"])).select("sentiment_label", "cnt")


def row_counts(spark, d):
    return content.table_counts({t: table(spark, d, t) for t in ("documents", "conversations", "labels", "events")})


def token_freq_topk(spark, d):
    return content.label_words(_unified(spark, d), 80)


def topk_per_group(spark, d):
    return content.top_comments(tables.comments(spark, d), 5).select("id", "post_id", "body")


def listing_top(spark, d):
    """The best 25 posts of every source, from landed pages."""
    with Scratch(spark) as scratch:
        listing.land(tables.posts(spark, d).select("id", "subreddit", "title", F.col("score").cast("long").alias("score")), f"{scratch.folder}/pages")
        return cut_lineage(listing.top(spark, f"{scratch.folder}/pages", 25))


def new_rows_anti(spark, d):
    posts = tables.posts(spark, d).select("id", "subreddit")
    return sinks.new_rows(posts, tables.results(spark, d).withColumnRenamed("content_id", "id"), "id")


def upsert_latest(spark, d):
    old = tables.results(spark, d)
    new = old.where(F.col("sentiment_label") == schemas.SENTIMENT_LABELS[2]).withColumn("sentiment_score", F.lit(0.125))
    return sinks.upsert(old, new, ["content_id", "content_type"]).select("content_id", "sentiment_label", "sentiment_score")


def dup_groups(spark, d):
    return dialogue.duplicate_groups(table(spark, d, "documents"), "text")


def missing_dim(spark, d):
    wanted = schemas.dimension(spark, ["assistant", "narrator", "system", "user"], "role")
    return dialogue.missing(wanted, table(spark, d, "conversations"), "role")


# Text


def _docs(spark, d):
    return table(spark, d, "documents")


def clean_text(spark, d):
    return _docs(spark, d).select("doc_id", text.clean_text(F.col("text")).alias("clean"))


def build_text(spark, d):
    return tables.posts(spark, d).select("id", text.build_text(F.col("title"), F.col("body")).alias("built"))


def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


def safe_name(spark, d):
    return table(spark, d, "part").select("p_partkey", text.safe_name(F.col("p_name")).alias("safe"), text.slug(F.col("p_name")).alias("slug"))


def acronyms(spark, d):
    return table(spark, d, "part").select("p_partkey", text.acronym(F.col("p_name")).alias("acronym"))


def first_sentence(spark, d):
    return _docs(spark, d).select("doc_id", text.first_sentence(F.col("text")).alias("first"))


def clean_dialogue(spark, d):
    marked = F.concat(F.lit("[[File:a.png]] (waves) [[Suits|Law]] [3] "), "text")
    return table(spark, d, "conversations").select("conv_id", "turn", text.clean_dialogue(marked).alias("clean"))


def truncate_words(spark, d):
    return _docs(spark, d).select("doc_id", text.truncate_words(F.col("text"), 40).alias("short"))


def scalar_misc(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", text.token_estimate(F.col("c_name")).alias("tokens"), text.thousands(F.col("c_custkey")).alias("thousands"), text.stem_key(F.col("c_name")).alias("stem"), text.lighten(F.concat(F.lit("#"), F.lpad(F.lower(F.hex("c_custkey")), 6, "0")), 0.5).alias("light"), text.node_size(F.col("c_custkey"), F.lit(20000)).alias("size"), text.comma_list(F.concat("c_name", F.lit(", ,"), "c_mktsegment")).alias("listed"))


def json_triples(spark, d):
    reply = F.concat(F.lit('Sure: {"triples": [{"source": "P:'), F.col("l_partkey").cast("string"), F.lit('", "relation": "'), F.when(F.col("l_linenumber") % 2 == 0, "REQUIRES").otherwise("KNOWS"), F.lit('", "target": "S:'), F.col("l_suppkey").cast("string"), F.lit('"}]} done'))
    return graph.extracted(table(spark, d, "lineitem").select(reply.alias("reply"))).groupBy("rel", "dst").agg(F.count(F.lit(1)).alias("cnt"))


# Chunks and dialogue


def chunk_documents(spark, d):
    return dialogue.chunks(_docs(spark, d).withColumn("file", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))), "file")


def chunk_stats(spark, d):
    made = chunk_documents(spark, d)
    return made.groupBy("source_file").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))


def context_window(spark, d):
    return dialogue.context_window(tables.dialogue(spark, d)).select("source", "pos", "context")


def conversation_history(spark, d):
    return dialogue.history(tables.dialogue(spark, d), "source", "pos").select("source", "pos", F.sha2("history", 256).alias("history_sha"))


def chat_examples(spark, d):
    return dialogue.chat_examples(tables.dialogue(spark, d), _prompts(spark))


def rendered_chats(spark, d):
    messages = dialogue.as_messages(dialogue.single_turn_examples(tables.dialogue(spark, d), _prompts(spark)))
    return messages.select(text.render_chat(F.col("messages")).alias("rendered"), text.character_of(F.col("messages")[0]["content"]).alias("who"))


def split_train_val(spark, d):
    lines = tables.dialogue(spark, d)
    return dialogue.split(lines, F.concat_ws(":", F.col("source").cast("string"), F.col("pos").cast("string"))).select("source", "pos", "part")


def sample_classes(spark, d):
    return dialogue.sample_per_class(tables.dialogue(spark, d), "character", F.concat_ws(":", F.col("source").cast("string"), F.col("pos").cast("string")), 5).select("character", "source", "pos", "rn")


def role_length_stats(spark, d):
    return dialogue.length_stats(table(spark, d, "conversations"), "role", "text")


def seq_length_stats(spark, d):
    return dialogue.sequence_stats(_docs(spark, d), text.token_estimate(F.col("text")))


def class_balance(spark, d):
    return dialogue.class_balance(table(spark, d, "conversations"), "role")


def gap_plan(spark, d):
    wanted = schemas.dimension(spark, ["assistant", "narrator", "system", "user"], "role").select("role")
    return dialogue.gap_plan(table(spark, d, "conversations"), wanted, "role", 100)


def classify_files(spark, d):
    return _docs(spark, d).select("doc_id", dialogue.classify_file(F.lit("quotes"), F.col("text")).alias("kind"))


def parse_vote(spark, d):
    ends = F.element_at(F.array(*[F.lit(x) for x in (" [VOTE: yes]", " I say no", ". Abstain", " Fine. You know it", " I say yes.", "")]), (F.col("turn") % 6 + 1).cast("int"))
    said = table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", ends).alias("reply"))
    return said.select("conv_id", "turn", scoring.vote(F.col("reply")).alias("vote"), F.length(scoring.without_vote(F.col("reply"))).alias("n"))


def vote_tally(spark, d):
    return dialogue.tally(parse_vote(spark, d), ["conv_id"])


# Retrieval


def route_queries(spark, d):
    return retrieval.routed(_asked(spark, d)).select("qid", "route", "mode")


def entity_scores(spark, d):
    return retrieval.entity_scores(_asked(spark, d), _labels(spark, d))


def entity_best(spark, d):
    return retrieval.entities(_asked(spark, d), _labels(spark, d)).select("qid", "name", F.round("confidence", 6).alias("confidence"))


def search_concepts(spark, d):
    return retrieval.search(_concepts(spark, d), "red", 10).select("name", "score")


def community_rank(spark, d):
    told = _docs(spark, d).select(F.col("doc_id").cast("int").alias("community_id"), F.col("text").alias("summary"))
    return retrieval.ranked_summaries(_questions(spark), told).select("qid", "community_id", "score", "rn")


def fallback_answers(spark, d):
    told = _docs(spark, d).select(F.col("doc_id").cast("int").alias("community_id"), F.col("text").alias("summary"))
    return retrieval.fallback_answers(retrieval.ranked_summaries(_questions(spark), told), 20)


def flagship(spark, d):
    """Chunks of all documents ranked against the questions: the five best for each."""
    made = chunk_documents(spark, d).select("chunk_id", F.col("text").alias("summary"))
    scored = retrieval.relevances(made, _questions(spark))
    return content.first_per_group(scored, ["qid"], [F.desc("score"), F.col("chunk_id")], 5).select("qid", "chunk_id", "score", "rn")


def _query_vectors(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))


def cosine_topk(spark, d):
    return retrieval.nearest(table(spark, d, "embeddings"), _query_vectors(spark, d), 3)


def cosine_topk_indexed(spark, d):
    """About what ``cosine_topk`` returns, from half the lists of an inverted-file index."""
    return vectors.search(vectors.build(table(spark, d, "embeddings")), _query_vectors(spark, d))


def cosine_topk_excluding(spark, d):
    return retrieval.nearest(table(spark, d, "embeddings"), _query_vectors(spark, d), 3, exclude=[0, 100, 200])


def context_text(spark, d):
    small = tables.concept_edges(spark, d)
    return retrieval.context_texts(_concepts(spark, d), small)


# Graph


def graph_stats(spark, d):
    nodes, edges, _ = graph.build(tables.concept_nodes(spark, d), tables.concept_edges(spark, d))
    return graph.stats(nodes, edges)


def graph_stubs(spark, d):
    triples = table(spark, d, "lineitem").select(F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("L:"), F.col("l_linenumber").cast("string")).alias("dst"))
    return graph.stubs(triples, tables.concept_nodes(spark, d))


def neighbors_khop(spark, d):
    return graph.neighbours(tables.concept_edges(spark, d), _node(spark, SOURCE), 2)[0]


def neighbors_edges(spark, d):
    return graph.neighbours(tables.concept_edges(spark, d), _node(spark, SOURCE), 2)[1]


def neighbors_filtered(spark, d):
    return graph.retrieve(tables.concept_edges(spark, d), _node(spark, SOURCE), "prerequisite")[0]


def closure(spark, d):
    return graph.closure(tables.concept_edges(spark, d), _node(spark, "P:1"))


def path_length(spark, d):
    return graph.paths(tables.concept_edges(spark, d), SOURCE, TARGET).agg((F.count(F.lit(1)) - 1).alias("steps"))


def curriculum_levels(spark, d):
    return graph.curriculum(tables.concept_edges(spark, d), _node(spark, "P:1"))


def compare(spark, d):
    return graph.compare(tables.concept_edges(spark, d), _node(spark, "P:1"), _node(spark, "P:2"))


def pagerank(spark, d):
    """To convergence: until a round moves a score by less than 1e-9 in the mean."""
    scored = graph.pagerank(tables.concept_nodes(spark, d), tables.concept_edges(spark, d))
    return scored.select("name", F.round("score", 6).alias("score"))


def category_heatmap(spark, d):
    return graph.heatmap(tables.concept_nodes(spark, d), tables.concept_edges(spark, d))


def category_rollup(spark, d):
    scores = table(spark, d, "supplier").select(F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("name"), F.lit(0.5).alias("score"))
    return graph.category_rollup(tables.concept_nodes(spark, d), scores).select("category", "name", "cnt", "total")


def incident_edges(spark, d):
    return graph.incident(tables.concept_edges(spark, d), SOURCE).select("rel", "direction", F.size("others").cast("long").alias("n"), F.array_join("others", ",").alias("others"))


def edges_within(spark, d):
    own = tables.concept_nodes(spark, d).where(F.col("category").isin("Domain", "Tool"))
    return graph.edges_within(tables.concept_edges(spark, d), own)


def concept_list(spark, d):
    scores = table(spark, d, "part").select(F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_size") / 64.0).alias("score")).where("score > 0.4")
    return graph.listed(_concepts(spark, d), scores, ["Model"], ["intermediate"]).select("name", "score")


def ingest_counts(spark, d):
    triples = table(spark, d, "lineitem").select(F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("src"), F.lit("USED_IN").alias("rel"), F.concat(F.lit("L:"), F.col("l_linenumber").cast("string")).alias("dst"))
    return graph.ingest(tables.concept_nodes(spark, d), tables.concept_edges(spark, d), triples)[2]


def drawn_nodes(spark, d):
    scores = table(spark, d, "supplier").select(F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("name"), F.greatest("s_acctbal", F.lit(0.0)).alias("score"))
    return graph.drawn(tables.concept_nodes(spark, d), tables.concept_edges(spark, d), scores, SOURCE)[0].select("name", "size", "highlighted")


def prompt_counts(spark, d):
    roles = schemas.dimension(spark, ["assistant", "user", "system"], "character")
    made = dialogue.chat_examples(tables.dialogue(spark, d), _prompts(spark))
    return dialogue.counts_by_prompt(made, roles)


def topic_texts(spark, d):
    return content.topic_texts(tables.posts(spark, d), tables.comments(spark, d)).select("id", "subreddit", F.sha2("clean", 256).alias("clean_sha"))


def monologues(spark, d):
    files = _docs(spark, d).select(F.col("doc_id").alias("source"), F.lit("Narrator").alias("character"), F.col("text").alias("content"))
    return dialogue.parse_monologue(files).select("source", "pos", F.sha2("dialogue", 256).alias("line_sha"))


def louvain(spark, d):
    return graph.communities(tables.concept_edges(spark, d))


def community_summaries(spark, d):
    return graph.summaries(louvain(spark, d)).select("community_id", "summary")


def lda_topics(spark, d):
    rows = _docs(spark, d).select("doc_id", "source", "text")
    model = topics.fit_topics(rows, "text", topics=8)
    return topics.assign(model, rows, "text").select("doc_id", "topic_id", "topic_confidence")


def _labelled(spark, d):
    known = tables.results(spark, d).select(F.col("content_id").cast("long").alias("doc_id"), "sentiment_label")
    return _docs(spark, d).select("doc_id", "text").join(known, "doc_id", "left")


def zero_shot(spark, d):
    """Labels of all documents, a row each, by a model fitted on the labelled ones; only these are joined with their labels."""
    fitted = topics.fit_labels(_labelled(spark, d), "text", "sentiment_label")
    return topics.classify(_docs(spark, d).select("doc_id", "text"), "text", fitted).select("doc_id", "sentiment.label", "sentiment.score")


def ranked_communities(spark, d):
    """The ten members of each community that rank highest by PageRank."""
    scored = graph.pagerank(tables.concept_nodes(spark, d), tables.concept_edges(spark, d))
    return graph.top_members(louvain(spark, d).select("community_id", "name"), scored).select("community_id", "name", "rn")


def hybrid_context(spark, d):
    """For each question the card and neighbourhood of the concept it names, and the nearest texts of the vector index."""
    asked = _asked(spark, d)
    found = retrieval.entities(asked, _labels(spark, d)).withColumnRenamed("name", "label")
    nodes = tables.concept_nodes(spark, d).groupBy("label").agg(F.min("name").alias("name"))
    named = cut_lineage(found.join(nodes, "label", "left").select("qid", "question", "name", retrieval.mode(F.col("question")).alias("mode")))
    concepts = _all_concepts(spark, d)
    return flows.hybrid_contexts(named, concepts, tables.concept_edges(spark, d), retrieval.indexed(None, concepts)).withColumnRenamed("key", "qid")


# Retrieval and ingest, further parts


STARTS = [(0, "S:1", "standard"), (1, "P:1", "prerequisite"), (2, "N:NATION_1", "usage"), (3, "P:2", "standard")]


def _all_concepts(spark, d):
    """A concept card for every node of the graph."""
    nodes = tables.concept_nodes(spark, d)
    return nodes.select("name", F.concat("label", F.lit(". A "), "category"), "category", F.lit("intermediate"), F.array("category")).toDF("name", "definition", "category", "difficulty", "example_use_cases")


def _starts(spark):
    from ..functions.scoring import MODE_TYPES

    return spark.createDataFrame([(k, n, MODE_TYPES[m]) for k, n, m in STARTS], "key int, name string, types array<string>")


def subgraph_nodes(spark, d):
    return graph.subgraphs(tables.concept_edges(spark, d), _starts(spark))[0]


def assembled_context(spark, d):
    starts = _starts(spark)
    nodes, touching = graph.subgraphs(tables.concept_edges(spark, d), starts)
    return retrieval.assembled(starts.select("key", "name"), nodes, touching, _all_concepts(spark, d))


def direct_nodes(spark, d):
    return graph.direct(tables.concept_edges(spark, d), _node(spark, SOURCE))[0]


def use_case_nodes(spark, d):
    brand = table(spark, d, "part").agg(F.concat(F.lit("B:"), F.min("p_brand")).alias("name"))
    return graph.use_cases(tables.concept_edges(spark, d), brand)[0]


def canonical_node(spark, d):
    return graph.canonical(tables.concept_nodes(spark, d), "s:1").select("name", "category")


def comparison_lists(spark, d):
    return graph.shown(compare(spark, d)).select("side", F.array_join("names", ",").alias("names"))


def community_top_members(spark, d):
    """The ten best-ranked suppliers of each nation, as of a community."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("community_id"), F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_acctbal").alias("score"))
    return graph.top_members(s.select("community_id", "name"), s).select("community_id", "name", "rn")


def community_prompts(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("community_id"), F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_acctbal").alias("score"))
    made = graph.summary_prompts(s.select("community_id", "name"), s, _all_concepts(spark, d))
    return made.select("community_id", F.array_join("node_names", ",").alias("names"), "details")


def vector_index(spark, d):
    """The index of all concepts: for each id its document and the vector's slots that aren't zero."""
    made = retrieval.indexed(None, _all_concepts(spark, d))
    slots = F.filter(F.transform("embedding", lambda v, i: F.struct(i.alias("i"), v.cast("int").alias("v"))), lambda x: x["v"] > 0)
    return made.select("id", "document", F.array_join(F.transform(slots, lambda x: F.concat_ws(":", x["i"].cast("string"), x["v"].cast("string"))), ",").alias("slots"))


def candidate_names(spark, d):
    return retrieval.candidates(_asked(spark, d), _labels(spark, d))


def name_suggestions(spark, d):
    """What a search finds for words in which no concept was recognised."""
    asked = spark.createDataFrame([(0, "red", None), (1, "steel", None), (2, "nothing", None)], "qid int, question string, name string")
    return retrieval.suggestions(asked, _concepts(spark, d)).select("qid", "name", "score", "rn")


def resumed_chunks(spark, d):
    """How many chunks a run takes and skips that goes on behind one over the labelled documents."""
    made = chunk_documents(spark, d)
    done = made.join(table(spark, d, "labels").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file")), "source_file", "left_semi")
    return graph.chunk_counts(made, done)


def line_counts(spark, d):
    wanted = schemas.dimension(spark, ["assistant", "narrator", "system", "user"], "character")
    return dialogue.line_counts(tables.dialogue(spark, d), wanted)


def duplicate_report(spark, d):
    return dialogue.duplicate_report(table(spark, d, "documents"), "text")


def fetch_titles(spark, d):
    own = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit("/x"))).when(F.col("p_partkey") % 11 == 0, "ab").otherwise(F.col("p_name")).alias("name"))
    return own.select("p_partkey", text.fetch_title(F.col("name"), {"ab": "about", "goldenrod": None}).alias("title"))


def _landed(scratch: Scratch, given: DataFrame, files: int = 5) -> DataFrame:
    """A stream over several files, two a batch, in which every third event comes in a second time, in a later file."""
    again = given.where("event_id % 3 = 0").withColumn("late", F.lit(1))
    dealt = given.withColumn("late", F.lit(0)).unionByName(again).repartitionByRange(files, "late", "ts").drop("late")
    dealt.write.parquet(f"{scratch.folder}/landed")
    return ingest.stream(given.sparkSession, f"{scratch.folder}/landed", given.schema, 2)


def stream_dedupe(spark, d):
    """Events that come in as a stream, some of them twice, each id written once, counted by day and type."""
    with Scratch(spark) as scratch:
        given = table(spark, d, "events")
        ingest.append_unseen(_landed(scratch, given), "event_id", f"{scratch.folder}/rows", f"{scratch.folder}/checkpoint").awaitTermination()
        rows = spark.read.schema(given.schema).parquet(f"{scratch.folder}/rows")
        return cut_lineage(rows.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("period"), "event_type").agg(F.count(F.lit(1)).alias("cnt")))


def stream_upsert(spark, d):
    """Each user's last event, from a stream upserted into a bucketed table."""
    with Scratch(spark) as scratch:
        given = table(spark, d, "events")
        last = ingest.BucketedTable(spark, f"{scratch.folder}/table", given.schema, ["user_id"], "ts", 16)
        ingest.upsert_stream(_landed(scratch, given), last, f"{scratch.folder}/checkpoint").awaitTermination()
        return cut_lineage(last.rows().select("user_id", "event_id", "event_type"))


def _in_parts(given: DataFrame, parts: int = 3) -> list[DataFrame]:
    """Events as they come in: by time, but every fifth of a part's last 12 hours a part too late, and every third event
    a second time, a part later."""
    ends = given.agg(F.min(ingest.as_instant("ts")).alias("a"), F.max(ingest.as_instant("ts")).alias("b")).select(F.unix_micros("a"), F.unix_micros("b")).first()
    first, last = (x or 0 for x in ends)
    at, width = F.unix_micros(ingest.as_instant("ts")) - F.lit(first), (last - first) // parts + 1
    own = F.floor(at / width).cast("int")
    tardy = (F.pmod("event_id", F.lit(5)) == 0) & (at % width >= width - 12 * 3_600_000_000)
    placed = given.withColumn("part", F.when(tardy, F.least(own + 1, F.lit(parts - 1))).otherwise(own))
    again = placed.where("event_id % 3 = 0").withColumn("part", F.col("part") + 1)
    both = placed.unionByName(again)
    return [both.where(F.col("part") == i).drop("part") for i in range(parts)]


def stream_trend(spark, d):
    """Events by day and type from a stream, some of them late and some twice: the days that are closed at its end.

    Each part is landed and taken by a run of its own, which goes on where the one before it ended.
    """
    with Scratch(spark) as scratch:
        given, target = table(spark, d, "events"), f"{scratch.folder}/trend"
        made = "period timestamp, event_type string, cnt long"
        for part in _in_parts(given):
            part.write.mode("append").parquet(f"{scratch.folder}/landed")
            ingest.closed_trend(ingest.stream(spark, f"{scratch.folder}/landed", given.schema, 1_000_000), "event_id", target, f"{scratch.folder}/checkpoint").awaitTermination()
        rows = spark.read.schema(made).parquet(target)
        return cut_lineage(rows.select(ingest.as_local("period").alias("period"), "event_type", "cnt"))


def learning_path(spark, d):
    """The way between two suppliers, with what is known of each step."""
    return flows.learning_path(_all_concepts(spark, d), tables.concept_edges(spark, d), SOURCE.lower(), TARGET).select("place", "name", "definition", "category")


def study_plan(spark, d):
    """What to learn before a part, without the regions and a supplier, which are known."""
    known = ", ".join(["r:region_0", SOURCE])
    return flows.study_plan(_all_concepts(spark, d), tables.concept_edges(spark, d), "p:1", known).select("level", "name", "definition")


def dataset_report(spark, d):
    """The validation report of the chat examples."""
    made = chat_examples(spark, d)
    return flows.validated(made.select(text.character_of(F.col("system")).alias("character"), "assistant", F.concat_ws(" ", "system", "user", "assistant").alias("whole")))


def seeded_corpus(spark, d):
    """Documents for the parts that have no file in a corpus that covers every second part's name."""
    part = table(spark, d, "part")
    concepts = part.select(F.col("p_name").alias("name"), F.concat("p_name", F.lit(" by "), "p_brand").alias("definition"), F.lit("Model").alias("category"), F.lit("intermediate").alias("difficulty"), F.array("p_type").alias("example_use_cases"))
    have = part.where("p_partkey % 2 = 0").select(F.concat(text.safe_name(F.col("p_name")), F.lit("_wiki.txt")).alias("source_file"))
    return retrieval.seeded(part.select(F.col("p_name").alias("name")), have, concepts)


_NOT_QUERIES = {"table"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All functions of this module that take (spark, d)."""
    return {name: f for name, f in globals().items() if callable(f) and not name.startswith("_") and getattr(f, "__module__", "") == __name__ and f.__code__.co_varnames[:2] == ("spark", "d") and name not in _NOT_QUERIES}
