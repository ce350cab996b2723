"""Whole flows, put together from the operators: answering, ingesting, debating, status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..columns import counted
from ..functions import hooks
from ..functions.scoring import MODE_TYPES
from ..functions.text import token_estimate
from ..operators import content, dialogue, graph, retrieval
from ..session import cut_lineage
from ..sources import sinks

Model = Callable[[str, str], str | None]


def local_answers(questions: DataFrame, concepts: DataFrame, edges: DataFrame, model: Model | None = None, index: DataFrame | None = None) -> DataFrame:
    """(qid, question, name, confidence, mode, context, answer): entity, mode, neighbourhood, similar
    texts, context and answer of each question.

    ``concepts`` has ord besides its own columns, ``index`` is a vector index as ``retrieval.indexed``
    makes it. A question without an entity keeps nulls.
    """
    names = concepts.select("ord", "name")
    found = retrieval.entities(questions, names)
    if model is not None:
        found = retrieval.asked_entities(cut_lineage(found), names, model)
    found = cut_lineage(found.withColumn("mode", retrieval.mode(F.col("question"))))
    contexts = hybrid_contexts(found, concepts, edges, index).withColumnRenamed("key", "qid")
    both = found.join(contexts, "qid", "left").select("qid", "question", "name", "confidence", "mode", "context")
    return retrieval.answered(both, model)


def hybrid_contexts(found: DataFrame, concepts: DataFrame, edges: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(key, context) of questions with their entity (qid, question, name, mode): the entity's
    neighbourhood by the mode's relationship types, and the index's nearest texts."""
    types = F.lit(None).cast("array<string>")
    for name, kinds in MODE_TYPES.items():
        if kinds:
            types = F.when(F.col("mode") == name, F.array(*[F.lit(t) for t in kinds])).otherwise(types)
    starts = found.where("name IS NOT NULL").select(F.col("qid").alias("key"), "name", types.alias("types"))
    nodes, touching = graph.subgraphs(edges, starts)
    hits = retrieval.vector_hits(found.where("name IS NOT NULL"), index) if index is not None else None
    return retrieval.assembled(starts.select("key", "name"), nodes, touching, concepts.drop("ord"), hits)


def summarised(edges: DataFrame, nodes: DataFrame, concepts: DataFrame, model: Model | None = None, cached: DataFrame | None = None) -> DataFrame:
    """(community_id, node_names, summary): communities, each with its cached summary, else the model's, else the fallback.

    The model sees the members' names and the ten best-ranked ones with their definitions.
    """
    members = cut_lineage(graph.communities(edges).select("community_id", "name"))
    prompts = graph.summary_prompts(members, graph.pagerank(nodes, edges), concepts)
    known = cached if cached is not None else prompts.select("node_names", F.lit(None).cast("string").alias("summary")).limit(0)
    if model is not None:
        done = known.where("summary <> ''")
        key = F.array_join(F.array_sort("node_names"), "\u0001")
        fresh = prompts.withColumn("key", key).join(done.select(key.alias("key")), "key", "left_anti")
        made = fresh.select("node_names", hooks.on_question(model)(F.array_join("node_names", ", "), F.col("details")).alias("summary"))
        known = done.select("node_names", "summary").unionByName(made)
    return graph.with_summaries(prompts.select("community_id", "node_names"), known)


def global_answers(questions: DataFrame, communities: DataFrame, model: Model | None = None, k: int = 5) -> DataFrame:
    """(qid, answer): map over the most relevant communities, keep what says something, reduce in order."""
    ranked = retrieval.ranked_summaries(questions, communities, k)
    if model is None:
        return retrieval.fallback_answers(ranked)
    asked = ranked.join(questions.select("qid", "question"), "qid").withColumn("answer", hooks.on_question(model)("question", "summary"))
    parts = retrieval.useful_answers(asked).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "answer"))), lambda p: p["answer"]), "\n\n").alias("context"))
    reduced = parts.join(questions.select("qid", "question"), "qid").withColumn("answer", hooks.on_question(model)("question", "context"))
    return retrieval.fallback_answers(ranked).withColumnRenamed("answer", "fallback").join(reduced.select("qid", "answer"), "qid", "left").select("qid", F.coalesce("answer", "fallback").alias("answer"))


def answers(questions: DataFrame, concepts: DataFrame, edges: DataFrame, communities: DataFrame, model: Model | None = None, index: DataFrame | None = None) -> DataFrame:
    """Each question down its own route, global or local."""
    routed = cut_lineage(retrieval.routed(questions, model).select("qid", "question", "route"))
    wide = global_answers(routed.where("route = 'global'"), communities, model).withColumn("route", F.lit("global"))
    narrow = local_answers(routed.where("route = 'local'"), concepts, edges, model, index).select("qid", "answer").withColumn("route", F.lit("local"))
    return wide.select("qid", "route", "answer").unionByName(narrow.select("qid", "route", "answer"))


def ingest(docs: DataFrame, file: str, nodes: DataFrame, edges: DataFrame, model: Model, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(chunks taken, nodes, edges, counts): chunks not done yet go through the model, its triples into the graph.

    The model sees the first 4 000 characters of a chunk, as extraction prompts allow.
    """
    chunks = dialogue.chunks(docs, file)
    fresh = chunks if done is None else graph.unprocessed(chunks, done)
    replies = fresh.select(hooks.on_question(model)(F.lit("triples"), F.substring("text", 1, 4000)).alias("reply"))
    return (fresh, *graph.ingest(nodes, edges, graph.extracted(replies)))


def resumed_ingest(docs: DataFrame, file: str, nodes: DataFrame, edges: DataFrame, model: Model, ledger: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts) of a run that goes on where ``ledger``, a table of chunk ids, says the last one ended.

    The triples are written before the chunks count as done, so a run that fails takes
    them again; the graph holds an edge once.
    """
    spark = docs.sparkSession
    chunks = dialogue.chunks(docs, file)
    done = cut_lineage(sinks.done_ids(spark, ledger))
    counts = graph.chunk_counts(chunks, done)
    fresh = graph.unprocessed(chunks, done)
    replies = fresh.select(hooks.on_question(model)(F.lit("triples"), F.substring("text", 1, 4000)).alias("reply"))
    triples = cut_lineage(graph.extracted(replies))
    grown, linked, written = graph.ingest(nodes, edges, triples)
    counts = cut_lineage(counts.join(F.broadcast(written)))  # one row each
    sinks.mark_done(fresh, ledger)
    return grown, linked, counts


def debate(pitches: DataFrame, characters: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """(messages, votes) of each pitch (pitch_id, pitch): openings in the characters' order, then votes.

    ``characters`` (ord, character, system) is a constant dimension. Each opening sees the
    pitch; a vote sees all openings of its pitch. Votes don't see each other.
    """
    ask = hooks.on_question(model)
    seats = pitches.join(counted(characters))
    openings = seats.withColumn("reply", ask("system", "pitch")).select("pitch_id", "pitch", "ord", "character", "system", "reply")
    heard = openings.groupBy("pitch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat("character", F.lit(": "), "reply").alias("line")))), lambda x: x["line"]), "\n").alias("heard"))
    voting = openings.drop("reply").join(heard, "pitch_id").withColumn("reply", ask("system", F.concat("pitch", F.lit("\n"), "heard")))
    voted = dialogue.votes(voting, "reply")
    messages = openings.select("pitch_id", F.lit("opening").alias("phase"), "ord", "character", F.col("reply").alias("content"), F.lit(None).cast("string").alias("vote")).unionByName(voted.select("pitch_id", F.lit("vote").alias("phase"), "ord", "character", "content", "vote"))
    return messages, dialogue.tally(voted, ["pitch_id"])


def collected(posts: DataFrame, comments: DataFrame, known_posts: DataFrame, known_comments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new posts, new comments, totals) of one collection run."""
    p = sinks.new_rows(posts, known_posts, "id")
    c = sinks.new_rows(content.top_comments(comments).drop("turn"), known_comments, "id")
    return p, c, content.table_counts({"posts": p, "comments": c})


def _known(concepts: DataFrame, name: str) -> str | None:
    """A concept's own name for one given in any case, null where there is none."""
    row = graph.canonical(concepts, name).agg(F.min("name").alias("name")).first()
    return row["name"]


def _card(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy("name").agg(F.min(F.struct("definition", "category", "difficulty")).alias("card")).select("name", "card.*")


def learning_path(concepts: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """(place, name, definition, category, difficulty): the shortest way between two concepts, in any case.

    Without rows if one of them isn't known; the two names alone if nothing connects them. Names on
    the way that have no concept keep nulls.
    """
    a, b = _known(concepts, source), _known(concepts, target)
    spark = concepts.sparkSession
    way = graph.paths(edges, a, b) if a is not None and b is not None else spark.createDataFrame([], "place int, name string")
    return way.join(_card(concepts), "name", "left").select("place", "name", "definition", "category", "difficulty")


def study_plan(concepts: DataFrame, edges: DataFrame, target: str, known: str = "") -> DataFrame:
    """(level, name, definition, category, difficulty): what to learn, in order of levels, up to a concept, in any case.

    ``known`` lists, comma-separated, what is left out. Without rows if the target isn't known;
    names without a concept are left out.
    """
    goal = _known(concepts, target)
    spark = concepts.sparkSession
    if goal is None:
        levels = spark.createDataFrame([], "level int, name string")
    else:
        levels = graph.curriculum(edges, spark.createDataFrame([(goal,)], "name string"), [k.strip() for k in known.split(",") if k.strip()])
    return graph.enriched(levels, _card(concepts)).select("level", "name", "definition", "category", "difficulty")


def validated(examples: DataFrame, by: str = "character", answer: str = "assistant", whole: str = "whole", low: int = 30, limit: int = 2048, most: int = 5) -> DataFrame:
    """(section, name, measure, value) of a training set: sizes of each class, answers that repeat, lengths of
    whole examples, balance of the classes.

    ``low`` is 1 for classes of fewer examples than that; ``duplicates`` has the number of texts that
    repeat and, by digest, how often the ``most`` commonest do; ``too_long`` counts examples of more
    than ``limit`` estimated tokens. A null class is a class, a null text counts as an example
    without a length. An empty set has a row each for groups (0) and too_long (0) and nulls for the rest.
    """
    classes = dialogue.length_stats(examples, by, answer).withColumn("low", (F.col("cnt") < low).cast("int"))
    repeats = dialogue.duplicate_groups(examples.where(F.col(answer).isNotNull()), answer)
    top = repeats.orderBy(F.desc("cnt"), "text_sha").limit(most)
    lengths = dialogue.sequence_stats(examples, token_estimate(F.col(whole)), limit)
    balance = dialogue.class_balance(examples, by).select("most", "least", "ratio")
    parts = [
        _measures(classes, "class", F.col(by).cast("string")),
        _measures(repeats.agg(F.count(F.lit(1)).alias("groups")), "duplicates", F.lit(None).cast("string")),
        _measures(top, "duplicates", F.col("text_sha"), ["cnt"]),
        _measures(lengths, "sequence", F.lit(None).cast("string")),
        _measures(balance, "balance", F.lit(None).cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _measures(df: DataFrame, section: str, name: Column, columns: list[str] | None = None) -> DataFrame:
    """The numeric columns of a report as rows."""
    own = columns or [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
    entries = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in own])
    return df.select(F.lit(section).alias("section"), name.alias("name"), F.inline(entries))
