"""Retrieval: matching questions to concepts and summaries, vector search, context texts.

Questions come as a table and are answered as a set. Each operator takes the
questions as the small side: their number is checked before they are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..columns import MAX_BROADCAST_ROWS, counted, first_rows, fresh
from ..functions import hooks
from ..functions.scoring import GLOBAL_SIGNALS, LOCAL_SIGNALS, hits, long_words, mode, route, search_score, tokens
from ..functions.text import acronym, concept_document, first_sentence, json_object, slug, strip, truncate_words
from ..session import cut_lineage
from . import cosines, matching

def against(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """All rows with each query of a stated query set; a set beyond the bound goes in blocks."""
    n = queries.limit(MAX_BROADCAST_ROWS + 1).count()
    if n <= MAX_BROADCAST_ROWS:
        return rows.join(F.broadcast(queries))
    block = fresh("block", rows, queries)
    dealt = queries.withColumn(block, F.pmod(F.xxhash64(*queries.columns), F.lit(-(-queries.count() // MAX_BROADCAST_ROWS) * 2)))
    blocks = sorted(r[block] for r in dealt.select(block).distinct().collect())
    out = None
    for b in blocks:
        part = rows.join(F.broadcast(dealt.where(F.col(block) == b).drop(block)))
        out = part if out is None else out.unionByName(part)
    return out


def routed(questions: DataFrame, model: Callable[[str, str], str | None] | None = None) -> DataFrame:
    """With route and mode. Where the signals tie a model hook on ("route", question) may decide; without one, local."""
    q = strip(F.lower("question"))
    found = route(F.col("question"))
    if model is not None:
        says = F.lower(hooks.on_question(model)(F.lit("route"), F.col("question")))
        tied = hits(q, GLOBAL_SIGNALS) == hits(q, LOCAL_SIGNALS)
        found = F.when(tied, F.when(F.contains(F.coalesce(says, F.lit("")), F.lit("global")), "global").otherwise("local")).otherwise(found)
    return questions.withColumns({"route": found, "mode": mode(F.col("question"))})


def acronyms(names: DataFrame) -> DataFrame:
    """(acronym, name): the first name, by name, for each acronym."""
    return names.select(acronym(F.col("name")).alias("acronym"), "name").where("acronym IS NOT NULL").groupBy("acronym").agg(F.min("name").alias("name"))


def entities(questions: DataFrame, names: DataFrame) -> DataFrame:
    """The best concept for each question and its confidence: an acronym among its words (0.92), else
    the best score. ``names`` has (ord, name); of equal scores the first by ord counts.
    """
    asked = questions.select("qid", "question", F.posexplode(F.split(F.lower("question"), r"[^\p{L}\p{N}_]+")).alias("pos", "acronym"))
    short = asked.join(acronyms(names), "acronym").groupBy("qid").agg(F.min_by("name", "pos").alias("short"))
    best = matching.scored(questions, names).groupBy("qid").agg(F.max_by("name", F.struct(F.col("score"), -F.col("ord"))).alias("name"), F.max("score").alias("score"))
    return questions.select("qid", "question").join(short, "qid", "left").join(best, "qid", "left").select("qid", "question", F.coalesce("short", "name").alias("name"), F.when(F.col("short").isNotNull(), 0.92).otherwise(F.coalesce("score", F.lit(0.0))).alias("confidence"))


#: Below this confidence a model hook is asked; what it finds has the other.
ASK_BELOW, ASKED = 0.8, 0.85


def asked_entities(found: DataFrame, names: DataFrame, model: Callable[[str, str], str | None], n: int = 30) -> DataFrame:
    """``entities`` with a model's help: asked with the question and a list of names where confidence is low.

    Its reply {"concept": name} counts if it names a known concept in any case and is surer.
    """
    unsure = found.where(F.col("confidence") < ASK_BELOW)
    listed = candidates(unsure.select("qid", "question"), names, n)
    replies = unsure.join(listed, "qid").withColumn("said", F.lower(json_object(hooks.on_question(model)("question", "listed"), "concept string", greedy=False)["concept"]))
    known = names.groupBy(F.lower("name").alias("said")).agg(F.min("name").alias("meant"))
    meant = replies.join(known, "said").where(F.col("confidence") < ASKED).select("qid", "meant")
    both = found.join(meant, "qid", "left")
    return both.select("qid", "question", F.coalesce("meant", "name").alias("name"), F.when(F.col("meant").isNotNull(), ASKED).otherwise(F.col("confidence")).alias("confidence"))


def candidates(questions: DataFrame, names: DataFrame, n: int = 30) -> DataFrame:
    """(qid, listed): the names that share most tokens with each question (ties: from the end of the
    alphabet), comma-joined; where none does the first ``n`` names by ord."""
    terms = names.select("name", F.explode(tokens(F.lower("name"))).alias("token"))
    asked = questions.select("qid", F.explode(tokens(F.lower("question"))).alias("token"))
    shared = terms.join(counted(asked), "token").groupBy("qid", "name").agg(F.count(F.lit(1)).alias("shared"))
    best = shared.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("shared"), F.desc("name")))).where(F.col("rn") <= n)
    told = best.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"]), ", ").alias("told"))
    first = names.orderBy("ord").limit(n).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ", ").alias("first"))
    return questions.select("qid").join(told, "qid", "left").join(F.broadcast(first)).select("qid", F.coalesce("told", "first").alias("listed"))  # first is one row


def entity_scores(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Every question's score for every name it has anything to do with."""
    return matching.scored(questions, names).select("qid", "name", F.round("score", 6).alias("score")).where("score > 0")


def search(concepts: DataFrame, question: str, n: int = 10) -> DataFrame:
    """Concepts with a search score, best first, ties by name from the end of the alphabet."""
    scored = concepts.withColumn("score", search_score(F.lit(question), F.col("name"), F.col("definition"), F.col("example_use_cases")))
    return scored.where("score > 0").orderBy(F.desc("score"), F.desc("name")).limit(n)


def suggestions(found: DataFrame, concepts: DataFrame, n: int = 5) -> DataFrame:
    """(qid, name, score, rn): for questions without an entity the concepts that a search for them finds."""
    lost = found.where("name IS NULL").select("qid", "question")
    scored = against(concepts.select("name", "definition", "example_use_cases"), lost).withColumn("score", search_score(F.col("question"), F.col("name"), F.col("definition"), F.col("example_use_cases"))).where("score > 0")
    return scored.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("name")))).where(F.col("rn") <= n).select("qid", "name", "score", "rn")


def related_names(names: DataFrame, question: str, n: int = 30) -> DataFrame:
    """(name, shared) by shared tokens, ties from the end of the alphabet; the first names by ord where none shares one."""
    shared = F.size(F.array_intersect(tokens(F.lower(F.lit(question))), tokens(F.lower("name"))))
    scored = names.select("name", "ord", shared.alias("shared"))
    best = scored.where("shared > 0").orderBy(F.desc("shared"), F.desc("name")).limit(n)
    any_ = best.agg(F.count(F.lit(1)).alias("some"))
    first = scored.orderBy("ord").limit(n).join(F.broadcast(any_)).where("some = 0").select("name", "ord", "shared")  # any_ is one row
    return best.unionByName(first).orderBy(F.desc("shared"), F.when(F.col("shared") > 0, F.col("name")).desc(), "ord").select("name", "shared")


def relevances(texts: DataFrame, questions: DataFrame) -> DataFrame:
    """``texts`` (with summary) with qid and score of each question that shares a long word with them.

    A text's words are cut once and cut down to the questions' words; those that are left
    look their questions up, so a text without any costs one pass over its words and gives
    no row. Nothing is dealt. The questions' words are counted: they go into the plan as
    long as they are few, a larger set in blocks of questions.
    """
    asked = questions.select("qid", F.array_distinct(long_words(F.col("question"))).alias("own")).where(F.size("own") > 0)
    n = asked.agg(F.coalesce(F.sum(F.size("own")), F.lit(0))).first()[0]
    blocks = -(-n // MAX_QUESTION_WORDS) or 1
    low, words, hit, own, found = (fresh(c, texts) for c in ("low", "words", "hit", "own", "found"))
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        rows = part.collect()  # bounded: a block's words
        by_word: dict[str, list] = {}
        for r in rows:
            for w in r["own"]:
                by_word.setdefault(w, []).append(r["qid"])
        kind = questions.schema["qid"].dataType.simpleString()
        every = F.array(*[F.lit(w) for w in sorted(by_word)]).cast("array<string>")
        index = F.create_map(*[c for w in sorted(by_word) for c in (F.lit(w), F.array(*[F.lit(q) for q in by_word[w]]).cast(f"array<{kind}>"))]) if by_word else F.lit(None).cast(f"map<string,array<{kind}>>")
        cut = texts.withColumn(low, F.lower("summary")).withColumn(words, F.array_intersect(long_words(F.col("summary")), every))
        # No filter on the words: it would move below the projection and cut every text twice. Exploding drops rows without any.
        some = cut.withColumn(found, F.flatten(F.transform(words, lambda w: F.element_at(index, w))))  # noqa: B023
        each = some.withColumn(hit, F.explode(F.array_distinct(found)))
        told = part.select(F.col("qid").alias(hit), F.col("own").alias(own))
        pairs = F.zip_with(F.slice(own, 1, F.size(own) - 1), F.slice(own, 2, F.size(own) - 1), lambda x, y: F.concat(x, F.lit(" "), y))
        score = F.size(F.filter(found, lambda q: q == F.col(hit))) / F.size(own) + 0.2 * F.size(F.filter(pairs, lambda p: F.contains(F.col(low), p)))  # noqa: B023
        scored = each.join(F.broadcast(told), hit).select(*texts.columns, F.col(hit).alias("qid"), F.round(score, 6).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


#: Question words that one plan holds.
MAX_QUESTION_WORDS = 2_000


def ranked_summaries(questions: DataFrame, communities: DataFrame, k: int = 5) -> DataFrame:
    """Each question's k most relevant communities; where none has a score, the first k by id at score 0."""
    told = communities.where(F.length("summary") > 0).select("community_id", "summary")
    # Ranked by id and hash alone, so that no summary is sorted once per question; those of the best come back by a join.
    marked = told.withColumn("mark", F.xxhash64("summary"))
    scored = relevances(marked, questions).select("community_id", "mark", "qid", "score")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "community_id", "mark")
    best_ids = cut_lineage(scored.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k))
    top = marked.join(counted(best_ids), ["community_id", "mark"]).select("qid", "community_id", "score", "rn", "summary")
    top = cut_lineage(top.dropDuplicates(["qid", "rn"]))  # repeated communities meet each of their ranks
    first = told.orderBy("community_id").limit(k).withColumn("rn", F.row_number().over(Window.orderBy("community_id")))  # k rows
    empty = questions.select("qid").join(top.select("qid").distinct(), "qid", "left_anti")
    rest = empty.join(F.broadcast(first)).select("qid", "community_id", F.lit(0.0).alias("score"), "rn", "summary")
    return top.unionByName(rest)


def fallback_answers(ranked: DataFrame, most_words: int = 400) -> DataFrame:
    """The answer without a model: the ranked summaries, cut to size and joined."""
    parts = F.array_sort(F.collect_list(F.struct("rn", truncate_words(F.col("summary"), most_words).alias("s"))))
    return ranked.groupBy("qid").agg(F.array_join(F.transform(parts, lambda p: p["s"]), "\n\n").alias("answer"))


def useful_answers(partial: DataFrame) -> DataFrame:
    """Partial answers that say something."""
    return partial.where((F.upper(strip(F.col("answer"))) != "IRRELEVANT") & (F.length("answer") > 20))


def answered(questions: DataFrame, model: Callable[[str, str], str | None] | None = None) -> DataFrame:
    """Answers of a model hook on (question, context), the context itself where there is none.

    The hook runs in Arrow batches, once per row; a null reply takes the fallback.
    """
    fallback = F.concat(F.lit("Context about "), "name", F.lit(":\n\n"), "context")
    if model is None:
        return questions.withColumn("answer", fallback)
    ask = hooks.on_question(model)
    return questions.withColumn("answer", F.coalesce(ask("question", "context"), fallback))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 3, exclude: list[int] | None = None) -> DataFrame:
    """The k nearest rows of each query vector by cosine; excluded rows go after the choice of k.

    ``vectors`` has vec_id and embedding, ``queries`` q_id and q. Vectors of the dimension of
    most queries go through matrix products (``cosines``); pairs with any other vector, or a row
    without an id, are scored one by one.
    """
    rows, asked = vectors.select("vec_id", "embedding"), queries.select("q_id", "q")
    sizes = asked.groupBy(F.size("q").alias("n")).agg(F.count(F.lit(1)).alias("cnt")).where("n > 0").orderBy(F.desc("cnt"), "n").first()
    dim = sizes["n"] if sizes else 0
    plain = cosines.regular("embedding", dim) & F.col("vec_id").isNotNull()
    even = cosines.regular("q", dim) & F.col("q_id").isNotNull()
    found = cosines.nearest(rows.where(plain), "embedding", "vec_id", asked.where(even), "q", k).select("q_id", "vec_id", F.col("cosine").alias("similarity"))
    odd = against(rows.where(~plain), asked.where(even))
    if not asked.where(~even).isEmpty():
        odd = odd.unionByName(against(rows, asked.where(~even)))
    scored = found.unionByName(odd.select("q_id", "vec_id", cosine(F.col("embedding"), F.col("q")).alias("similarity"))).withColumn("similarity", F.round("similarity", 5))
    top = scored.withColumn("rn", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("similarity"), "vec_id"))).where(F.col("rn") <= k)
    return top.where(~F.col("vec_id").isin(exclude)) if exclude else top


def embed(rows: DataFrame, text: str, size: int = 64, model: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """``embedding`` of a text: by a model hook in Arrow batches, else feature hashing of its words."""
    if model is not None:
        return rows.withColumn("embedding", hooks.on_texts(model)(F.col(text)))
    return rows.withColumn("embedding", _hashed(size)(tokens(F.lower(F.col(text)))))


#: Words whose slot a task remembers.
SLOTS = 100_000


def _hashed(size: int):  # type: ignore[no-untyped-def]
    """A column function: how many of the words (distinct ones, empty ones apart) fall into each slot, by the MD5 of a word."""

    @F.pandas_udf("array<float>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {"": size}
        for batch in batches:
            made = []
            for words in batch:
                if words is None:
                    made.append([None] * size)
                    continue
                if len(known) > SLOTS:
                    known = {"": size}
                for w in words:
                    if w not in known:
                        known[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % size
                made.append(np.bincount([known[w] for w in words], minlength=size + 1)[:size].astype(np.float32))
            yield pd.Series(made, index=batch.index, dtype=object)

    return count


#: Lines that one task sorts for ``context_texts``.
TASK_LINES = 250_000


def context_texts(concepts: DataFrame, edges: DataFrame, most: int = 6000) -> DataFrame:
    """Each concept's card with its direct relationships, by priority, as one text."""
    priority = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in schemas.RELATIONSHIP_PRIORITY]), F.col("rel")).cast("int"), F.lit(0))
    rank = F.when(priority == 0, 99).otherwise(priority - 1)
    edges = cut_lineage(edges.select("src", "rel", "dst"))
    # As many partitions as the lines ask for, so that a task sorts no more of them in a larger graph.
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * edges.count() // TASK_LINES))
    out = edges.select(F.col("src").alias("name"), "rel", F.lit("→").alias("arrow"), F.col("dst").alias("other"))
    back = edges.where("src <> dst").select(F.col("dst").alias("name"), "rel", F.lit("←").alias("arrow"), F.col("src").alias("other"))
    known = concepts.select(F.col("name").alias("other"), first_sentence(F.col("definition")).alias("preview"))
    # Ends without a card show no lines. A card shows no more than ``most`` characters, so no more lines
    # than that are given their preview and gathered.
    own = out.unionByName(back).repartition(parts, "name").join(concepts.select("name"), "name", "left_semi").withColumn("rank", rank)
    first = own.withColumn("rn", F.row_number().over(Window.partitionBy("name").orderBy("rank", "other", "arrow", "rel"))).where(F.col("rn") <= most // 8)
    lines = first.repartition(parts, "other").join(known, "other", "left").select("name", F.struct("rn", F.concat(F.lit("  - "), "rel", F.lit(" "), "arrow", F.lit(" "), "other", F.coalesce(F.concat(F.lit(": "), "preview"), F.lit(""))).alias("line")).alias("l"))
    listed = lines.repartition(parts, "name").groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda l: l["line"]), "\n").alias("relations"))  # noqa: E741
    head = F.concat(F.lit("[CONCEPT: "), "name", F.lit("]\nDefinition: "), "definition", F.lit("\nCategory: "), "category", F.lit(" | Difficulty: "), "difficulty", F.lit("\n"))
    text = F.concat(head, F.coalesce(F.concat(F.lit("\n[DIRECT RELATIONSHIPS]\n"), "relations", F.lit("\n")), F.lit("")))
    return concepts.join(listed, "name", "left").select("name", F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n...[context truncated]"))).otherwise(text).alias("context"))


def comparison_context(a: Column, name_a: Column, b: Column, name_b: Column) -> Column:
    return F.concat(F.lit("=== "), name_a, F.lit(" ===\n"), a, F.lit("\n\n=== "), name_b, F.lit(" ===\n"), b)


def covered(names: DataFrame, files: DataFrame) -> DataFrame:
    """(name, covered): whether the corpus has a file for a concept: its safe name, an underscore, anything, ".txt".

    So a file answers for every part of its name that ends before an underscore; these parts are
    joined by equality. A null name isn't covered; repeated names give repeated rows.
    """
    from ..functions.text import safe_name

    parts = F.split(F.regexp_extract("source_file", r"(?s)^(.*)\.txt$", 1), "_")
    starts = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(parts, 1, i), "_"))
    have = files.select(F.explode(starts).alias("safe")).distinct()
    return names.withColumn("safe", safe_name(F.col("name"))).join(have.withColumn("covered", F.lit(True)), "safe", "left").select("name", F.coalesce("covered", F.lit(False)).alias("covered"))


def seeded(names: DataFrame, files: DataFrame, concepts: DataFrame) -> DataFrame:
    """(source_file, text): for each name that no corpus file covers a document made of its concept.

    Names without a concept, and concepts without a definition, give none. Names that share a safe
    name share a file, which the first of them by name gets, and of concepts with one name the first by all columns.
    """
    from ..functions.text import safe_name, seed_document

    lost = covered(names, files).where(~F.col("covered")).select("name").distinct()
    col = lambda c, kind: F.col(c) if c in concepts.columns else F.lit(None).cast(kind)
    text = seed_document(F.col("name"), col("category", "string"), col("difficulty", "string"), col("definition", "string"), col("example_use_cases", "array<string>"), col("related_tools", "array<string>"), col("source_references", "array<string>"))
    made = concepts.join(lost, "name", "left_semi").select("name", F.concat(safe_name(F.col("name")), F.lit("_seed.txt")).alias("source_file"), text.alias("text")).where("text IS NOT NULL")
    return first_rows(made, ["source_file"], "name").select("source_file", "text")


def vector_id(name: Column) -> Column:
    """The id under which a concept's vector is kept; names with one id overwrite each other."""
    return slug(name)


def index_rows(concepts: DataFrame, model: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """(id, name, category, difficulty, document, embedding) of concepts, as the vector index keeps them."""
    return embed(_index_texts(concepts), "document", model=model)


def _index_texts(concepts: DataFrame) -> DataFrame:
    document = concept_document(F.col("name"), F.col("definition"), F.col("category"), F.col("difficulty"), F.col("example_use_cases"))
    return concepts.select(vector_id(F.col("name")).alias("id"), "name", "category", "difficulty", document.alias("document"))


def indexed(index: DataFrame | None, concepts: DataFrame, model: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """The index after an upsert of ``concepts`` by id; of incoming names with one id the last by all columns counts.

    A document decides its vector, so a new index is embedded when it has one row per id; no vector is sent.
    """
    from ..sources.sinks import upsert

    if index is None:
        new = _index_texts(concepts)
        return embed(upsert(new.limit(0), new, ["id"]), "document", model=model)
    return upsert(index, index_rows(concepts, model), ["id"])


def vector_hits(questions: DataFrame, index: DataFrame, k: int = 3, model: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """(qid, name, document, similarity, rn): the k documents nearest to each question; the question's own
    concept (``name``, may be null) goes after the choice of k."""
    asked = embed(questions.select("qid", F.col("name").alias("own"), "question"), "question", model=model)
    rows, told = index.select("id", "name", "document", F.col("embedding").alias("v")), asked.select("qid", "own", F.col("embedding").alias("q"))
    told = cut_lineage(told)
    sizes = told.groupBy(F.size("q").alias("n")).agg(F.count(F.lit(1)).alias("cnt")).where("n > 0").orderBy(F.desc("cnt"), "n").first()
    dim = sizes["n"] if sizes else 0
    plain = cosines.regular("v", dim) & F.col("id").isNotNull()
    even = cosines.regular("q", dim)
    found = cosines.nearest(rows.where(plain), "v", "id", told.where(even), "q", k).select("qid", "own", "id", "name", "document", F.col("cosine").alias("similarity"))
    odd = against(rows.where(~plain), told.where(even))
    if not told.where(~even).isEmpty():
        odd = odd.unionByName(against(rows, told.where(~even)))
    each = odd.select("qid", "own", "id", "name", "document", F.coalesce(F.try_divide(_dot("v", "q"), F.sqrt(_dot("v", "v")) * F.sqrt(_dot("q", "q"))), F.lit(0.0)).alias("similarity"))
    near = found.unionByName(each).withColumn("similarity", F.round("similarity", 5))
    top = near.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "id"))).where(F.col("rn") <= k)
    return top.where(F.col("own").isNull() | (F.col("name") != F.col("own"))).select("qid", "name", "document", "similarity", "rn")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, t: s + t)


def assembled(centers: DataFrame, nodes: DataFrame, touching: DataFrame, concepts: DataFrame, hits: DataFrame | None = None, most: int = 6000, per_hop: int = 8) -> DataFrame:
    """(key, context): a concept's card, its direct relationships, what lies further off, and similar texts.

    ``centers`` has (key, name), ``nodes`` and ``touching`` come from ``graph.subgraphs``, ``hits``
    from ``vector_hits`` with qid as key. Relationships stand by priority, then name; a preview is
    shown for nodes of the subgraph only. Hops from 2 on list ``per_hop`` nodes each by name.
    """
    priority = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in schemas.RELATIONSHIP_PRIORITY]), F.col("rel")), F.lit(0)), F.lit(100))
    card = concepts.select("name", first_sentence(F.col("definition")).alias("preview"), "category")
    around = nodes.join(card, "name", "left")
    own = centers.withColumnRenamed("name", "center")
    ends = touching.join(own, "key")
    out = ends.where("src = center").select("key", "rel", F.lit("→").alias("arrow"), F.col("dst").alias("name"))
    back = ends.where("dst = center AND src <> center").select("key", "rel", F.lit("←").alias("arrow"), F.col("src").alias("name"))
    told = out.unionByName(back).join(around.select("key", "name", "preview"), ["key", "name"], "left")
    line = F.concat(F.lit("  - "), "rel", F.lit(" "), "arrow", F.lit(" "), "name", F.coalesce(F.concat(F.lit(": "), "preview"), F.lit("")))
    ranked = told.select("key", F.struct(priority.alias("p"), "name", "arrow", "rel", line.alias("line")).alias("l"))
    # The context shows no more than ``most`` characters, so no more lines than that are gathered.
    ranked = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("l"))).where(F.col("rn") <= most // 8)
    relations = ranked.groupBy("key").agg(_lines("l").alias("relations"))
    far = around.where("depth >= 2").withColumn("rn", F.row_number().over(Window.partitionBy("key", "depth").orderBy("name"))).where(F.col("rn") <= per_hop)
    named = F.concat(F.lit("  - "), "name", F.coalesce(F.concat(F.lit(" ("), "category", F.lit("): "), "preview"), F.lit("")))
    hop = far.groupBy("key", "depth").agg(_lines(F.struct("rn", named.alias("line"))).alias("ls"))
    section = F.concat(F.lit("[RELATED CONCEPTS - HOP "), F.col("depth").cast("string"), F.lit("]\n"), "ls", F.lit("\n"))
    hops = hop.groupBy("key").agg(_lines(F.struct("depth", section.alias("line"))).alias("hops"))
    listed = lambda head, c, n: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(F.slice(c, 1, n), ", "))) if c in concepts.columns else F.lit(None).cast("string")
    uses, tools = listed("Example uses: ", "example_use_cases", 3), listed("Key tools: ", "related_tools", 5)
    head = F.concat(F.concat_ws("\n", F.concat(F.lit("[CONCEPT: "), "name", F.lit("]")), F.concat(F.lit("Definition: "), "definition"), F.concat(F.lit("Category: "), "category", F.lit(" | Difficulty: "), "difficulty"), uses, tools), F.lit("\n"))
    full = centers.join(concepts, "name").select("key", head.alias("head")).join(relations, "key", "left").join(hops, "key", "left")
    parts = [F.col("head"), F.concat(F.lit("[DIRECT RELATIONSHIPS]\n"), "relations", F.lit("\n")), F.col("hops")]
    if hits is not None:
        text = F.replace(F.substring("document", 1, 300), F.lit("\n"), F.lit(" "))
        hit = F.concat(F.lit("  ["), "name", F.lit(" | similarity: "), F.format_number("similarity", 2), F.lit("]\n  "), text, F.lit("\n"))
        shown = hits.groupBy(F.col("qid").alias("key")).agg(_lines(F.struct("rn", hit.alias("line"))).alias("hits"))
        full = full.join(shown, "key", "left")
        parts.append(F.concat(F.lit("[SUPPORTING TEXT - semantic search]\n"), "hits"))
    text = F.concat_ws("\n", *parts)
    return full.select("key", F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n...[context truncated]"))).otherwise(text).alias("context"))


def _lines(entry: Column | str) -> Column:
    """The ``line`` of gathered structs in their order, one below the other."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["line"]), "\n")
