"""Scores and decisions over question texts, names and summaries, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas
from .text import W, strip

# Signals whose counts decide the route.
GLOBAL_SIGNALS = [
    r"\boverview\b",
    r"\bsummariz",
    r"\blandscape\b",
    r"\btrend",
    r"\bmain (approach|method|technique|way|type)",
    r"\bdifferent (approach|method|technique|type|kind)",
    r"\ball (approach|method|technique|way|type|concept)",
    r"\bhow has\b",
    r"\bhow have\b",
    r"\bwhat are the (main|key|major|different|various|common)",
    r"\bbroadly\b",
    r"\bin general\b",
    r"\bfield of\b",
    r"\bacross (the|different|various)\b",
    r"\bstate of the art\b",
    r"\bevolution of\b",
    r"\bhistory of\b",
    r"\blandscape of\b",
    r"\bclassif(y|ication) of\b",
    r"\btaxonom",
    r"\bcategor",
]
LOCAL_SIGNALS = [
    r"\bwhat is (a |an |the )?\w",
    r"\bdefine\b",
    r"\bexplain\b",
    r"\bhow does .+ work\b",
    r"\bwhat does .+ (do|mean|require|need)\b",
    r"\brequire",
    r"\bprerequisite",
    r"\bdepend",
    r"\bcompare\b",
    r"\bversus\b",
    r"\bvs\.?\b",
    r"\bdifference between\b",
    r"\blearning path\b",
    r"\bhow to (learn|use|implement|build|train)\b",
    r"\bexample of\b",
    r"\buse case",
    r"\bapplication of\b",
]
# Substrings that decide the retrieval mode, in order of precedence.
MODE_SIGNALS = {
    "prerequisite": ["before", "prerequisite", "require", "need to know", "depend", "foundation", "learn first", "should know", "start with"],
    "similarity": ["similar", "compare", "difference", "versus", "vs", "alternative", "like", "same as", "related to"],
    "usage": ["used in", "application", "example", "use case", "how is", "where is"],
}
MODE_TYPES = {"standard": None, "prerequisite": schemas.PREREQUISITE_TYPES, "similarity": schemas.SIMILARITY_TYPES, "usage": schemas.USAGE_TYPES}


def hits(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur."""
    return reduce(lambda a, b: a + b, [F.regexp_like(text, F.lit(p)).cast("int") for p in patterns])


def route(query: Column) -> Column:
    """global where its signals win, else local (also on ties)."""
    q = strip(F.lower(query))
    return F.when(hits(q, GLOBAL_SIGNALS) > hits(q, LOCAL_SIGNALS), "global").otherwise("local")


def mode(query: Column) -> Column:
    q = F.lower(query)
    out = F.lit("standard")
    for name, signals in reversed(MODE_SIGNALS.items()):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(q, F.lit(s)) for s in signals]), name).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Distinct pieces between non-word characters; an empty piece counts where one arises."""
    return F.array_distinct(F.split(text, r"[^\p{L}\p{N}_]+"))


def entity_score(query: Column, name: Column) -> Column:
    """How well a concept's name fits a question: exact, contained, or by shared words."""
    q, n = F.lower(query), F.lower(name)
    contained = F.when(F.contains(q, n), F.least(F.lit(0.95), 0.7 + F.length(n) / 100.0)).otherwise(0.0)
    own = tokens(n)
    shared = F.size(F.array_intersect(F.array_except(tokens(q), F.array(*[F.lit(w) for w in schemas.QUESTION_WORDS])), own))
    return F.when(q == n, 1.0).otherwise(F.greatest(contained, shared / F.greatest(F.size(own), F.lit(1)) * 0.8))


def search_score(query: Column, name: Column, definition: Column, uses: Column) -> Column:
    """Name equal 10 or containing 5, definition +2, any use case +1."""
    q = F.lower(query)
    n = F.lower(name)
    return F.when(n == q, 10).when(F.contains(n, q), 5).otherwise(0) + F.when(F.contains(F.lower(definition), q), 2).otherwise(0) + F.when(F.exists(uses, lambda u: F.contains(F.lower(u), q)), 1).otherwise(0)


def long_words(text: Column) -> Column:
    """Words of three characters or more, in order, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit(W + "{3,}"), F.lit(0))


def relevance(query: Column, summary: Column) -> Column:
    """Share of the question's long words in the summary, plus 0.2 for each pair of them, in
    question order, that stands in the summary as a phrase."""
    return word_relevance(F.array_distinct(long_words(query)), F.array_distinct(long_words(summary)), F.lower(summary))


def word_relevance(own: Column, there: Column, lowered: Column) -> Column:
    """The same from the distinct long words of both and the lower-cased summary, worked out once per row before any join."""
    rest = F.greatest(F.size(own) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(own, 1, rest), F.slice(own, 2, rest), lambda a, b: F.concat(a, F.lit(" "), b))
    found = F.size(F.filter(pairs, lambda p: F.contains(lowered, p)))
    return F.when((F.size(own) > 0) & (F.size(there) > 0), F.size(F.array_intersect(own, there)) / F.size(own) + 0.2 * found).otherwise(0.0)


def vote(response: Column) -> Column:
    """The marked vote; else abstain, yes or no by what the last sentence says; else abstain."""
    upper = F.upper(response)
    marked = F.lower(F.regexp_extract(upper, r"\[VOTE:\s*(YES|NO|ABSTAIN)\]", 1))
    last = F.element_at(F.split(upper, r"\."), -1)
    return F.when(marked != "", marked).when(F.contains(upper, F.lit("ABSTAIN")), "abstain").when(F.contains(last, F.lit("YES")), "yes").when(F.contains(last, F.lit("NO")), "no").otherwise("abstain")


def without_vote(response: Column) -> Column:
    return strip(F.regexp_replace(response, r"(?i)\[VOTE:\s*(YES|NO|ABSTAIN)\]", ""))


def verdict(yes: Column, no: Column) -> Column:
    return F.when(yes > no, "APPROVED").when(no > yes, "REJECTED").otherwise("SPLIT")
