"""Which names a set of questions can have anything to do with, without trying all pairs.

A name scores above zero for a question if it stands in it or shares a word with it. Names
that stand in a question are found by an Aho-Corasick automaton: each task builds one from
its own names, a batch at a time, and reads every question once. Names that share a word are
found by a join on the word. Only these pairs are scored.

Edge cases: a null question or name has no pairs; an empty name stands in every question;
repeated questions and names give repeated pairs; without questions or names there are none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..columns import MAX_BROADCAST_ROWS, counted
from ..functions.scoring import entity_score, tokens

#: Names in one automaton.
NAMES_AT_ONCE = 50_000


def contained(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, ord) of all names that stand in a question, in any case.

    The questions are a stated set, told to every task; a larger one goes in blocks.
    """
    asked = questions.select("qid", F.lower("question").alias("q")).where("q IS NOT NULL")
    told = names.select("ord", F.lower("name").alias("n")).where("n IS NOT NULL")
    blocks = -(-asked.count() // MAX_BROADCAST_ROWS)
    qid, place = questions.schema["qid"].dataType.simpleString(), names.schema["ord"].dataType.simpleString()
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid", "q"), F.lit(blocks)) == b)
        found = told.mapInPandas(_finder([(r["qid"], r["q"]) for r in part.collect()]), f"qid {qid}, ord {place}")  # a block of questions
        out = found if out is None else out.unionByName(found)
    return out if out is not None else asked.select("qid", F.lit(None).cast(place).alias("ord")).limit(0)


def _finder(questions: list[tuple]):  # type: ignore[no-untyped-def]
    """What finds the names of a task's batches in the questions."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        for batch in batches:
            for at in range(0, len(batch), NAMES_AT_ONCE):
                part = batch.iloc[at : at + NAMES_AT_ONCE]
                places: dict[str, list] = {}
                for n, o in zip(part["n"], part["ord"], strict=True):
                    places.setdefault(n, []).append(o)
                everywhere = places.pop("", [])
                automaton = ahocorasick.Automaton()
                for n, own in places.items():
                    automaton.add_word(n, own)
                automaton.make_automaton()
                rows = []
                for qid, q in questions:
                    hit = {id(own): own for _, own in automaton.iter(q)} if places else {}
                    rows += [(qid, o) for own in [*hit.values(), everywhere] for o in own]
                yield pd.DataFrame(rows, columns=["qid", "ord"])

    return run


def sharing(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, ord) of all names that share a word with a question, question words apart."""
    asked = questions.select("qid", F.explode(F.array_except(tokens(F.lower("question")), F.array(*[F.lit(w) for w in schemas.QUESTION_WORDS]))).alias("token"))
    own = names.select("ord", F.explode(tokens(F.lower("name"))).alias("token"))
    return own.join(counted(asked), "token").select("qid", "ord")


def scored(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, ord, name, score): all pairs with a score above zero. ``qid`` and ``ord`` are unique."""
    pairs = contained(questions, names).unionByName(sharing(questions, names)).distinct()
    both = pairs.join(names.select("ord", "name"), "ord").join(counted(questions.select("qid", "question")), "qid")
    return both.select("qid", "ord", "name", entity_score(F.col("question"), F.col("name")).alias("score")).where("score > 0")
