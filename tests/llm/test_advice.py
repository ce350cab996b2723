"""Cases in which an operator once did less than its whole job."""

from collections import Counter

import corpus_pipeline
from sparkloom.llm import mixing


def test_curriculum_keeps_rows_without_or_with_repeated_ids(spark, edge):
    rows = [(None, "one two three", "a"), (None, "four five", "a"), (1, "six seven eight nine", "a"), (1, "six seven eight nine", "a"), (1, "ten", "b"), (2, "eleven twelve", None)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string, source string"), edge):
        placed = Counter()
        for r in mixing.place(df).collect():
            placed[r["doc_id"], r["source"], r["size"]] += r["epochs"]
        got = Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in mixing.curriculum(df).collect())
        assert got == +placed
        assert sum(n for (d, *_), n in got.items() if d is None) > 0


def test_all_stages_stand_the_edge_cases(spark, sf, edge):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, edge, sf).columns == edge.columns, name
        stage(spark, edge, sf).collect()
    assert None in {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, edge, sf).collect()}
