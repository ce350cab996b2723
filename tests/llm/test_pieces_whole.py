"""op5 gives its whole result, measured on the text as given."""

from sparkloom.llm import pieces, queries


def test_op5_has_the_ids(spark, sf, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op5_sentencepiece(spark, sf).collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]])


def test_texts_with_the_mark_do_not_come_back(spark):
    rows = [(1, "a\u2581b"), (2, "a b"), (3, ""), (4, None), (5, "\u2581"), (6, " \u00e9 ")]
    got = {r["doc_id"]: (r["n_bytes"], r["round_trip"]) for r in pieces.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (5, False), 2: (3, True), 3: (0, True), 4: (0, True), 5: (3, False), 6: (4, True)}
