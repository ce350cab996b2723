"""Cards of concepts: tasks sort a bounded number of lines, and lines of ends without a card aren't gathered."""

from sparkloom.operators import retrieval


def test_tasks_of_context_texts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TASK_LINES", 10)
    concepts = spark.createDataFrame([(f"P:{i}", f"Part {i}. More.", "Model", "expert") for i in range(40)], "name string, definition string, category string, difficulty string")
    edges = spark.createDataFrame([(f"P:{i}", "REQUIRES", "S:hub") for i in range(40)] + [("P:0", "IS_A", "P:1"), ("P:1", "IS_A", "P:1")], "src string, rel string, dst string")
    made = retrieval.context_texts(concepts, edges)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert ", 9)" in plan and "LeftSemi" in plan
    got = {r["name"]: r["context"] for r in made.collect()}
    assert len(got) == 40
    assert got["P:1"].endswith("[DIRECT RELATIONSHIPS]\n  - IS_A ← P:0: Part 0.\n  - IS_A → P:1: Part 1.\n  - REQUIRES → S:hub\n") or got["P:1"].endswith("[DIRECT RELATIONSHIPS]\n  - REQUIRES → S:hub\n  - IS_A ← P:0: Part 0.\n  - IS_A → P:1: Part 1.\n"), got["P:1"]
