"""Documents are labelled where they are read: no text crosses the network for it."""

from sparkloom.plans import queries


def test_no_join_or_shuffle_for_labelling(spark, sf, capsys):
    got = queries.zero_shot(spark, sf)
    got.explain()
    plan = capsys.readouterr().out
    assert "Scan parquet" in plan and "Join" not in plan and "Exchange" not in plan
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
