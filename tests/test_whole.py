"""Registered queries work on all of their input."""

from sparkloom.plans import queries


def test_parts_have_communities(spark, sf):
    kinds = {r["name"][:2] for r in queries.louvain(spark, sf).select("name").distinct().collect()}
    assert kinds >= {"P:", "S:", "B:", "T:"}
