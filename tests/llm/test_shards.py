"""Sampled splitters against an exact cut of the sorted rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import queries, shards
from tests.llm.conftest import SCHEMA


def plain(rows, n=8):
    """(doc_id, size, crc, shard, slot) of rows (doc_id, text) by one sort."""
    size = lambda t: len((t or "").encode()) + 1
    lot = lambda t: int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)
    order = sorted(rows, key=lambda r: (lot(r[1]), -(1 << 63) if r[0] is None else r[0]))
    total, at, out, held = sum(size(t) for _, t in rows), 0, [], [0] * n
    for i, t in order:
        s = min(n - 1, n * (2 * at + size(t)) // (2 * total))
        out.append((i, size(t), zlib.crc32((t or "").encode()), s, held[s]))
        held[s] += 1
        at += size(t)
    return sorted(out, key=str)


def got(found):
    return sorted([(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in shards.digest(found).collect()], key=str)


def test_query_equals_an_exact_cut(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    df = queries.op13_sampled_splitters(spark, sf)
    assert sorted([(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in df.collect()], key=str) == plain(rows)
    assert {(r["law"], r["grown_shard"]) for r in df.select("law", "grown_shard").distinct().collect()} == {("bytes", None)}


@pytest.mark.parametrize("n", [1, 3, 8])
def test_edge_cases(spark, edge, n):
    found = shards.sharded(edge, n)
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert got(found) == plain(rows, n)
    assert found.select("record.*").columns == edge.columns


def test_empty_table(spark, empty):
    assert got(shards.sharded(empty)) == []


def test_hot_groups_are_cut(spark):
    """A third of the rows have one text, another third one text and one id; sizes stay near equal."""
    rows = [(i, "hot text", "", "", 0) for i in range(3000)] + [(7, "the same row", "", "", 0)] * 3000 + [(i, f"text {i} " * (i % 9), "", "", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = shards.sharded(df)
    assert got(found) == plain([(r[0], r[1]) for r in rows])
    sums = [r["b"] for r in found.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 8 and max(sums) - min(sums) <= 2 * 90


def test_overfull_ranges_are_divided(spark, monkeypatch):
    """With hardly any splitters at first the ranges are sampled again until none is overfull."""
    rows = spark.range(4000).select("id", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("lot"), F.col("id").alias("row"), (F.col("id") % 50 + 1).alias("size"))
    first = shards._drawn
    monkeypatch.setattr(shards, "_drawn", lambda k, w, t, salt, *every: first(k, w, t, salt, *every)[: None if salt else 2])
    total = rows.agg(F.sum("size")).first()[0]
    splitters, sums = shards.split_points(rows, 40, total, 4000)
    assert len(splitters) >= 20 and sums["rows"].sum() == 4000 and sums["bytes"].sum() == total
    mean = total // 4000
    assert (sums["bytes"] + mean * (sums["rows"] - 1) - sums["largest"] <= 2 * (total + mean * 4000) / 40).all()


def test_written_shards(spark, docs, tmp_path):
    found = shards.sharded(docs)
    shards.write(found, str(tmp_path / "out"), "part_no")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["doc_id"] for r in back.select("doc_id").collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert back.select("part_no").distinct().count() == 8
