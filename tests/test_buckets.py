"""Bucketed upserts: repeated keys over many batches, replays, a crash before the swap, untouched buckets."""

import random

import pytest

from sparkloom.streaming import ingest

SCHEMA = "k string, v int, bucket string"


def latest(batches):
    out = {}
    for batch in batches:
        for k, v, b in batch:
            if k not in out or v > out[k][0]:
                out[k] = (v, b)
    return sorted(((k, *r) for k, r in out.items()), key=str)


def held(table):
    return sorted(map(tuple, table.rows().collect()), key=str)


def test_many_batches_equal_a_plain_dict(spark, tmp_path):
    draw = random.Random(2)
    table = ingest.BucketedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], "v", 8)
    assert held(table) == []
    batches, place = [], 0
    for n in range(4):
        rows = [(draw.choice([None, *"abcdefgh"]), place := place + 1, "x") for _ in range(draw.randrange(1, 9))]
        batches.append(rows)
        table.upsert(spark.createDataFrame(rows, SCHEMA), n)
        assert held(table) == latest(batches)
    table.upsert(spark.createDataFrame([], SCHEMA), 4)
    assert held(table) == latest(batches) and table.versions() == [0, 1, 2, 3, 4]
    batches.append([("a", 0, "late")])
    table.upsert(spark.createDataFrame(batches[-1], SCHEMA), 5)
    assert held(table) == latest(batches)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = ingest.BucketedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], "v", 16)
    table.upsert(spark.createDataFrame([(f"k{i}", i, "x") for i in range(60)], SCHEMA), 0)
    before = table.manifest()
    table.upsert(spark.createDataFrame([("k7", 100, "y")], SCHEMA), 1)
    changed = {b for b, f in table.manifest().items() if before[b] != f}
    assert len(changed) == 1 and len(held(table)) == 60 and ("k7", 100, "y") in held(table)


def test_replays_and_crashes(spark, tmp_path, monkeypatch):
    table = ingest.BucketedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], "v", 4)
    first, second = [("a", 1, "x"), ("b", 1, "x")], [("a", 2, "y"), ("c", 1, "y")]
    table.upsert(spark.createDataFrame(first, SCHEMA), 0)
    with monkeypatch.context() as m:
        m.setattr(table, "_swap", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            table.upsert(spark.createDataFrame(second, SCHEMA), 1)
    assert held(table) == latest([first])
    table.upsert(spark.createDataFrame(second, SCHEMA), 1)
    assert held(table) == latest([first, second])
    table.upsert(spark.createDataFrame([("a", 9, "replayed as something else")], SCHEMA), 1)
    assert held(table) == latest([first, second])
    assert table.vacuum() and held(table) == latest([first, second]) and not table.vacuum()


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    for n, rows in enumerate([[("a", 1, "x"), ("a", 2, "x")], [("b", 1, "x")], [("a", 3, "x"), ("b", 0, "x")]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n == 1:
            continue
        table = ingest.BucketedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], "v", 4)
        ingest.upsert_stream(ingest.stream(spark, str(tmp_path / "in"), SCHEMA), table, str(tmp_path / "c")).awaitTermination()
    assert held(table) == [("a", 3, "x"), ("b", 1, "x")] and table.versions() == [0, 1, 2]
