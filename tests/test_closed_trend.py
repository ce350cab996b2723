"""Daily counts of a stream with late and repeated rows, against plain Python that keeps the watermark by hand."""

import datetime as dt
import random

from sparkloom.plans import queries
from sparkloom.streaming import ingest

SCHEMA = "event_id long, ts timestamp_ntz, event_type string"
START = dt.datetime(2024, 3, 1)


def by_hand(batches, late=dt.timedelta(days=1)):
    """(counts of closed days, keys dropped as late): rows behind the watermark of the batches before are dropped."""
    mark, seen, counts, dropped = dt.datetime.min, set(), {}, 0
    for batch in batches:
        for key, ts, kind in batch:
            if ts is None:
                continue
            if ts < mark:
                dropped += key not in seen
            elif key is None or key not in seen:
                seen.add(key)
                day = ts.replace(hour=0, minute=0, second=0, microsecond=0)
                counts[day, kind] = counts.get((day, kind), 0) + 1
        times = [ts for _, ts, _ in batch if ts is not None]
        if times:
            mark = max(mark, max(times) - late)
    return {k: n for k, n in counts.items() if k[0] + dt.timedelta(days=1) <= mark}, dropped


def run(spark, folder, batches):
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).write.mode("append").parquet(f"{folder}/in")
        rows = ingest.stream(spark, f"{folder}/in", SCHEMA, 1000)
        ingest.closed_trend(rows, "event_id", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    out = spark.read.schema("period timestamp, event_type string, cnt long").parquet(f"{folder}/out")
    return {(r["p"], r["event_type"]): r["cnt"] for r in out.select(ingest.as_local("period").alias("p"), "event_type", "cnt").collect()}


def test_five_batches_with_late_and_repeated_rows(spark, tmp_path):
    draw = random.Random(5)
    rows = [(i, START + dt.timedelta(minutes=17 * i), draw.choice(["a", "b", None])) for i in range(500)]
    batches = [[], [], [], [], []]
    for i, row in enumerate(rows):
        own = i // 100
        behind = draw.random() < 0.1 and i % 100 > 60  # at most 40 rows of 17 minutes: still in time
        batches[min(own + behind, 4)].append(row)
        if draw.random() < 0.3:
            batches[min(own + draw.randrange(2), 4)].append(row)
        if draw.random() < 0.05:
            batches[4].append(row)  # far behind: a repeat that comes after its state has gone
    want, dropped = by_hand(batches)
    assert dropped == 0 and len({d for d, _ in want}) >= 4
    plain = {}
    for _, ts, kind in rows:
        key = (ts.replace(hour=0, minute=0), kind)
        plain[key] = plain.get(key, 0) + 1
    assert want == {k: n for k, n in plain.items() if k[0] in {d for d, _ in want}}  # the batch result of the closed days
    assert run(spark, tmp_path, batches) == want


def test_rows_behind_the_watermark_are_dropped_and_nulls_have_a_place(spark, tmp_path):
    day = lambda n, h=0: START + dt.timedelta(days=n, hours=h)
    batches = [
        [(1, day(0), "a"), (1, day(0), "a"), (None, day(0, 1), "a"), (None, day(0, 2), "a"), (None, day(0, 2), "a"), (2, None, "a"), (3, day(3), None)],
        [(4, day(0, 3), "a"), (5, day(2, 5), "b"), (1, day(0), "a"), (6, day(9), "z")],
    ]
    got = run(spark, tmp_path, batches)
    assert got == {(day(0), "a"): 3, (day(2), "b"): 1, (day(3), None): 1}


def test_no_rows(spark, tmp_path):
    assert run(spark, tmp_path, [[], []]) == {}


def test_query_of_an_empty_table(spark, tmp_path, sf):
    given = spark.read.parquet(f"{sf}/events.parquet")
    given.limit(0).write.parquet(str(tmp_path / "events.parquet"))
    assert queries.stream_trend(spark, str(tmp_path)).count() == 0
