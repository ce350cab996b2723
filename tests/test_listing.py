"""The listing source against the same listing worked out by hand."""

import os
import time

import pytest

from sparkloom.plans import oracle, queries
from sparkloom.sources import listing

ROWS = [(f"p{i:03d}", ["a", "b/c", "a b", "", None][i % 5 if i % 3 else 0], f"title {i}", None if i % 17 == 0 else (i * 37) % 23) for i in range(200)]
SCHEMA = listing.POSTS


def landed(spark, folder, rows=ROWS, parts=4):
    listing.land(spark.createDataFrame(rows, SCHEMA).repartition(parts), str(folder))
    return str(folder)


def by_hand(rows, limit):
    out = []
    for g in {r[1] or None for r in rows}:
        own = sorted((r for r in rows if (r[1] or None) == g), key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))
        out += [(r[0], g, r[2], r[3]) for r in own[:limit]]
    return sorted(out)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def test_the_best_of_each_group(spark, tmp_path):
    folder = landed(spark, tmp_path / "pages")
    for limit in (1, 7, 1000):
        assert rows_of(listing.top(spark, folder, limit)) == by_hand(ROWS, limit)
    assert rows_of(listing.top(spark, f"file://{folder}", 7)) == by_hand(ROWS, 7)
    more = [(i, g, t, 99) for i, g, t, _ in ROWS[:3]]
    landed(spark, folder, [("q" + r[0], *r[1:]) for r in more])
    assert rows_of(listing.top(spark, folder, 2)) == by_hand(ROWS + [("q" + r[0], *r[1:]) for r in more], 2)


def test_other_groups_pages_are_not_read(spark, tmp_path):
    folder = landed(spark, tmp_path / "pages")
    for name in os.listdir(folder):
        if name.startswith("subreddit=") and "a%20b" not in name and name != "subreddit=a b":
            for file in os.listdir(f"{folder}/{name}"):
                if file.endswith(".parquet"):
                    with open(f"{folder}/{name}/{file}", "wb") as f:
                        f.write(b"broken")
    want = [r for r in by_hand(ROWS, 5) if r[1] == "a b"]
    assert rows_of(listing.top(spark, folder, 5, ["a b"])) == want
    got = listing.top(spark, folder, 5, schema=SCHEMA + ", error string", wait=0).collect()
    assert rows_of(spark.createDataFrame([r[:4] for r in got if r["error"] is None], SCHEMA)) == want
    failed = {r["subreddit"] for r in got if r["error"]}
    assert failed == {"a", "b/c", None}
    with pytest.raises(Exception, match="(?i)parquet"):
        listing.top(spark, folder, 5, wait=0).collect()


def test_scores_are_pushed_down(spark, tmp_path):
    folder = landed(spark, tmp_path / "pages")
    got = listing.top(spark, folder, 1000).where("score >= 10")
    assert rows_of(got) == [r for r in by_hand(ROWS, 1000) if r[3] is not None and r[3] >= 10]
    listing.register(spark)
    reader = listing.PageReader({"path": folder}, spark.createDataFrame([], SCHEMA).schema)
    asked = [listing.GreaterThan(("score",), 3), listing.In(("subreddit",), ("a", "b/c")), listing.EqualTo(("subreddit",), "b/c")]
    assert list(reader.pushFilters(asked)) == asked
    assert {p.group for p in reader.partitions()} == {"b/c"} and reader.least == 3


def test_nothing_landed(spark, tmp_path):
    assert listing.top(spark, str(tmp_path / "none"), 3).collect() == []
    (tmp_path / "empty").mkdir()
    assert listing.top(spark, str(tmp_path / "empty"), 3).collect() == []


def test_refusals_are_asked_again():
    waits, left = [], [OSError("429"), OSError("429")]

    def get():
        if left:
            raise left.pop()
        return "page"

    assert listing.attempted(get, 3, 15.0, waits.append) == "page" and waits == [15.0, 30.0]
    left += [OSError("429")] * 2
    with pytest.raises(OSError, match="429"):
        listing.attempted(get, 2, 1.0, waits.append)
    left[:] = [FileNotFoundError("gone")]
    waits.clear()
    with pytest.raises(FileNotFoundError):
        listing.attempted(get, 3, 1.0, waits.append)
    assert waits == []


def test_a_stream_of_pages(spark, tmp_path):
    folder, out = str(tmp_path / "pages"), str(tmp_path / "out")
    listing.register(spark)
    pages = spark.readStream.format("listing").schema(SCHEMA).option("settle", 0).load(folder)

    def go():
        q = pages.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", out).start()
        q.processAllAvailable()
        q.stop()

    want = []
    for i in range(3):
        part = [(f"{i}-{r[0]}", *r[1:]) for r in ROWS[i * 50 : i * 50 + 50]]
        landed(spark, folder, part, 2)
        time.sleep(0.05)
        want += [(r[0], r[1] or None, r[2], r[3]) for r in part]
        go()
        assert rows_of(spark.read.schema(SCHEMA).parquet(out)) == sorted(want)
    with pytest.raises(Exception, match="no limit"):
        spark.readStream.format("listing").schema(SCHEMA).option("limit", 3).load(folder).writeStream.format("noop").start().processAllAvailable()


def test_the_registered_listing(spark, sf):
    assert "listing_top" in oracle.oracle_sql()
    got = queries.queries()["listing_top"](spark, sf)
    assert got.groupBy("subreddit").count().where("count > 25").isEmpty() and got.count() > 25
