"""Delta Lloyd against plain Lloyd rounds in Python's whole numbers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import lloyd, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=8, rounds=10, dim=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept row."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    lot = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=lot)[:k]]

    def assign():
        out = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        owners = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), (o, _) in zip(kept, owners, strict=True) if o == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    owners = assign()
    sums = [sum(d for o, d in owners if o == c) for c in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, o, d, sums[o], sum(sums), digests[o]) for (i, _), (o, d) in zip(kept, owners, strict=True)], key=str)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_equals_plain_rounds(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(queries.op11_delta_lloyd(spark, sf)) == plain(rows)


@pytest.mark.parametrize("count", [0, 1, 5, 40])
def test_edge_cases(spark, count):
    """Unusable vectors, ties, repeated rows, null ids, fewer vectors than centroids, empty clusters, a hot vector."""
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.integers(-3, 4, 64) / 1024]) for i in range(count)]
    rows += [rows[0], (None, rows[0][1])] * 15 if count > 1 else []
    bad = [(90, None), (91, []), (92, [0.5] * 63), (93, [0.5] * 65), (94, [None] + [0.5] * 63), (95, [float("nan")] * 64), (96, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + bad], SCHEMA).withColumns({c: F.lit("clash") for c in ("block", "owner", "matrix", "cluster", "distance", "v")})
    assert got(lloyd.digest(lloyd.cluster(df.repartition(3)))) == plain(rows)


def test_rounds_compare_only_what_changed():
    """An owner that stood still is compared with changed centroids only, and the result is that of a full round."""
    draw = np.random.default_rng(1)
    v = draw.integers(-2000, 2000, (500, 64))
    c = v[:8].copy()
    owner, far, compared = lloyd.reassign(v, np.full(500, -1), np.zeros(500, np.int64), c, np.arange(8))
    assert compared == 500 * 8
    c[3] += draw.integers(-900, 900, 64)
    now, near, compared = lloyd.reassign(v, owner, far, c, np.array([3]))
    full = lloyd.squared_distances(v, c)
    assert (now == full.argmin(1)).all() and (near == full.min(1)).all()
    assert compared == (owner == 3).sum() * 8 + (owner != 3).sum()
    moved = lloyd.transfers(v, owner, now, 8)
    assert moved[:, :64].sum() == 0 and moved[:, 64].sum() == 0
    for k in range(8):
        assert (moved[k, :64] == v[now == k].sum(0) - v[owner == k].sum(0)).all()


def test_large_components_are_exact():
    v = np.array([[lloyd.LARGEST] * 64, [-lloyd.LARGEST] * 64, [1] * 64])
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in v] for x in v]
    assert lloyd.squared_distances(v, v).tolist() == exact


def test_a_component_that_fits_no_distance_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e9] + [0.0] * 63, 0)], SCHEMA)
    with pytest.raises(Exception, match="beyond"):
        lloyd.cluster(df)


def test_blocks_and_states_meet_without_a_shuffle(spark, sf):
    whole = lloyd.whole_numbers(spark.read.parquet(f"{sf}/embeddings.parquet"), 64, 1024)
    tables = lloyd.Buckets(spark, 3)
    packed = tables.written(lloyd.pack(whole, 16).repartition(3, "block"))
    state = tables.written(packed.select("block", F.array(F.lit(0)).alias("owner"), F.array(F.lit(0).cast("long")).alias("distance")))
    plan = lloyd.one_round(packed, state, 64, lloyd.first_centroids(whole, 8, 3), np.arange(8))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Exchange" not in plan
    for which in (1, 2):
        tables.drop(which)


def test_tables_are_dropped(spark, sf):
    before = spark.catalog.listTables()
    lloyd.cluster(spark.read.parquet(f"{sf}/embeddings.parquet"), rounds=2)
    assert spark.catalog.listTables() == before
