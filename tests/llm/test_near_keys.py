"""The pipeline's near-duplicate stage searches by SimHash anchors, too, and checks what they find."""

import numpy as np

from sparkloom.llm import overlap, simhash


def test_the_stage_searches_by_anchors(spark, docs, monkeypatch):
    asked = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct, *more: asked.append(distinct.count()) or links(distinct, *more))
    simhash.keep_one(docs).count()
    assert len(asked) == 1 and asked[0] > 100


def test_what_anchors_connect_shares_a_key(spark, docs):
    marked = simhash.near_duplicates(docs).where("fp <> 0").select("fp", "component_id").distinct().collect()
    rows = [(i, r["fp"], np.zeros(overlap.BANDS, np.int64).tobytes()) for i, r in enumerate(marked)]
    got = overlap._with_near_keys(spark.createDataFrame(rows, "node long, fp long, bands binary")).collect()
    component = {r["fp"]: r["component_id"] for r in marked}
    pairs = {(component[r["fp"]], r["near"]) for r in got}
    assert len(pairs) == len({c for c, _ in pairs}) == len({k for _, k in pairs})
    assert all(len(r["bands"]) == 8 * (overlap.BANDS + 1) for r in got)
    assert len({r["bands"][-8:] for r in got}) == len({k for _, k in pairs})


def test_a_pair_without_a_common_band_is_checked_by_its_near_key():
    """Two sets of similarity 0.8 that share no band key."""
    hashes = [7771794001463831865, 6394958867152547923, 4384264655921975499, 2127249035713757069, 6001391186426818814, 1437310772635326354, 15634601735559507470, 15002889185751842125, 8941432698446079836, 9135432001073789611]
    sets = [np.sort(np.array(hashes[:9], np.uint64)), np.sort(np.array(hashes[1:], np.uint64))]
    assert overlap.similar(*sets)
    assert overlap.linked([5, 9], sets) == [5, 9]
    assert overlap.linked([5, 9], sets, None, [1, 2]) == [5, 9]
    assert overlap.linked([5, 9], sets, None, [1, 1]) == [5, 5]
