"""Cases that once lost or mixed up rows: no ids, repeated ids, changed rules, broken media, clashing names."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import langid, media, mixing, quality, repeats, secrets, simhash, urls

from .test_queries import brute_repeats


def test_repeats_of_many_rows_without_an_id(spark):
    rng = random.Random(8)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(8)]
    text = lambda: "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(5, 60)))
    rows = [(None, text() + (rng.choice(passages) if i % 2 else "") + text()) for i in range(3000)]
    rows += [(i, text() + rng.choice(passages) + text()) for i in range(20)]
    rows += [(5, text() + rng.choice(passages) + text()) for _ in range(200)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False).collect()
    last = 10**9  # no id is the largest
    want = brute_repeats([(last if d is None else d, t) for d, t in rows])
    assert sorted((last if r[0] is None else r[0], *r[1:]) for r in got) == want


def spans_of(findings):
    return {r["path"]: r["out"] for r in findings.collect()}


def test_ledger_follows_the_rules(spark, tmp_path):
    old = secrets.Rule("hex", 1, r"[0-9a-f]{8,}")
    new = secrets.Rule("hex", 2, r"[0-9a-f]{16,}")
    assign, access = secrets.BASE_RULES[:2]
    rows = spark.createDataFrame([("a", "token = 'abcdefgh1234' 0123456789"), ("b", "0123456789abcdef"), ("c", None), ("d", "0123456789abcdef")], "path string, text string")
    path = str(tmp_path / "ledger")

    def run(docs, *rules):
        return spans_of(secrets.scan_into(docs, path, rules, path="path").withColumn("out", secrets.listed(F.col("spans"), rules)))

    first = run(rows, assign, access, old)
    assert first == {"a": "assign:0:21,hex:23:33", "b": "hex:0:16", "c": "", "d": "hex:0:16"}
    assert spark.read.parquet(path).count() == 3
    assert run(rows, assign, access, old) == first and spark.read.parquet(path).count() == 3
    assert run(rows, assign, access, new) == {"a": "assign:0:21", "b": "hex:0:16", "c": "", "d": "hex:0:16"}
    assert {tuple(r["rule_ids"]) for r in spark.read.parquet(path).where("array_contains(rule_ids, 'hex@2')").collect()} == {("hex@2",)}
    assert run(rows, new, assign) == {"a": "assign:0:21", "b": "hex:0:16", "c": "", "d": "hex:0:16"}
    assert run(rows, access) == dict.fromkeys("abcd", "")
    assert run(rows.union(spark.createDataFrame([("e", "token=abcdefgh")], "path string, text string")), assign)["e"] == "assign:0:14"


def test_many_matches_in_one_text(spark):
    text = "token=abcdefgh9 é deadbeefdeadbeefdeadbeefdeadbeef " * 5000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = secrets.digest(secrets.scan_versions(df)[0]).first()
    assert (got["n_assign"], got["n_hex"]) == (5000, 5000)
    assert secrets.redact(df).first()["text"] == "[SECRET] é [SECRET] " * 5000


def test_redact_merges_overlapping_spans(spark):
    rng = random.Random(4)
    bits = ["token=", "abcdefgh", "0123456789abcdef" * 2, "api_key: ", " ", "é", "AKIAABCDEFGHIJKL", "x", "deadbeef" * 4]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = [re.compile(r.pattern, re.A) for r in secrets.BASE_RULES]
    got = {r["doc_id"]: r["text"] for r in secrets.redact(df, secrets.BASE_RULES).collect()}
    for d, text in rows:
        spans = sorted(m.span() for k, p in enumerate(plain) for m in p.finditer(text) if k or len(m[2]) >= 8)
        out, at = [], 0
        for k, (s, e) in enumerate(spans):
            if not k or s >= at:
                out += [text[at:s], "[SECRET]"]
            at = max(at, e)
        assert got[d] == "".join(out) + text[at:]


def test_media_that_cannot_be_read(spark):
    data = np.random.default_rng(2).integers(0, 256, 576 * 3, dtype=np.uint8)
    good = media.encode_payloads(data, np.array([0, 576, 1728]))
    foreign = re.sub(rb"\xff\xfe\x00\x0a.{8}", b"", good[0], flags=re.S)
    assert len(foreign) < len(good[0])
    rows = [(1, good[0]), (2, b"no image"), (3, b""), (4, None), (5, foreign), (6, good[1]), (7, good[1][:40]), (8, b"\xff\xd8\xff\xd9")]
    got = {r["doc_id"]: r for r in media.load(spark.createDataFrame(rows, "doc_id long, media binary").coalesce(1)).collect()}
    assert bytes(got[1]["payload"]) == data[:576].tobytes() and bytes(got[6]["payload"]) == data[576:].tobytes()
    assert got[5]["payload"] is None and got[5]["feature"] == got[1]["feature"]
    for d in (2, 3, 4, 7, 8):
        assert got[d]["payload"] is None and got[d]["rgb"] is None, d
    digest = {r["doc_id"]: r for r in media.digest(spark.createDataFrame([(d, 1, m) for d, m in rows], "doc_id long, n_bytes long, media binary")).collect()}
    assert digest[5]["payload_bytes"] is None and digest[5]["feature"] == got[5]["feature"] and digest[2]["feature"] is None


CLASH = ("row", "due", "nth", "gone", "text_sha", "blob", "salt", "found", "clean", "o0", "new", "place", "rn", "epochs", "middle", "rank", "slice", "key", "lot", "inside", "offset")


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_of_any_name(stage, spark, sf, edge):
    df = edge.select("doc_id", "text", "lang", "source", "n_chars", *[F.col("doc_id").alias(c) for c in CLASH])
    got = corpus_pipeline.STAGES[stage][1](spark, df, sf)
    assert got.columns == df.columns
    for r in got.collect():
        assert all(r[c] == r["doc_id"] for c in CLASH)


@pytest.mark.parametrize("make", [quality.keep_good, simhash.keep_one, secrets.redact, mixing.curriculum])
def test_stages_stand_empty_tables(make, empty):
    assert make(empty).collect() == []


def test_globs(spark):
    rules = (urls.Rule("block", "ads*.example.com", "/*/banner/*", kind="glob"), urls.Rule("allow", "ads1.example.com", "/x/banner/keep", kind="site"))
    assert urls.Rule("block", "ads*.example.com", "/*/banner/*", kind="glob").tokens == ["example", "com", "banner"]
    cases = {"http://ads7.example.com/a/b/banner/1": "block", "http://ads7.example.com/banner/1": "allow", "http://adsx.y.example.com/a/banner/": "allow", "http://ads1.example.com/x/banner/keep": "allow", "http://ads1.example.com/x/banner/k": "block"}
    got = {r["url"]: r["verdict"] for r in urls.judge(spark.createDataFrame([(u,) for u in cases], "url string"), rules, keep=("url",)).collect()}
    assert got == cases


def test_more_languages_than_the_model_may_hold(spark):
    df = spark.createDataFrame([(i, f"word{chr(97 + i)}", f"l{i}") for i in range(20)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="max_langs"):
        langid.train(df, max_langs=3)


def test_language_scores_against_a_plain_count(spark, docs):
    """The model and a text's score, counted again word by word."""
    import math
    from collections import Counter

    rows = [r for r in docs.select("doc_id", "text", "lang").collect() if r["text"]][:60]
    df = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string")
    model = langid.train(df)
    own = df.where(~langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).collect()
    langs = sorted({r["lang"] for r in own})
    cut = lambda t: [w for w in re.split(r"[\x00-\x60\x7B-\x7F]+", t.lower()) if w]
    words = {k: Counter(w for r in own if r["lang"] == lang for w in cut(r["text"])) for k, lang in enumerate(langs)}
    every = set().union(*words.values())
    assert model.langs == langs and set(model.words) == {w.encode() for w in every}
    for w in every:
        for k in words:
            assert model.words[w.encode()][k] == pytest.approx(math.log((words[k][w] + 0.5) / (1 + sum(words[k].values()) + 0.5 * len(every))), abs=2e-6)
    grams = Counter()
    for c in words.values():
        for w, n in c.items():
            for i in range(len(w)):
                grams[f" {w} "[i : i + 3]] += n
    assert set(model.grams[3]) == set(grams)
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    for r in rows:
        scores = [s for s in (langid.score_word(model, w.encode()) for w in cut(r["text"])) if s]
        if scores:
            mean = [sum(s[k] for s in scores) / len(scores) for k in range(len(langs))]
            best = max(mean)
            assert got[r["doc_id"]]["lang_pred"] == langs[mean.index(best)]
            assert got[r["doc_id"]]["score"] == pytest.approx(1 / sum(math.exp(m - best) for m in mean), abs=1e-5)


def test_kept_is_recomputed(spark, docs):
    """op7's verdict from the published measures and bands alone."""
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    for r in quality.assess(docs).collect():
        low, high, fallback, least, most = quality.BANDS.get(lang[r["doc_id"]], quality.LATIN)
        fits = low <= r["chars_per_token"] <= high and r["byte_share"] <= fallback and least <= r["entropy"] <= most
        if lang[r["doc_id"]] in quality.BANDS:
            assert r["kept"] == (fits and not r["base_failed"])
