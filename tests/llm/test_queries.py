"""The registered queries: SQL where there is some, brute force elsewhere."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
import xxhash

from sparkloom.llm import queries

TABLES = ["documents", "conversations", "pages", "embeddings"]
SQL = queries.oracle_sql()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({SQL[name]})").fetchall()
    plain = lambda rows: sorted(tuple(repr(round(v, 9)) if isinstance(v, float) and not math.isnan(v) else repr(v) for v in r) for r in rows)
    assert plain(tuple(r) for r in df.select(*columns).collect()) == plain(want)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def run(name, spark, sf):
    return {r["doc_id"]: r for r in queries.queries()[name](spark, sf).collect()}


def test_op1(spark, sf, texts):
    for d, r in run("op1_progressive_jpeg", spark, sf).items():
        raw = texts[d].encode()
        payload = raw + b"\xff" * (max(-(-len(raw) // 576), 1) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_op5(spark, sf, texts):
    import sentencepiece

    from sparkloom.llm import pieces

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = run("op5_sentencepiece", spark, sf)
    assert got.keys() == texts.keys()
    for d, r in got.items():
        import numpy as np

        ids = library.encode(texts[d])
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, np.int32)).hexdigest() and r["n_pieces"] == len(ids)
        assert r["round_trip"] and r["decoded_sha256"] == hashlib.sha256(texts[d].encode()).hexdigest()


def brute_repeats(rows, least=50):
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        for i in range(len(raw) - least + 1):
            first.setdefault(raw[i : i + least], d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - least + 1):
            if first[raw[i : i + least]] < d:
                gone[i : i + least] = b"\1" * least
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def test_op6(spark, sf, texts):
    got = sorted(tuple(r) for r in queries.op6_suffix_repeats(spark, sf).collect())
    assert got == brute_repeats(list(texts.items()))


def test_op7(spark, sf, texts):
    for d, r in run("op7_quality_rules", spark, sf).items():
        words = WORD.findall(texts[d])
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
        lines = [x for x in texts[d].split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", texts[d])), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        assert r["base_failed"] == failed and (not failed or not r["kept"])


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest doc_id reachable over links of at most two bits."""
    ids = sorted(prints)
    parent = {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


def test_op8(spark, sf, texts):
    got = run("op8_simhash", spark, sf)
    prints = {d: brute_fingerprint(t) for d, t in texts.items()}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: r["component_id"] for d, r in got.items()} == brute_components(prints)


def test_op9_is_right_on_held_out_rows(spark, sf, docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = run("op9_language_id", spark, sf)
    assert {d for d, r in got.items() if r["held_out"]} == {d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2}
    apart = [r["lang_pred"] == lang[d] for d, r in got.items() if r["held_out"] and lang[d]]
    assert sum(apart) / len(apart) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_op10_takes_come_near_the_targets(spark, sf, docs):
    got = queries.op10_mixing(spark, sf).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    by = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        s = by.setdefault(source[r["doc_id"]], [0, 0, r["target"], 0])
        s[0] += r["size"]
        s[1] += r["taken"]
        s[3] = max(s[3], r["size"])
    total = sum(s[0] for s in by.values())
    assert sum(s[2] for s in by.values()) == pytest.approx(total)
    for size, taken, target, largest in by.values():
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= largest
    again = queries.op10_mixing(spark, sf).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
