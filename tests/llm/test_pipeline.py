"""The pipeline against a plain version of it in Python."""

import hashlib
import math
import re
from collections import Counter

import corpus_pipeline
from sparkloom.llm import pieces, quality

from .test_queries import WORD

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
PLAIN = [re.compile(p) for p in (r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*")]


def blanked(text):
    spans = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 8] + [m.span() for p in PLAIN for m in p.finditer(text)]
    out, at, fresh = [], 0, True
    for s, e in sorted(spans):
        if fresh or s >= at:
            out += [text[at:s], "[SECRET]"]
        at, fresh = max(at, e), False
    return "".join(out) + text[at:]


def plain_kept(rows, library):
    """doc_ids that the quality rules keep, from the tokenizers and the published bands."""
    tokenizer, _, is_byte = quality._tokenizers(quality.BYTE_VOCABULARY, quality.PIECE_VOCABULARY)
    kept = set()
    for d, text, lang in rows:
        words = WORD.findall(text or "")
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
        if len(words) < 50 or 100 * len(covered) > 50 * len(words):
            continue
        ids = [i for w in words for i in tokenizer.encode_ordinary(" " + w)]
        split = [i for w in words for i in library.encode(w)]
        bits = -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())
        low, high, fallback, least, most = quality.BANDS.get(lang, quality.LATIN)
        if low <= sum(map(len, words)) / len(ids) <= high and sum(bool(is_byte[i]) for i in split) / len(split) <= fallback and least <= bits <= most:
            kept.add(d)
    return kept


def plain_times(rows):
    """How often each (doc_id, text, source) is taken, by the definition of targets and order."""
    from .test_operators import iterated

    size = {d: len(WORD.findall(text)) for d, text, _ in rows}
    by = {}
    for d, _, source in rows:
        by.setdefault(source, []).append(d)
    totals = {s: sum(size[d] for d in own) for s, own in by.items()}
    target = iterated(totals)
    times = {}
    for s, own in by.items():
        before = 0
        for d in sorted(own, key=lambda d: (hashlib.md5(str(d).encode()).hexdigest(), d)):
            middle = before + size[d] / 2
            before += size[d]
            n = sum(middle + e * totals[s] <= target[s] + 1e-6 for e in range(3)) if size[d] else 0
            if n:
                times[d] = n
    return times


def test_pipeline(spark, sf, docs):
    """All five stages by plain Python. The near-duplicate rule is that for stages on word shingles: five
    words, similarity 0.8."""
    import sentencepiece

    from .test_overlap import brute_kept

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    all_rows = docs.collect()
    kept = plain_kept([(r["doc_id"], r["text"], r["lang"]) for r in all_rows], library)
    first = set(brute_kept([(r["doc_id"], r["text"]) for r in all_rows if r["doc_id"] in kept]))
    clean = {r["doc_id"]: blanked(r["text"]) for r in all_rows if r["doc_id"] in first}
    times = plain_times([(r["doc_id"], clean[r["doc_id"]], r["source"]) for r in all_rows if r["doc_id"] in clean])
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r["doc_id"] for r in got) == times
    for r in got:
        assert r["ids"] == library.encode(clean[r["doc_id"]]) and r["round_trip"]


def test_stages_return_the_columns_of_documents(spark, sf, docs):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "secret scans", "mixing", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_stages_stand_the_edge_cases(spark, sf, edge, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).collect() == []
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, edge, sf).columns == edge.columns
