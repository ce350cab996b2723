"""The language model holds every word and n-gram of its sample."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import langid


def _made(seed, n, letters):
    draw = random.Random(seed)
    return sorted({"".join(draw.choices(letters, k=9)) for _ in range(n)})


def test_rare_words_and_small_languages_are_kept(spark):
    large, small = _made(1, 24_000, "abcdefghijklm"), _made(2, 40, "nopqrstuvwxyz")
    rows = [(i, " ".join(large), "la") for i in range(3)] + [(i, " ".join(small), "sm") for i in range(3, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    taught = Counter(r["lang"] for r in df.where(~langid.held_out(df["doc_id"])).collect())
    assert set(taught) == {"la", "sm"}
    assert set(model.words) == {w.encode() for w in large + small}
    grams = Counter()
    for lang, words in (("la", large), ("sm", small)):
        for w in words:
            m = f" {w} "
            for i in range(len(m) - 4):
                grams[m[i : i + 5], lang] += taught[lang]
    items = {g for g, _ in grams}
    assert len(items) > 20_000 and set(model.grams[5]) == items
    totals = {lang: 1 + sum(n for (_, x), n in grams.items() if x == lang) + 0.5 * len(items) for lang in taught}
    for g in random.Random(3).sample(sorted(items), 300):
        want = [math.log((grams[g, lang] + 0.5) / totals[lang]) for lang in ("la", "sm")]
        assert model.grams[5][g] == pytest.approx(want, abs=2e-6)


def test_words_in_blocks_score_like_one_at_a_time():
    draw = random.Random(5)
    logs = lambda: (round(-draw.random() * 9, 6), round(-draw.random() * 9, 6))
    words = {w.encode(): logs() for w in _made(4, 50, "abc")}
    grams = {k: {"".join(draw.choices("abc ", k=k)): logs() for _ in range(30)} for k in (1, 2, 3, 5)}
    model = langid.Model(["a", "b"], words, grams)

    def plain(word):
        if word in words:
            return words[word]
        marked = f" {word.decode()} "
        for size in (5, 4, 3, 2, 1):
            hits = [grams[size][marked[i : i + size]] for i in range(len(marked) - size + 1) if marked[i : i + size] in grams.get(size, {})]
            if hits:
                return tuple(sum(h[k] for h in hits) / len(hits) - langid.DISCOUNT * (6 - size) for k in range(2))
        return None

    asked = [*words, *(("".join(draw.choices("abcd", k=draw.randint(1, 12)))).encode() for _ in range(3000)), b"zzz", "é中".encode(), b"a" * 100_000]
    scores, known = langid.score_words(model, asked)
    for w, s, k in zip(asked, scores, known, strict=True):
        want = plain(w)
        assert k == (want is not None)
        if want is not None:
            assert s == pytest.approx(want, abs=1e-9)
    assert langid.score_words(model, [])[0].shape == (0, 2)


def test_items_of_equal_hashes_stay_apart(monkeypatch):
    monkeypatch.setattr(langid, "_hash", lambda items: np.array([len(x) for x in items], np.uint64))
    table = langid.Table.of_rows({b"aa": (1.0,), b"bb": (2.0,), b"c": (3.0,)}, 1)
    assert {k: table[k] for k in table} == {b"aa": (1.0,), b"bb": (2.0,), b"c": (3.0,)}
    assert b"cc" not in table and b"d" not in table
