"""Periodic runs of words, from Lyndon arrays, and texts with the repetitions taken out.

A run is a stretch of words with smallest period q that can't be extended on either side
and is at least ``max(LEAST, POWER * q)`` words long. The words of a text are numbered; the
numbers are an ordered alphabet, of which only comparisons are used: there is no suffix
array or tree and no hash of stretches.

For each of the two orders (numbers as they are, and turned around) the Lyndon array is
built from right to left: the next smaller suffix of i is found by hopping from candidate
to candidate. What is known of the match between i and one candidate, and between that one
and the next, settles the next comparison unless both matches are equally long; only then
words are compared, from where the match stood. A match is kept per distance: once the
comparison arrives at a place from which the match at that distance is known, its length is
taken over, so the places of one run aren't each compared with all of it. Comparisons per
word are constant on random, constant and periodic texts; on Fibonacci words, whose runs
overlap at all scales, they grow with the logarithm of the length (7.4 at 16 000). Each edge (i, next smaller
suffix) carries the right extension of a candidate period; those that reach a whole period
further are extended to the left, once per run. Every run's first Lyndon root is such an
edge in the order in which the word behind the run is the smaller one.

Before that, texts are cut at words that can't stand in any run: in a run of three or more
periods each word stands three times or more. The cut is repeated on the pieces a fixed
number of times, so it costs a pass over the words each; for prose next to nothing is left,
and what is left goes through the search.

Edge cases: null and empty texts have no words, no runs and an empty collapsed text; rows
without a doc_id and repeated rows are handled like any other; a very long text is handled
whole, in memory that grows with its words; other columns, whatever their names, are
ignored; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ranges, slices, text_bytes, whole_text
from .words import cut_words, number

LEAST, POWER = 24, 3
#: Times that texts are cut at words too rare for a run.
CUTS = 6
RUNS = "array<struct<start:long,length:long,period:long>>"


# Lyndon arrays


def lyndon(word: list[int]) -> tuple[list[int], list[int]]:
    """(next smaller suffix, length of the match with it) for each place; the end is smaller than all.

    ``word`` holds numbers of 0 or more; the list is closed with -1 while it is worked on.
    """
    n = len(word)
    w = [*word, -1]
    after, match = [n] * (n + 1), [0] * (n + 1)
    known_at, known = [n + 1] * (n + 1), [0] * (n + 1)  # per distance: leftmost place with a known match
    for i in range(n - 1, -1, -1):
        j = i + 1
        same, scan = 0, True
        while True:
            if scan:
                d = j - i
                at, stop = known_at[d], known_at[d] + known[d]
                p = i + same
                while True:
                    if at <= p <= stop:
                        p = stop
                        break
                    if w[p] != w[p + d]:
                        break
                    p += 1
                same = p - i
                known_at[d], known[d] = i, same
            if w[i + same] > w[j + same]:
                break
            other = match[j]
            j = after[j]
            scan = other == same
            if other < same:
                same = other
        after[i], match[i] = j, same
    return after, match


def runs_of(word: list[int], least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``least`` words and ``power`` (2 or more) periods, by start and period."""
    n = len(word)
    if n < least:
        return []
    top = max(word)
    found: set[tuple[int, int, int]] = set()
    for w in (word, [top - x for x in word]):
        after, match = lyndon(w)
        began = [n + 1] * (n + 1)  # per period: start of the leftmost run found
        for i in range(n - 1, -1, -1):
            j = after[i]
            p = j - i
            right = match[i]
            # The first root of a long enough run reaches beyond (power - 2) periods.
            if right < (power - 2) * p or i >= began[p]:
                continue
            s = i
            while s and w[s - 1] == w[s - 1 + p]:
                s -= 1
            length = j + right - s
            if length >= 2 * p:
                began[p] = s
            if length >= least and length >= power * p:
                found.add((s, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


# Many texts at once


def stretches(codes: np.ndarray, owner: np.ndarray, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words in which runs can stand.

    ``owner`` numbers the texts in order. A word that stands fewer than ``power`` times in
    its stretch ends it; stretches of fewer than ``least`` words go.
    """
    at = np.arange(len(codes))
    group = np.asarray(owner, np.int64)
    width = int(codes.max(initial=0)) + 1
    for _ in range(CUTS):
        if not len(at):
            break
        before = len(at)
        _, inverse, counts = np.unique(group * width + codes[at], return_inverse=True, return_counts=True)
        common = counts[inverse] >= power
        at, group = at[common], group[common]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(group) != 0)
        group = np.cumsum(new) - 1
        sizes = np.bincount(group, minlength=0)
        long = sizes[group] >= least if len(at) else np.zeros(0, bool)
        at, group = at[long], group[long]
        if len(at) == before:
            break
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = np.diff(group) != 0
    starts = np.flatnonzero(new)
    return at[starts], at[np.append(starts[1:], len(at)) - 1] + 1


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length per period; ties: smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r  # runs come by start and period, so the first of equals stays
    return best


def batch_runs(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, int]]], list[bytes]]:
    """Of each text its number of words, its runs, and its words without repetitions, joined by one space."""
    data, offsets, first = cut_words(raw, starts)
    n = len(starts) - 1
    counts = np.diff(first)
    codes, _ = number(data, offsets)
    owner = np.repeat(np.arange(n), counts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    keep = np.ones(len(codes), bool)
    for a, b in zip(*(x.tolist() for x in stretches(codes, owner)), strict=True):
        text = int(owner[a])
        base = int(first[text])
        for s, length, p in runs_of(np.unique(codes[a:b], return_inverse=True)[1].tolist()):
            found[text].append((a - base + s, length, p))
            keep[a + s + p : a + s + length] = False
    # The kept words, each with a space behind it; the last space of a text is left out.
    kept = np.flatnonzero(keep)
    sizes = offsets[kept + 1] - offsets[kept] if len(kept) else np.zeros(0, np.int64)
    joined = np.full(int(sizes.sum()) + len(kept), 32, np.uint8)
    to = np.concatenate([[0], np.cumsum(sizes + 1)])
    joined[ranges(to[:-1], sizes)] = data[ranges(offsets[kept], sizes)]
    left = np.concatenate([[0], np.cumsum(keep)])[first]
    view = joined.tobytes()
    texts = [view[to[a] : to[b] - 1] if b > a else b"" for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
    return counts, found, texts


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), strongest, collapsed: one row per row of (doc_id, text).

    ``collapsed`` has the words that no run repeats: of each run those behind its first
    period go.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        as_dict = lambda r: None if r is None else {"start": r[0], "length": r[1], "period": r[2]}
        for part in slices(batches, "text"):
            counts, found, texts = batch_runs(*text_bytes(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array([[as_dict(r) for r in rs] for rs in found], pa.list_(one)),
                    pa.array([as_dict(_strongest(rs)) for rs in found], one),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "strongest", "collapsed"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return own.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, strongest struct<start:long,length:long,period:long>, collapsed string")


def with_periodic_tail(text: Column, doc_id: Column) -> Column:
    """The text, and for a tenth of all ids one whose words repeat from some place on, by the id's checksum.

    With h the checksum and g = h // 10, texts with h % 10 = 0 get, behind word a = g % n, the
    words from a on repeated with period 1 + (n - a) // (3 + g % 8).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / F.lit(10))

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        # Places and period are bound once, not worked out per word.
        place = F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda k: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < k["a"], i).otherwise(k["a"] + (i - k["a"]) % k["p"])))[0]
        return F.when(n > 0, F.array_join(F.transform(place, lambda i: F.element_at(w, (i + 1).cast("int"))), " ")).otherwise(F.lit(""))

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return F.when(h % 10 == 0, F.transform(F.array(words), tail)[0]).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """The number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    best = F.col("strongest")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    # Exact: one long division, without a detour by doubles.
    milli = F.expr("(1000 * strongest.length) div strongest.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        milli.alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
