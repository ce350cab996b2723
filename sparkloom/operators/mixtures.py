"""Latent Dirichlet allocation by online variational Bayes over packed counts of words and pairs.

Texts are cut into words once per pass, as bytes, and never sent: a pass counts words, one counts the
pairs of those words that can still be among the commonest terms, one packs each row's counts by
number. A round reads the packed rows, brings every row to rest from where the round before left it, and
sends a matrix of sums per task. The updates of topics and priors are those of Spark's online optimizer.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Rows of a block of packed counts.
BLOCK_ROWS = 512
#: A task hands on its counts of words or pairs beyond this many.
HELD = 1_000_000
#: Numbers of one slice of rows that are brought to rest together.
SLICE = 40_000
#: Mean change of a row's weights at which it is at rest; the same as Spark's.
REST = 1e-3

_SITE = re.compile(rb"http\S+")
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class TopicModel:
    """``weights`` of every topic for every term of the ``vocabulary``, ``alpha``: the topics' own."""

    vocabulary: list[str]
    weights: np.ndarray
    alpha: np.ndarray

    def top_terms(self, n: int) -> list[list[str]]:
        order = np.argsort(-self.weights, axis=1, kind="stable")[:, :n]
        return [[self.vocabulary[i] for i in row] for row in order.tolist()]


def _words(text: bytes | None) -> list[bytes]:
    """The words of ``text.clean_text``."""
    text = text or b""
    return (_SITE.sub(b" ", text) if b"http" in text else text).translate(_LETTERS).split()


def _skipped(stop: list[str]) -> dict[bytes, int]:
    """Words that don't count and don't part their neighbours: stop words and single letters."""
    return dict.fromkeys([w.lower().encode() for w in stop] + [bytes([b]) for b in range(97, 123)], -1)


class _Numbers(dict):
    """Numbers words in the order of their first use."""

    def __init__(self, skipped: dict[bytes, int]):
        super().__init__(skipped)
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


def _coded(column: pa.Array, number: Callable[[bytes], int]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words that aren't skipped, their rows)."""
    parts = [[number(w) for w in _words(t)] for t in column.cast(pa.binary()).to_pylist()]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    codes = np.fromiter(itertools.chain.from_iterable(parts), np.int64, int(lengths.sum()))
    kept = codes != -1
    return codes[kept], np.repeat(np.arange(len(parts)), lengths)[kept]


def _tally(keys: np.ndarray, rows: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, how often, in how many rows); keys are under ``base``."""
    both, n = np.unique(rows * base + keys, return_counts=True)
    key, at = np.unique(both % base, return_inverse=True)
    return key, np.bincount(at, n, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))


def _added(tallies: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([t[0] for t in tallies]), return_inverse=True)
    add = lambda i: np.bincount(at, np.concatenate([t[i] for t in tallies]), len(key)).astype(np.int64)
    return key, add(1), add(2)


def _small(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def vocabulary(texts: DataFrame, stop: list[str], most: int, min_df: float, max_df: float) -> list[str]:
    """The commonest words and pairs of neighbours (ties: by term) that at least ``min_df`` rows have and at most ``max_df``.

    A pair is no commoner than either of its words, nor has more rows. So once the words are counted,
    only pairs of words that reach the last place are counted; the others can't be in the vocabulary.
    """
    skipped = _skipped(stop)

    def words(batches):  # type: ignore[no-untyped-def]
        numbers, held = _Numbers(skipped), []

        def out():  # type: ignore[no-untyped-def]
            key, n, df = _added(held)
            return pa.RecordBatch.from_pydict({"term": pa.array([numbers.words[k].decode() for k in key.tolist()], pa.string()), "n": n, "df": df})

        for batch in itertools.chain.from_iterable(map(_small, batches)):
            codes, rows = _coded(batch.column(0), numbers.__getitem__)
            held.append(_tally(codes, rows, max(1, len(numbers.words))))
            if len(held) == 16:
                held = [_added(held)]
            if len(numbers.words) > HELD:
                yield out()
                numbers, held = _Numbers(skipped), []
        if held:
            yield out()

    total = texts.count()
    share = lambda x: x if x >= 1 else x * total
    counted = texts.mapInArrow(words, "term string, n long, df long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).where(F.col("df") >= share(min_df))
    order = [F.desc("n"), F.col("term")]
    with Scratch(texts.sparkSession) as scratch:
        counted = scratch.kept(counted)
        best = [(r["n"], r["term"]) for r in counted.where(F.col("df") <= share(max_df)).orderBy(*order).limit(most).collect()]  # the vocabulary
        last = best[-1][0] if len(best) == most else 0
        # As many as the vocabulary, those with the last place's count, and those that too many rows have.
        able = sorted(r["term"] for r in counted.where(F.col("n") >= last).select("term").collect())
    if not able:
        return []
    known, base = skipped | {w.encode(): i for i, w in enumerate(able)}, len(able)

    def pairs(batches):  # type: ignore[no-untyped-def]
        held = []
        for batch in itertools.chain.from_iterable(map(_small, batches)):
            codes, rows = _coded(batch.column(0), lambda w: known.get(w, -2))
            held.append(_tally(*_pairs(codes, rows, base), base * base))
            if len(held) == 16:
                held = [_added(held)]
                if len(held[0][0]) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["term", "n", "df"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _added(held)], ["term", "n", "df"])

    twos = texts.mapInArrow(pairs, "term long, n long, df long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    twos = twos.where((F.col("df") >= share(min_df)) & (F.col("df") <= share(max_df)) & (F.col("n") >= last))
    # Pairs' numbers are in the order of their terms, since a space comes before all letters.
    best += [(r["n"], f"{able[r['term'] // base]} {able[r['term'] % base]}") for r in twos.orderBy(*order).limit(most).collect()]  # the vocabulary
    return [term for _, term in sorted(best, key=lambda x: (-x[0], x[1]))[:most]]


def _pairs(codes: np.ndarray, rows: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the pair, row) of neighbours in a row, both with a number."""
    a, b = codes[:-1], codes[1:]
    own = (rows[:-1] == rows[1:]) & (a >= 0) & (b >= 0)
    return a[own] * base + b[own], rows[:-1][own]


def _counter(terms: list[str], stop: list[str]) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Makes of texts (starts by row, terms' places in the vocabulary, counts)."""
    words = sorted({w for t in terms for w in t.split(" ")})
    at = {w: i for i, w in enumerate(words)}
    known, base = _skipped(stop) | {w.encode(): i for w, i in at.items()}, max(1, len(words))
    one = np.full(base, -1)
    two = []
    for place, term in enumerate(terms):
        a, *b = term.split(" ")
        if b:
            two.append((at[a] * base + at[b[0]], place))
        else:
            one[at[a]] = place
    keys, places = (np.array(x, np.int64) for x in (zip(*sorted(two), strict=True) if two else ((), ())))

    def run(column: pa.Array):  # type: ignore[no-untyped-def]
        codes, rows = _coded(column, lambda w: known.get(w, -2))
        pair, pair_rows = _pairs(codes, rows, base)
        single = codes >= 0
        found = np.searchsorted(keys, pair)
        hit = found < len(keys)
        hit[hit] = keys[found[hit]] == pair[hit]
        term, row = np.concatenate([one[codes[single]], places[found[hit]]]), np.concatenate([rows[single], pair_rows[hit]])
        own = term >= 0
        size = max(1, len(terms))
        both, counts = np.unique(row[own] * size + term[own], return_counts=True)
        starts = np.searchsorted(both, np.arange(len(column) + 1) * size)
        return starts, both % size, counts

    return run


def digamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    z = 1 / (y * y)
    pairs = sum((2 * x + 5) / ((x + i) * (x + 5 - i)) for i in range(3))
    return np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - pairs


def trigamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    z = 1 / (y * y)
    return 1 / y + z / 2 + z / y * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z * (1 / 30 - z * 5 / 66)))) + sum(1 / (x + i) ** 2 for i in range(6))


def expected_log(x: np.ndarray) -> np.ndarray:
    """Of Dirichlet weights along the last axis."""
    return digamma(x) - digamma(x.sum(-1, keepdims=True))


def at_rest(starts: np.ndarray, ids: np.ndarray, counts: np.ndarray, beta: np.ndarray, alpha: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Each row's weights of topics, from ``start`` (1 each) until a step changes them by ``REST`` in the mean at most.

    Steps are those of variational Bayes; two of them tell how far to go on in their direction (SQUAREM),
    a third settles what that made. A row without terms keeps ``alpha``.
    """
    n, k = np.diff(starts), len(alpha)
    out = np.tile(alpha, (len(n), 1))
    order = np.argsort(n, kind="stable")
    order = order[n[order] > 0]

    def step(b, c, g):  # type: ignore[no-untyped-def]
        t = np.exp(digamma(g))
        phi = np.matmul(t[:, None, :], b)[:, 0, :] + 1e-300
        return t * np.matmul(b, (c / phi)[:, :, None])[:, :, 0] + alpha

    at = 0
    while at < len(order):
        # Rows of like length together.
        most = min(64, max(1, SLICE // int(n[order[min(at + 63, len(order) - 1)]])))
        rows, at = order[at : at + most], at + most
        place = np.arange(n[rows[-1]])
        real = place < n[rows][:, None]
        place = np.where(real, starts[rows][:, None] + place, 0)
        b, c = np.ascontiguousarray(beta[:, ids[place]].transpose(1, 0, 2)), np.where(real, counts[place], 0.0)
        g = np.ones((len(rows), k)) if start is None else start[rows]
        cycle = 0
        while True:
            one = step(b, c, g)
            go = np.abs(one - g).mean(1) > REST
            if not go.all():
                out[rows[~go]] = one[~go]
                rows, g, one, b, c = rows[go], g[go], one[go], b[go], c[go]
                if not len(rows):
                    break
            two = step(b, c, one)
            cycle += 1
            # Steps as they are raise the bound each time: beyond 200 turns nothing else is done.
            if cycle > 200:
                g = two
                continue
            x, y = np.log(g), np.log(one)
            r, v = y - x, np.log(two) - 2 * y + x
            far = np.clip(np.sqrt((r * r).sum(1) / np.maximum((v * v).sum(1), 1e-300)), 1, 64)[:, None]
            g = step(b, c, np.clip(np.exp(np.minimum(x + 2 * far * r + far * far * v, 700)), alpha / 2, two.sum(1)[:, None]))
    return out


def _sums(starts, ids, counts, beta, gamma) -> np.ndarray:  # type: ignore[no-untyped-def]
    """What rows at rest add to each topic's weight of each term, before ``beta``."""
    row = np.repeat(np.arange(len(gamma)), np.diff(starts))
    t = np.exp(expected_log(gamma))
    phi = np.zeros(len(ids))
    for k in range(len(beta)):
        phi += t[row, k] * beta[k, ids]
    share = counts / (phi + 1e-300)
    return np.stack([np.bincount(ids, share * t[row, k], beta.shape[1]) for k in range(len(beta))])


_BLOCK = "starts binary, ids binary, counts binary, gamma binary, sums binary, logs binary, n long"
_NAMES = ["starts", "ids", "counts", "gamma", "sums", "logs", "n"]


def _row(*values) -> pa.RecordBatch:  # type: ignore[no-untyped-def]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if name == "n" else pa.binary()) for name, v in zip(_NAMES, values, strict=True)], _NAMES)


def packed(texts: DataFrame, terms: list[str], stop: list[str]) -> DataFrame:
    """Blocks of the rows that have a term, dealt evenly."""

    def run(batches):  # type: ignore[no-untyped-def]
        count = _counter(terms, stop)
        for batch in itertools.chain.from_iterable(_small(b, BLOCK_ROWS) for b in batches):
            starts, ids, counts = count(batch.column(0))
            starts = np.unique(starts)  # rows without a term have no place
            if len(starts) > 1:
                yield _row(starts.astype(np.int32).tobytes(), ids.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), None, None, None, len(starts) - 1)

    parts = max(texts.rdd.getNumPartitions(), 2 * texts.sparkSession.sparkContext.defaultParallelism)
    return texts.mapInArrow(run, _BLOCK).repartition(parts)


def _round(beta: np.ndarray, alpha: np.ndarray):  # type: ignore[no-untyped-def]
    def run(batches):  # type: ignore[no-untyped-def]
        sums, logs, seen = np.zeros(beta.shape), np.zeros(len(alpha)), 0
        for batch in batches:
            for block in batch.select(["starts", "ids", "counts", "gamma"]).to_pylist():
                if block["starts"] is None:  # what a task of the round before added up
                    continue
                starts, ids, counts = (np.frombuffer(block[c], np.int32) for c in ("starts", "ids", "counts"))
                before = None if block["gamma"] is None else np.frombuffer(block["gamma"]).reshape(-1, len(alpha))
                gamma = at_rest(starts, ids, counts, beta, alpha, before)
                sums += _sums(starts, ids, counts, beta, gamma)
                logs += expected_log(gamma).sum(0)
                seen += len(gamma)
                yield _row(block["starts"], block["ids"], block["counts"], gamma.tobytes(), None, None, len(gamma))
        if seen:
            yield _row(None, None, None, None, sums.tobytes(), logs.tobytes(), seen)

    return run


def _added_up(batches):  # type: ignore[no-untyped-def]
    total = None
    for row in itertools.chain.from_iterable(b.to_pylist() for b in batches):
        own = [np.frombuffer(row["sums"]), np.frombuffer(row["logs"]), row["n"]]
        total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total[0].tobytes()]), pa.array([total[1].tobytes()]), pa.array([total[2]])], ["sums", "logs", "n"])


def fit(texts: DataFrame, terms: list[str], stop: list[str], topics: int, rounds: int, seed: int, offset: float = 1024.0, decay: float = 0.51) -> TopicModel:
    """Topics after ``rounds`` rounds over all rows of ``texts`` (one column)."""
    weights = np.random.default_rng(seed).gamma(100.0, 0.01, (topics, len(terms)))
    alpha, eta = np.full(topics, 1 / topics), 1 / topics
    if not terms:
        return TopicModel(terms, weights, alpha)
    held = Scratch(texts.sparkSession)
    try:
        blocks = held.kept(packed(texts, terms, stop))
        for turn in range(1, rounds + 1):
            beta = np.exp(expected_log(weights))
            after = Scratch(texts.sparkSession)
            try:
                blocks = after.kept(blocks.mapInArrow(_round(beta, alpha), _BLOCK))
            finally:
                # Only the last round's rows are needed.
                held.__exit__()
                held = after
            parts = blocks.where("sums IS NOT NULL").select("sums", "logs", "n").coalesce(16).mapInArrow(_added_up, "sums binary, logs binary, n long").collect()  # 16 rows at most
            n = sum(r["n"] for r in parts)
            if not n:
                break
            sums = sum(np.frombuffer(r["sums"]) for r in parts).reshape(beta.shape) * beta
            rho = (offset + turn) ** -decay
            weights = (1 - rho) * weights + rho * (sums + eta)
            alpha = _moved_prior(alpha, sum(np.frombuffer(r["logs"]) for r in parts) / n, n, rho)
    finally:
        held.__exit__()
    return TopicModel(terms, weights, alpha)


def _moved_prior(alpha: np.ndarray, logs: np.ndarray, n: int, rho: float) -> np.ndarray:
    """A Newton step towards the prior under which rows are likeliest, ``rho`` of it; as it was where that isn't positive."""
    slope = n * (logs - expected_log(alpha))
    c, q = n * trigamma(alpha.sum()), -n * trigamma(alpha)
    b = (slope / q).sum() / (1 / c + (1 / q).sum())
    moved = alpha - rho * (slope - b) / q
    return moved if (moved > 0).all() else alpha


def shares(model: TopicModel, stop: list[str]) -> Callable[[pa.Array], np.ndarray]:
    """Makes of texts each one's shares of topics; the same for all where a text has no term."""
    count = _counter(model.vocabulary, stop)
    beta = np.exp(expected_log(model.weights)) if model.vocabulary else model.weights

    def run(column: pa.Array) -> np.ndarray:
        starts, ids, counts = count(column)
        gamma = at_rest(starts, ids, counts, beta, model.alpha)
        gamma[np.diff(starts) == 0] = 1.0
        return gamma / gamma.sum(1, keepdims=True)

    return run
