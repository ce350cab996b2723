"""Language identification, words first.

The model has, per language, the log frequencies of its words and of the character
n-grams of those words. A known word scores by its log frequencies; an
unseen one by the longest n-grams of it that are known, falling back from five
characters to one, each step at a discount. A text's language is the one with the
highest mean over its words.

The model is learned from a bounded sample of labelled rows: of each language those
whose hashed doc_id falls under a threshold set for ``sample_docs`` rows (all, where
it has fewer). Every word of the sample and every n-gram of those words is in it, however
rare, so that no language is starved by the others. The driver holds and broadcasts the
distinct words and n-grams of the sample, packed: some 30 bytes and what the languages
that have them take, 10 each. More than ``max_langs`` languages are an error, none is
left out in silence.

Edge cases: a null text or one without a letter is "und" with score 0; a text whose
words hold nothing known gets the first language at an even score; ties go to the
first language by code point; with nothing to learn from all texts are "und";
repeated rows are judged alike; a very long text is judged whole; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import slices
from .words import Cache, cut_words, number

UNKNOWN = "und"
LONGEST = 5
#: Log probability taken off at each step to shorter n-grams.
DISCOUNT = 0.7
#: Between words: all ASCII bytes but the small letters (texts are lower-cased first).
_GAPS = np.ones(256, bool)
_GAPS[97:123] = False
_GAPS[128:] = False


def _hash(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, items), np.uint64, len(items))


class Table(Mapping):
    """Log frequencies by item, read as {item: (one value per language)}.

    Items stand in the order of their hashes, one after the other in ``data``. Each has entries
    for the languages it was seen in; the others have their language's value in ``floors``.
    """

    def __init__(self, items: list[bytes], owner: np.ndarray, lang: np.ndarray, logs: np.ndarray, floors: np.ndarray, as_text: bool):
        """``owner`` tells which item an entry belongs to."""
        hashes = _hash(items)
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(items), np.int64)
        place[order] = np.arange(len(items))
        entries = np.lexsort((lang, place[owner]))
        sorted_items = [items[i] for i in order]
        self.hashes, self.data = hashes[order], b"".join(sorted_items)
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in sorted_items])]).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(place[owner], minlength=len(items)))]).astype(np.int64)
        self.lang, self.logs, self.floors, self.as_text = lang[entries].astype(np.int16), logs[entries], floors, as_text

    @classmethod
    def of_counts(cls, items: pa.Array, lang: np.ndarray, n: np.ndarray, langs: int, as_text: bool) -> Table:
        """Smoothed log frequencies of counts by (item, language), each pair once."""
        coded = items.dictionary_encode()
        distinct = [x.encode() for x in coded.dictionary.to_pylist()]
        totals = 1.0 + np.bincount(lang, weights=n, minlength=langs) + 0.5 * len(distinct)
        owner = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return cls(distinct, owner, lang, np.round(np.log((n + 0.5) / totals[lang]), 6), np.round(np.log(0.5 / totals), 6), as_text)

    @classmethod
    def of_rows(cls, rows: Mapping, langs: int) -> Table:
        """From {item: (one value per language)}."""
        items = [x.encode() if isinstance(x, str) else x for x in rows]
        logs = np.array(list(rows.values()), float).reshape(-1)
        return cls(items, np.repeat(np.arange(len(items)), langs), np.tile(np.arange(langs), len(items)), logs, np.zeros(langs), any(isinstance(x, str) for x in rows))

    def find(self, items: list[bytes]) -> np.ndarray:
        """The place of each item, -1 where it isn't known."""
        wanted = _hash(items)
        at = np.searchsorted(self.hashes, wanted)
        same = at < len(self.hashes)
        same[same] = self.hashes[at[same]] == wanted[same]
        out = np.full(len(items), -1, np.int64)
        for i in np.flatnonzero(same).tolist():
            for k in range(int(at[i]), len(self.hashes)):  # one step, but for items of equal hashes
                if self.hashes[k] != wanted[i]:
                    break
                if self.data[self.ends[k] : self.ends[k + 1]] == items[i]:
                    out[i] = k
                    break
        return out

    def rows(self, at: np.ndarray) -> np.ndarray:
        """One row of values per language for each place."""
        out = np.tile(self.floors, (len(at), 1))
        held = self.starts[at + 1] - self.starts[at]
        within = np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held)
        entry = np.repeat(self.starts[at], held) + within
        out[np.repeat(np.arange(len(at)), held), self.lang[entry]] = self.logs[entry]
        return out

    def __getitem__(self, item: bytes | str) -> tuple[float, ...]:
        at = self.find([item.encode() if isinstance(item, str) else item])
        if at[0] < 0:
            raise KeyError(item)
        return tuple(self.rows(at)[0].tolist())

    def __iter__(self) -> Iterator[bytes | str]:
        cut = (self.data[a:b] for a, b in zip(self.ends[:-1], self.ends[1:], strict=True))
        return (x.decode() for x in cut) if self.as_text else cut

    def __len__(self) -> int:
        return len(self.hashes)


@dataclass
class Model:
    langs: list[str]
    words: Mapping[bytes, tuple[float, ...]] = field(default_factory=dict)
    #: By length in characters.
    grams: dict[int, Mapping[str, tuple[float, ...]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        packed = lambda t: t if isinstance(t, Table) else Table.of_rows(t, len(self.langs))
        self.words, self.grams = packed(self.words), {k: packed(t) for k, t in self.grams.items()}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _lower_words(text: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(text), r"[\x00-\x60\x7B-\x7F]+", " "), " ")


def train(docs: DataFrame, sample_docs: int = 1500, max_langs: int = 256) -> Model:
    """Learn from text and lang of the rows that aren't held out."""
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages: raise max_langs (the model holds the words and n-grams of {sample_docs} documents of each)")
    langs = sorted(sizes)
    if not langs:
        return Model([])
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample_docs / sizes[lang]))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(place < F.try_element_at(share, F.col("lang")))
    coded = sample.select((F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int").alias("lang"), F.explode(_lower_words(F.col("text"))).alias("word")).where("word <> ''")
    counted = cut_lineage(coded.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    marked = counted.select("lang", "n", F.concat(F.lit(" "), "word", F.lit(" ")).alias("marked"))
    sized = marked.select("lang", "n", "marked", F.explode(F.array(*[F.lit(k) for k in range(1, LONGEST + 1)])).alias("size")).where(F.length("marked") >= F.col("size"))
    cut = sized.select("lang", "n", "size", F.explode(F.transform(F.sequence(F.lit(1), F.length("marked") - F.col("size") + 1), lambda i: F.substring("marked", i, F.col("size")))).alias("item"))
    grams = cut.groupBy("size", "item", "lang").agg(F.sum("n").alias("n")).toArrow()  # what the sample has
    words = counted.select("lang", F.col("word").alias("item"), "n").toArrow()
    table = lambda t, as_text: Table.of_counts(t["item"].combine_chunks(), t["lang"].to_numpy(), t["n"].to_numpy(), len(langs), as_text)
    return Model(langs, table(words, False), {k: table(grams.filter(pc.equal(grams["size"], k)), True) for k in range(1, LONGEST + 1)})


def score_words(model: Model, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Log scores by language, a row per word: the word's own, else the mean of its longest known n-grams; and which words have any."""
    out = np.zeros((len(words), len(model.langs)))
    at = model.words.find(words)
    known = at >= 0
    out[known] = model.words.rows(at[known])
    left = np.flatnonzero(~known)
    for size in range(LONGEST, 0, -1):
        table = model.grams.get(size)
        if table is None or not len(left):
            continue
        items, owner, times = [], [], []
        for k, i in enumerate(left.tolist()):
            marked = f" {words[i].decode('utf-8', 'replace')} "
            for gram, n in Counter(marked[j : j + size] for j in range(len(marked) - size + 1)).items():
                items.append(gram.encode())
                owner.append(k)
                times.append(n)
        at = table.find(items)
        hit = at >= 0
        own, weight = np.array(owner, np.int64)[hit], np.array(times, float)[hit]
        if not len(own):
            continue
        firsts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        found = left[own[firsts]]
        out[found] = np.add.reduceat(table.rows(at[hit]) * weight[:, None], firsts) / np.add.reduceat(weight, firsts)[:, None] - DISCOUNT * (LONGEST + 1 - size)
        known[found] = True
        left = left[~known[left]]
    return out, known


def score_word(model: Model, word: bytes) -> tuple[float, ...] | None:
    """The scores of one word, None where nothing of it is known."""
    scores, known = score_words(model, [word])
    return tuple(scores[0].tolist()) if known[0] else None


#: Words that are scored at a time: bounds the dense rows of their n-grams.
BLOCK = 4096


def _score_all(model: Model, words: list[bytes]) -> list[tuple[float, ...]]:
    """Scores per word, () where nothing of it is known."""
    out: list[tuple[float, ...]] = []
    for i in range(0, len(words), BLOCK):
        scores, known = score_words(model, words[i : i + BLOCK])
        out += [tuple(s) if k else () for s, k in zip(scores.tolist(), known.tolist(), strict=True)]
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the mean-score posterior of the language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        n = len(model.langs)
        cache = Cache(lambda words: _score_all(model, words))
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            spoken = np.array([t is not None and any(c.isalpha() for c in t) for t in texts]) if n else np.zeros(len(texts), bool)
            lowered = [(t or "").lower().encode() for t in texts]
            raw = np.frombuffer(b"".join(lowered), np.uint8)
            data, offsets, firsts = cut_words(raw, np.concatenate([[0], np.cumsum([len(t) for t in lowered])]).astype(np.int64), _GAPS)
            codes, words = number(data, offsets)
            held = cache.of(words)
            scores = np.array([s if s else (0.0,) * n for s in held], float).reshape(-1, max(n, 1))
            counted = np.array([bool(s) for s in held], bool)
            langs, sure = [], []
            for i in range(len(texts)):
                own = codes[firsts[i] : firsts[i + 1]]
                if not spoken[i]:
                    langs.append(UNKNOWN)
                    sure.append(0.0)
                    continue
                mean = scores[own].sum(axis=0) / max(1, int(counted[own].sum())) if len(own) else np.zeros(n)
                mean = np.round(mean, 9)
                best = int(np.argmax(mean))
                langs.append(model.langs[best])
                sure.append(round(float(1.0 / np.exp(mean - mean[best]).sum()), 6))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
