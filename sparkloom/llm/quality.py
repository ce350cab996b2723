"""Quality rules: base counts and the fertility of public tokenizers.

Three measures, over the words of a text, each encoded with its leading space:

* characters per token of a byte-level BPE vocabulary for many languages;
* byte-fallback share: the part of another vocabulary's pieces that stand for single
  bytes, because no piece has their character;
* token entropy: bits per token of the first vocabulary's tokens within the text.

A text outside the band of its language (where the language has one, else of the
script that most of its letters have) is rejected. Each distinct word is encoded
once per worker, up to a bound.

Edge cases: a null text has no words and fails the base rules; so do short texts,
whatever their tokens; a null or unknown lang takes the script's band; repeated rows
are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat import SPLIT
from .common import ranges, slices, text_bytes
from .words import Cache, cut_words, number

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PIECE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Texts in one step; small, so that a text's number and three word codes fit in 63 bits.
STEP_BYTES = 2_000_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"

#: Least and most characters per token, most byte-fallback share, least and most entropy.
Band = tuple[float, float, float, float, float]
LATIN: Band = (1.25, 7.5, 0.20, 3.0, 13.0)
#: The lower bounds stand some 8 % under the least that documents labelled good reach.
BANDS: dict[str, Band] = {
    "en": (1.80, 7.5, 0.20, 3.0, 13.0),
    "de": (1.85, 7.5, 0.20, 3.0, 13.0),
    "fr": (1.72, 7.5, 0.20, 3.0, 13.0),
    "es": (1.72, 7.5, 0.20, 3.0, 13.0),
}
SCRIPT_BANDS: dict[str, Band] = {
    "latin": LATIN,
    "greek": (0.6, 6.0, 0.35, 3.0, 13.0),
    "cyrillic": (0.7, 6.0, 0.25, 3.0, 13.0),
    "semitic": (0.5, 6.0, 0.40, 3.0, 13.0),
    "indic": (0.3, 5.0, 0.90, 2.5, 13.0),
    "east_asian": (0.3, 3.5, 0.70, 3.0, 14.0),
    "other": (0.25, 8.0, 1.00, 1.0, 15.0),
}
_SCRIPTS = list(SCRIPT_BANDS)


def _script_table() -> np.ndarray:
    """For each lead byte of UTF-8 the number of the script it mostly opens, or -1."""
    table = np.full(256, -1, np.int8)
    for name, spans in {
        "latin": [(65, 90), (97, 122), (0xC3, 0xCA)],
        "greek": [(0xCD, 0xCF)],
        "cyrillic": [(0xD0, 0xD4)],
        "semitic": [(0xD6, 0xDD)],
        "indic": [(0xE0, 0xE1)],
        "east_asian": [(0xE3, 0xED)],
        "other": [(0xF0, 0xF4)],
    }.items():
        for low, high in spans:
            table[low : high + 1] = _SCRIPTS.index(name)
    return table


_SCRIPT_OF = _script_table()
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_STARTS_CHAR = np.ones(256, bool)
_STARTS_CHAR[0x80:0xC0] = False


@lru_cache(maxsize=2)
def _tokenizers(byte_path: str, piece_path: str):
    import sentencepiece
    import tiktoken

    with open(byte_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    return tiktoken.Encoding("fertility", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), pieces, np.array([pieces.IsByte(i) for i in range(pieces.GetPieceSize())])


@lru_cache(maxsize=2)
def _word_cache(byte_path: str, piece_path: str) -> Cache:
    tokenizer, pieces, is_byte = _tokenizers(byte_path, piece_path)

    def measure(words: list[bytes]) -> list[tuple[bytes, int, int]]:
        """Per word its token ids, its pieces and how many of them stand for one byte."""
        texts = [w.decode("utf-8", "replace") for w in words]
        split = pieces.encode(texts, num_threads=1)
        return [(np.array(tokenizer.encode_ordinary(" " + t), np.uint16).tobytes(), len(p), int(is_byte[p].sum())) for t, p in zip(texts, split, strict=True)]

    return Cache(measure)


def _per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive starts; empty spans give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def _repeated(codes: np.ndarray, n_codes: int, texts: np.ndarray, n_texts: int) -> np.ndarray:
    """Which words stand in a 3-word window that the same text has twice or more."""
    covered = np.zeros(len(codes), bool)
    at = np.flatnonzero(texts[:-2] == texts[2:]) if len(codes) > 2 else np.zeros(0, np.int64)
    if not len(at):
        return covered
    width = max(1, int(n_codes - 1).bit_length())
    if 3 * width + int(n_texts).bit_length() <= 63:
        key = (((texts[at] << width | codes[at]) << width) | codes[at + 1]) << width | codes[at + 2]
        order = np.argsort(key)
        same = np.diff(key[order]) == 0
    else:
        columns = (codes[at + 2], codes[at + 1], codes[at], texts[at])
        order = np.lexsort(columns)
        same = np.logical_and.reduce([np.diff(c[order]) == 0 for c in columns])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for k in range(3):
        covered[at[twice] + k] = True
    return covered


def measure(texts: pa.Array, byte_path: str = BYTE_VOCABULARY, piece_path: str = PIECE_VOCABULARY) -> dict[str, np.ndarray]:
    """All counts and measures of an Arrow array of texts."""
    raw, starts = text_bytes(texts)
    n = len(starts) - 1
    data, offsets, firsts = cut_words(raw, starts)
    codes, words = number(data, offsets)
    n_words = np.diff(firsts)
    text_of = np.repeat(np.arange(n), n_words)
    lines = np.zeros(n, np.int64)
    view = raw.tobytes()
    for i in np.flatnonzero(_per_text(raw == 10, starts)):
        own = [x for x in view[starts[i] : starts[i + 1]].split(b"\n") if x.strip()]
        lines[i] = len(own) - len(set(own))
    known = _word_cache(byte_path, piece_path).of(words)
    ids = np.frombuffer(b"".join(k[0] for k in known), np.uint16).astype(np.int64)
    n_ids = np.array([len(k[0]) // 2 for k in known], np.int64)
    n_pieces, n_bytes = np.array([k[1:] for k in known], np.int64).reshape(-1, 2).T
    tokens = ids[ranges((np.cumsum(n_ids) - n_ids)[codes], n_ids[codes])]
    n_tokens = _per_text(n_ids[codes], firsts)
    # Entropy from the counts of (text, token).
    key = np.sort(np.repeat(np.arange(n), n_tokens) * 65536 + tokens)
    cuts = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(np.append(cuts, len(key))).astype(np.float64)
    self_sum = np.bincount(key[cuts] >> 16, weights=count * np.log2(count), minlength=n) if len(key) else np.zeros(n)
    some = np.maximum(n_tokens, 1)
    chars = _STARTS_CHAR[data]
    word_starts = offsets[firsts]
    letters = np.stack([_per_text(_SCRIPT_OF[data] == k, word_starts) for k in range(len(_SCRIPTS))])
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": _per_text(chars, word_starts),
        "n_symbols": _per_text(_IS_SYMBOL[raw], starts),
        "n_dup_lines": lines,
        "n_repeat_words": _per_text(_repeated(codes, len(words), text_of, n), firsts),
        "chars_per_token": np.round(_per_text(chars, word_starts) / some, 6),
        "byte_share": np.round(_per_text(n_bytes[codes], firsts) / np.maximum(_per_text(n_pieces[codes], firsts), 1), 6),
        "entropy": np.round(np.where(n_tokens > 0, np.log2(some) - self_sum / some, 0.0), 6) + 0.0,
        "script": np.where(letters.sum(0) > 0, letters.argmax(0), _SCRIPTS.index("other")),
    }


def verdict(m: dict[str, np.ndarray], langs: list[str | None], bands: dict[str, Band]) -> np.ndarray:
    """Which texts lie within the band of their language, else of their script."""
    low, high, fallback, least, most = np.array([bands.get(lang or "", SCRIPT_BANDS[_SCRIPTS[s]]) for lang, s in zip(langs, m["script"].tolist(), strict=True)], float).reshape(-1, 5).T
    return (m["chars_per_token"] >= low) & (m["chars_per_token"] <= high) & (m["byte_share"] <= fallback) & (m["entropy"] >= least) & (m["entropy"] <= most)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SHARES = ("chars_per_token", "byte_share", "entropy")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", " + ", ".join(f"{c} double" for c in _SHARES) + ", base_failed boolean, kept boolean"


def _judged(part: pa.RecordBatch, bands: dict[str, Band]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    m = measure(part.column("text"))
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    return m, failed, ~failed & verdict(m, part.column("lang").to_pylist(), bands)


def assess(docs: DataFrame, bands: dict[str, Band] = BANDS) -> DataFrame:
    """Counts, measures, base_failed and kept for every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", STEP_BYTES):
            m, failed, kept = _judged(part, bands)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(m[c]) for c in (*_COUNTS, *_SHARES)), pa.array(failed), pa.array(kept)], ["doc_id", *_COUNTS, *_SHARES, "base_failed", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, bands: dict[str, Band] = BANDS) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged; decided and filtered in one pass, without a join."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", STEP_BYTES):
            yield part.filter(pa.array(_judged(part, bands)[2]))

    return docs.mapInArrow(run, docs.schema)
