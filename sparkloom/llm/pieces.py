"""SentencePiece encoding and decoding with shared-prefix forward passes.

A text is marked as the library does (a space in front, spaces shown as U+2581) and
cut into words: before each run of marks and around characters that no longer piece
holds, where no piece can reach across. The distinct words of many texts are sorted,
which lays them out as a trie in depth-first order: next to each other, two words
share the prefix up to their first difference. The forward pass keeps one state per
prefix length on a stack, cuts the stack back to the shared length and goes on from
there, so each trie node is worked out once.

What a state holds depends on the model's kind:

* unigram: the best score of the prefix and the last piece on that way (Viterbi);
* BPE: the one piece that ends the prefix's own merge result. A piece t may follow a
  piece s if merging the string s + t gives back s and t; then the result for the
  prefix is the result for what lies before t, followed by t. No sum of scores finds
  the merge result, so the pass looks for that piece among the suffixes instead.

Both give the ids that the library gives. Characters without a piece fall back to
bytes. Decoding gathers the pieces' bytes and drops the mark in front.

Edge cases: a null text is empty and has no pieces; a text's own U+2581 is a space
after decoding, as in the library; a very long text is encoded whole, a very long word
in time proportional to its length; repeated rows are encoded alike; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, slices, text_bytes
from .words import Cache, number

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
#: What an unknown character costs below the worst piece, as in the library.
_PENALTY = 10.0


class Pieces:
    """A SentencePiece model file's pieces, ready for encoding words and decoding ids."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        self.kind = proto.trainer_spec.model_type
        spec = proto.normalizer_spec
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
            raise ValueError("only models with identity normalisation, a space in front and byte fallback are supported")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (_NORMAL, _USER)}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type in (_NORMAL, _USER)}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.unknown = min(self.scores.values()) - _PENALTY
        # Which lengths of pieces end in which character, longest first.
        lengths: dict[str, set[int]] = {}
        for piece in self.ids:
            lengths.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {c: tuple(sorted(n, reverse=True)) for c, n in lengths.items()}
        alone = {c for p in self.ids for c in p if len(p) > 1}
        self.cuts = "\n" not in alone
        self._bytes = [b"".join([bytes([int(p.piece[3:5], 16)])] if p.type == _BYTE else [p.piece.replace(MARK, " ").encode()] if p.type in (_NORMAL, _USER) else [b" \xe2\x81\x87 "] if p.type == _UNKNOWN else []) for p in proto.pieces]
        self.piece_bytes = np.frombuffer(b"".join(self._bytes), np.uint8)
        self.piece_lengths = np.array([len(b) for b in self._bytes], np.int64)
        self.piece_starts = np.cumsum(self.piece_lengths) - self.piece_lengths
        self._pairs: dict[tuple[str, str], bool] = {}
        self._own: dict[str, bool] = {}

    # BPE

    def merged(self, text: str) -> list[str]:
        """The merge result of a short string, by the rule itself: the best-scored pair, leftmost first."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, before: str, piece: str) -> bool:
        key = (before, piece)
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) > 500_000:
                self._pairs.clear()
            found = self._pairs[key] = self.merged(before + piece) == [before, piece]
        return found

    def _stable(self, piece: str) -> bool:
        found = self._own.get(piece)
        if found is None:
            found = self._own[piece] = self.merged(piece) == [piece]
        return found

    def _bpe(self, word: str, last: list[str], done: int) -> None:
        """Extend ``last``, the last piece of each prefix's merge result, from length ``done`` on."""
        ids, lengths = self.ids, self.lengths
        pairs, follows, stable = self._pairs, self._follows, self._stable
        for end in range(done + 1, len(word) + 1):
            for n in lengths.get(word[end - 1], ()):
                start = end - n
                if start < 0:
                    continue
                piece = word[start:end]
                if piece not in ids or (n > 1 and not stable(piece)):
                    continue
                if start == 0:
                    last.append(piece)
                    break
                before = last[start]
                fits = pairs.get((before, piece))
                if fits or (fits is None and follows(before, piece)):
                    last.append(piece)
                    break
            else:
                last.append(word[end - 1])  # a character without a piece

    # Unigram

    def _viterbi(self, word: str, last: list[str], best: list[float], done: int) -> None:
        scores, lengths, unknown = self.scores, self.lengths, self.unknown
        for end in range(done + 1, len(word) + 1):
            top, way = None, ""
            for n in lengths.get(word[end - 1], ()):
                if n > end:
                    continue
                piece = word[end - n : end]
                score = scores.get(piece)
                if score is not None and (top is None or best[end - n] + score > top):
                    top, way = best[end - n] + score, piece
            if word[end - 1] not in scores and (top is None or best[end - 1] + unknown > top):
                top, way = best[end - 1] + unknown, word[end - 1]
            last.append(way)
            best.append(top)

    # Both

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of marked words, worked out depth-first over the trie of the sorted words."""
        out: list[list[int]] = [[]] * len(words)
        last, best, before = [""], [0.0], ""
        for i in sorted(range(len(words)), key=words.__getitem__):
            word = words[i]
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            if self.kind == BPE:
                self._bpe(word, last, shared)
            else:
                del best[shared + 1 :]
                self._viterbi(word, last, best, shared)
            before, end, ids = word, len(word), []
            while end:
                piece = last[end]
                known = self.ids.get(piece)
                ids += [known] if known is not None else [self.byte_ids[b] for b in reversed(piece.encode())]
                end -= len(piece)
            out[i] = ids[::-1]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        if not text:
            return []
        words = re.findall(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if self.cuts else rf"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK))
        return [i for ids in self.encode_words(words) for i in ids]

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The pieces' bytes, joined; the mark in front is still there."""
        return self.piece_bytes[ranges(self.piece_starts[ids], self.piece_lengths[ids])]

    def decode(self, ids: list[int]) -> str:
        raw = self.decode_bytes(np.array(ids, np.int64)).tobytes()
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str = MODEL) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read())


@lru_cache(maxsize=2)
def _cache(path: str) -> Cache:
    pieces = load(path)
    return Cache(lambda words: [np.array(ids, np.int32).tobytes() for ids in pieces.encode_words([w.decode().replace(" ", MARK) for w in words])])


def encode_batch(texts: pa.Array, path: str = MODEL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts in one piece, ids' starts per text, the texts' bytes as marked, their starts)."""
    pieces = load(path)
    raw, starts = text_bytes(texts)
    if MARK.encode() in raw.tobytes():
        texts = pa.array([(t or "").replace(MARK, " ") for t in texts.to_pylist()], pa.string())
        raw, starts = text_bytes(texts)
    n = np.diff(starts)
    # A space in front of each text that isn't empty.
    marked_starts = np.concatenate([[0], np.cumsum(n + (n > 0))])
    marked = np.full(int(marked_starts[-1]), 32, np.uint8)
    marked[ranges(marked_starts[:-1] + (n > 0), n)] = raw
    space = marked == 32
    opens = space.copy()
    opens[1:] &= ~space[:-1]
    if pieces.cuts:
        line = marked == 10
        opens |= line
        opens[1:] |= line[:-1]
    opens[marked_starts[:-1][n > 0]] = True
    at = np.flatnonzero(opens)
    codes, words = number(marked, np.append(at, len(marked)))
    blobs = _cache(path).of(words)
    word_ids = np.frombuffer(b"".join(blobs), np.int32)
    sizes = np.array([len(b) // 4 for b in blobs], np.int64)
    ids = word_ids[ranges((np.cumsum(sizes) - sizes)[codes], sizes[codes])]
    before = np.concatenate([[0], np.cumsum(sizes[codes])])
    return ids, before[np.searchsorted(at, marked_starts)], marked, marked_starts


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and its piece ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids, starts, _, _ = encode_batch(part.column("text"), path)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and the text of its piece ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pieces.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGEST = "doc_id long, n_bytes long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def digest(docs: DataFrame, path: str = MODEL, with_ids: bool = False) -> DataFrame:
    """Per row: sizes, the digest of its ids (little-endian int32) and of the text decoded from them.

    Sizes and ``round_trip`` are those of the text as given: one that holds the mark U+2581
    decodes to spaces and so doesn't come back. ``with_ids`` adds the ids themselves.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for part in slices(batches, "text"):
            ids, starts, _, _ = encode_batch(part.column("text"), path)
            raw, raw_starts = text_bytes(part.column("text"))
            decoded = pieces.decode_bytes(ids)
            ends = np.concatenate([[0], np.cumsum(pieces.piece_lengths[ids])])[starts]
            id_sha, text_sha, same = [], [], []
            for i in range(part.num_rows):
                id_sha.append(hashlib.sha256(ids[starts[i] : starts[i + 1]]).hexdigest())
                own, given = decoded[ends[i] : ends[i + 1]], raw[raw_starts[i] : raw_starts[i + 1]]
                text_sha.append(hashlib.sha256(own[1:]).hexdigest())
                same.append(bool((own[:1] == 32).all() and np.array_equal(own[1:], given)))
            columns = [part.column("doc_id"), pa.array(np.diff(raw_starts)), pa.array(np.diff(starts)), pa.array(id_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(same, pa.bool_())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    schema = DIGEST + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
