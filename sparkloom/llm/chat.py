r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole, turn after turn:

    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>

It is encoded once; token offsets are the running sums of the tokens' byte
lengths. The rendered turns' text spans are sorted, and so are the token spans, so
a binary search finds the first and last token of each span. The mask keeps, for
each token, how many of its bytes belong to a trained turn, from where.

Control strings inside roles and texts are escaped by one backslash after ``<`` in
``<|`` (``<\|`` becomes ``<\\|`` and so on), so no text can open a marker, and
taking one backslash away restores it.

Rows of a conversation are sorted into one stream and rendered as they pass, so a
worker holds one conversation at most, and long ones in pieces of ``PIECE_BYTES``.

Edge cases: a null text or role is empty; a null conv_id is a conversation of its
own; rows with equal turns stand in order of role and text; repeated rows are
turns of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The usual splitting pattern of byte-level BPE vocabularies: a fixed value.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rendered text that is encoded at once; a longer conversation is cut between turns.
PIECE_BYTES = 8_000_000


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: Iterable[tuple[str, str]]) -> str:
    return "".join(f"{START}{escape(role)}{SEP}{escape(text)}{END}" for role, text in turns)


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    """The tokenizer with the three markers as tokens after the vocabulary, and all tokens' byte lengths."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    top = max(ranks.values()) + 1
    markers = {marker: top + i for i, marker in enumerate((START, SEP, END))}
    lengths = np.zeros(top + len(markers), np.int64)
    for token, i in [*ranks.items(), *((m.encode(), i) for m, i in markers.items())]:
        lengths[i] = len(token)
    return tiktoken.Encoding("chat", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=markers), lengths


def turn_spans(rendered: str) -> list[tuple[str, int, int]]:
    """(role, start, end) of each turn's text in the UTF-8 bytes of a rendered conversation."""
    spans, at, done = [], 0, 0
    for m in re.finditer(rf"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}", rendered, re.S):
        start = at + len(rendered[done : m.start(2)].encode())
        at = start + len(m[2].encode())
        done = m.end(2)
        spans.append((unescape(m[1]), start, at))
    return spans


def align(token_ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens that meet the spans, and the part [from, to) of the text that each gives to the mask.

    Both lists are sorted, so each span's tokens are one run, bounded by two binary
    searches: the first token that ends behind the span's start, and the first that
    starts at or behind its end.
    """
    spans = [s for s in spans if s[1] > s[0]]
    if not spans:
        none = np.zeros(0, np.int64)
        return none, none, none
    starts, ends = np.array(spans, np.int64).T
    token_starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(token_ends, starts, side="right")
    last = np.searchsorted(token_starts, ends, side="left")
    count = last - first
    total = np.cumsum(count)
    tokens = np.arange(total[-1]) + np.repeat(first - (total - count), count)
    return tokens, np.maximum(token_starts[tokens], np.repeat(starts, count)), np.minimum(token_ends[tokens], np.repeat(ends, count))


class _Conversation:
    """What is read back from the rendered and encoded pieces of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.held = conv_id, [], 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_tokens = self.loss_tokens = 0
        self.ids: list[np.ndarray] = []
        self.masks: list[np.ndarray] = []
        self.texts: list[str] = []

    def add(self, role: str, text: str, path: str, keep: bool) -> None:
        self.rows.append((role, text))
        self.held += len(text)
        if self.held > PIECE_BYTES // 4:
            self.close(path, keep)

    def close(self, path: str, keep: bool) -> None:
        """Render, encode, mask and read back the turns held."""
        tokenizer, lengths = encoder(path)
        rendered = render(self.rows)
        self.rows, self.held = [], 0
        ids = np.array(tokenizer.encode(rendered, allowed_special="all"), np.int64)
        ends = np.cumsum(lengths[ids])
        raw = rendered.encode()
        spans = turn_spans(rendered)
        tokens, starts, stops = align(ends, [(a, b) for role, a, b in spans if role == TRAINED_ROLE])
        mask = np.zeros(len(ids), bool)
        mask[tokens] = True
        for role, a, b in spans:
            self.turns.update(f"{role}\n{unescape(raw[a:b].decode())}\n".encode())
        trained, at = [], 0
        for role, a, b in spans:  # the mask's own runs, turn by turn, so that unescaping never spans two turns
            if role == TRAINED_ROLE:
                to = at + int(np.searchsorted(starts[at:], b)) if b > a else at
                trained.append(unescape(b"".join(raw[x:y] for x, y in _runs(starts[at:to], stops[at:to])).decode()))
                at = to
        for text in trained:
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.n_turns += len(spans)
        self.chars += len(rendered)
        self.n_tokens += len(ids)
        self.loss_tokens += int(mask.sum())
        if keep:
            self.ids.append(ids)
            self.masks.append(mask)
            self.texts.append(rendered)


def _runs(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Adjoining parts joined."""
    if not len(starts):
        return []
    new = np.flatnonzero(starts[1:] != stops[:-1]) + 1
    return list(zip(starts[np.concatenate([[0], new])].tolist(), stops[np.concatenate([new - 1, [len(stops) - 1]])].tolist(), strict=True))


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
_EXAMPLES = "conv_id long, formatted string, token_ids array<int>, loss_mask array<boolean>"


def _stream(batches: Iterable[pa.RecordBatch], path: str, keep: bool) -> Iterator[pa.RecordBatch]:
    def rows_of(done: list[_Conversation]) -> pa.RecordBatch:
        if keep:
            return pa.RecordBatch.from_arrays(
                [pa.array([c.conv_id for c in done], pa.int64()), pa.array(["".join(c.texts) for c in done], pa.string()), pa.array([np.concatenate([np.zeros(0, np.int64), *c.ids]).astype(np.int32) for c in done], pa.list_(pa.int32())), pa.array([np.concatenate([np.zeros(0, bool), *c.masks]) for c in done], pa.list_(pa.bool_()))],
                ["conv_id", "formatted", "token_ids", "loss_mask"],
            )
        columns = [pa.array([f(c) for c in done], kind) for f, kind in ((lambda c: c.conv_id, pa.int64()), (lambda c: c.n_turns, pa.int64()), (lambda c: c.turns.hexdigest(), pa.string()), (lambda c: c.loss_chars, pa.int64()), (lambda c: c.loss.hexdigest(), pa.string()), (lambda c: c.chars, pa.int64()), (lambda c: c.n_tokens, pa.int64()), (lambda c: c.loss_tokens, pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, [p.split()[0] for p in _DIGEST.split(", ")])

    now: _Conversation | None = None
    for batch in batches:
        done = []
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    now.close(path, keep)
                    done.append(now)
                now = _Conversation(conv_id)
            now.add(role, text, path, keep)
        if done:
            yield rows_of(done)
    if now is not None:
        now.close(path, keep)
        yield rows_of([now])


def _ordered(conversations: DataFrame) -> DataFrame:
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(conversations: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """conv_id, formatted, token_ids and loss_mask (per token: does it meet a trained text)."""
    return _ordered(conversations).mapInArrow(lambda batches: _stream(batches, path, True), _EXAMPLES)


def format_digest(conversations: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Counts and digests per conversation, all read back from the rendered text and its mask."""
    return _ordered(conversations).mapInArrow(lambda batches: _stream(batches, path, False), _DIGEST)
