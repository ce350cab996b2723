"""Repeated passages by enhanced suffix arrays over anchored fragments.

Every 50-byte window of a text has an anchor: the least hash among its 16-byte grams.
It depends on the window alone, so equal windows in different texts have the same
anchor. Consecutive windows with one anchor form a fragment; each window is in one.

1. Anchors: each slice of texts sends its anchors to buckets; a bucket answers which
   of them occur in two documents or more. Others can't hold a shared window.
2. Fragments with shared anchors are cut out and sent to buckets by anchor, so all
   occurrences of a shared window meet in one bucket. Equal fragments collapse.
3. A bucket sorts the suffixes of its fragments into an enhanced suffix array (order
   and longest common prefixes) and scans it with a stack for the intervals of common
   prefixes of 50 bytes or more. An interval whose occurrences have different left
   neighbours, or one at its fragment's edge, is a maximal repeat; it is put out with
   all occurrences, of which those in other than its first document are removed.
4. Removed spans go back to the documents' buckets, where they are joined and cut.

Rows between the steps are packed and compressed arrays, one per slice and bucket,
so the corpus crosses the network a few times as bytes, never as one row per window.
Such rows are as many as slices times buckets or buckets times buckets, so buckets grow
with the corpus up to what a task may hold, and are worked through in smaller steps. An
anchor that very many documents share is sent once per slice, an equal fragment once per
bucket of documents. An anchor's fragments with different text meet in one step.

Edge cases: a null text is empty; texts under 50 bytes lose nothing; a document's
repeats within itself stay, as do those of rows with an equal doc_id; repeated rows
give repeated rows; a null doc_id counts as the largest, so rows without one take
nothing from each other; a very long text is handled whole, in one task; an empty
table gives an empty result; other columns, whatever their names, are ignored.

A row is known by its doc_id and a 63-bit hash of its text, one without a doc_id by two
hashes of its text, 127 bits in all. Rows with equal id and text are treated alike.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, slices, text_bytes

LEAST = 50
GRAM = 16
STEP_BYTES = 2_000_000
#: Texts that are packed for their buckets at once.
PACK_BYTES = 16_000_000
#: Members of repeats handled at once.
BLOCK_MEMBERS = 500_000
#: Text bytes per bucket of anchors.
ANCHOR_BUCKET = 24_000_000
#: Text bytes per bucket of documents or fragments: the least until there are ``BUCKETS``, then more, at last the most.
LEAST_BUCKET, MOST_BUCKET, BUCKETS = 3_000_000, 24_000_000, 128
#: Bytes of fragments whose suffixes are sorted at once (or one anchor's).
SORT_BYTES = 2_000_000
#: Bytes of a suffix that are sorted; longer repeats come out in overlapping pieces, one from each of their suffixes.
DEPTH = 96
ROW = "part int, kind int, blob binary"
_NULL_ID = np.iinfo(np.int64).max
_ANCHOR_BITS = np.uint64(40)
_U = np.uint64


# Packing


def bucket_count(size: int, least: int = LEAST_BUCKET, most: int = MOST_BUCKET) -> int:
    """Buckets for ``size`` bytes; twice the bytes make less than twice the buckets until each holds the ``most``."""
    return int(size // min(max(size // BUCKETS, least), most)) + 1


@lru_cache(maxsize=1)
def _coders():  # type: ignore[no-untyped-def]
    import zstandard

    return zstandard.ZstdCompressor(level=5), zstandard.ZstdDecompressor()


def pack(**columns: np.ndarray) -> bytes:
    """Arrays in one compressed blob; sorted integer columns named ``d_`` are stored as differences."""
    head, body = [], []
    for name, values in columns.items():
        kind = values.dtype.str
        if name.startswith("d_"):
            values = np.diff(values, prepend=values.dtype.type(0))
        if values.dtype.itemsize > 1:  # byte planes compress better
            values = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
        head.append(f"{name} {kind} {values.nbytes}")
        body.append(values.tobytes())
    top = ",".join(head).encode()
    return _coders()[0].compress(len(top).to_bytes(4, "little") + top + b"".join(body))


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = _coders()[1].decompress(blob)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for entry in raw[4:at].decode().split(","):
        name, kind, size = entry.split(" ")
        dtype, n = np.dtype(kind), int(size)
        values = np.frombuffer(raw, np.uint8, n, at)
        if dtype.itemsize > 1:
            values = np.ascontiguousarray(values.reshape(dtype.itemsize, -1).T).view(dtype).ravel()
        else:
            values = values.view(dtype)
        out[name] = np.cumsum(values, dtype=dtype) if name.startswith("d_") else values
        at += n
    return out


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    parts, kinds, blobs = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["part", "kind", "blob"])


def _by_part(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """The blobs of each part in turn; rows come sorted by part."""
    part, held = None, []
    for batch in batches:
        for p, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "blob")), strict=True):
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append((kind, blob))
    if held:
        yield part, held


def _split(part: np.ndarray, n_parts: int) -> list[tuple[int, np.ndarray]]:
    """Row numbers of each part that has any, in their order."""
    if not len(part):
        return []
    order = np.argsort(part.astype(np.uint16) if n_parts <= 1 << 16 else part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n_parts + 1)) if n_parts < len(part) else None
    if cuts is not None:
        return [(p, order[cuts[p] : cuts[p + 1]]) for p in np.flatnonzero(np.diff(cuts)).tolist()]
    found, starts = np.unique(part[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, starts[1:]), strict=True))


# Hashes


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, 256, dtype=np.uint64)


_GRAM_OF, _BYTE_OF = _table(11), _table(12)
_BASE = _U(0x9E3779B97F4A7C15 | 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(29)
    return h


def _anchors(raw: np.ndarray, gram: int, least: int) -> np.ndarray:
    """For each position the least gram hash of the window that starts there."""
    h, n, factor = _GRAM_OF[raw], 1, 0x9E3779B97F4A7C15
    while n < gram:
        k = min(n, gram - n)
        h = h[: len(h) - k] * _U(factor) + (h[k:] ^ (h[k:] >> _U(31)))
        factor, n = factor * 0xD6E8FEB86659FD93 % 2**64, n + k
    h = _mix(h)
    width, n = least - gram + 1, 1
    while 2 * n <= width:
        h = np.minimum(h[: len(h) - n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (width - n)], h[width - n :]) if n < width else h


def fragments(raw: np.ndarray, starts: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor in 40 bits, text number, start, length) of every run of windows with one anchor."""
    sizes = np.diff(starts)
    none = np.zeros(0, np.int64)
    if len(raw) < least:
        return none.astype(np.uint64), none, none, none
    value = _anchors(raw, gram, least)
    valid = np.zeros(len(value), bool)
    valid[ranges(starts[:-1], np.maximum(sizes - least + 1, 0))] = True
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (value[1:] != value[:-1])
    opens[starts[:-1][sizes >= least]] = True
    closes = valid.copy()
    closes[:-1] &= ~valid[1:] | opens[1:]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    return value[first] >> (_U(64) - _ANCHOR_BITS), np.searchsorted(starts, first, side="right") - 1, first, last - first + least


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    """The powers of ``base`` modulo 2^64 from 0 up to ``n`` - 1."""
    powers = np.empty(n, np.uint64)
    powers[0] = 1
    filled = 1
    while filled < n:  # doubling: powers[i + filled] = powers[i] * base^filled
        k = min(filled, n - filled)
        powers[filled : filled + k] = powers[:k] * _U(pow(base, filled, 2**64))
        filled += k
    return powers


def _prefix_hash(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial hash modulo 2^64 and the powers that align its differences."""
    n = len(raw)
    most = 1 << n.bit_length()
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_OF[raw] * _powers(int(_BASE), most)[:n], out=total[1:])
    return total, _powers(pow(int(_BASE), -1, 2**64), most)


def _span_hash(total: np.ndarray, powers: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hash of bytes [start, start + length), independent of the place and of the array around them."""
    return _mix((total[start + length] - total[start]) * powers[start])


# Steps


def _keyed(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, starts = text_bytes(part.column("text"))
    return raw, starts, *(part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))


def _rank(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """What rows are compared by: the doc_id, the largest number where there is none (odd tags)."""
    return np.where(tags & 1, _NULL_ID, ids)


def _part_of(ids: np.ndarray, tags: np.ndarray, n: int) -> np.ndarray:
    return (_mix(ids.view(np.uint64) ^ _mix(tags.view(np.uint64).copy())) % _U(n)).astype(np.int64)


def _stepwise(raw: np.ndarray, starts: np.ndarray, least: int) -> Iterator[tuple[int, int, tuple[np.ndarray, ...]]]:
    """(first text, the one behind the last, their fragments from there on), so that the hashes stay small."""
    at = 0
    while at < len(starts) - 1:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + STEP_BYTES, side="right")) - 1)
        yield at, to, fragments(raw[starts[at] : starts[to]], starts[at : to + 1] - starts[at], least)
        at = to


def _sorted_pairs(anchor: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order; small numbers fit behind the anchor in one key."""
    bits = _U(64) - _ANCHOR_BITS
    if len(number) and int(number.max()) >> int(bits):
        order = np.lexsort((number, anchor))
        return anchor[order], number[order]
    key = np.sort(anchor << bits | number.astype(np.uint64))
    return key >> bits, (key & ((_U(1) << bits) - _U(1))).astype(np.int64)


def _send_anchors(batches: Iterable[pa.RecordBatch], n_anchor: int, n_docs: int, least: int) -> Iterator[pa.RecordBatch]:
    """Per slice and bucket: the anchors with a document each; those of two documents are answered here."""
    for part in slices(batches, "text", PACK_BYTES):
        raw, starts, ids, tags = _keyed(part)
        anchor, text = (np.concatenate(x) for x in zip(*((a, t + at) for at, _, (a, t, _, _) in _stepwise(raw, starts, least)), strict=True))
        if not len(anchor):
            continue
        anchor, text = _sorted_pairs(anchor, text)
        fresh = np.ones(len(anchor), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        anchor, text = anchor[fresh], text[fresh]
        starts_of = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        doc, tag = ids[text], tags[text]
        rank = _rank(doc, tag)
        many = np.minimum.reduceat(rank, starts_of) != np.maximum.reduceat(rank, starts_of)
        size = np.diff(np.append(starts_of, len(anchor)))
        known = np.repeat(many, size)
        rows = []
        # Answered: straight to the documents' buckets, by way of any anchor bucket.
        d, g, a = doc[known], tag[known], anchor[known]
        for p, own in _split(_part_of(d, g, n_docs), n_docs):
            rows.append((int(p) % n_anchor, 1 + int(p), _shared_blob(d[own], g[own], a[own])))
        # One entry stands for an anchor that needs no answer; it only tells others.
        send = ~known
        send[starts_of[many]] = True
        a, t, open_ = anchor[send], text[send], ~known[send]
        for p, own in _split((a % _U(n_anchor)).astype(np.int64), n_anchor):
            used, local = np.unique(t[own], return_inverse=True)
            rows.append((p, 0, pack(d_anchor=a[own], text=local.astype(np.uint16 if len(used) < 65536 else np.uint32), open=open_[own], ids=ids[used], tags=tags[used])))
        yield _rows(rows)


def _shared_blob(doc: np.ndarray, tag: np.ndarray, anchor: np.ndarray) -> bytes:
    order = np.argsort(doc, kind="stable")
    return pack(d_doc=doc[order], tag=tag[order], anchor=anchor[order])


def _answer(batches: Iterable[pa.RecordBatch], n_docs: int) -> Iterator[pa.RecordBatch]:
    """Which anchors of a bucket occur in two documents, to these documents' buckets."""
    for _, blobs in _by_part(batches):
        rows = [(kind - 1, 1, blob) for kind, blob in blobs if kind]
        sent = [unpack(blob) for kind, blob in blobs if not kind]
        if sent:
            anchor = np.concatenate([s["d_anchor"] for s in sent])
            doc = np.concatenate([s["ids"][s["text"]] for s in sent])
            tag = np.concatenate([s["tags"][s["text"]] for s in sent])
            waits = np.concatenate([s["open"] for s in sent])
            a, order = _sorted_pairs(anchor, np.arange(len(anchor)))
            d = _rank(doc, tag)[order]
            starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            shared = (np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)) | np.logical_not(np.logical_and.reduceat(waits[order], starts))
            back = order[np.repeat(shared, np.diff(np.append(starts, len(a)))) & waits[order]]
            rows += [(p, 1, _shared_blob(doc[back][own], tag[back][own], anchor[back][own])) for p, own in _split(_part_of(doc[back], tag[back], n_docs), n_docs)]
        yield _rows(rows)


def _send_texts(batches: Iterable[pa.RecordBatch], n_docs: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", PACK_BYTES):
        raw, starts, ids, tags = _keyed(part)
        size = np.diff(starts)
        rows = [(p, 0, pack(doc=ids[own], tag=tags[own], size=size[own], text=raw[ranges(starts[own], size[own])])) for p, own in _split(_part_of(ids, tags, n_docs), n_docs)]
        yield _rows(rows)


def _texts_of(blobs: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ids, tags) of a bucket's documents, in order of id and tag."""
    got = [unpack(blob) for kind, blob in blobs if kind == 0]
    if not got:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, tag, size, raw = (np.concatenate([g[c] for g in got]) for c in ("doc", "tag", "size", "text"))
    order = np.lexsort((tag, doc))
    at = np.cumsum(size) - size
    whole = np.concatenate([raw[b:e] for b, e in zip(at[order].tolist(), (at + size)[order].tolist(), strict=True)])
    return whole, np.concatenate([[0], np.cumsum(size[order])]), doc[order], tag[order]


def _number_keys(ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for (id, tag) pairs: of the sorted first list (equal pairs share one), and of the second, all of them in the first."""
    n = len(ids)
    both_ids, both_tags = np.concatenate([ids, doc]), np.concatenate([tags, tag])
    order = np.lexsort((both_tags, both_ids))
    i, t = both_ids[order], both_tags[order]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(np.concatenate([[0], (i[1:] != i[:-1]) | (t[1:] != t[:-1])])) if len(order) else 0
    return number[:n], number[n:]


def _same_text(raw: np.ndarray, start: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each fragment has the bytes of the fragment numbered ``first`` (of equal length)."""
    out = np.ones(len(start), bool)
    ask = np.flatnonzero(first != np.arange(len(start)))
    for at in range(0, len(ask), 50_000):
        own = ask[at : at + 50_000]
        differ = raw[ranges(start[own], length[own])] != raw[ranges(start[first[own]], length[own])]
        out[own] = ~np.logical_or.reduceat(differ, np.cumsum(length[own]) - length[own])
    return out


def _content(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of spans."""
    total, powers = _prefix_hash(raw)
    return _span_hash(total, powers, start, length)


def _collapse(raw: np.ndarray, anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which fragments stay, which are repeats of a first document's equal fragment); ``content`` has their hashes."""
    n = len(anchor)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((doc, content, length, anchor))
    a, s, c = anchor[order], length[order], content[order]
    fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1]) | (c[1:] != c[:-1])])
    first = np.empty(n, np.int64)
    first[order] = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    repeat = (doc > doc[first]) & _same_text(raw, start, length, first)
    return ~repeat, repeat


def _spans_blob(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Spans of a bucket's documents, overlapping and adjoining ones joined."""
    order = np.lexsort((end, start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    key = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])) << 40
    reach = np.maximum.accumulate(key + end)
    fresh = np.concatenate([[True], (key + start)[1:] > reach[:-1]])
    opens = np.flatnonzero(fresh)
    closes = np.append(opens[1:], len(doc)) - 1
    return pack(d_doc=doc[opens], tag=tag[opens], start=start[opens].astype(np.int64), size=(reach[closes] - key[closes] - start[opens]).astype(np.int64))


def _cut_fragments(batches: Iterable[pa.RecordBatch], n_fragment: int, n_docs: int, least: int, collapse: bool) -> Iterator[pa.RecordBatch]:
    """Fragments with shared anchors, to buckets by anchor; kind 0. Repeats found here pass as spans; kind 1 + bucket."""
    for _, blobs in _by_part(batches):
        raw, starts, ids, tags = _texts_of(blobs)
        answers = [unpack(blob) for kind, blob in blobs if kind == 1]
        if not answers or not len(ids):
            continue
        doc, tag, anchor = (np.concatenate([x[c] for x in answers]) for c in ("d_doc", "tag", "anchor"))
        own, asked = _number_keys(ids, tags, doc, tag)
        shared = np.sort(asked.astype(np.uint64) << _ANCHOR_BITS | anchor)
        found = []
        for at, to, (a, text, start, length) in _stepwise(raw, starts, least):
            key = own[text + at].astype(np.uint64) << _ANCHOR_BITS | a
            place = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
            hit = shared[place] == key
            content = _content(raw[starts[at] : starts[to]], start[hit], length[hit])
            found.append((a[hit], text[hit] + at, start[hit] + starts[at], length[hit], content))
        a, text, start, length, content = (np.concatenate(x) for x in zip(*found, strict=True))
        rows = []
        stay = np.ones(len(a), bool)
        if collapse:
            stay, repeat = _collapse(raw, a, _rank(ids, tags)[text], start, length, content)
            if repeat.any():
                t = text[repeat]
                s = start[repeat] - starts[t]
                blob_of = _part_of(ids[t], tags[t], n_docs)
                rows += [(p % n_fragment, 1 + p, _spans_blob(ids[t][x], tags[t][x], s[x], (s + length[repeat])[x])) for p, x in _split(blob_of, n_docs)]
        a, text, start, length = a[stay], text[stay], start[stay], length[stay]
        order = np.argsort(a, kind="stable")
        for p, x in _split((a[order] % _U(n_fragment)).astype(np.int64), n_fragment):
            x = order[x]
            t = text[x]
            used, local = np.unique(t, return_inverse=True)
            rows.append((p, 0, pack(d_anchor=a[x], text=local.astype(np.uint32), start=(start[x] - starts[t]).astype(np.uint32 if len(raw) < 2**32 else np.uint64), size=length[x].astype(np.uint32), ids=ids[used], tags=tags[used], bytes=raw[ranges(start[x], length[x])])))
        yield _rows(rows)


def suffix_array(raw: np.ndarray, at: np.ndarray, end: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that start at ``at`` and stop at ``end``, by their first ``depth``
    bytes, and the common prefix of each with the one before (0 for the first)."""
    n = len(at)
    size = np.minimum(end - at, depth)
    padded = np.concatenate([raw, np.zeros(depth, np.uint8)])
    words = np.empty((depth // 8, n), np.uint64)
    for k in range(depth // 8):
        word = np.zeros(n, np.uint64)
        for j in range(8):
            i = 8 * k + j
            word = word << _U(8) | np.where(i < size, padded[at + i], 0).astype(np.uint64)
        words[k] = word
    order = np.lexsort((size, *words[::-1]))
    common = np.zeros(n, np.int64)
    if n > 1:
        left, right = order[:-1], order[1:]
        open_ = np.ones(n - 1, bool)
        prefix = np.zeros(n - 1, np.int64)
        for k in range(depth // 8):
            differ = words[k][left] ^ words[k][right]
            prefix += np.where(open_, sum(((differ >> _U(64 - 8 * j)) == 0).astype(np.int64) for j in range(1, 9)), 0)
            open_ &= differ == 0
        common[1:] = np.minimum(prefix, np.minimum(size[left], size[right]))
    return order, common


def maximal_repeats(common: np.ndarray, left: np.ndarray, least: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, first, last) in the suffix array of each interval of the common-prefix tree
    that is at least ``least`` long and whose left neighbours differ; and of each one that
    is ``depth`` long, whatever its left: the one further left may be cut there, too, and
    so not reach as far.

    ``left`` has the byte before each suffix in suffix-array order, negative where it is
    unknown. The stack holds the open intervals: their common prefix, first suffix and
    the one left neighbour of all so far, or ``_MIXED``.
    """
    out_length, out_first, out_last = array("q"), array("q"), array("q")
    lengths, firsts, lefts = [0], [0], [_MIXED]
    lcp = np.where(common >= least, common, 0).tolist()
    lcp.append(0)
    before = left.tolist()
    for i in range(1, len(lcp)):
        now, first, value = lcp[i], i - 1, before[i - 1]
        if value < 0:
            value = _MIXED
        while now < lengths[-1]:
            length, first, held = lengths.pop(), firsts.pop(), lefts.pop()
            value = held if held == value else _MIXED
            if value == _MIXED or length >= depth:
                out_length.append(length)
                out_first.append(first)
                out_last.append(i - 1)
        if now > lengths[-1]:
            lengths.append(now)
            firsts.append(first)
            lefts.append(value)
        elif now and lefts[-1] != value:
            lefts[-1] = _MIXED
    return tuple(np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for x in (out_length, out_first, out_last))


def _in_blocks(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Intervals a bounded number of members at a time: (number of the first, members, their
    intervals' places in the block, the intervals' first members' places).

    Intervals nest, so all members together can be many times the suffixes.
    """
    many = last - first + 1
    ends = np.cumsum(many)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_MEMBERS, side="right")))
        own = many[at:to]
        yield at, ranges(first[at:to], own), np.repeat(np.arange(to - at), own), np.cumsum(own) - own
        at = to


_MIXED = -2


def _shared_windows(raw: np.ndarray, at: np.ndarray, size: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (fragment, place in ``raw``) whose hash occurs in two documents."""
    total, powers = _prefix_hash(raw)
    count = size - least + 1
    fragment = np.repeat(np.arange(len(at)), count)
    place = ranges(at, count)
    key = _span_hash(total, powers, place, least)
    order = np.argsort(key)
    k = key[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    n = np.diff(np.append(starts, len(k)))
    more = np.flatnonzero(n > 1)
    order = order[ranges(starts[more], n[more])]
    d = doc[fragment[order]]
    cuts = np.cumsum(n[more]) - n[more]
    mixed = np.minimum.reduceat(d, cuts) != np.maximum.reduceat(d, cuts) if len(cuts) else np.zeros(0, bool)
    keep = np.sort(order[np.repeat(mixed, n[more])])
    return fragment[keep], place[keep]


class _Bucket:
    """The fragments of one bucket and, once ``sort`` has run on some, their enhanced suffix array."""

    def __init__(self, sent: list[dict[str, np.ndarray]]):
        self.anchor, start, size, self.raw = (np.concatenate([s[c] for s in sent]) for c in ("d_anchor", "start", "size", "bytes"))
        self.doc = np.concatenate([s["ids"][s["text"]] for s in sent])
        self.tag = np.concatenate([s["tags"][s["text"]] for s in sent])
        self.rank = _rank(self.doc, self.tag)
        self.start, self.size = start.astype(np.int64), size.astype(np.int64)
        self.at = np.cumsum(self.size) - self.size

    def steps(self) -> Iterator[np.ndarray]:
        """Fragments by anchor, about ``SORT_BYTES`` at a time; those of one anchor stay together."""
        order = np.argsort(self.anchor, kind="stable")
        a, ends = self.anchor[order], np.cumsum(self.size[order])
        opens = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        step = (ends - self.size[order])[opens] // SORT_BYTES
        cuts = opens[np.flatnonzero(np.diff(step)) + 1]
        yield from (own for own in np.split(order, cuts) if len(own))

    def sort(self, who: np.ndarray, least: int) -> None:
        """Suffixes of shared windows among the fragments ``who``, which come by anchor, and the maximal repeats."""
        none = np.zeros(0, np.int64)
        self.source = self.begin = self.length = self.first = self.last = none
        if not len(who):
            return
        a, d = self.anchor[who], self.rank[who]
        starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        mixed = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)  # anchors left with two documents
        who = who[np.repeat(mixed, np.diff(np.append(starts, len(a))))]
        if not len(who):
            return
        n = self.size[who]
        text = self.raw[ranges(self.at[who], n)]
        own = np.cumsum(n) - n
        fragment, place = _shared_windows(text, own, n, self.rank[who], least)
        if not len(place):
            return
        order, common = suffix_array(text, place, (own + n)[fragment])
        fragment, place = fragment[order], place[order]
        left = np.where(place > own[fragment], text[np.maximum(place - 1, 0)].astype(np.int64), -1)
        self.length, self.first, self.last = maximal_repeats(common, left, least)
        self.source = who[fragment]
        self.begin = self.start[self.source] + place - own[fragment]

    def removed(self) -> tuple[np.ndarray, np.ndarray]:
        """(suffix, length): the longest repeat at each suffix that an earlier document has, too."""
        reach = np.zeros(len(self.source), np.int64)
        for at, inside, which, opens in _in_blocks(self.first, self.last):
            d = self.rank[self.source[inside]]
            later = d > np.minimum.reduceat(d, opens)[which]
            np.maximum.at(reach, inside[later], self.length[at + which[later]])
        hit = np.flatnonzero(reach)
        return hit, reach[hit]


def _find(batches: Iterable[pa.RecordBatch], n_docs: int, least: int) -> Iterator[pa.RecordBatch]:
    for _, blobs in _by_part(batches):
        rows = [(kind - 1, 1, blob) for kind, blob in blobs if kind]
        sent = [unpack(blob) for kind, blob in blobs if not kind]
        if sent:
            bucket = _Bucket(sent)
            del sent, blobs
            found = []
            for own in bucket.steps():
                at, size = bucket.at[own], bucket.size[own]
                text, inner = bucket.raw[ranges(at, size)], np.cumsum(size) - size
                stay, repeat = _collapse(text, bucket.anchor[own], bucket.rank[own], inner, size, _content(text, inner, size))
                bucket.sort(own[stay], least)
                hit, length = bucket.removed()
                found.append((own[repeat], bucket.start[own[repeat]], size[repeat]))
                found.append((bucket.source[hit], bucket.begin[hit], length))
            who, begin, size = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
            end, doc, tag = begin + size, bucket.doc[who], bucket.tag[who]
            rows += [(p, 1, _spans_blob(doc[x], tag[x], begin[x], end[x])) for p, x in _split(_part_of(doc, tag, n_docs), n_docs)]
        yield _rows(rows)


def _strip(batches: Iterable[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    """Per document: what is left of it once its spans are joined and cut."""
    for _, blobs in _by_part(batches):
        raw, starts, ids, tags = _texts_of(blobs)
        if not len(ids):
            continue
        sent = [unpack(blob) for kind, blob in blobs if kind == 1]
        row, begin, size = (np.zeros(0, np.int64) for _ in range(3))
        if sent:
            doc, tag, begin, size = (np.concatenate([s[c] for s in sent]) for c in ("d_doc", "tag", "start", "size"))
            own, asked = _number_keys(ids, tags, doc, tag)
            # Rows with equal id and text share their spans.
            first, many = np.searchsorted(own, asked), np.searchsorted(own, asked, side="right") - np.searchsorted(own, asked)
            row, begin, size = ranges(first, many), np.repeat(begin, many), np.repeat(size, many)
            order = np.argsort(row, kind="stable")
            row, begin, size = row[order], begin[order], size[order]
        at = 0
        while at < len(ids):  # texts in steps, so that the counts stay small
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + STEP_BYTES, side="right")) - 1)
            low, high = np.searchsorted(row, [at, to])
            own = slice(low, high)
            yield _left(raw[starts[at] : starts[to]], starts[at : to + 1] - starts[at], ids[at:to], tags[at:to], row[own] - at, begin[own], size[own], keep_text)
            at = to


def _left(raw: np.ndarray, starts: np.ndarray, ids: np.ndarray, tags: np.ndarray, row: np.ndarray, begin: np.ndarray, size: np.ndarray, keep_text: bool) -> pa.RecordBatch:
    """The result's rows of some documents, from spans (row, begin, size) to be cut."""
    gone = np.zeros(len(raw) + 1, np.int64)
    np.add.at(gone, begin + starts[row], 1)
    np.add.at(gone, begin + starts[row] + size, -1)
    removed = np.cumsum(gone[:-1]) > 0
    kept = raw[~removed]
    n_removed = np.diff(np.concatenate([[0], np.cumsum(removed)])[starts])
    opens = removed.copy()
    opens[1:] &= ~removed[:-1]
    opens[starts[:-1][np.diff(starts) > 0]] = removed[starts[:-1][np.diff(starts) > 0]]
    n_spans = np.diff(np.concatenate([[0], np.cumsum(opens)])[starts])
    cuts = starts - np.concatenate([[0], np.cumsum(n_removed)])
    texts = [kept[cuts[i] : cuts[i + 1]].tobytes() for i in range(len(ids))]
    columns = [pa.array(ids, pa.int64(), mask=(tags & 1).astype(bool)), pa.array(np.diff(starts)), pa.array(n_removed), pa.array(n_spans)]
    last = pa.array(texts, pa.binary()) if keep_text else pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
    return pa.RecordBatch.from_arrays([*columns, last], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if keep_text else "kept_sha256"])


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part", "kind")


class _Plan:
    """The steps over one table, with as many buckets as its texts need."""

    def __init__(self, docs: DataFrame, least: int):
        text, known = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
        tag = F.xxhash64(text).bitwiseAND(F.lit(-2)) + F.when(known.isNull(), 1).otherwise(0)
        self.docs = docs.select(F.coalesce(known, F.xxhash64(F.lit("row"), text)).alias("doc_id"), tag.alias("tag"), text.alias("text"))
        size = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.size, self.least = size, least
        self.n_anchor = int(size // ANCHOR_BUCKET) + 1
        self.n_docs = self.n_fragment = bucket_count(size)

    def texts(self) -> DataFrame:
        n = self.n_docs
        return self.docs.mapInArrow(lambda it: _send_texts(it, n), ROW)

    def fragments(self, collapse: bool) -> DataFrame:
        na, nf, nd, least = self.n_anchor, self.n_fragment, self.n_docs, self.least
        sent = self.docs.mapInArrow(lambda it: _send_anchors(it, na, nd, least), ROW)
        shared = _dealt(sent).mapInArrow(lambda it: _answer(it, nd), ROW)
        return _dealt(_dealt(self.texts().unionByName(shared)).mapInArrow(lambda it: _cut_fragments(it, nf, nd, least, collapse), ROW))


def remove_repeats(docs: DataFrame, least: int = LEAST, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (bytes; or ``kept_sha256``) of every row.

    Removed is every byte covered by a string of ``least`` bytes that also starts in a
    document with a smaller doc_id.
    """
    plan = _Plan(docs, least)
    nd = plan.n_docs
    spans = plan.fragments(True).mapInArrow(lambda it: _find(it, nd, least), ROW)
    last = "kept binary" if keep_text else "kept_sha256 string"
    return _dealt(plan.texts().unionByName(spans)).mapInArrow(lambda it: _strip(it, keep_text), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")
