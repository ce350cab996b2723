"""Media columns: progressive JPEG encoding and decoding, many images at a time.

Decoding follows the progressive mode: every scan adds to the coefficient arrays,
by spectral selection (bands of coefficients) and successive approximation (first
their high bits, then one bit more per refinement). When all scans are in, the
coefficients are dequantised and inverse-transformed in numpy, chroma is upsampled
and full-resolution RGB tensors come out.

Entropy-coded data can only be read bit by bit, but restart intervals can be read
side by side: all intervals of all images of a batch are lanes, and one numpy step
reads the next symbol of every lane.

``encode_payloads`` stores bytes losslessly in the format's own unit, the quantised
coefficients: each byte plus 2 is one coefficient, in zigzag order, six blocks (four
of luma, one of each chroma) to a unit of 16 x 16 pixels. The transform is exact
integer arithmetic (in doubles), so equal bytes give equal tensors in any batch.

Edge cases: a null text is empty and stored as 576 padding bytes; null media and media
that can't be read give a null payload, tensor and feature, whatever stands beside them;
an image that holds no payload gives a null payload and its tensor; a very long text is
one image; repeated rows are stored alike; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, slices, text_bytes

UNIT = 576
PAD = 255
#: What a stored byte's coefficient lies above it: so none has a zero high part.
LIFT = 2
#: Stored in blocks behind the payload, up to the image's edge.
FILL = 64
STEP_BYTES = 3_000_000
#: Restart intervals: units of the scans with all components, blocks of the others.
MCU_INTERVAL, BLOCK_INTERVAL = 16, 8
#: (component, row, column) of the blocks of a unit.
SLOTS = ((0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (2, 0, 0))


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Natural position (row * 8 + column) of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


@lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    """The transform's basis, rounded to multiples of 2^-13."""
    u, x = np.mgrid[0:8, 0:8]
    return np.round(8192 * np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16))


# Huffman tables

#: Code lengths of the symbols that this encoder writes.
DC_LENGTHS = {0: 2, 1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 4, 7: 5, 8: 6, 9: 7}
AC_LENGTHS = {0x06: 1, 0x05: 2, 0x07: 3, 0x04: 5, 0x08: 5, 0x03: 6, 0x30: 6, 0x00: 8, 0x01: 8, 0x02: 8, 0x10: 8, 0x20: 8, 0xF0: 8}


def _segment(lengths: dict[int, int], kind: int) -> bytes:
    """A table as DHT holds it: how many codes have each length, then the symbols."""
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    return bytes([kind]) + counts + bytes(sorted(lengths, key=lambda s: (lengths[s], s)))


def _codes(table: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) from a table's counts and symbols."""
    out, code, at = [], 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out.append((table[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(maxsize=64)
def _lookup(table: bytes) -> np.ndarray:
    """For each next 16 bits: code length * 256 + symbol; 0 where there is no code."""
    out = np.zeros(65536, np.int32)
    for symbol, code, length in _codes(table):
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out


def _by_symbol(lengths: dict[int, int], kind: int) -> tuple[np.ndarray, np.ndarray]:
    codes, sizes = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for symbol, code, length in _codes(_segment(lengths, kind)[1:]):
        codes[symbol], sizes[symbol] = code, length
    return codes, sizes


# Encoding


def _geometry(n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units across and down of an image for each payload."""
    units = -(-(n_bytes // 64) // 6)
    across = np.ceil(np.sqrt(units)).astype(np.int64)
    return across, -(-units // across)


def _size_of(values: np.ndarray) -> np.ndarray:
    """Bits of each magnitude."""
    return np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)


def _amplitude(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.where(values < 0, values + (1 << sizes) - 1, values)


def _pack(values: np.ndarray, lengths: np.ndarray, counts: np.ndarray, number: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit strings to bytes: ``counts`` of them to a restart interval, filled up with ones,
    0xFF stuffed, and a restart marker behind each interval but the ``last`` of a scan.

    ``number`` is the interval's place in its scan. Returns the bytes and the intervals' ends.
    """
    ends = np.cumsum(lengths)
    stops = np.cumsum(counts)
    bits = np.diff(np.concatenate([[0], ends[stops - 1]]))
    n_bytes = (bits + 7) >> 3
    base = np.cumsum(n_bytes) - n_bytes
    shift = np.repeat(base * 8 - np.concatenate([[0], ends[stops - 1]])[:-1], counts)
    at = ends - lengths + shift
    window = values << (32 - (at & 7) - lengths)
    total = int(n_bytes.sum())
    out = np.zeros(total + 4, np.int64)
    for k in range(4):
        out += np.bincount((at >> 3) + k, weights=(window >> (24 - 8 * k)) & 255, minlength=total + 4).astype(np.int64)
    out = out[:total].astype(np.uint8)
    out[base + n_bytes - 1] |= ((1 << (n_bytes * 8 - bits)) - 1).astype(np.uint8)
    full = np.flatnonzero(out == 255)
    close = base + n_bytes
    marked = np.flatnonzero(~last)
    places = np.concatenate([full + 1, np.repeat(close[marked], 2)])
    added = np.concatenate([np.zeros(len(full), np.uint8), np.stack([np.full(len(marked), 255), 0xD0 + number[marked] % 8], 1).ravel().astype(np.uint8)])
    order = np.argsort(places, kind="stable")
    before = np.searchsorted(full + 1, close, side="right") + 2 * np.cumsum(~last)
    return np.insert(out, places[order], added[order]), close + before


def _intervals(n: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the restart intervals of scans with ``n`` items each, their numbers, and which end a scan."""
    many = -(-n // step)
    number = ranges(np.zeros(len(n), np.int64), many)
    last = np.zeros(len(number), bool)
    last[np.cumsum(many) - 1] = True
    return np.minimum(step, np.repeat(n, many) - number * step), number, last


def _sos(components: list[int], first: int, last: int, high: int, low: int) -> bytes:
    body = bytes([len(components)]) + b"".join(bytes([c + 1, 0]) for c in components) + bytes([first, last, high << 4 | low])
    return b"\xff\xda" + struct.pack(">H", len(body) + 2) + body


def _dri(n: int) -> bytes:
    return b"\xff\xdd" + struct.pack(">HH", 4, n)


def _raster(across: np.ndarray, down: np.ndarray, component: int) -> np.ndarray:
    """Numbers (in unit order, six to a unit) of a component's blocks in raster order, for all images."""
    units = across * down
    base = 6 * np.repeat(np.cumsum(units) - units, units * (4 if component == 0 else 1))
    if component:
        return base + 6 * ranges(np.zeros(len(units), np.int64), units) + 3 + component
    i = ranges(np.zeros(len(units), np.int64), units * 4)
    wide = np.repeat(2 * across, units * 4)
    row, column = i // wide, i % wide
    return base + 6 * ((row >> 1) * (wide >> 1) + (column >> 1)) + 2 * (row & 1) + (column & 1)


def encode_payloads(data: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """One progressive JPEG per payload; sizes must be positive multiples of 64."""
    sizes = np.diff(starts)
    across, down = _geometry(sizes)
    units = across * down
    unit_starts = np.cumsum(units) - units
    stored = np.full(int(units.sum()) * 384, FILL, np.uint8)
    stored[ranges(unit_starts * 384, sizes)] = data
    blocks = stored.reshape(-1, 64).astype(np.int64) + LIFT
    high = blocks >> 1
    scans: list[tuple[bytes, np.ndarray, np.ndarray]] = []

    # DC, high bits: differences within each component and interval, six to a unit.
    counts, number, last = _intervals(units, MCU_INTERVAL)
    opens = np.cumsum(counts) - counts
    dc = high[:, 0].reshape(-1, 6)
    diff = dc.copy()
    diff[:, 1:4] -= dc[:, 0:3]
    diff[1:, 0] -= dc[:-1, 3]
    diff[1:, 4:] -= dc[:-1, 4:]
    diff[opens[:, None], [0, 4, 5]] = dc[opens[:, None], [0, 4, 5]]
    diff = diff.ravel()
    codes, lengths = _by_symbol(DC_LENGTHS, 0)
    bits = _size_of(diff)
    packed, ends = _pack(codes[bits] << bits | _amplitude(diff, bits), lengths[bits] + bits, counts * 6, number, last)
    scans.append((_dri(MCU_INTERVAL) + _sos([0, 1, 2], 0, 0, 0, 1), packed, np.concatenate([[0], ends[last]])))

    # AC, high bits: no coefficient is zero, so every symbol has run 0.
    codes, lengths = _by_symbol(AC_LENGTHS, 0x10)
    for component, first, final in ((0, 1, 5), (1, 1, 63), (2, 1, 63), (0, 6, 63)):
        n = units * (4 if component == 0 else 1)
        counts, number, last = _intervals(n, BLOCK_INTERVAL)
        values = high[_raster(across, down, component), first : final + 1].ravel()
        bits = _size_of(values)
        packed, ends = _pack(codes[bits] << bits | values, lengths[bits] + bits, counts * (final - first + 1), number, last)
        scans.append((_dri(BLOCK_INTERVAL) + _sos([component], first, final, 0, 1), packed, np.concatenate([[0], ends[last]])))

    # Low bits: DC one bit a block; AC one end-of-band run an interval, then its correction bits.
    counts, number, last = _intervals(units, MCU_INTERVAL)
    packed, ends = _pack(blocks[:, 0] & 1, np.ones(len(blocks), np.int64), counts * 6, number, last)
    scans.append((_dri(MCU_INTERVAL) + _sos([0, 1, 2], 0, 0, 1, 0), packed, np.concatenate([[0], ends[last]])))
    for component in range(3):
        n = units * (4 if component == 0 else 1)
        counts, number, last = _intervals(n, BLOCK_INTERVAL)
        low = (blocks[_raster(across, down, component), 1:] & 1).reshape(-1, 7, 9) @ (1 << np.arange(8, -1, -1))
        exponent = _size_of(counts) - 1
        symbol = exponent << 4
        run = codes[symbol] << exponent | (counts - (1 << exponent))
        where = np.cumsum(counts * 7) - counts * 7
        values = np.insert(low.ravel(), where, run)
        widths = np.insert(np.full(low.size, 9), where, lengths[symbol] + exponent)
        packed, ends = _pack(values, widths, counts * 7 + 1, number, last)
        scans.append((_dri(BLOCK_INTERVAL) + _sos([component], 1, 63, 1, 0), packed, np.concatenate([[0], ends[last]])))

    tables = _segment(DC_LENGTHS, 0) + _segment(AC_LENGTHS, 0x10)
    fixed = b"\xff\xdb" + struct.pack(">H", 67) + b"\0" + b"\1" * 64 + b"\xff\xc4" + struct.pack(">H", len(tables) + 2) + tables
    views = [(head, body.tobytes(), cut.tolist()) for head, body, cut in scans]
    out = []
    for i, (size, wide, high_) in enumerate(zip(sizes.tolist(), across.tolist(), down.tolist(), strict=True)):
        frame = struct.pack(">HBHHB", 17, 8, high_ * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        comment = b"\xff\xfe" + struct.pack(">HQ", 10, size)
        out.append(b"\xff\xd8" + comment + fixed + b"\xff\xc2" + frame + b"".join(part for head, body, cut in views for part in (head, body[cut[i] : cut[i + 1]])) + b"\xff\xd9")
    return out


# Decoding


@dataclass
class Component:
    number: int
    across: int  # sampling factors
    down: int
    table: int
    wide: int = 0  # blocks that the image's own area has
    high: int = 0
    stride: int = 0  # blocks stored in a row, up to whole units
    rows: int = 0
    base: int = 0  # first block in the batch's coefficient array


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    units_across: int
    units_down: int
    quant: dict[int, np.ndarray]
    payload: int | None


_NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _parse(view: bytes, block: int) -> tuple[Image, list[tuple], int]:
    """An image's frame and its scans; ``block`` is its first block in the coefficient array.

    A scan is (kind, components, first, last, low, tables, interval, start, stop).
    """
    if view[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at = 2
    quant: dict[int, np.ndarray] = {}
    huffman: dict[int, bytes] = {}
    image, interval, payload, scans = None, 0, None, []
    while True:
        while view[at + 1] == 0xFF:
            at += 1
        marker = view[at + 1]
        if marker == 0xD9:
            break
        size = view[at + 2] << 8 | view[at + 3]
        body, at = view[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, n = body[0] >> 4, 64 * (1 + (body[0] >> 4))
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                huffman[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xC2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            most_x, most_y = max(c.across for c in parts), max(c.down for c in parts)
            ux, uy = -(-width // (8 * most_x)), -(-height // (8 * most_y))
            for c in parts:
                c.wide, c.high = -(-(-(-width * c.across // most_x)) // 8), -(-(-(-height * c.down // most_y)) // 8)
                c.stride, c.rows, c.base = ux * c.across, uy * c.down, block
                block += c.stride * c.rows
            image = Image(width, height, parts, ux, uy, quant, payload)
        elif marker == 0xDD:
            interval = body[0] << 8 | body[1]
        elif marker == 0xFE and len(body) == 8:
            payload = struct.unpack(">Q", body)[0]
            if image:
                image.payload = payload
        elif marker == 0xDA:
            if image is None:
                raise ValueError("scan before a progressive frame")
            n = body[0]
            own = [next(c for c in image.components if c.number == body[1 + 2 * i]) for i in range(n)]
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            tables = [huffman.get((body[2 + 2 * i] >> 4) if first == 0 else 0x10 | (body[2 + 2 * i] & 15), b"") for i in range(n)]
            found = _NEXT_MARKER.search(view, at)
            stop = found.start() if found else len(view)
            scans.append(((first > 0) * 2 + (bits >> 4 > 0), own, first, last, bits & 15, tables, interval, at, stop))
            at = stop
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only progressive Huffman frames are decoded")
    if image is None:
        raise ValueError("no frame")
    return image, scans, block


class _Bits:
    """Unstuffed data of a batch, read at any bit positions."""

    def __init__(self, data: np.ndarray):
        keep = np.ones(len(data), bool)
        keep[1:] = ~((data[:-1] == 255) & (data[1:] == 0))
        clean = np.concatenate([data[keep], np.full(8, 255, np.uint8)]).astype(np.uint32)
        self.place = np.concatenate([[0], np.cumsum(keep)])  # of a byte of the given data
        self.window = clean[:-4] << 24 | clean[1:-3] << 16 | clean[2:-2] << 8 | clean[3:-1]

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 16 bits."""
        return ((self.window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(16)).astype(np.int64)


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)


def _lanes_of(scans: list[tuple], restarts: np.ndarray, place: np.ndarray, images: list[Image]) -> dict[int, dict[str, np.ndarray]]:
    """The restart intervals of all scans by kind (DC first, DC refined, AC first, AC refined)."""
    tables: dict[bytes, int] = {}
    groups: dict[int, list[tuple]] = {0: [], 1: [], 2: [], 3: []}
    cuts_from = np.searchsorted(restarts, [s[7] for _, s in scans])
    cuts_to = np.searchsorted(restarts, [s[8] for _, s in scans])
    for (image, (kind, own, first, last, low, used, interval, start, stop)), a, b in zip(scans, cuts_from.tolist(), cuts_to.tolist(), strict=True):
        alone = len(own) == 1
        total = own[0].wide * own[0].high if alone else images[image].units_across * images[image].units_down
        opens = [start, *(restarts[a:b] + 2).tolist()]
        numbers = [tables.setdefault(t, len(tables)) for t in used]
        for k, at in enumerate(opens):
            begin = k * interval if interval else 0
            count = min(interval, total - begin) if interval else total
            if count > 0:
                groups[kind].append((image, own, first, last, low, numbers, at, begin, count))
    out: dict[int, dict[str, np.ndarray]] = {"tables": tables}  # type: ignore[dict-item]
    for kind, rows in groups.items():
        if not rows:
            continue
        lane = {"at": place[np.array([r[6] for r in rows])] * 8, "low": np.array([r[4] for r in rows]), "begin": np.array([r[7] for r in rows]), "count": np.array([r[8] for r in rows])}
        if kind >= 2:
            one = [r[1][0] for r in rows]
            lane |= {"first": np.array([r[2] for r in rows]), "last": np.array([r[3] for r in rows]), "table": np.array([r[5][0] for r in rows]), "wide": np.array([c.wide for c in one]), "stride": np.array([c.stride for c in one]), "base": np.array([c.base for c in one])}
        else:
            lane["rows"] = rows  # type: ignore[assignment]
        out[kind] = lane
    return out


def _read_dc(lane: dict, look: np.ndarray, bits: _Bits, coef: np.ndarray, refine: bool, images: list[Image]) -> None:
    """Scans of the first coefficient; a lane's blocks go unit by unit through the components."""
    layouts: dict[tuple, int] = {}
    slots: list[list[tuple]] = []
    layout = []
    for r in lane["rows"]:
        key = tuple((c.across, c.down) for c in r[1]) if len(r[1]) > 1 else ((1, 1),)
        if key not in layouts:
            layouts[key] = len(slots)
            slots.append([(i, dy, dx) for i, (h, v) in enumerate(key) for dy in range(v) for dx in range(h)])
        layout.append(layouts[key])
    layout = np.array(layout)
    for kind, cells in enumerate(slots):
        own = np.flatnonzero(layout == kind)
        parts = [lane["rows"][i][1] for i in own]
        n = len(parts[0])
        alone = n == 1
        column = lambda f: np.array([[f(c) for c in p] for p in parts])  # noqa: E731, B023
        base, stride = column(lambda c: c.base), column(lambda c: c.stride)
        h, v = column(lambda c: 1 if alone else c.across), column(lambda c: 1 if alone else c.down)  # noqa: B023
        wide = np.array([p[0].wide if alone else images[lane["rows"][i][0]].units_across for i, p in zip(own, parts, strict=True)])
        table = np.array([lane["rows"][i][5] for i in own])
        at, low, unit = lane["at"][own].copy(), lane["low"][own], lane["begin"][own].copy()
        left = lane["count"][own].copy()
        before = np.zeros((len(own), n), np.int64)
        live = np.arange(len(own))
        while len(live):
            for c, dy, dx in cells:
                u = unit[live]
                block = base[live, c] + (u // wide[live] * v[live, c] + dy) * stride[live, c] + u % wide[live] * h[live, c] + dx
                if refine:
                    coef[block, 0] |= (bits.peek(at[live]) >> 15) << low[live]
                    at[live] += 1
                    continue
                found = look[table[live, c], bits.peek(at[live])]
                size = (found & 15).astype(np.int64)
                a = at[live] + (found >> 8)
                before[live, c] += _extend(bits.peek(a) >> (16 - size), size)
                coef[block, 0] = before[live, c] << low[live]
                at[live] = a + size
            unit[live] += 1
            left[live] -= 1
            live = live[left[live] > 0]


def _block(lane: dict, item: np.ndarray) -> np.ndarray:
    return lane["base"] + item // lane["wide"] * lane["stride"] + item % lane["wide"]


def _thin(lane: dict, state: list[np.ndarray], keep: np.ndarray) -> tuple[dict, list[np.ndarray]]:
    return {k: v[keep] for k, v in lane.items()}, [s[keep] for s in state]


def _read_ac(lane: dict, look: np.ndarray, bits: _Bits, coef: np.ndarray) -> None:
    """First scans of a band: one symbol of every lane at a time."""
    flat = coef.ravel()
    at, item, k = lane["at"].copy(), lane["begin"].copy(), lane["first"].copy()
    stop = lane["begin"] + lane["count"]
    block = _block(lane, item)
    while len(at):
        found = look[lane["table"], bits.peek(at)]
        at += found >> 8
        size, run = (found & 15).astype(np.int64), (found >> 4 & 15).astype(np.int64)
        value = bits.peek(at)
        empty = size == 0
        over = None
        if empty.any():
            ends = empty & (run < 15)
            k += np.where(empty & ~ends, 16, np.where(empty, 0, run))
            more = np.where(ends, (1 << run) - 1 + np.where(run > 0, value >> (16 - np.minimum(run, 15)), 0), 0)
            at += np.where(ends, run, size)
            put = np.flatnonzero(~empty)
            over = ends, more
        else:
            k += run
            at += size
            put = slice(None)
        flat[block[put] * 64 + k[put]] = _extend(value[put] >> (16 - size[put]), size[put]) << lane["low"][put]
        k[put] += 1
        done = k > lane["last"]
        if over is not None:
            done |= over[0]
        if done.any():
            item += done
            if over is not None:
                item += over[1]
            k = np.where(done, lane["first"], k)
            alive = item < stop
            if not alive.all():
                lane, (at, item, k, stop) = _thin(lane, [at, item, k, stop], alive)
            block = _block(lane, item)


def _refine_ac(lane: dict, look: np.ndarray, bits: _Bits, coef: np.ndarray) -> None:
    """Refinement scans of a band: one coefficient of every lane at a time.

    A lane is at a symbol (0), passing zeros up to a new coefficient (1), or in an
    end-of-band run (2), where only correction bits come.
    """
    flat = coef.ravel()
    at, item, k = lane["at"].copy(), lane["begin"].copy(), lane["first"].copy()
    stop = lane["begin"] + lane["count"]
    mode, zeros, fresh, run_left = (np.zeros(len(at), np.int64) for _ in range(4))
    block = _block(lane, item)
    while len(at):
        ask = np.flatnonzero(mode == 0)
        if len(ask):
            found = look[lane["table"][ask], bits.peek(at[ask])]
            a = at[ask] + (found >> 8)
            size, run = (found & 15).astype(np.int64), (found >> 4 & 15).astype(np.int64)
            value = bits.peek(a)
            ends = (size == 0) & (run < 15)
            run_left[ask] = np.where(ends, (1 << run) + np.where(run > 0, value >> (16 - np.minimum(run, 15)), 0), 0)
            fresh[ask] = np.where(size > 0, np.where(value >> 15 == 1, 1, -1), 0) << lane["low"][ask]
            at[ask] = a + np.where(ends, run, size)
            zeros[ask] = run
            mode[ask] = np.where(ends, 2, 1)
        where = block * 64 + k
        now = flat[where]
        old = now != 0
        bit = (bits.peek(at) >> 15) & old
        step = bit << lane["low"]
        flat[where] = np.where((np.abs(now) & step) == 0, now + np.sign(now) * step, now)
        at += old
        passing = np.flatnonzero(~old & (mode == 1))
        if len(passing):
            reached = passing[zeros[passing] == 0]
            flat[where[reached]] = fresh[reached]
            zeros[passing] -= 1
            mode[reached] = 0
        k += 1
        done = k > lane["last"]
        if done.any():
            item += done
            k = np.where(done, lane["first"], k)
            run_left -= done & (mode == 2)
            mode = np.where(done & ((mode == 1) | (run_left <= 0)), 0, mode)
            alive = item < stop
            if not alive.all():
                lane, (at, item, k, stop, mode, zeros, fresh, run_left) = _thin(lane, [at, item, k, stop, mode, zeros, fresh, run_left], alive)
            block = _block(lane, item)


def read_coefficients(media: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """The images' frames and all their coefficients, a row of 64 in zigzag order per block."""
    view = b"".join(media)
    images, scans, block, at = [], [], 0, 0
    for blob in media:
        image, own, block = _parse(blob, block)
        own = [(*s[:7], s[7] + at, s[8] + at) for s in own]
        scans += [(len(images), s) for s in own]
        images.append(image)
        at += len(blob)
    data = np.frombuffer(view, np.uint8)
    restarts = np.flatnonzero((data[:-1] == 255) & (data[1:] >= 0xD0) & (data[1:] <= 0xD7))
    bits = _Bits(data)
    # Progressive scans build on each other, first parts before refinements.
    coef = np.zeros((block, 64), np.int64)
    for level in sorted({s[4] for _, s in scans}, reverse=True) if scans else []:
        lanes = _lanes_of([x for x in scans if x[1][4] == level], restarts, bits.place, images)
        look = np.stack([_lookup(t) if t else np.zeros(65536, np.int32) for t in lanes.pop("tables")])  # type: ignore[call-overload]
        for kind, lane in sorted(lanes.items()):
            if kind < 2:
                _read_dc(lane, look, bits, coef, kind == 1, images)
            elif kind == 2:
                _read_ac(lane, look, bits, coef)
            else:
                _refine_ac(lane, look, bits, coef)
    return images, coef


def read_payloads(images: list[Image], coef: np.ndarray) -> list[bytes]:
    """The bytes that ``encode_payloads`` stored."""
    across, down = np.array([i.units_across for i in images]), np.array([i.units_down for i in images])
    order = np.empty(len(coef), np.int64)  # where each block, in unit order, stands in the array
    units = across * down
    starts = 6 * (np.cumsum(units) - units)
    for component in range(3):
        many = units * (4 if component == 0 else 1)
        own = ranges(starts + (0, 4, 5)[component] * units, many)
        order[_raster(across, down, component)] = own
    raw = (coef[order] - LIFT).astype(np.uint8).tobytes()
    return [raw[64 * s : 64 * s + (i.payload or 0)] for s, i in zip(starts.tolist(), images, strict=True)]


def tensors(images: list[Image], coef: np.ndarray) -> list[np.ndarray]:
    """Full-resolution RGB of each image, height x width x 3."""
    basis, natural = _basis(), zigzag()
    pixels = np.empty((len(coef), 8, 8), np.uint8)
    for image in images:  # dequantise; tables of ones leave the coefficients as they are
        for c in image.components:
            table = image.quant[c.table]
            if (table != 1).any():
                coef[c.base : c.base + c.stride * c.rows] *= table
    for at in range(0, len(coef), 8192):
        part = np.empty((len(coef[at : at + 8192]), 64))
        part[:, natural] = coef[at : at + 8192]
        rows = (part.reshape(-1, 8) @ basis).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ basis
        exact = np.floor((rows + 2.0**25) / 2.0**26) + 128
        pixels[at : at + 8192] = np.clip(exact, 0, 255).astype(np.uint8).reshape(-1, 8, 8).transpose(0, 2, 1)
    out = []
    for image in images:
        most_x, most_y = max(c.across for c in image.components), max(c.down for c in image.components)
        planes = []
        for c in image.components:
            plane = pixels[c.base : c.base + c.stride * c.rows].reshape(c.rows, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.stride * 8)
            planes.append(plane.repeat(most_y // c.down, 0).repeat(most_x // c.across, 1)[: image.height, : image.width].astype(np.int32))
        if len(planes) == 1:
            out.append(np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, 2))
            continue
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        # The usual conversion, in units of 2^-16.
        rgb = np.empty((*y.shape, 3), np.uint8)
        rgb[..., 0] = np.clip(y + ((91881 * cr + 32768) >> 16), 0, 255)
        rgb[..., 1] = np.clip(y - ((22554 * cb + 46802 * cr + 32768) >> 16), 0, 255)
        rgb[..., 2] = np.clip(y + ((116130 * cb + 32768) >> 16), 0, 255)
        out.append(rgb)
    return out


def feature(rgb: np.ndarray) -> str:
    """Size, channel sums and checksum of a tensor."""
    red, green, blue = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()
    return f"{rgb.shape[0]}x{rgb.shape[1]}:{red}:{green}:{blue}:{zlib.crc32(rgb.tobytes()):08x}"


# Columns


def _padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, each filled up to a positive multiple of the unit; their starts; the unpadded sizes."""
    raw, starts = text_bytes(texts)
    n = np.diff(starts)
    size = np.maximum(-(-n // UNIT), 1) * UNIT
    out_starts = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(out_starts[-1]), PAD, np.uint8)
    out[ranges(out_starts[:-1], n)] = raw
    return out, out_starts, n


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as a progressive JPEG."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", STEP_BYTES):
            data, starts, n = _padded(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(encode_payloads(data, starts), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _readable(blob: bytes) -> bool:
    """Whether an image's markers can be walked and its frame and scans decoded."""
    try:
        image, scans, _ = _parse(blob, 0)
    except (ValueError, IndexError, KeyError, StopIteration, struct.error, ZeroDivisionError):
        return False
    tables = all(t for _, _, _, _, _, used, *_ in scans for t in used if t is not None) or not scans
    return bool(image.width and image.height and image.components) and len(image.components) in (1, 3) and tables and all(c.table in image.quant for c in image.components)


def _decoded(media: pa.Array) -> Iterator[tuple[int, bytes | None, np.ndarray]]:
    """(row, payload, tensor) of each image that can be read; the payload is null where the image holds none.

    A batch is read side by side. What can't be read is left out; should a stream break
    within its scans, the batch's images are read one by one.
    """
    present = [i for i, ok in enumerate(media.is_valid().to_pylist()) if ok]
    blobs = {i: media[i].as_py() for i in present}
    good = [i for i in present if _readable(blobs[i])]
    if not good:
        return
    try:
        images, coef = read_coefficients([blobs[i] for i in good])
    except (ValueError, IndexError, KeyError):
        if len(good) > 1:
            for i in good:
                for _, payload, rgb in _decoded(media.slice(i, 1)):
                    yield i, payload, rgb
        return
    payloads: list[bytes | None] = [None] * len(images)
    own = [k for k, image in enumerate(images) if _stored_here(image)]
    if len(own) == len(images):
        payloads = list(read_payloads(images, coef))
    else:
        for k in own:
            one, part = read_coefficients([blobs[good[k]]])
            payloads[k] = read_payloads(one, part)[0]
    yield from zip(good, payloads, tensors(images, coef), strict=True)


def _stored_here(image: Image) -> bool:
    """Whether an image has the layout that ``encode_payloads`` gives."""
    return image.payload is not None and [(c.across, c.down) for c in image.components] == [(2, 2), (1, 1), (1, 1)]


def load(stored: DataFrame) -> DataFrame:
    """doc_id, payload, height, width, rgb (row-major bytes) and feature, decoded from ``media``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", STEP_BYTES):
            rows: list[tuple] = [(None,) * 5] * part.num_rows
            for i, payload, rgb in _decoded(part.column("media")):
                rows[i] = (payload, rgb.shape[0], rgb.shape[1], rgb.tobytes(), feature(rgb))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True))], ["doc_id", "payload", "height", "width", "rgb", "feature"])

    return stored.select("doc_id", "media").mapInArrow(run, "doc_id long, payload binary, height int, width int, rgb binary, feature string")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(stored: DataFrame) -> DataFrame:
    """Digests of ``media`` and of what is read back from it; the tensors stay in the worker."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", STEP_BYTES):
            rows: list[tuple] = [(None,) * 6] * part.num_rows
            for i, payload, rgb in _decoded(part.column("media")):
                blob = part.column("media")[i].as_py()
                read = (None,) * 3 if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
                rows[i] = (*read, len(blob), hashlib.sha256(blob).hexdigest(), feature(rgb))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [c.split()[0] for c in DIGEST.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST)
