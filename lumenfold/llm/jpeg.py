"""Baseline JPEG media columns: write payloads losslessly as quantised coefficients, parse and Huffman-decode scans, and
take luminance thumbnails from the DC coefficients alone.

The unit of the format is the quantised coefficient. A payload of 64 k bytes becomes k blocks of a grey image with
unit quantisation, byte - 128 a coefficient in zigzag order; a comment segment has the payload's length, and restart
markers stand after every few blocks. The decoder reads any baseline image (SOF0/SOF1, 8 bits, interleaved scan,
sampling factors, restart intervals): all intervals of all images that share tables advance together, one symbol a
step, as numpy arrays.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenfold.llm.common import lean, ship, spans, utf8

RESTART = 4
#: Bytes encoded or decoded at once: more of them make longer arrays and fewer steps.
CHUNK = 2 << 20
COMMENT = b"payload "


def own_tables() -> tuple[dict[int, int], dict[int, int]]:
    """Symbol -> code length of the tables we write. DC: sizes 0 to 11, 4 bits each. AC: a run of no zero takes 4 bits, end of
    block and sixteen zeros 5, any other run 10."""
    ac = {s: 4 for s in range(1, 9)} | {0x00: 5, 0xF0: 5} | {r << 4 | s: 10 for r in range(1, 16) for s in range(1, 9)}
    return dict.fromkeys(range(12), 4), ac


def canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The segment's sixteen counts and symbols, and symbol -> (code, length)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)) + bytes(order), codes


def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits that may come next: code length << 8 | symbol; 0 where no code fits."""
    table, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for n, many in enumerate(counts, 1):
        for s in symbols[at : at + many]:
            table[code << 16 - n : code + 1 << 16 - n] = n << 8 | s
            code += 1
        at += many
        code <<= 1
    return table


(_DC_BYTES, _DC_CODES), (_AC_BYTES, _AC_CODES) = map(canonical, own_tables())
_SIZE = np.array([int(abs(v)).bit_length() for v in range(1024)], np.int64)


def _codes(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, k) in codes.items():
        code[s], n[s] = c, k
    return code, n


_DC, _AC = _codes(_DC_CODES), _codes(_AC_CODES)


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def header(blocks_wide: int, blocks_high: int, payload: int) -> bytes:
    frame = b"\x08" + (8 * blocks_high).to_bytes(2, "big") + (8 * blocks_wide).to_bytes(2, "big") + b"\x01\x01\x11\x00"
    return b"\xff\xd8" + segment(0xFE, COMMENT + str(payload).encode()) + segment(0xDB, b"\x00" + b"\x01" * 64) + segment(0xC0, frame) + segment(0xC4, b"\x00" + _DC_BYTES) + segment(0xC4, b"\x10" + _AC_BYTES) + segment(0xDD, RESTART.to_bytes(2, "big")) + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def entropy(coefficients: np.ndarray, interval: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Huffman-coded bytes of (blocks, 64) coefficients and the end of each interval in them. ``interval``: the intervals'
    numbers of the blocks, ascending. Each interval starts with a DC prediction of 0 and is padded to whole bytes."""
    blocks = len(coefficients)
    value = coefficients.astype(np.int64)
    new = np.r_[True, interval[1:] != interval[:-1]]
    value[1:, 0] -= np.where(new[1:], 0, coefficients[:-1, 0])
    flat = value.reshape(-1)
    column = np.tile(np.arange(64), blocks)
    at = np.flatnonzero((flat != 0) | (column == 0))
    run = np.diff(at, prepend=-1) - 1
    run[column[at] == 0] = 0  # zeros before a block's end are its end-of-block code
    v = flat[at]
    size = _SIZE[np.abs(v)]
    bits = np.where(v < 0, v + (1 << size) - 1, v)
    symbol = (run & 15) << 4 | size
    dc = column[at] == 0
    code = np.where(dc, _DC[0][size], _AC[0][symbol])
    length = np.where(dc, _DC[1][size], _AC[1][symbol])
    zeros = run >> 4  # codes for sixteen zeros that come first
    word, n = code << size | bits, length + size
    owner = at >> 6
    last = np.r_[dc[1:], True]  # last code of its block
    end = last & (column[at] != 63)
    extra, k = np.flatnonzero((zeros > 0) | end), zeros + end + 1
    if len(extra):  # put the codes for zeros before, that for a block's end behind
        place = np.cumsum(k) - k
        total = int(k.sum())
        words, ns, owners = np.zeros(total, np.int64), np.zeros(total, np.int64), np.repeat(owner, k)
        words[:], ns[:] = _AC[0][0xF0], _AC[1][0xF0]
        words[place + zeros], ns[place + zeros] = word, n
        tail = place[end] + zeros[end] + 1
        words[tail], ns[tail] = _AC[0][0], _AC[1][0]
        word, n, owner = words, ns, owners
    group = np.cumsum(new) - 1
    own = group[owner]
    used = np.bincount(own, n, int(group[-1]) + 1).astype(np.int64)
    whole = (used + 7) // 8
    ends = np.cumsum(whole)
    start = np.cumsum(n) - n
    first = np.r_[0, np.cumsum(used)[:-1]]
    start += 8 * (ends - whole)[own] - first[own]
    # Codes of up to 26 bits: their bits fall on two words of 32 at most. Fields do not overlap, so sums are unions.
    out = np.zeros(int(ends[-1]) // 4 + 2, np.uint64)
    slot, shift = start >> 5, 64 - (start & 31) - n
    wide = word.astype(np.uint64) << shift.astype(np.uint64)
    heads = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    out[slot[heads]] += np.add.reduceat(wide >> np.uint64(32), heads)
    tails = np.r_[heads[1:] - 1, len(slot) - 1]
    out[slot[tails] + 1] += wide[tails] & np.uint64(0xFFFFFFFF)
    raw = out.astype(">u4").view(np.uint8)[: ends[-1]].copy()
    pad = 8 * whole - used
    raw[ends - 1] |= ((1 << pad) - 1).astype(np.uint8)
    return raw, ends


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """One image each of byte arrays whose lengths are positive multiples of 64."""
    sizes = np.array([len(p) // 64 for p in payloads])
    wide = np.ceil(np.sqrt(sizes)).astype(np.int64)
    high = -(-sizes // wide)
    blocks = wide * high
    first = np.cumsum(blocks) - blocks
    values = np.zeros((int(blocks.sum()), 64), np.int16)
    for p, at, k in zip(payloads, first, sizes, strict=True):
        values[at : at + k] = p.reshape(-1, 64).astype(np.int16) - 128
    intervals = -(-blocks // RESTART)
    offset = np.cumsum(intervals) - intervals
    number = np.repeat(offset, blocks) + (np.arange(len(values)) - np.repeat(first, blocks)) // RESTART
    raw, ends = entropy(values, number)
    starts = np.r_[0, ends[:-1]]
    # Byte stuffing: a zero after each 255 of the coded data; then the markers between intervals.
    marks = np.flatnonzero(raw == 255)
    out = []
    for i, p in enumerate(payloads):
        lo, hi = offset[i], offset[i] + intervals[i]
        a, b = starts[lo], ends[hi - 1]
        m = marks[np.searchsorted(marks, a) : np.searchsorted(marks, b)] + 1 - a
        cut = ends[lo : hi - 1] - a
        where = np.concatenate([m, cut, cut])
        what = np.concatenate([np.zeros(len(m), np.uint8), np.full(len(cut), 255, np.uint8), (0xD0 + np.arange(len(cut)) % 8).astype(np.uint8)])
        # at one place the stuffed zero comes first, then the marker's two bytes
        rank = np.concatenate([np.zeros(len(m)), np.full(len(cut), 1), np.full(len(cut), 2)])
        order = np.lexsort((rank, where))
        body = np.insert(raw[a:b], where[order], what[order])
        out.append(header(int(wide[i]), int(high[i]), len(p)) + body.tobytes() + b"\xff\xd9")
    return out


@dataclass
class Image:
    """What the markers say; ``data`` is the scan without stuffing, ``ends`` the ends of its restart intervals."""

    width: int = 0
    height: int = 0
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quantiser
    selectors: dict[int, tuple[int, int]] = field(default_factory=dict)
    restart: int = 0
    comment: bytes = b""
    data: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def units(self) -> tuple[int, int, list[int]]:
        """Units (MCUs) across and down, and the component of each block of a unit."""
        if len(self.components) == 1:
            return -(-self.width // 8), -(-self.height // 8), [0]
        h, v = (max(c[k] for c in self.components) for k in (1, 2))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v)), [i for i, c in enumerate(self.components) for _ in range(c[1] * c[2])]

    def signature(self) -> tuple:
        pattern = self.units()[2]
        return tuple(pattern), tuple((self.tables[self.selectors[self.components[i][0]][0]], self.tables[0x10 | self.selectors[self.components[i][0]][1]]) for i in sorted(set(pattern)))


def parse(media: bytes) -> Image:
    """Read the markers and cut the scan into restart intervals; ValueError for anything but a baseline image."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image, at = Image(), 2
    while at + 4 <= len(media):
        if media[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        marker = media[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        n = int.from_bytes(media[at + 2 : at + 4], "big")
        body, at = media[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                size = 128 if body[0] >> 4 else 64
                image.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if size == 128 else "u1").astype(np.int64)
                body = body[1 + size :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("samples are not of 8 bits")
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xC4:
            while body:
                k = sum(body[1:17])
                image.tables[body[0]] = (body[1:17], body[17 : 17 + k])
                body = body[17 + k :]
        elif marker == 0xDD:
            image.restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            image.selectors = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            raw = np.frombuffer(media, np.uint8, offset=at)
            marks = np.flatnonzero(raw[:-1] == 255)
            after = raw[marks + 1]
            stop = marks[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
            end = int(stop[0]) if len(stop) else len(raw)
            marks, after = marks[marks < end], after[marks < end]
            keep = np.ones(end, bool)
            keep[(marks + 1)[marks + 1 < end]] = False
            resets = marks[after != 0]
            keep[resets] = False
            place = np.cumsum(keep)
            image.data = raw[:end][keep]
            image.ends = np.append(place[resets], len(image.data)).astype(np.int64)
            return image
    raise ValueError("no scan")


def decode(images: list[Image]) -> list[list[np.ndarray]]:
    """For each image a (blocks, 64) array of quantised coefficients in zigzag order for each component, in scan order."""
    groups: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        groups.setdefault(image.signature(), []).append(i)
    out: list[list[np.ndarray]] = [[] for _ in images]
    for (pattern, tables), members in groups.items():
        for i, flat in zip(members, _lockstep([images[i] for i in members], np.array(pattern), tables), strict=True):
            component = np.tile(pattern, len(flat) // len(pattern))
            out[i] = [flat[component == c] for c in sorted(set(pattern))]
    return out


def _lockstep(images: list[Image], pattern: np.ndarray, tables: tuple) -> list[np.ndarray]:
    """All intervals of images with equal tables at once: each step reads one symbol of every interval that goes on."""
    luts = np.concatenate([lookup(*t) for pair in tables for t in pair])  # DC and AC of each component in turn
    first_bit, first_block, last_block, totals, pieces, at = [], [], [], [], [], 0
    for image in images:
        wide, high, _ = image.units()
        blocks = wide * high * len(pattern)
        step = (image.restart or wide * high) * len(pattern)
        starts = np.arange(0, blocks, step)
        base = sum(totals)
        if len(starts) != len(image.ends):
            raise ValueError("restart intervals are missing")
        first_block.append(base + starts)
        last_block.append(base + np.minimum(starts + step, blocks))
        first_bit.append(8 * (at + np.r_[0, image.ends[:-1]]))
        pieces.append(image.data)
        at += len(image.data)
        totals.append(blocks)
    data = np.concatenate([*pieces, np.zeros(8, np.uint8)]).astype(np.int64)
    window = data[:-4] << 32 | data[1:-3] << 24 | data[2:-2] << 16 | data[3:-1] << 8 | data[4:]
    coefficients = np.zeros(sum(totals) * 64, np.int16)
    bit, block, stop = np.concatenate(first_bit), np.concatenate(first_block), np.concatenate(last_block)
    prediction = np.zeros((len(tables), len(bit)), np.int64)
    k, slot = np.zeros(len(bit), np.int64), np.zeros(len(bit), np.int64)
    alone, lane = len(pattern) == 1, np.arange(len(bit))
    limit = 8 * at
    while len(bit):
        if (bit >= limit + 32).any():
            raise ValueError("the scan ends early")
        component = 0 if alone else pattern[slot]
        w = window[np.minimum(bit >> 3, len(window) - 1)]
        off = bit & 7
        is_ac = k > 0
        found = luts[((2 * component + is_ac) << 16) + (w >> (24 - off) & 0xFFFF)].astype(np.int64)
        n, run, size = found >> 8, found >> 4 & 15, found & 15
        if not n.all():
            raise ValueError("a code that no table has")
        if not is_ac.all():  # a DC symbol is a size alone
            size = np.where(is_ac, size, found & 255)
        bits = w >> (40 - off - n - size) & ((1 << size) - 1)
        v = np.where(bits << 1 >= 1 << size, bits, bits - (1 << size) + 1)
        v[size == 0] = 0
        bit = bit + n + size
        dc = ~is_ac
        if dc.any():
            c = np.zeros(int(dc.sum()), np.int64) if alone else component[dc]
            prediction[c, lane[dc]] += v[dc]
            v[dc] = prediction[c, lane[dc]]
        k = np.where(is_ac, k + run, 0)
        end = is_ac & (size == 0) & (run == 0)
        put = ~end & (k < 64)
        coefficients[(block[put] << 6) + k[put]] = v[put]
        k = np.where(end, 64, k + 1)
        over = k >= 64
        if over.any():
            block = block + over
            k[over] = 0
            if not alone:
                slot = (slot + over) % len(pattern)
            going = block < stop
            if not going.all():
                bit, block, stop, k, slot, lane = (x[going] for x in (bit, block, stop, k, slot, lane))
    parts = np.split(coefficients.reshape(-1, 64), np.cumsum(totals)[:-1])
    return parts


def thumbnail(image: Image, coefficients: list[np.ndarray]) -> np.ndarray:
    """One luminance sample a block, 0 to 255, from the DC coefficients of the first component."""
    wide, high, _ = image.units()
    _, h, v, q = image.components[0]
    dc = np.clip(coefficients[0][:, 0].astype(np.int64) * int(image.quantisers[q][0]) // 8 + 128, 0, 255)
    if len(image.components) == 1:
        return dc.reshape(high, wide).astype(np.uint8)
    return dc.reshape(high, wide, v, h).swapaxes(1, 2).reshape(high * v, wide * h).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which samples of the thumbnail, taken at an 8 x 8 grid, are above their mean."""
    h, w = thumb.shape
    grid = thumb[np.ix_(np.arange(8) * h // 8, np.arange(8) * w // 8)].astype(np.int64)
    return np.packbits((grid * 64 > grid.sum()).reshape(-1)).tobytes().hex()


def payload(image: Image, coefficients: list[np.ndarray]) -> bytes:
    """The bytes that ``encode`` stored."""
    if not image.comment.startswith(COMMENT):
        raise ValueError("the image holds no payload")
    n = int(image.comment[len(COMMENT) :])
    return (coefficients[0].reshape(-1)[:n] + 128).astype(np.uint8).tobytes()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): every text, a null as an empty one, padded with zero bytes to a positive multiple of 64
    and written as an image. Equal texts give equal images; repeated rows stay; other columns go."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            for i, j in spans(off, CHUNK):
                padded = []
                for a, e in zip(off[i:j], off[i + 1 : j + 1], strict=True):
                    p = np.zeros(max(64, -(-(e - a) // 64) * 64), np.uint8)
                    p[: e - a] = data[a:e]
                    padded.append(p)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(off[i : j + 1])), pa.array(encode(padded), pa.binary())], ["id", "n_bytes", "media"])

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(lean(run), f"id {dict(docs.dtypes)[id_col]}, n_bytes long, media binary")


def read(media: DataFrame) -> DataFrame:
    """(id, n_bytes, payload, media, width, height, thumb_width, thumb_height, thumb_hash) of ``store``'s rows, read from their bytes."""
    ship(media.sparkSession)
    names = ["id", "n_bytes", "payload", "media", "width", "height", "thumb_width", "thumb_height", "thumb_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, off = utf8(b.column(2))
            for i, j in spans(off, CHUNK):
                part = b.slice(i, j - i)
                images = [parse(m) for m in part.column(2).to_pylist()]
                values = decode(images)
                thumbs = [thumbnail(x, v) for x, v in zip(images, values, strict=True)]
                columns = [part.column(0), part.column(1), pa.array([payload(x, v) for x, v in zip(images, values, strict=True)], pa.binary()), part.column(2), pa.array([x.width for x in images], pa.int32()), pa.array([x.height for x in images], pa.int32()), pa.array([t.shape[1] for t in thumbs], pa.int32()), pa.array([t.shape[0] for t in thumbs], pa.int32()), pa.array([average_hash(t) for t in thumbs])]
                yield pa.RecordBatch.from_arrays(columns, names)

    return media.select("id", "n_bytes", "media").mapInArrow(lean(run), f"id {dict(media.dtypes)['id']}, n_bytes long, payload binary, media binary, width int, height int, thumb_width int, thumb_height int, thumb_hash string")


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def blocks(n_bytes: int) -> int:
    return max(1, math.ceil(n_bytes / 64))
