"""Suffix-array removal of repeated passages: maximal repeats by the interval tree of common prefixes.

Every window of ``length`` bytes picks an anchor in itself: the gram (a fourth as long) with the least hash, the leftmost
of equal ones. Equal windows pick the same anchor at the same place, so only texts that share an anchor need comparing, and
each window is judged at one anchor only. The bytes of an anchor's windows are its segment. Of equal segments a task hands on
two and settles the others itself (they repeat as a whole), so what a passage or line sends does not grow with its copies in
a task. Anchors meet in a sort by hash; those that meet nothing are dropped there.

For anchors that meet, their segments go to one task, a few MB at once. There an enhanced suffix array is made over the
suffixes that matter (those whose window occurs again and may be extended to the left in two ways, or not at all; any other
occurrence is part of one of these), and a scan with a stack over its common prefixes visits the intervals of the prefix
tree bottom-up: each interval that is long enough and left-diverse is a maximal repeat with all its occurrences. What is cut
are the places of these groups. A repeat longer than a segment is given piece by piece, one for each of its anchors.

An anchor with more than ``HOT`` segments (a line in very many contexts) is split by longer keys: the bytes that the windows
of a sixteenth of its places have in common. Contexts that share no window part there. What is still as frequent are windows
that are nearly the same everywhere; those are told by fingerprints of 128 bits, and equal ones are one group.

Equal texts are one text with a count; one that occurs twice is a repeat as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenfold.llm.common import lean, maybe_in, mix, prefix_hash, ship, spans, stored, utf8, window_hash

HOT, CHUNK = 8_000, 1 << 20
#: Keys that an anchor with more segments is split by, and entries of a task's memory of segments and texts it has met.
PARTS, MEMORY = 16, 300_000
ANCHOR = "h long, k1 long, k2 long, lo long, hi long, settled boolean"


def anchors_of(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text number, hash, first window, last window) of each anchor of a chunk of texts; windows by their starts in the chunk."""
    gram = length // 4
    width = length - gram + 1
    n = len(data) - gram + 1
    starts = np.arange(max(0, len(data) - length + 1))
    row = np.searchsorted(off, starts, "right") - 1
    valid = starts + length <= off[row + 1] if len(starts) else np.zeros(0, bool)
    if not valid.any():
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    sums = prefix_hash(data)
    at = np.arange(n)
    hashes = window_hash(sums, at, at + gram)
    bits = np.uint64(len(data).bit_length())
    least = (hashes >> bits << bits) | at.astype(np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        shift = width - span
        least = np.minimum(least[:-shift], least[shift:])
    chosen = (least[: len(starts)][valid] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts, row = starts[valid], row[valid]
    head = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])])
    tail = np.r_[head[1:] - 1, len(starts) - 1]
    return row[head], hashes[chosen[head]], starts[head], starts[tail]


class Met:
    """The segments a task has handed on. Bounded: a full memory starts again, and then more rows are handed on."""

    def __init__(self) -> None:
        self.segments: dict[int, tuple[int, int, int] | int] = {}
        self.texts: set[tuple[int, int]] = set()

    def fresh_text(self, k1: int, k2: int) -> bool:
        if (k1, k2) in self.texts:
            return False
        if len(self.texts) >= MEMORY:
            self.texts.clear()
        self.texts.add((k1, k2))
        return True

    def settled(self, prints: list[int], hashes: list[int], texts: list[int], starts: list[int]) -> np.ndarray:
        """For each segment (fingerprint, anchor's hash, text, start) whether two equal ones of other places went before it."""
        seen, out = self.segments, np.zeros(len(prints), bool)
        for i, (f, h, k, lo) in enumerate(zip(prints, hashes, texts, starts, strict=True)):
            got = seen.get(f)
            if got is None:
                if len(seen) >= MEMORY:
                    seen.clear()
                seen[f] = (h, k, lo)
            elif got.__class__ is int:
                out[i] = got == h
            elif got[0] == h and got[1:] != (k, lo):
                seen[f] = h
        return out


def anchors(docs: DataFrame, length: int, settle: bool = True) -> DataFrame:
    """(h, k1, k2, lo, hi, settled): anchors of all rows, with the first and last window start that picked them; a settled one's
    segment repeats as a whole and need not meet others (its h only deals it). Without ``settle`` all of them meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met()
        for b in batches:
            new = [met.fresh_text(*k) for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            b = b.filter(pa.array(new, pa.bool_()))
            data, off = utf8(b.column(2))
            for i, j in spans(off):
                part = data[off[i] : off[j]]
                row, h, lo, hi = anchors_of(part, off[i : j + 1] - off[i], length)
                base = off[i:j][row] - off[i]
                k1, k2 = (b.column(c).slice(i, j - i).to_numpy()[row] for c in (0, 1))
                prints = window_hash(prefix_hash(part), lo, hi + length)
                settled = met.settled(prints.tolist(), h.tolist(), k1.tolist(), (lo - base).tolist()) if settle else np.zeros(len(h), bool)
                dealt = np.where(settled, k1, h.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(dealt), pa.array(k1), pa.array(k2), pa.array((lo - base).astype(np.int64)), pa.array((hi - base).astype(np.int64)), pa.array(settled)], ["h", "k1", "k2", "lo", "hi", "settled"])

    return docs.where(F.octet_length("text") >= length).select("k1", "k2", "text").mapInArrow(lean(run), ANCHOR)


def meetings(rows: DataFrame) -> DataFrame:
    """Anchors whose hash another place has too, and the settled ones; equal texts count once. Rows come sorted, a task holds a
    batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not len(b):
                continue
            t = pa.Table.from_batches([held[0], b]).combine_chunks().to_batches()[0] if held else b
            columns = [np.asarray(c) for c in t.columns]
            copy = np.ones(len(t) - 1, bool)
            for c in columns:
                copy &= c[1:] == c[:-1]
            t = t.filter(pa.array(np.r_[True, ~copy]))
            h, settled = (np.asarray(t.column(c)) for c in (0, 5))
            same = (h[1:] == h[:-1]) & ~settled[1:] & ~settled[:-1]
            meets = settled | np.r_[held[1] if held else False, same] | np.r_[same, False]
            yield t.filter(pa.array(np.r_[meets[:-1], False]))
            held = t.slice(len(t) - 1), bool(meets[-1])
        if held and held[1]:
            yield held[0]

    return rows.repartition("h").sortWithinPartitions("h", "settled", "k1", "k2", "lo", "hi").mapInArrow(lean(run), ANCHOR)


def prefix_intervals(lcp: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int, bool]]:
    """(common length, first, last, left-diverse) of the intervals of a suffix array, inner ones first.

    ``lcp[i]``: what suffixes i - 1 and i have in common; ``left[i]``: the byte before suffix i, or a negative number of
    its own where there is none. Only intervals of ``least`` or more are visited.
    """
    stack: list[list] = []  # common length, first suffix, byte before all of its suffixes (None: several)
    n = len(left)
    for i in range(1, n + 1):
        value = lcp[i] if i < n and lcp[i] >= least else 0
        first, before = i - 1, left[i - 1]
        while stack and stack[-1][0] > value:
            size, first, own = stack.pop()
            before = own if own == before else None
            yield size, first, i - 1, before is None
        if value:
            if stack and stack[-1][0] == value:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == before else None
            else:
                stack.append([value, first, before])


def suffix_array(raw: bytes, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The given suffixes (from ``at`` to ``stop``) in order, and each one's common prefix with the one before it."""
    ends = stop.tolist()
    keys = [raw[a:z] for a, z in zip(at.tolist(), ends, strict=True)]
    order = np.array(sorted(range(len(at)), key=keys.__getitem__), np.int64)
    at, stop = at[order], stop[order]
    lcp = np.zeros(len(at), np.int64)
    if len(at) > 1:
        sums = prefix_hash(np.frombuffer(raw, np.uint8))
        a, b = at[:-1], at[1:]
        lo, hi = np.zeros(len(a), np.int64), np.minimum(stop[:-1] - a, stop[1:] - b)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = window_hash(sums, a, a + mid) == window_hash(sums, b, b + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        for i, (x, y, n) in enumerate(zip(a.tolist(), b.tolist(), lo.tolist(), strict=True)):
            while n and raw[x : x + n] != raw[y : y + n]:  # hashes of different bytes were equal
                n -= 1
            lcp[i + 1] = n
    return at, stop, lcp


def maximal_repeats(parts: list[bytes], length: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], list[tuple[int, int, int]]]:
    """Of several byte strings, all of whose windows matter: (groups, covered).

    Groups: (common length, occurrences as (part, start)) of each maximal repeat, with all its occurrences.
    Covered: (part, start, stop) of what repeats, as unions of the groups' occurrences.
    """
    places, groups, covered = repeat_intervals(parts, length)
    return [(size, places[first : last + 1]) for size, first, last in groups], covered


def repeat_intervals(parts: list[bytes], length: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The same with a group as (common length, first, last) of the suffix array, whose places (part, start) come first: nested
    groups share them."""
    sizes = np.array([len(p) for p in parts])
    raw = b"".join(parts)
    base = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - length + 1, 0)
    part = np.repeat(np.arange(len(parts)), windows)
    at = base[part] + np.arange(len(part)) - np.repeat(np.cumsum(windows) - windows, windows)
    if not len(at):
        return [], [], []
    data = np.frombuffer(raw, np.uint8)
    prints = window_hash(prefix_hash(data), at, at + length)
    left = np.where(at > base[part], data[at - 1].astype(np.int64), -1 - at)
    order = np.argsort(prints, kind="stable")
    p = prints[order]
    head = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    many = np.diff(np.r_[head, len(p)])
    lowest, highest = np.minimum.reduceat(left[order], head), np.maximum.reduceat(left[order], head)
    keep = np.sort(order[np.repeat((many > 1) & (lowest != highest), many)])
    if not len(keep):
        return [], [], []
    stop = base[part[keep]] + sizes[part[keep]]
    owner = dict(zip(at[keep].tolist(), zip(part[keep].tolist(), left[keep].tolist(), strict=True), strict=True))
    at, stop, lcp = suffix_array(raw, at[keep], stop)
    places = at.tolist()
    groups, reach = [], np.zeros(len(at), np.int64)
    taken = np.zeros(len(at), bool)
    for size, first, last, diverse in prefix_intervals(lcp.tolist(), [owner[a][1] for a in places], length):
        inner = slice(first, last + 1)
        if diverse:
            fresh = ~taken[inner]
            reach[inner][fresh] = size  # the innermost group of a suffix is its longest repeat
            taken[inner] = True
            groups.append((size, first, last))
    covered: list[tuple[int, int, int]] = []
    order = np.argsort(at)
    for a, n in zip(at[order].tolist(), reach[order].tolist(), strict=True):
        if n:
            k = owner[a][0]
            s = a - int(base[k])
            if covered and covered[-1][0] == k and s <= covered[-1][2]:
                covered[-1] = (k, covered[-1][1], max(covered[-1][2], s + n))
            else:
                covered.append((k, s, s + n))
    return [(owner[a][0], a - int(base[owner[a][0]])) for a in places], groups, covered


PLACE = "k1 long, k2 long, start long, stop long"
GROUP = "repeat long, size long, k1 long, k2 long, start long"
SEGMENT = "h long, k1 long, k2 long, lo long, bytes binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    types = [pa.binary() if c.endswith("binary") else pa.int64() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def segments(texts: DataFrame, met: DataFrame, length: int) -> DataFrame:
    """(h, k1, k2, lo, bytes): for each anchor that meets others, the bytes of its windows."""
    listed = met.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "lo", "hi")).alias("anchors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(2))
            for i in range(len(b)):
                raw, rows = data[off[i] : off[i + 1]].tobytes(), b.column(3)[i].as_py()
                k1, k2 = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                for s in range(0, len(rows), 4000):
                    yield _batch([(r["h"], k1, k2, r["lo"], raw[r["lo"] : r["hi"] + length]) for r in rows[s : s + 4000]], SEGMENT)

    return texts.join(listed, ["k1", "k2"]).select("k1", "k2", "text", "anchors").mapInArrow(lean(run), SEGMENT)


def scanned(rows: DataFrame, length: int, listed: bool = False) -> DataFrame:
    """(k1, k2, start, stop): repeats among the segments of each anchor, by suffix arrays over whole groups of CHUNK bytes or more;
    or, ``listed``, the maximal repeats themselves: (repeat, size, k1, k2, start), a row for each occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, group = 0, None

        def found() -> Iterator[pa.RecordBatch]:
            places, groups, covered = repeat_intervals([r[3] for r in held], length)
            if not listed:
                yield _batch([(held[k][0], held[k][1], held[k][2] + a, held[k][2] + z) for k, a, z in covered], PLACE)
                return
            for n, first, last in groups:
                k, a = places[first]
                name = name_of(held[k][3][a : a + n])
                for i in range(first, last + 1, 5000):
                    yield _batch([(name, n, held[k][0], held[k][1], held[k][2] + a) for k, a in places[i : min(last + 1, i + 5000)]], GROUP)

        for b in batches:
            h = b.column(0).to_pylist()
            for i, row in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)):
                if h[i] != group and size >= CHUNK:
                    yield from found()
                    held, size = [], 0
                group = h[i]
                held.append(row)
                size += len(row[3])
        if held:
            yield from found()

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(lean(run), GROUP if listed else PLACE)


def name_of(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)


def split(rows: DataFrame, length: int) -> DataFrame:
    """Segments by longer keys. An anchor's windows are dealt into PARTS by how far in front of the gram they start; those of one
    part have all bytes but ``step`` in common, and the hash of these is the new key."""
    gram = length // 4
    step = -(-(length - gram + 1) // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, k1, k2, lo, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sums = prefix_hash(np.frombuffer(raw, np.uint8))
                at = np.arange(len(raw) - gram + 1)
                p = int(np.argmax(window_hash(sums, at, at + gram).view(np.int64) == h))  # the leftmost is the one that was picked
                for part in range(PARTS):
                    first, last = max(0, p - (part + 1) * step + 1), min(len(raw) - length, p - part * step)
                    if first <= last:
                        core = np.array([p - part * step]), np.array([p - (part + 1) * step + 1 + length])
                        key = (window_hash(sums, *core) + np.uint64(part)).view(np.int64)[0]
                        out.append((int(key), k1, k2, lo + first, raw[first : last + length]))
            yield _batch(out, SEGMENT)

    return rows.mapInArrow(lean(run), SEGMENT)


def counted(rows: DataFrame, length: int, listed: bool = False) -> DataFrame:
    """The same for keys that are frequent after all: every window's fingerprint, counted where it stands and then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k1, k2, lo, raw in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                data = np.frombuffer(raw, np.uint8)
                at = np.arange(len(data) - length + 1)
                f1 = window_hash(prefix_hash(data), at, at + length)
                f2 = window_hash(prefix_hash(data ^ np.uint8(0x5A)), at, at + length)
                same = [pa.array(np.full(len(at), k)) for k in (k1, k2)]
                yield pa.RecordBatch.from_arrays([pa.array(f1.view(np.int64)), pa.array(mix(f2).view(np.int64)), *same, pa.array(at + lo)], ["f1", "f2", "k1", "k2", "start"])

    prints = rows.mapInArrow(lean(run), "f1 long, f2 long, k1 long, k2 long, start long")
    again = prints.groupBy("f1", "f2").agg(F.count("*").alias("n")).where("n > 1").select("f1", "f2")
    size = F.lit(length).cast("long")
    found = prints.join(again, ["f1", "f2"])
    return found.select(F.col("f1").alias("repeat"), size.alias("size"), "k1", "k2", "start") if listed else found.select("k1", "k2", "start", (F.col("start") + size).alias("stop"))


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """The input with (k1, k2) for its texts: two hashes of 64 bits, of the text and of it behind a fixed byte; null as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("k1", F.xxhash64(text)).withColumn("k2", F.xxhash64(F.concat(F.lit("\u0001"), text)))


def by_size(rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys with HOT rows at most, and of the others (None if there are none); ``sizes``: (h, n) of all keys."""
    hot = sizes.where(F.col("n") > HOT).select("h")
    return (rows, None) if hot.isEmpty() else (rows.join(hot, "h", "left_anti"), rows.join(hot, "h", "left_semi"))


def found_in(texts: DataFrame, met: DataFrame, length: int, listed: bool = False) -> DataFrame:
    """Repeats among the anchors that meet: places or, ``listed``, groups with all their occurrences."""
    few, many = by_size(met, met.groupBy("h").agg(F.count("*").alias("n")))
    out = scanned(segments(texts, few, length), length, listed)
    if many is not None:
        parts = stored(split(segments(texts, many, length), length), "parts")
        sizes = stored(parts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "part-sizes")
        few, many = by_size(parts.join(sizes.select("h"), "h", "left_semi"), sizes)
        out = out.union(scanned(few, length, listed))
        if many is not None:
            out = out.union(counted(many, length, listed))
    return out


def repeated(docs: DataFrame, length: int = 400, text_col: str = "text") -> DataFrame:
    """(k1, k2, places): byte ranges (they may overlap) of each text that has any, which strings of ``length`` bytes cover that
    start at another place too. ``k1, k2``: see ``keyed``. The text column of ``docs`` must be a string."""
    ship(docs.sparkSession)
    texts = keyed(docs.select(F.col(text_col).alias("text")), "text")
    met = stored(meetings(anchors(texts, length)), "anchors")
    there = maybe_in(met, "k1")
    distinct = texts.where(F.octet_length("text") >= length).where(there("k1")).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    places = found_in(distinct, met.where("NOT settled").drop("settled"), length)
    places = places.union(met.where("settled").select("k1", "k2", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop")))
    copies = keyed(docs.select(F.col(text_col).alias("text")), "text").where(F.octet_length("text") >= length)
    whole = copies.select("k1", "k2", F.octet_length("text").cast("long").alias("n")).groupBy("k1", "k2").agg(F.count("*").alias("m"), F.max("n").alias("n")).where("m > 1").select("k1", "k2", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop"))
    # Ranges of one text: a document's own, never those of a group of documents.
    listed = places.union(whole).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("places"))
    return stored(listed, "repeats")


def groups(docs: DataFrame, length: int = 400, text_col: str = "text") -> DataFrame:
    """(repeat, size, k1, k2, start): the maximal repeats of ``length`` bytes or more with all their occurrences, a row each, in
    the texts (k1, k2: see ``keyed``). Nested repeats are listed each.

    ``repeat`` is a hash of the string. A repeat that is longer than its anchors' segments is listed in pieces, as many as it
    has anchors; in the way for very frequent keys the pieces are single windows. Equal texts are one text here. Null texts are
    empty; texts below ``length`` have none.
    """
    ship(docs.sparkSession)
    texts = keyed(docs.select(F.col(text_col).alias("text")), "text")
    met = stored(meetings(anchors(texts, length, False)), "anchors")
    distinct = texts.where(F.octet_length("text") >= length).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    return found_in(distinct, met.where("NOT settled").drop("settled"), length, True)


def merge(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(places):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def removed(docs: DataFrame, length: int = 400, text_col: str = "text") -> DataFrame:
    """The input with ``kept`` binary (the bytes that no repeated string covers) and ``cut`` array<struct<start,stop>>.

    Input columns of those names (and of k1, k2, places) are replaced. A null text is an empty one: nothing kept or cut. Texts below
    ``length`` bytes stay whole. Equal rows stay, each cut like the other. Nothing is kept of a text that occurs twice.
    """
    base = keyed(docs.drop("kept", "cut", "k1", "k2", "places"), text_col)
    found = repeated(docs, length, text_col)
    there = maybe_in(found, "k1")
    names = [c for c in base.columns if c not in ("k1", "k2")]
    at = names.index(text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(at))
            kept, cut = [], []
            for i, rows in enumerate(b.column("places").to_pylist()):
                ranges = merge([(r["start"], r["stop"]) for r in rows or ()])
                raw = data[off[i] : off[i + 1]].tobytes()
                edges = [0, *(x for r in ranges for x in r), len(raw)]
                kept.append(b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
                cut.append([{"start": a, "stop": z} for a, z in ranges])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(kept, pa.binary()), pa.array(cut, kind)], [*names, "kept", "cut"])

    schema = ", ".join(f"`{c}` {t}" for c, t in base.select(*[f"`{c}`" for c in names]).dtypes)
    maybe = base.where(there("k1")).join(found, ["k1", "k2"], "left").select(*[f"`{c}`" for c in names], "places")
    out = maybe.mapInArrow(lean(run), f"{schema}, kept binary, cut array<struct<start:bigint,stop:bigint>>")
    rest = base.where(~there("k1")).select(*[f"`{c}`" for c in names], F.coalesce(F.encode(text_col, "UTF-8"), F.lit(b"")).alias("kept"), F.expr("cast(array() AS array<struct<start:bigint,stop:bigint>>)").alias("cut"))
    return out.union(rest)


def text_of(kept: bytes) -> str:
    """Kept bytes as text: what is left of a character that was cut goes too."""
    return kept.decode("utf-8", "ignore")


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
