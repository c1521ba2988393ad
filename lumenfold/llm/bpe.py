"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a vocabulary entry is one id and needs no
merging. Tier two merges the bytes of any other pre-token, kept as a linked list, in the order of a heap of pair ranks.
A worker keeps what both tiers found in memos bounded by bytes, so that a repeated word costs one dictionary access.

Texts are cut before white space that follows something else. No pre-token of the GPT-2 pattern reaches over such a
place and its look-ahead sees the same there, so the pieces can be encoded apart from each other.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from lumenfold.llm.common import broadcast_file, lean, ship

#: Unicode White_Space, as the pattern's \s has it (re's own \s has four control characters more).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Bytes (as estimated by ``cost``) that a worker's memos of pieces and of pre-tokens hold before they start again; longer
#: strings than LONGEST characters are not kept.
PIECE_BYTES, TOKEN_BYTES, LONGEST = 120 << 20, 40 << 20, 64


class MinimalPerfectHash:
    """Hash and displace: a key's bucket holds a displacement that sends its keys to slots of their own.

    Buckets of one key hold their slot itself (as -1 - slot), so the table fills up without long searches. ``find``
    returns the value of a key, or -1 for any other byte string (the slot's key is compared).
    """

    def __init__(self, table: dict[bytes, int]) -> None:
        n = len(table)
        self.n, self.m = max(1, n), max(1, n // 2)
        buckets: list[list[tuple[int, int, bytes]]] = [[] for _ in range(self.m)]
        for key in table:
            h = xxhash.xxh3_64_intdigest(key)
            buckets[h % self.m].append((h >> 20 & 0xFFFFFFFF, h >> 32 | 1, key))
        shift, keys = [0] * self.m, [b""] * self.n
        taken, values = bytearray(self.n), array("q", [-1]) * self.n
        singles = []
        for b in sorted(range(self.m), key=lambda b: -len(buckets[b])):
            if len(buckets[b]) < 2:
                singles.append(b)
                continue
            d = 0
            while True:
                slots = [(a + d * s + (d * d >> 3)) % self.n for a, s, _ in buckets[b]]
                if len(set(slots)) == len(slots) and not any(taken[x] for x in slots):
                    break
                d += 1
            shift[b] = d
            for x, (_, _, key) in zip(slots, buckets[b], strict=True):
                taken[x], keys[x], values[x] = 1, key, table[key]
        free = iter([x for x in range(self.n) if not taken[x]])
        for b in singles:
            for _, _, key in buckets[b]:
                x = next(free)
                shift[b], keys[x], values[x] = -1 - x, key, table[key]
        self.shift, self.keys, self.values = array("q", shift), keys, values

    def find(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.m]
        x = -1 - d if d < 0 else ((h >> 20 & 0xFFFFFFFF) + d * (h >> 32 | 1) + (d * d >> 3)) % self.n
        return self.values[x] if self.keys[x] == key else -1


def merge_bytes(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the lowest-ranked adjacent pair is merged first, the leftmost of equal ones."""
    n = len(raw)
    stop, following, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = following[i] if stop[i] else n
        if j >= n or stop[j] != end:
            continue
        stop[i], stop[j] = end, 0  # a node that was merged into the one before it has no end
        k = following[i] = following[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(raw[i : stop[k]])) is not None:
                heapq.heappush(heap, (r, i, stop[k]))
        if (p := before[i]) >= 0 and (r := ranks.get(raw[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[raw[i : stop[i]]])
        i = following[i]
    return out


class Memo(dict):
    """String -> packed unsigned 32-bit ids; fills itself by ``make``, and starts again when its bytes reach ``limit``."""

    def __init__(self, limit: int, make: Callable[[str], bytes]) -> None:
        self.limit, self.make, self.held = limit, make, 0

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        if len(key) <= LONGEST:
            self.held += 190 + len(key) + len(found)  # a dictionary's slot at its usual load, and two objects
            if self.held > self.limit:
                self.clear()
                self.held = 190 + len(key) + len(found)
            self[key] = found
        return found


class Codec:
    """Encoder and decoder of one vocabulary of ranks (lines of base64 bytes and rank)."""

    def __init__(self, ranks_file: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks_file.splitlines() if x.strip())}
        self.pattern = regex.compile(pattern)
        self.whole = MinimalPerfectHash(self.ranks)
        self.bytes_of = dict(zip(self.ranks.values(), self.ranks, strict=True))
        if max(self.bytes_of) < 2 * len(self.bytes_of):
            self.bytes_of = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.token = Memo(TOKEN_BYTES, self.ids_of)
        self.piece = Memo(PIECE_BYTES, lambda piece: b"".join([self.token[x] for x in self.pattern.findall(piece)]))

    def ids_of(self, token: str) -> bytes:
        """A pre-token's ids, by the two tiers."""
        raw = token.encode()
        whole = self.whole.find(raw)
        return array("I", [whole] if whole >= 0 else merge_bytes(raw, self.ranks)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; empty for an empty text."""
        return b"".join(map(self.piece.__getitem__, PIECE.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


_CODECS: dict[bytes, Codec] = {}


def codec(ranks_file: bytes, pattern: str) -> Codec:
    """One codec a worker process and vocabulary."""
    key = hashlib.blake2b(ranks_file + pattern.encode(), digest_size=16).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks_file, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): each text's ids, little-endian unsigned 32-bit. A null text counts as empty and has no ids.

    Rows stay apart (repeated rows give repeated results), other columns are not carried, and no shuffle takes place.
    """
    ship(docs.sparkSession)
    file = broadcast_file(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file.value, pattern)
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, len(b), 500)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.encode(t or "") for t in part.column(1).to_pylist()], pa.binary())], ["id", "ids"])

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(lean(run), f"id {dict(docs.dtypes)[id_col]}, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(id, ids, raw binary): what ``encode`` returned, with the bytes that the ids stand for."""
    file = broadcast_file(encoded.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file.value, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([own.decode(x) for x in b.column(1).to_pylist()], pa.binary())], ["id", "ids", "raw"])

    return encoded.select("id", "ids").mapInArrow(lean(run), f"id {dict(encoded.dtypes)['id']}, ids binary, raw binary")
