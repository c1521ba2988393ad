"""Token counts by a map-side two-tier lookup, without a shuffle of pre-tokens.

A SentencePiece BPE model without a normaliser whose pieces have a space mark only in front merges nothing over a
boundary in front of a run of spaces or a line break. A text is cut there; the length of each pre-token comes from a
broadcast compact table of the frequent ones, or else from the model through the worker's cache.

The table of frequent pre-tokens is found in one pass over all texts: each task keeps a bounded summary of heavy
hitters and hands on its largest ones, which are summed. It only saves time; counts never depend on it.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lumenfold.llm.common import broadcast_file, lean, ship

MARK = "▁"
#: A run of spaces with what follows, or a line break with what follows; the text has a space put in front first.
PIECE = re.compile(f"[ {MARK}]+[^ {MARK}\n]*|\n[^ {MARK}\n]*")
#: Entries of a task's summary, of what it hands on, of the broadcast table, and of a worker's cache. Pre-tokens of more than
#: LONGEST characters are in none of them, which bounds their bytes.
SUMMARY, HANDED_ON, FREQUENT, CACHE, LONGEST = 60_000, 4_000, 50_000, 300_000, 64


class LengthTable:
    """Open addressing by 64-bit hashes of pre-tokens; the pre-tokens themselves lie one after another in a byte string and are
    compared, so that another one of equal hash is not taken for them."""

    def __init__(self, lengths: dict[str, int]) -> None:
        size = 1 << max(4, (2 * len(lengths)).bit_length())
        self.mask, self.entry = size - 1, np.full(size, -1, np.int32)
        raws = [t.encode() for t in lengths]
        self.raw, self.ends, self.values = b"".join(raws), np.cumsum([0, *map(len, raws)]), np.fromiter(lengths.values(), np.int64, len(lengths))
        for k, raw in enumerate(raws):
            i = xxhash.xxh3_64_intdigest(raw) & self.mask
            while self.entry[i] >= 0:
                i = (i + 1) & self.mask
            self.entry[i] = k
        self.tokens: list[bytes] = []

    def opened(self) -> LengthTable:
        """Plain lists, once a worker: single accesses are faster there."""
        if not self.tokens and len(self.values):
            ends = self.ends.tolist()
            self.tokens = [self.raw[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]
            self.entry, self.values = self.entry.tolist(), self.values.tolist()
        return self

    def find(self, token: str) -> int:
        raw = token.encode()
        i = xxhash.xxh3_64_intdigest(raw) & self.mask
        while (k := self.entry[i]) >= 0:
            if self.tokens[k] == raw:
                return self.values[k]
            i = (i + 1) & self.mask
        return -1


#: Characters that the usual normalisers change, runs of spaces, and a line break.
SAMPLE = "ﬁ Ａ① e\u0301  x\u00a0y\t z\n w "


def checked(model) -> None:
    """Raise unless texts may be cut as PIECE cuts them: no normaliser, a space mark in front, no piece that goes on over one."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    if any(MARK in p.lstrip(MARK) or "\n" in p[1:] for p in pieces):
        raise ValueError("the model has pieces that reach over a space or a line break")
    if bytes(model.decode(model.encode(SAMPLE)), "utf-8") != SAMPLE.encode() or model.encode(" a") == model.encode("a"):
        raise ValueError("the model normalises texts")


def model_lengths(model, pieces: list[str]) -> list[int]:
    """Each pre-token's number of tokens. The model puts a space mark in front of whatever it gets, which stands for a
    piece's own first mark; in front of a line break it is a token of its own, which does not count."""
    got = model.encode([p if p[0] == "\n" else p[1:] for p in pieces], num_threads=1)
    return [len(x) - 1 if p[0] == "\n" else len(x) or 1 for p, x in zip(pieces, got, strict=True)]


class Lengths(dict):
    """Pre-token -> number of tokens. What neither the cache nor the table knows goes to the model, a batch at once."""

    def __init__(self, model, table: LengthTable) -> None:
        self.model, self.table = model, table

    def counts(self, texts: list[str]) -> list[int]:
        pieces = [PIECE.findall(" " + t) if t else [] for t in texts]
        if len(self) >= CACHE:
            self.clear()
        misses = []
        for piece in set().union(*pieces).difference(self):
            if (n := self.table.find(piece)) < 0:
                misses.append(piece)
            else:
                self[piece] = n
        self.update(zip(misses, model_lengths(self.model, misses), strict=True) if misses else ())
        counts = [sum(map(self.__getitem__, p)) for p in pieces]
        for piece in misses:
            if len(piece) > LONGEST:
                del self[piece]
        return counts


_OWN: dict[bytes, Lengths] = {}


def lengths(model_file: bytes, table: LengthTable | None) -> Lengths:
    import sentencepiece

    key = hashlib.blake2b(model_file, digest_size=16).digest()
    if key not in _OWN or table is not None and _OWN[key].table is not table:
        _OWN[key] = Lengths(sentencepiece.SentencePieceProcessor(model_proto=model_file), table if table is not None else LengthTable({}))
    return _OWN[key]


def frequent(docs: DataFrame, text_col: str = "text") -> list[str]:
    """At most FREQUENT pre-tokens, the most frequent first. The driver gets no more than those, whatever the input."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(PIECE.findall(" " + text) if text else ())
                if len(seen) > 4 * SUMMARY:  # as Misra and Gries: what falls out counts against the rest
                    kept = seen.most_common(SUMMARY + 1)
                    seen = Counter({k: n - kept[-1][1] for k, n in kept[:-1] if n > kept[-1][1]})
        top = [(k, n) for k, n in seen.most_common(HANDED_ON) if n > 1 and len(k) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    top = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r.piece for r in top.orderBy(F.desc("n"), "piece").limit(FREQUENT).select("piece").collect()]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; a null text counts as empty: 0 and 0. Repeated rows stay, other columns go."""
    import sentencepiece

    spark = docs.sparkSession
    ship(spark)
    file = broadcast_file(spark, model_path)
    top = frequent(docs, text_col)
    model = sentencepiece.SentencePieceProcessor(model_proto=file.value)
    checked(model)
    table = spark.sparkContext.broadcast(LengthTable(dict(zip(top, model_lengths(model, top), strict=True)) if top else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            own = own or lengths(file.value, table.value.opened())
            for part in (b.slice(i, 500) for i in range(0, len(b), 500)):
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(own.counts(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(lean(run), f"id {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long")
