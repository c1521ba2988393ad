"""Sum-of-squares online packing of token sequences into windows of a fixed length.

A document's full windows are sequences of their own. Its remainder goes to the fill level at which the sum of the
squared counts of partially filled windows becomes least; the counts stand in an array by level. Every task packs the
documents it reads, so there is no shuffle, and at most one window a task is not full at the end: what is left open
is closed by cutting the pieces of the emptiest windows into the gaps of the fullest ones, and the last window becomes
sequences whose lengths are powers of two.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lumenfold.llm.bpe import LONGEST, PIECE
from lumenfold.llm.common import broadcast_file, lean, ship

SCHEMA = "doc_id {}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


#: Fixed value: the pattern of the library's byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that a byte-level vocabulary writes bytes with: printable ones as they are, others from 256 on in turn."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}

#: Pieces of LONGEST characters at most whose ids a worker keeps, for tokenizers that are not plain ranks.
KEPT = 200_000


class Tokenized:
    """Ids as the tokenizers library gives them for one of its files.

    A plain byte-level BPE whose ids ascend with its merges is a table of ranks, which tiktoken encodes by several times
    faster, with the same ids. Other files, and texts with the string of an added token (which the library takes for that
    token), go through the library, with a bounded memo of the pieces between white space (see ``bpe.PIECE``).
    """

    def __init__(self, file: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_str(file.decode()), {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = self._ranks(json.loads(file), set(added))

    @staticmethod
    def _ranks(spec: dict, added: set[str]):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return None
        vocab, letters = model["vocab"], byte_letters()
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged[:-1], merged[1:], strict=True)) or merged and min(merged) < 256:
            return None
        import tiktoken

        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in added}
        return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [not (self.added and self.added.search(t)) for t in texts]
        if self.fast:
            one = self.fast.encode_ordinary
            return [np.array(one(t) if p else self._library(t), np.uint32) for t, p in zip(texts, plain, strict=True)]
        pieces = [PIECE.findall(t) if p else None for t, p in zip(texts, plain, strict=True)]
        if len(self.memo) >= KEPT:
            self.memo.clear()
        new = list(set().union(*(p for p in pieces if p)).difference(self.memo))
        if new:
            for piece, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                self.memo[piece] = np.array(e.ids, np.uint32).tobytes()
        get = self.memo.__getitem__
        found = [np.frombuffer(b"".join(map(get, p)), np.uint32) if p is not None else np.array(self._library(t), np.uint32) for t, p in zip(texts, pieces, strict=True)]
        for piece in new:
            if len(piece) > LONGEST:
                del self.memo[piece]
        return found

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


_OWN: dict[bytes, Tokenized] = {}


def tokenized(file: bytes) -> Tokenized:
    key = hashlib.blake2b(file, digest_size=16).digest()
    if key not in _OWN:
        _OWN[key] = Tokenized(file)
    return _OWN[key]


class Packer:
    """One task's windows. ``counts[h]``: how many windows are filled up to h, for 0 < h < size."""

    def __init__(self, size: int, first_id: int) -> None:
        self.size, self.next_id, self.out = size, first_id, []
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(size + 1)]

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, ids, total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def level(self, n: int) -> int:
        """The level to put n tokens on: least growth of the sum of squares, the fullest window of equal ones."""
        last = self.size - n
        before = self.counts[: last + 1]
        growth = 1 - 2 * before
        growth[0] = 0
        after = 2 * self.counts[n:] + 1
        after[-1] = 0  # a full window no longer counts
        growth += after
        growth[1:][before[1:] == 0] = np.iinfo(np.int64).max
        return last - int(np.argmin(growth[::-1]))

    def add(self, doc, ids: np.ndarray) -> None:
        total = len(ids)
        full = total - total % self.size
        for at in range(0, full, self.size):
            self.emit([(doc, at, ids[at : at + self.size], total)])
        if n := total - full:
            h = self.level(n)
            window = self.open[h].pop() if h else []
            window.append((doc, full, ids[full:], total))
            if h:
                self.counts[h] -= 1
            if h + n == self.size:
                self.emit(window)
            else:
                self.counts[h + n] += 1
                self.open[h + n].append(window)

    def close(self) -> None:
        """Fill the fullest windows from the emptiest; cut the last one at powers of two."""
        left = [(h, w) for h in range(self.size) for w in self.open[h]]
        while len(left) > 1:
            fill, window = left.pop()
            while fill < self.size and left:
                h, donor = left[0]
                doc, start, ids, total = donor.pop()
                room = self.size - fill
                cut = max(0, len(ids) - room)
                window.append((doc, start + cut, ids[cut:], total))
                fill += len(ids) - cut
                if cut:
                    donor.append((doc, start, ids[:cut], total))
                h -= len(ids) - cut
                left[0] = (h, donor)
                if not h:
                    left.pop(0)
            if fill == self.size:
                self.emit(window)
            else:
                left.append((fill, window))
        for fill, window in left:
            for bit in range(fill.bit_length() - 1, -1, -1):
                room, taken = fill & 1 << bit, []
                while room:
                    doc, start, ids, total = window.pop(0)
                    taken.append((doc, start, ids[:room], total))
                    if len(ids) > room:
                        window.insert(0, (doc, start + room, ids[room:], total))
                    room -= min(room, len(ids))
                if taken:
                    self.emit(taken)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: (doc_id, start, length, ids, doc_tokens, sequence_id, offset), every id in exactly one piece.

    ``ids`` are little-endian unsigned 32-bit. A null or empty text is a document of ``end_id`` alone. Repeated rows are
    documents of their own; other columns are not carried. A sequence's id has the task's number above its own.
    """
    ship(docs.sparkSession)
    file = broadcast_file(docs.sparkSession, tokenizer_path)
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer, kind = tokenized(file.value), Packer(size, TaskContext.get().partitionId() << 40), None

        def flush() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            doc, start, ids, total, sequence, offset = map(list, zip(*rows, strict=True)) if rows else [[]] * 6
            columns = [pa.array(doc, kind), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            kind = b.column(0).type
            for part in (b.slice(i, 500) for i in range(0, len(b), 500)):
                for doc, ids in zip(part.column(0).to_pylist(), own.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    packer.add(doc, np.append(ids, np.uint32(end_id)))
                yield flush()
        packer.close()
        if packer.out:
            yield flush()

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(lean(run), SCHEMA.format(dict(docs.dtypes)[id_col]))


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
