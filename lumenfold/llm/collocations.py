"""Phrase collocations of each language: n-grams as rows, counts, the score of the weakest cut, longest phrases only, ranks.

The texts are exploded into n-gram rows of 1 to ``max_words`` words, which are hash-aggregated by language in the task that
reads them and then across tasks. As an n-gram cannot be more frequent than its parts, and only n-grams of at least
``min_count`` occurrences enter any later step (candidates, their parts, their extensions), those with an infrequent part are not
exploded: words come first, then pairs of frequent words, then longer ones of which all pairs are frequent. Pairs and longer ones
are counted in cells first, 32 bits of a hash, and as texts only where their cell is full enough. Broadcast bitmaps of
fixed size tell what may be frequent; where they err, rows are counted that are dropped later, so counts are exact: phrases
are compared as texts, never as hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenfold.llm.common import BITMAP_BITS, bitmap, lean, mix, prefix_hash, ship, spans, stored, utf8, window_hash

#: Bytes of text of one language that are counted together in a task before Spark aggregates the rows.
CHUNK = 2 << 20
#: Languages up to which their totals are broadcast; beyond it they are joined as any table.
FEW_LANGUAGES = 10_000
#: Lots in which a language's phrases are ranked first, so that the last ranking sees at most so many times ``top`` rows.
LOTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0: part of a word, 1: between words, 2: between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2


class Words:
    """The words of some texts of one language: normalised bytes (one space behind each word), places, pieces, and numbers that
    are equal for equal words."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        kind = _KIND[data]
        solid = kind == 0
        after = np.r_[False, solid[:-1]]
        starts = np.flatnonzero(solid & ~after)
        self.bytes = np.where(solid, _LOWER[data], 32)[solid | after].astype(np.uint8)
        self.ends = np.flatnonzero(self.bytes == 32) if len(starts) else np.zeros(0, np.int64)  # words hold no spaces
        self.starts = np.r_[0, self.ends[:-1] + 1][: len(starts)]
        self.piece = np.cumsum(kind == 2)[starts]
        offsets = pa.py_buffer(np.r_[self.starts, len(self.bytes)].astype(np.int32))
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(self.bytes)])
        self.number = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(starts) else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def texts(self, at: np.ndarray, n: int) -> pa.Array:
        """The n words from each place on, with single spaces."""
        a, size = self.starts[at], self.ends[at + n - 1] - self.starts[at]
        offsets = np.r_[0, np.cumsum(size)]
        picked = self.bytes[np.repeat(a - offsets[:-1], size) + np.arange(offsets[-1])]
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(picked)])


def keys(language: bytes, phrases: pa.Array) -> np.ndarray:
    """64-bit keys of a language's phrases, for the bitmap."""
    data, off = utf8(phrases)
    own = window_hash(prefix_hash(np.frombuffer(language, np.uint8)), np.array([0]), np.array([len(language)]))
    return mix(window_hash(prefix_hash(data), off[:-1], off[1:]) + own).view(np.int64)


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[bytes]]]:
    """(language, texts) of a batch (lang, text), of about CHUNK bytes at most."""
    names = batch.column(0).cast(pa.string()).fill_null("und")
    for name in names.unique():
        own = batch.column(1).filter(pc.equal(names, name)).cast(pa.large_binary()).fill_null(b"").to_pylist()
        off = np.r_[0, np.cumsum([len(t) + 1 for t in own])]
        for i, j in spans(off, CHUNK):
            yield name.as_py().encode(), own[i:j]


def maybe(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the keys' bits."""
    b = np.mod(key, BITMAP_BITS)
    return (known[b >> 6] >> (b & 63) & 1).astype(bool)


def unique(code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places, numbers of all places, counts."""
    _, first, number, many = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    return at[first], number, many


def found(w: Words, language: bytes, sizes: range, known: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, first places, counts) of the distinct n-grams of these sizes: of pairs, those whose words may be in the bitmap
    ``known``, of longer ones those of which all pairs may be."""
    if not len(w):
        return
    first, number, many = unique(w.number, np.arange(len(w)))
    if sizes[0] == 1:
        yield 1, first, many
        return
    inside = w.piece[1:] == w.piece[:-1]
    if sizes[0] == 2:
        fine = maybe(known, keys(language, w.texts(first, 1)))[number]
        inside &= fine[1:] & fine[:-1]
    at = np.flatnonzero(inside)
    if not len(at):
        return
    first, code, many = unique(number[at] * len(w) + number[at + 1], at)
    if sizes[0] == 2:
        yield 2, first, many
        return
    pair = np.zeros(len(w), bool)  # whether a likely pair starts at a place
    pair[at] = maybe(known, keys(language, w.texts(first, 2)))[code]
    start, numbers = pair, np.zeros(len(w), np.int64)  # whether, and which, n-gram starts at a place
    numbers[at] = code
    for n in range(3, min(sizes[-1], len(w)) + 1):
        start = start & np.r_[pair[n - 2 :], np.zeros(n - 2, bool)]
        at = np.flatnonzero(start)
        if not len(at):
            return
        first, code, many = unique(numbers[at] * len(w) + number[at + n - 1], at)
        numbers[at] = code
        yield n, first, many


def cells(language: bytes, phrases: pa.Array) -> np.ndarray:
    """32 bits of the phrases' keys."""
    return (keys(language, phrases).view(np.uint64) >> np.uint64(32)).astype(np.int64)


def full_cells(docs: DataFrame, sizes: range, known, min_count: int):
    """The bitmap of the cells in which n-grams of these sizes occur ``min_count`` times or more together: those of all that are so
    frequent, and a few more. Rows of two numbers are counted for it, where phrases would be several times as large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for language, texts in by_language(batch):
                w = Words(texts)
                for n, first, many in found(w, language, sizes, known.value):
                    yield pa.RecordBatch.from_arrays([pa.array(cells(language, w.texts(first, n))), pa.array(many)], ["cell", "f"])

    counted = docs.select("lang", "text").mapInArrow(lean(run), "cell long, f long").groupBy("cell").agg(F.sum("f").alias("f"))
    return bitmap(counted.where(F.col("f") >= min_count), "cell")


def ngrams(docs: DataFrame, sizes: range, known=None, full=None) -> DataFrame:
    """(lang, phrase, size, f) of the n-grams of these sizes (see ``found``) whose cell may be in the bitmap ``full``, with their
    counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for language, texts in by_language(batch):
                w = Words(texts)
                for n, first, many in found(w, language, sizes, known and known.value):
                    phrases = w.texts(first, n)
                    if full is not None:
                        keep = pa.array(maybe(full.value, cells(language, phrases)))
                        phrases, many = phrases.filter(keep), many[keep.to_numpy(zero_copy_only=False)]
                    name = pa.array([language.decode()]).take(pa.array(np.zeros(len(phrases), np.int64)))
                    yield pa.RecordBatch.from_arrays([name, phrases, pa.array(np.full(len(phrases), n, np.int32)), pa.array(many)], ["lang", "phrase", "size", "f"])

    counted = docs.select("lang", "text").mapInArrow(lean(run), "lang string, phrase string, size int, f long")
    return counted.groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.sum("f").alias("f"))


def marked(frequent: DataFrame):
    """The bitmap of the keys of (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.zeros(len(b), np.int64)
            for name in b.column(0).unique():
                own = np.asarray(pc.equal(b.column(0), name))
                h[own] = keys(name.as_py().encode(), b.column(1).filter(pa.array(own)))
            yield pa.RecordBatch.from_arrays([pa.array(h)], ["h"])

    return bitmap(frequent.select("lang", "phrase").mapInArrow(run, "h long"), "h")


def counts(docs: DataFrame, max_words: int = 5, min_count: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all n-grams of up to ``max_words`` words with at least ``min_count`` occurrences, and (lang, n):
    all words of each language."""
    words = stored(ngrams(docs, range(1, 2)), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = [words.where(F.col("f") >= min_count)]
    for sizes in (range(2, 3), range(3, max_words + 1)):
        if sizes and sizes[0] <= max_words:
            known = marked(levels[-1])
            more = ngrams(docs, sizes, known, full_cells(docs, sizes, known, min_count)).where(F.col("f") >= min_count)
            levels.append(stored(more, "phrases"))
    out = levels[0]
    for f in levels[1:]:
        out = out.union(f)
    return out, totals


def exact(c: str) -> Column:
    return F.col(c).cast("decimal(18,0)")


def scored(frequent: DataFrame, totals: DataFrame, scale: int = 1000) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of each phrase of two words or more, by its weakest cut: score is
    floor(scale a n / (l r)), in decimals of 38 digits; of cuts with the same score the first counts."""
    phrase = frequent.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    cuts = phrase.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - size)").alias("right"))
    cuts = cuts.join(frequent.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(frequent.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    few = totals.count() <= FEW_LANGUAGES
    each = cuts.join(F.broadcast(totals) if few else totals, "lang")
    whole = each.select("*", exact("a").alias("da"), exact("n").alias("dn"), exact("l").alias("dl"), exact("r").alias("dr"))
    score = F.expr(f"(cast({scale} as decimal(9,0)) * cast(da * dn as decimal(28,0))) div (dl * dr)")
    best = whole.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")


def longest(phrases: DataFrame, percent: int = 100) -> DataFrame:
    """Phrases (lang, phrase, size, a) that no longer one holds with at least ``percent`` of their occurrences. A phrase of one word
    more that lies within the longer one occurs at least as often as that, so extensions by one word tell of all."""
    longer = phrases.where("size > 2").select("lang", F.col("a").alias("longer"), F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = phrases.join(most, ["lang", "phrase"]).where(100 * F.col("longer") >= percent * F.col("a")).select("lang", "phrase")
    return phrases.join(held, ["lang", "phrase"], "left_anti")


def best(phrases: DataFrame, top: int) -> DataFrame:
    """Each language's first ``top`` phrases with their rank: by score and occurrences descending, then bytewise. Phrases are
    ranked in lots first."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = phrases.withColumn("lot", F.pmod(F.xxhash64("phrase"), F.lit(LOTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lot").orderBy(*order))).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("lot")


def collocations(docs: DataFrame, max_words: int = 5, min_count: int = 100, top: int = 2000, percent: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's collocations. Other columns are not carried.

    A-Z are lower-cased, texts part at ``.,;:!?`` and line ends into pieces, and those at spaces and tabs into words; phrases
    never cross pieces. A null text is empty, a null language is ``und``. A text without words adds nothing; a table without rows,
    or without phrases that are frequent enough, gives none. A repeated row counts as often as it stands.
    """
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases have two words or more and occur")
    ship(docs.sparkSession)
    frequent, totals = counts(docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")), max_words, min_count)
    phrases = stored(longest(scored(frequent, totals), percent), "scored")
    return best(phrases, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
