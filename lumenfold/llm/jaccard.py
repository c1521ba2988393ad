"""N-gram Jaccard self-join with adaptive multi-match prefixes, giving classes and components.

A document's set has its distinct word n-grams as 64-bit hashes, ordered by frequency (rarest first) and then by hash.
Two sets whose similarity is t or more share at least m of the first n - ceil(t n) + m elements of each, for any m; a
document chooses its m (1 to 8) by the estimated cost of the candidates its prefix brings and of verifying them. Two
documents are compared at the lesser of their two m.

1. One pass estimates which n-grams are frequent; it only settles the order, which is as good as any other.
2. Equal sets are one class; one document stands for it from here on.
3. Prefix elements meet in a sort by element; what meets nothing (nearly all) is dropped there. The elements take turns, a part
   of all their values each, so that the disk holds the shuffled rows of one turn. Rows of an element that the estimate knows
   in over ``LOT`` documents are dealt in lots, here and in every later join by element.
4. Each element's first document is compared with the element's others; verified links make first components.
5. Only elements that still meet in different components go on. The rare ones give their pairs. The documents of
   frequent ones (over ``HOT`` at once) make families of like sizes, compared block by block: a block is a bounded number of
   whole sets and a comparison a product of incidence matrices, so that no pairs are listed; both ways are complete.

Candidates are dropped without their sets only by exact bounds: on sizes, on the number of shared prefix elements, and
on how many elements only one of the two has up to the place in the order where the first of the two prefixes ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenfold.llm.common import lean, maybe_in, mix, prefix_hash, release, ship, spans, stored, utf8, window_hash
from lumenfold.llm.components import components

MAX_MATCHES, VERIFY_COST = 8, 4.0
#: Places of a prefix whose keys are kept, evenly spread; the last is its end.
MARKS = 8
#: Of the frequency estimate: n-grams a task hands on, least count, and entries of the broadcast table (16 bytes each).
HANDED_ON, LEAST, TABLE = 100_000, 4, 1_000_000
HOT, BLOCK = 64, 512
#: Documents of one element that are dealt together; a more frequent one has several lots.
LOT = 2048
#: Prefix elements of a turn, and most turns.
TURN, TURNS = 4_000_000, 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, parted by space and bytes 9 to 13), and the n + 1 offsets of the texts' words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.r_[False, solid[:-1]]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    stops = np.flatnonzero(solid & (~np.r_[solid[1:], False] | edge[1:])) + 1
    return window_hash(prefix_hash(_LOWER[data]), starts, stops), np.searchsorted(starts, off)


def shingles(data: np.ndarray, off: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes and the texts' numbers, by text. Fewer than n words make one n-gram; none make none."""
    w, at = words(data, off)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    ends = np.repeat(at[1:], n)
    here = np.flatnonzero(np.arange(len(w)) + size <= ends)
    acc = mix(w[here])
    for k in range(1, size):
        acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + w[here + k])
    owner = row[here]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = []
        for i in short:
            h = np.full(1, n[i], np.uint64)
            for x in range(at[i], at[i + 1]):
                h = mix(h * np.uint64(0x9FB21C651E98DF25) + w[x : x + 1])
            whole.append(h[0])
        acc, owner = np.concatenate([acc, np.array(whole, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((acc, owner))
    acc, owner = acc[order], owner[order]
    keep = np.ones(len(acc), bool)
    keep[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
    return acc[keep], owner[keep]


def frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and counts of at most TABLE frequent n-grams, from bounded summaries of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, summary = [], 0, (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def fold() -> None:
            nonlocal held, n, summary
            if held:
                keys, counts = np.unique(np.concatenate(held), return_counts=True)
                keys, counts = np.concatenate([keys[counts > 1], summary[0]]), np.concatenate([counts[counts > 1], summary[1]])
                keys, at = np.unique(keys, return_inverse=True)
                counts = np.bincount(at, counts, len(keys)).astype(np.int64)
                best = np.argsort(-counts, kind="stable")[: 4 * HANDED_ON]
                summary, held, n = (keys[best], counts[best]), [], 0

        for b in batches:
            data, off = utf8(b.column(0))
            for i, j in spans(off):
                h, _ = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
                held.append(h)
                n += len(h)
                if n > 500_000:
                    fold()
        fold()
        best = np.argsort(-summary[1], kind="stable")[:HANDED_ON]
        yield pa.RecordBatch.from_arrays([pa.array(summary[0][best].view(np.int64)), pa.array(summary[1][best])], ["h", "n"])

    top = docs.select("text").mapInArrow(lean(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    rows = top.orderBy(F.desc("n"), "h").limit(TABLE).toPandas()
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["n"].to_numpy(np.int64)[order]


def prefixes(h: np.ndarray, owner: np.ndarray, n: np.ndarray, table: tuple[np.ndarray, np.ndarray], threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(elements in prefix order, how many of each text, each text's number of required matches, its MARKS keys)."""
    keys, counts = table
    at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
    df = np.where(keys[at] == h, counts[at], 0) if len(keys) else np.zeros(len(h), np.int64)
    rank = np.where(df == 0, h >> np.uint64(1), np.uint64(1 << 63) | np.minimum(df, (1 << 20) - 1).astype(np.uint64) << np.uint64(43) | h >> np.uint64(21))
    order = np.lexsort((h, rank, owner))
    h, df, rank = h[order], df[order], rank[order]
    first = np.cumsum(n) - n
    sums = np.r_[0, np.cumsum(df)]
    need = -(-threshold[0] * n // threshold[1])  # least overlap with any partner
    best, matches = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for m in range(1, MAX_MATCHES + 1):
        length = np.minimum(n - need + m, n)
        met = sums[first + length] - sums[first]
        cost = np.where(m <= np.maximum(need, 1), met + VERIFY_COST * met / m, np.inf)
        better = cost < best
        best, matches = np.where(better, cost, best), np.where(better, m, matches)
    length = np.where(n > 0, np.minimum(n - need + matches, n), 0)
    keep = np.arange(len(h)) - np.repeat(first, n) < np.repeat(length, n)
    marks = np.zeros((len(n), MARKS), np.uint64)
    some = n > 0
    at = np.maximum(length[some, None] * np.arange(1, MARKS + 1) // MARKS - 1, 0) + first[some, None]
    marks[some] = rank[at]
    return h[keep], length, matches, marks


def signatures(docs: DataFrame, size: int, threshold: tuple[int, int], table: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, n, c1, c2, matches, length, prefix, marks): set size, 128 bits that stand for the set, required matches, prefix elements
    and their number, and the places in the order of MARKS of them. ``table``: see ``frequent``."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            for i, j in spans(off):
                h, owner = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
                n = np.bincount(owner, minlength=j - i)
                sums = [np.r_[np.uint64(0), np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)] for salt in (0x1234567, 0x7654321ABCDEF)]
                ends = np.cumsum(n)
                c1, c2 = ((s[ends] - s[ends - n]).view(np.int64) for s in sums)
                elements, length, matches, marks = prefixes(h, owner, n, shared.value, threshold)
                listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pa.array(elements.view(np.int64)))
                signed = (marks ^ np.uint64(1 << 63)).view(np.int64)  # in the order of signed integers
                places = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * MARKS, pa.int32()), pa.array(signed.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(c1), pa.array(c2), pa.array(matches, pa.int32()), pa.array(length, pa.int64()), listed, places], ["id", "n", "c1", "c2", "matches", "length", "prefix", "marks"])

    return docs.select("id", "text").mapInArrow(lean(run), "id long, n long, c1 long, c2 long, matches int, length long, prefix array<long>, marks array<long>")


def in_lots(rows: DataFrame, table: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (h, doc, ...) with the number of lots of their element, by its estimated frequency, and their own lot (0 for most).
    The frequent elements are broadcast: those of TABLE at most, 16 bytes each."""
    keys, counts = table
    many = counts > LOT
    frame = pa.table({"h": pa.array(keys[many].view(np.int64)), "lots": pa.array(-(-counts[many] // LOT), pa.int64())})
    dealt = rows.join(F.broadcast(rows.sparkSession.createDataFrame(frame)), "h", "left").withColumn("lots", F.coalesce("lots", F.lit(1)))
    return dealt.withColumn("lot", F.pmod(F.xxhash64("doc"), "lots"))


def each_lot(elements: DataFrame) -> DataFrame:
    """A row for each lot of an element, from (h, lots, ...)."""
    return elements.withColumn("lot", F.explode(F.expr("sequence(0L, lots - 1)"))).drop("lots")


def representatives(live: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, n, matches, prefix) of a document of each class, those of classes of one document and, stored, those of the others.

    A bitmap of the classes (c1, c2, many) of several documents tells the rows that are alone for sure, nearly all; only the rest
    is shuffled with its prefixes.
    """
    doubtful = maybe_in(classes.where("many > 1"), "c1")("c1")
    several = live.where(doubtful).groupBy("c1", "c2").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("n", "matches", "prefix")))
    return live.where(~doubtful).select("id", "n", "matches", "prefix"), stored(several.select("id", "n", "matches", "prefix"), "representatives")


def meetings(rows: DataFrame) -> DataFrame:
    """Of rows (h, doc, n, matches, pos, lots, lot) those whose element another row has too, and those of elements with several
    lots. Rows come sorted by element and lot: a task holds a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of the batch before, and whether the row before it had its element
        for b in batches:
            if not len(b):
                continue
            t = pa.Table.from_batches([held[0], b]).combine_chunks().to_batches()[0] if held else b
            h = t.column(0).to_numpy()
            same = h[1:] == h[:-1]
            meets = np.r_[held[1] if held else False, same] | np.r_[same, False] | (t.column(5).to_numpy() > 1)
            yield t.filter(pa.array(np.r_[meets[:-1], False]))
            held = t.slice(len(t) - 1), bool(meets[-1])
        if held and held[1]:
            yield held[0]

    return rows.repartition("h", "lot").sortWithinPartitions("h", "lot", "doc").mapInArrow(lean(run), "h long, doc long, n long, matches int, pos int, lots long, lot long")


def sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, items binary): whole sets, as sorted unsigned 64-bit integers, of the documents of ``ids`` (id) and of few others: a
    bitmap tells which, so that no text is shuffled. Whoever reads the sets joins them by id."""
    wanted = maybe_in(ids, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            for i, j in spans(off):
                h, owner = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
                cuts = np.searchsorted(owner, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([h[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["id", "items"])

    return stored(docs.where("id IS NOT NULL").where(wanted(F.coalesce("id", F.lit(0)))).select("id", "text").mapInArrow(lean(run), "id long, items binary"), "sets")


def verified(pairs: DataFrame, whole: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that are similar, by their whole sets."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    left, right = (whole.select(F.col("id").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab")
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "items_a", "items_b").mapInArrow(lean(run), "a long, b long")


def possible(met: DataFrame, profiles: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) that may be similar, from meetings (a, b, n_a, n_b, m_a, m_b, pos_a, pos_b) and (id, length, marks) of prefixes."""
    num, den = threshold
    m = F.least("m_a", "m_b")

    def level(x: str):  # the least number of matches whose prefix has the element
        return F.col(f"pos_{x}") - (F.col(f"n_{x}") - F.ceil(num * F.col(f"n_{x}") / den)) + 1

    sized = met.where(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
    matched = F.count_if((level("a") <= m) & (level("b") <= m))
    both = sized.groupBy("a", "b").agg(F.count("*").alias("shared"), matched.alias("matched"), F.max("pos_a").alias("pos_a"), F.max("pos_b").alias("pos_b"), *(F.first(c).alias(c) for c in ("n_a", "n_b", "m_a", "m_b")))

    def close(apart):  # sets with similarity t or more differ in (n_a + n_b) (1 - t) / (1 + t) elements at most
        return apart * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num)

    some = both.where((F.col("matched") >= m) & close(F.col("pos_a") + F.col("pos_b") + 2 - 2 * F.col("shared")))
    for x in "ab":
        some = some.join(profiles.select(F.col("id").alias(x), F.col("length").alias(f"length_{x}"), F.col("marks").alias(f"marks_{x}")), x)
    end = F.least(F.element_at("marks_a", -1), F.element_at("marks_b", -1))

    def within(x: str):  # at least so many elements up to that end; all shared ones up to it have met
        before = F.size(F.filter(f"marks_{x}", lambda k: k < F.col("end")))
        return F.when(F.element_at(f"marks_{x}", -1) == F.col("end"), F.col(f"length_{x}")).otherwise(F.floor(F.col(f"length_{x}") * before / MARKS))

    return some.withColumn("end", end).where(close(within("a") + within("b") - 2 * F.col("shared"))).select("a", "b")


def side(rows: DataFrame, x: str) -> DataFrame:
    return rows.select("h", "lot", F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("matches").alias(f"m_{x}"), F.col("pos").alias(f"pos_{x}"), F.col("component").alias(f"c_{x}"))


def stars(rows: DataFrame) -> DataFrame:
    """Meetings of each element's first document with the element's others, where their components differ."""
    found = rows.groupBy("h").agg(F.max("lots").alias("lots"), F.min(F.struct("doc", "n", "matches", "pos", "component")).alias("p"))
    first = each_lot(found.select("h", "lots", F.col("p.doc").alias("a"), F.col("p.n").alias("n_a"), F.col("p.matches").alias("m_a"), F.col("p.pos").alias("pos_a"), F.col("p.component").alias("c_a")))
    return side(rows, "b").join(first, ["h", "lot"]).where("a <> b AND c_a <> c_b")


def mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their documents' components, of elements that meet in several."""
    labelled = rows.drop("component").join(labels.select(F.col("id").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    several = labelled.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("many"), F.max("lots").alias("lots")).where("lo < hi").select("h", "many", "lots")
    return stored(labelled.join(each_lot(several), ["h", "lot"]), "mixed")


def families(hot: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(id, family): documents that frequent elements bring together, where their sizes allow it.

    Sizes fall into bands a little wider than similar sets may differ; a document stands in its own band and the next one,
    so similar ones share a band. A family is what elements connect in one band, if it has several components.
    """
    base = math.log(1.005 * threshold[1] / threshold[0])
    own = F.floor(F.log(F.col("n").cast("double")) / base)
    banded = hot.select("h", "lots", "lot", "doc", "component", F.explode(F.array(own, own + 1)).alias("band")).withColumn("node", F.xxhash64("doc", "band"))
    first = banded.groupBy("h", "band").agg(F.max("lots").alias("lots"), F.min("node").alias("a"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("h", "band", "a", "lots")
    edges = banded.join(each_lot(first), ["h", "band", "lot"]).select("a", F.col("node").alias("b"))
    named = components(edges).select(F.col("id").alias("node"), F.col("component").alias("family"))
    return stored(named.join(banded.select("node", F.col("doc").alias("id")).distinct(), "node").select("id", "family"), "families")


def block_links(families: DataFrame, whole: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Similar pairs among documents of one family, from blocks of BLOCK whole sets at most.

    Each block is sent to the comparisons it takes part in, as many as its family has blocks; what a comparison gives are
    links, and of those only a forest of its own documents.
    """
    num, den = threshold
    sizes = families.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).alias("k"))
    placed = families.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64(F.lit(11), "id"), "k"))
    sent = placed.select("id", "family", "block", F.explode(F.expr("sequence(0L, k - 1)")).alias("other")).select("id", "family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).alias("second"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: list[tuple]) -> pa.RecordBatch:
            ids = np.array([r[0] for r in rows], np.int64)
            items = [np.frombuffer(r[1], np.uint64) for r in rows]
            n = np.array([len(x) for x in items])
            h = np.concatenate(items)
            _, column, many = np.unique(h, return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(n)), n)
            own = np.flatnonzero(many > 1)
            number = np.full(len(many), -1)
            number[own] = np.arange(len(own))
            column = number[column]
            row, column = row[column >= 0], column[column >= 0]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            both = np.zeros((len(n), len(n)), np.float32)
            for start in range(0, len(own), 4096):  # the shared elements, some columns at a time
                lo, hi = np.searchsorted(column, [start, start + 4096])
                part = np.zeros((len(n), min(4096, len(own) - start)), np.float32)
                part[row[lo:hi], column[lo:hi] - start] = 1
                both += part @ part.T
            similar = den * both >= num * (n[:, None] + n[None, :] - both)
            a, b = np.nonzero(np.triu(similar, 1))
            parent = list(range(len(n)))
            out = []
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                i, j = x, y
                while parent[i] != i:
                    parent[i] = i = parent[parent[i]]
                while parent[j] != j:
                    parent[j] = j = parent[parent[j]]
                if i != j:
                    parent[max(i, j)] = min(i, j)
                    out.append((x, y))
            x, y = (np.array(out, np.int64).reshape(-1, 2)).T
            return pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], ["a", "b"])

        key, held = None, []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and r[:3] != key:
                    yield links(held)
                    held = []
                key = r[:3]
                held.append(r[3:])
        if held:
            yield links(held)

    full = sent.drop("second").join(whole, "id").select("family", "lo", "hi", "id", "items")
    return full.repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi", "id").mapInArrow(lean(run), "a long, b long")


def join(docs: DataFrame, size: int = 5, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id): set size, least id with an equal set, least id reachable by links of
    similarity ``threshold`` or more. A row for each row of the input.

    Null and empty texts, and texts of white space, have an empty set and are linked with nothing. A repeated id is one
    document with all its texts. A row with a null id is counted (n_shingles) but takes no part: its class and component
    are null. Other columns are not carried.
    """
    ship(docs.sparkSession)
    num = round(threshold * 100)
    limit = (num // math.gcd(num, 100), 100 // math.gcd(num, 100))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table = frequent(own, size)
    full = stored(signatures(own, size, limit, table), "prefixes")
    signed = stored(full.drop("prefix"), "signatures")  # all that is needed after the meetings
    live = signed.where("n > 0 AND id IS NOT NULL")
    classes = stored(live.groupBy("c1", "c2").agg(F.min("id").alias("class_id"), F.count("*").alias("many")), "classes")
    alone, several = representatives(full.where("n > 0 AND id IS NOT NULL"), classes)
    rows = alone.union(several).select(F.col("id").alias("doc"), "n", "matches", F.posexplode("prefix").alias("pos", "h")).select("h", "doc", "n", "matches", "pos")
    profiles = live.select("id", "length", "marks")
    turns = min(TURNS, -(-(live.agg(F.sum("length")).first()[0] or 1) // TURN))
    parts = []
    for turn in range(turns):
        own_turn = rows.where(F.pmod(F.col("h"), F.lit(turns)) == turn)
        parts.append(stored(meetings(in_lots(own_turn, table).select(*rows.columns, "lots", "lot")), "meetings"))
    met = reduce(DataFrame.union, parts)
    release(full, several)
    own = own.where("id IS NOT NULL")

    pairs = stored(possible(stars(met.withColumn("component", F.col("doc"))), profiles, limit), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    whole = sets(own, ids, size)
    links = stored(verified(pairs, whole, limit), "links")
    release(pairs, whole)
    labels = components(links)

    rest = mixed(met, labels)
    release(*parts, labels)
    rare, hot = rest.where(F.col("many") <= HOT), rest.where(F.col("many") > HOT)
    more = stored(possible(side(rare, "a").drop("lot").join(side(rare, "b").drop("lot"), "h").where("a < b AND c_a <> c_b"), profiles, limit), "pairs")
    groups = families(hot, limit)
    release(rest)
    ids = more.select(F.col("a").alias("id")).union(more.select("b")).union(groups.select("id")).distinct()
    whole = sets(own, ids, size)
    found = [links, stored(verified(more, whole, limit), "links"), stored(block_links(groups, whole, limit), "links")]
    release(more, groups, whole)
    labels = components(found[0].union(found[1]).union(found[2]))
    release(*found)

    # The classes are stored, so that both sides of the last join are dealt for it alone: then a class of very many equal sets is
    # split over tasks.
    named = classes.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left").select("c1", "c2", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    found = live.select("id", "n", "c1", "c2").join(named, ["c1", "c2"]).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "class_id", "component_id")
    alone = signed.where("n = 0 OR id IS NULL").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    return found.union(alone)
