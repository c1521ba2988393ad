"""Near duplicates by MinHash: many universal hash minima, banding, verification of signatures and of whole sets, components.

A document's set has its distinct word n-grams as 64-bit hashes. Its signature has, for each of ``bands * rows`` functions
a x + b modulo 2**64 (a odd, both random), the least value over the set; two sets agree in such a place with the probability of
their similarity. Documents that agree in all ``rows`` places of a band meet in a bucket.

1. Equal sets are one class; one document stands for it from here on.
2. Each bucket's first document is compared with the bucket's others: by sizes, by signatures, then by whole sets. The
   verified links make first components, by alternating large-star and small-star.
3. Buckets that still hold several components are compared in full: small ones give their pairs of different components,
   documents of large ones are compared in blocks of whole sets. So no pairs of a family of copies are listed.

Every link given is verified exactly. A link can only be missed by chance: with 24 bands of 5 rows a pair whose similarity is
0.85 stays apart in all bands with a probability under 1e-6 (0.90: 1e-9), and signatures drop it with one under 1e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenfold.llm.common import lean, mix, release, ship, spans, stored, utf8
from lumenfold.llm.components import alternating
from lumenfold.llm.jaccard import block_links, families, mixed, sets, shingles, verified

BANDS, ROWS = 24, 5
#: Documents of a bucket whose pairs are listed; larger buckets are compared in blocks.
SMALL = 64
#: Standard deviations below the threshold at which an estimate still lets a pair through.
DOUBT = 5.5


def functions(n: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and terms of n universal hash functions."""
    draw = np.random.default_rng(seed)
    return draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, n, np.uint64)


def minima(h: np.ndarray, starts: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The upper 32 bits of each function's least value over each run h[starts[i] : starts[i + 1]]."""
    out = np.empty((len(starts), len(factors)), np.uint32)
    values = np.empty_like(h)
    for k, (a, b) in enumerate(zip(factors, terms, strict=True)):
        np.multiply(h, a, out=values)
        values += b
        out[:, k] = np.minimum.reduceat(values, starts) >> np.uint64(32)
    return out


def signatures(docs: DataFrame, size: int, places: int) -> DataFrame:
    """(id, n, c1, c2, signature): set size, 128 bits that stand for the set, and its minima; empty sets have no signature."""
    factors, terms = functions(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            for i, j in spans(off):
                h, owner = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
                n = np.bincount(owner, minlength=j - i)
                ends = np.cumsum(n)
                sums = [np.r_[np.uint64(0), np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)] for salt in (0x1234567, 0x7654321ABCDEF)]
                c1, c2 = ((s[ends] - s[ends - n]).view(np.int64) for s in sums)
                signed: list[bytes | None] = [None] * (j - i)
                some = np.flatnonzero(n)
                if len(some):
                    for at, row in zip(some.tolist(), minima(h, (ends - n)[some], factors, terms), strict=True):
                        signed[at] = row.tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(c1), pa.array(c2), pa.array(signed, pa.binary())], ["id", "n", "c1", "c2", "signature"])

    return docs.select("id", "text").mapInArrow(lean(run), "id long, n long, c1 long, c2 long, signature binary")


def buckets(signed: DataFrame, bands: int, rows: int) -> DataFrame:
    """(h, doc, n): a row for each band of each signature; h stands for the band and its minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            places = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(len(b), bands, rows).astype(np.uint64)
            h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(b), bands)).copy()
            for k in range(rows):
                h = mix(h * np.uint64(0x9FB21C651E98DF25) + places[:, :, k])
            each = np.repeat(np.arange(len(b)), bands)
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), b.column(0).take(each), b.column(1).take(each)], ["h", "doc", "n"])

    return signed.select("doc", "n", "signature").mapInArrow(lean(run), "h long, doc long, n long")


def alike(pairs: DataFrame, signed: DataFrame, threshold: float, places: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in as many places as similar sets' do."""
    least = math.floor(places * threshold - DOUBT * math.sqrt(places * threshold * (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(len(b), places) for c in (2, 3))
            yield b.filter(pa.array((x == y).sum(1) >= least)).select(["a", "b"])

    left, right = (signed.select(F.col("doc").alias(x), F.col("signature").alias(f"signature_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "signature_a", "signature_b").mapInArrow(lean(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 3, threshold: float = 0.85, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept): set size, least id with an equal set, least id reachable by links of
    similarity ``threshold`` or more, and whether that is the document itself. A row for each row of the input.

    Null and empty texts, and texts of white space, have an empty set, are linked with nothing and kept. A repeated id is one
    document with all its texts; each of its rows says the same of ``kept``. A row with a null id is counted (n_shingles) but takes
    no part: its class and component are null and it is kept. Other columns are not carried.
    """
    ship(docs.sparkSession)
    num = round(threshold * 100)
    limit = (num // math.gcd(num, 100), 100 // math.gcd(num, 100))
    num, den = limit
    places = bands * rows
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = stored(signatures(own, size, places), "signatures", "zstd")
    live = signed.where("n > 0 AND id IS NOT NULL")
    classes = stored(live.groupBy("c1", "c2").agg(F.min("id").alias("doc"), F.first("n").alias("n"), F.first("signature").alias("signature")), "classes", "zstd")
    own = own.where("id IS NOT NULL")

    each = buckets(classes, bands, rows)
    first = each.groupBy("h").agg(F.min(F.struct("doc", "n")).alias("p"), F.count("*").alias("many")).where("many > 1").select("h", F.col("p.doc").alias("a"), F.col("p.n").alias("n_a"))
    met = stored(each.join(first, "h"), "meetings")
    sized = den * F.least("n", "n_a") >= num * F.greatest("n", "n_a")
    stars = met.where(sized & (F.col("doc") != F.col("a"))).select("a", F.col("doc").alias("b")).distinct()
    pairs = stored(alike(stars, classes, threshold, places), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    links = stored(verified(pairs, sets(own, ids, size), limit), "links")
    labels = stored(alternating(links), "labels")

    rest = mixed(met.select("h", "doc", "n", F.lit(1).cast("long").alias("lots"), F.lit(0).cast("long").alias("lot")), labels)
    side = lambda x: rest.where(F.col("many") <= SMALL).select("h", F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("component").alias(f"c_{x}"))
    across = side("a").join(side("b"), "h").where("a < b AND c_a <> c_b").where(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
    more = stored(alike(across.select("a", "b").distinct(), classes, threshold, places), "pairs")
    groups = families(rest.where(F.col("many") > SMALL), limit)
    ids = more.select(F.col("a").alias("id")).union(more.select("b")).union(groups.select("id")).distinct()
    whole = sets(own, ids, size)
    links = links.union(stored(verified(more, whole, limit), "links")).union(stored(block_links(groups, whole, limit), "links"))
    labels = stored(alternating(links), "labels")
    release(met, rest)

    named = classes.join(labels, classes.doc == labels.id, "left").select("c1", "c2", F.col("doc").alias("class_id"), F.coalesce("component", "doc").alias("component_id"))
    found = live.select("id", "n", "c1", "c2").join(named, ["c1", "c2"]).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "class_id", "component_id")
    alone = signed.where("n = 0 OR id IS NULL").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
