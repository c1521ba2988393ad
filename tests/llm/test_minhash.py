"""MinHash near duplicates and alternating stars against brute force."""

import random
import re

import numpy as np
import pytest

from lumenfold.llm import components, jaccard, minhash, queries


def similar_components(texts, size=3, percent=85):
    sets, least = [], []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    least = list(range(len(sets)))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            small, large = sorted((len(a), len(sets[j])))
            if small and 100 * small >= percent * large and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root(i), root(j)
                least[max(x, y)] = min(x, y)
    return [(i, len(s), root(i), root(i) == i) for i, s in enumerate(sets)]


def edited(draw, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split(" ")
        for _ in range(draw.randint(0, edits)):
            w[draw.randrange(len(w))] = f"w{draw.randint(0, 99)}"
        out.append(" ".join(w))
    return out


def found(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


@pytest.mark.parametrize("small", [64, 6])
def test_families_that_fall_apart(spark, monkeypatch, small):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdef") for _ in range(4))
    texts = []
    for n, edits in ((60, 3), (50, 8), (40, 14)):
        texts += edited(draw, " ".join(word() for _ in range(120)), n, edits)
    passage = " ".join(word() for _ in range(90))
    texts += [passage + " " + " ".join(word() for _ in range(draw.choice([3, 9, 20]))) for _ in range(40)]
    texts += ["", None, " \n\t", "a", "A", "a b", "é É", "é É", "x " * 30000, "x " * 29999 + "\x0b"]
    draw.shuffle(texts)
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    frame = spark.createDataFrame([(i, t, "c", b"s", i) for i, t in enumerate(texts)], "doc_id long, text string, component_id string, signature binary, n int").repartition(3)
    want = similar_components(texts)
    assert len({c for _, _, c, _ in want}) > 30
    assert found(minhash.near_duplicates(frame)) == want


def test_null_and_repeated_ids(spark):
    odd = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b"), (1, "c"), (2, "A b"), (2, "A b"), (3, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(odd).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == sorted([(None, 1, None, True), (None, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 0, 3, True)], key=str)
    assert minhash.near_duplicates(odd.where("false")).count() == 0


def test_minima_are_those_of_each_function():
    draw = np.random.default_rng(1)
    h = draw.integers(0, 1 << 63, 50, np.uint64)
    factors, terms = minhash.functions(7)
    got = minhash.minima(h, np.array([0, 20, 21]), factors, terms)
    for row, part in zip(got, (h[:20], h[20:21], h[21:]), strict=True):
        assert row.tolist() == [min((int(x) * int(a) + int(b)) % 2**64 for x in part) >> 32 for a, b in zip(factors, terms, strict=True)]


def test_alternating_stars(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(draw.randint(100, 180), draw.randint(100, 180)) for _ in range(60)] + [(7, 7), (900, 900), (None, 3), (500, 7)] * 2
    edges += [(300, i) for i in range(301, 360)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = components.alternating(spark.createDataFrame(edges, "a long, b long").repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == sorted((x, root(x)) for x in list(parent))
    assert components.alternating(spark.createDataFrame([], "a long, b long")).count() == 0


def test_minhash_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = [(rows[i].doc_id, n, rows[c].doc_id, kept) for i, n, c, kept in similar_components([r.text for r in rows])]
    assert found(queries.op13_minhash_near_duplicates(spark, sf)) == want
