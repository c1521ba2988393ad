"""Collocations against brute force, and their query against SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

from lumenfold.llm import collocations, queries


def brute(rows, max_words, least, top, percent=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    often = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = {}
    for (lang, *p), a in often.items():
        if any(q[0] == lang and len(q) > len(p) + 1 and 100 * b >= percent * a and inside(p, list(q[1:])) for q, b in often.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, *p[:k]] * f[lang, *p[k:]]), k, f[lang, *p[:k]], f[lang, *p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def corpus(draw):
    word = lambda: draw.choice(["a", "B", "c", "new", "York", "é", "É", "x-y", "\x1c", "日本"])
    gap = lambda: draw.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!? ", "\x0b", "\r\n"])
    rows = []
    for _ in range(150):
        parts = [draw.choice(["New york city", "the red Apple of my eye", word(), word(), word(), word()]) + gap() for _ in range(draw.randint(0, 40))]
        rows.append((draw.choice(["en", "en", "en", "de", None, "und", ""]), "".join(parts)))
    return rows + [("en", None), (None, ""), ("xx", " \t\n"), ("fr", "long " * 30000), *[("en", "same row here. same row")] * 30]


@pytest.mark.parametrize(("max_words", "least", "top", "percent"), [(5, 8, 2000, 100), (2, 3, 7, 100), (3, 5, 4, 60), (4, 1, 50, 100)])
def test_collocations_against_brute_force(spark, monkeypatch, max_words, least, top, percent):
    monkeypatch.setattr(collocations, "LOTS", 3)
    rows = corpus(random.Random(5))
    frame = spark.createDataFrame([(lang, text, 1, "p") for lang, text in rows], "lang string, text string, rank int, phrase string").repartition(4)
    found = collocations.collocations(frame, max_words, least, top, percent)
    want = brute(rows, max_words, least, top, percent)
    assert len(want) > 10
    assert sorted(map(tuple, found.collect())) == want


def test_small_chunks_and_no_rows(spark, monkeypatch):
    rows = corpus(random.Random(6))[:60]
    frame = spark.createDataFrame(rows, "lang string, text string")
    parts = list(collocations.by_language(frame.coalesce(1).toArrow().combine_chunks().to_batches()[0]))
    assert sorted((k, t) for k, own in parts for t in own) == sorted(((lang if lang is not None else "und").encode(), (t or "").encode()) for lang, t in rows)
    assert collocations.collocations(frame.where("false")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None)], "lang string, text string"), min_count=1).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(frame, max_words=1)


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, left, right = 10**12 + 7, 9 * 10**14 + 1, 2 * 10**12 + 11, 10**12 + 39
    frequent = spark.createDataFrame([("en", "x", 1, left), ("en", "y", 1, right), ("en", "x y", 2, a)], "lang string, phrase string, size int, f long")
    row = collocations.scored(frequent, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert row.score == 1000 * a * n // (left * right)


def test_collocation_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.SQL["op11_collocations"])
    columns = [d[0] for d in want.description]
    got = queries.op11_collocations(spark, sf).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) > 20
