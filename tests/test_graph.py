"""Communities that settle, their modularity, and similar works, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import graph as G


def q(edges, label):
    pairs = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    m = len(pairs)
    out = 0.0
    for c in set(label.values()):
        ends = sum(label[a] == c for a, _ in pairs)
        out += sum(label[a] == c == label[b] for a, b in pairs) / m - (ends / m) ** 2
    return out


def propagate(edges, half, patience=4, most=50):
    pairs = {(a, b) for a, b in edges if a != b} | {(b, a) for a, b in edges if a != b}
    label = {a: a for a, _ in pairs}
    best, top, since, still = label, q(pairs, label), 0, 0
    for n in range(most):
        new = dict(label)
        for v in label:
            if half[v] == n % 2:
                votes = [label[b] for a, b in pairs if a == v] + [label[v]]
                new[v] = min(set(votes), key=lambda x: (-votes.count(x), x))
        still = 0 if new != label else still + 1
        label = new
        if still == 2:
            break
        if still == 0:
            now = q(pairs, label)
            best, top, since = (label, now, 0) if now > top else (best, top, since + 1)
            if since == patience:
                break
    return best


def graphs():
    draw = random.Random(3)
    cliques = [(a + k * 10, b + k * 10) for k in range(3) for a in range(6) for b in range(a)] + [(0, 10), (10, 20)]
    star = [(100, i) for i in range(30)]
    pairs = [(i, 50 + i) for i in range(8)]  # two neighbours that would swap labels
    loose = [(draw.randrange(40), draw.randrange(40)) for _ in range(70)]
    return [cliques, star, pairs, loose]


@pytest.mark.parametrize("edges", graphs())
def test_communities_settle(spark, edges):
    frame = spark.createDataFrame(edges, "src long, dst long")
    labels = G.settled_communities(frame)
    half = {r.id: r.h for r in labels.select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("h")).collect()}
    got = {r.id: r.label for r in labels.collect()}
    want = propagate(edges, half)
    pairs = [(a, b) for a, b in edges if a != b]
    assert q(pairs, got) == pytest.approx(q(pairs, want)) and got == want
    assert G.modularity(frame.where("src <> dst"), labels).first().modularity == pytest.approx(q(pairs, got))
    assert q(pairs, got) >= q(pairs, {v: v for v in got})


def test_cliques_are_found(spark):
    got = {r.id: r.label for r in G.settled_communities(spark.createDataFrame(graphs()[0], "src long, dst long")).collect()}
    assert len({got[v] for v in range(6)}) == len({got[v] for v in range(10, 16)}) == 1 and got[3] != got[13] != got[23]


def test_similar_works(spark):
    works = spark.createDataFrame([(1, "kbs", 2000), (2, "kbs", 2001), (3, "mbc", 2000), (4, None, None), (5, "kbs", 2000)], "work long, channel string, year int")
    cast = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (2, 8), (3, 8), (3, 9), (4, 7), (5, 99)], "work long, member long")
    genre = spark.createDataFrame([(1, 1), (3, 1), (5, 2)], "work long, member long")
    rows = G.similar_works(works, {"cast": cast, "genre": genre}, 1, {"cast": 2.0, "genre": 1.0, "year": 1.0, "channel": 0.5}).collect()
    got = [(r.related, r.cast, r.genre, r.year, r.channel, r.score) for r in rows]
    assert got == [(2, 1.0, 0.0, 0.5, 1.0, 3.0), (3, pytest.approx(1 / 3), 1.0, 1.0, 0.0, pytest.approx(2.666667)), (4, 0.5, 0.0, 0.0, 0.0, 1.0)]
    assert G.similar_works(works, {"cast": cast}, 77, {}).count() == 0
