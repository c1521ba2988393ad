"""The stored text index with its cover density, and the stored vector index, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import fulltext as X
from lumenfold.operators import retrieval as R
from lumenfold.operators import vectors as N
from lumenfold.plans import q_retrieval, registry

DOC = "doc_id long, title string, aliases string, body string, synopsis string, channel string, year int"


def cover_density(places, words):
    """By the definition: every extent with all words that holds no other such extent."""
    own = [(pos, token, w) for pos, token, w in sorted(places) if token in words]
    extents = [(a, b) for a in range(len(own)) for b in range(a, len(own)) if {t for _, t, _ in own[a : b + 1]} == set(words)]
    minimal = [(a, b) for a, b in extents if not any((c, d) != (a, b) and a <= c and d <= b for c, d in extents)]
    total = 0.0
    for a, b in minimal:
        inside = own[a : b + 1]
        total += len(inside) / sum(1 / w for *_, w in inside) / (1 + own[b][0] - own[a][0] + 1 - len(inside))
    return round(total, 6)


def corpus(spark):
    draw = random.Random(2)
    text = lambda n: " ".join(draw.choice(["the", "and", "with", "a", "b", "둘", "c"]) for _ in range(draw.randint(0, n)))
    rows = [(i, text(4), text(2), text(40), text(9), draw.choice(["kbs", "mbc", None]), draw.choice([1999, 2000, None])) for i in range(80)]
    return spark.createDataFrame([*rows, (80, None, None, None, None, None, None)], DOC), rows


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs, rows = corpus(spark)
    return X.TextIndex.write(docs, str(tmp_path_factory.mktemp("text") / "index"), carried=["channel", "year"], buckets=8), docs, rows


def places(row):
    out = []
    for text, w in zip(row[1:5], X.FIELD_WEIGHTS.values(), strict=True):
        out += [(t, w) for t in text.split()]
    return [(i, t, w) for i, (t, w) in enumerate(out)]


@pytest.mark.parametrize("words", [["the"], ["the", "and"], ["the", "and", "with"], ["둘", "with"]])
def test_cover_density(index, words):
    found = {r.doc_id: r for r in index[0].matches(X.websearch(" ".join(words))).collect()}
    for row in index[2]:
        own = [(p, t, w) for p, t, w in places(row) if t in words]
        assert (row[0] in found) == bool(own)
        if own:
            r = found[row[0]]
            assert r.every == ({t for _, t, _ in own} == set(words))
            assert r.cover == pytest.approx(cover_density(own, words), abs=2e-6) and r.mass == pytest.approx(sum(w for *_, w in own))


@pytest.mark.parametrize("said", ["the and with", '"the and" -b', "둘 or the a", '"a b" or "b a" -with', "nothing", "-the", ""])
def test_index_gives_what_the_texts_give(index, said):
    search = X.websearch(said)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(index[0].matches(search)) == key(X.matches(index[1], search))
    near = index[1].where("year = 1999 AND channel = 'kbs'")
    assert key(index[0].matches(search, R.allowed(R.Plan("", "", 1999, 1999, "kbs")))) == key(X.matches(near, search))
    if tokens := X.wanted_tokens(search):
        assert sorted(map(tuple, index[0].any_of(tokens).collect())) == key(index[0].matches(search).select("doc_id", "mass"))


def test_only_the_words_buckets_are_read(index):
    plan = index[0].places(["the"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "(token,the)" in plan.split("PushedFilters")[1]


def test_an_index_is_written_once(index, tmp_path):
    path = str(tmp_path / "index")
    first = X.TextIndex.write(index[1].where("doc_id < 3"), path)
    X.TextIndex.write(index[1], path)
    assert X.TextIndex(first.spark, path).rows.agg(F.max("doc_id")).first()[0] < 3
    assert [p.name for p in tmp_path.iterdir() if p.name != "index"] == []


def test_retriever_with_indexes_gives_the_same(spark, index, tmp_path):
    docs = index[1].withColumn("embedding", F.array(*(F.sin(F.col("doc_id") * (k + 1)) for k in range(8))))
    embedder = R.HashEmbedder(8)
    vectors = N.VectorIndex.write(docs.select(F.col("doc_id").alias("id"), "embedding", "channel", "year"), str(tmp_path / "v"), cells=4, carried=["channel", "year"])
    vectors.probed = 4
    plain, stored = R.Retriever(docs, embedder), R.Retriever(docs, embedder, index=index[0], vectors=vectors)
    for said in ("the and", '"a b" 1999년', "kbs with"):
        got, want = ([(r.doc_id, round(r.score, 9), r.ranks) for r in x.search(said).collect()] for x in (stored, plain))
        assert got == want and want


def clustered(spark, groups=12, each=40, dim=16):
    draw = np.random.default_rng(1)
    centre = draw.standard_normal((groups, dim)) * 4
    rows = [(g * each + i, (centre[g] + draw.standard_normal(dim)).tolist(), g) for g in range(groups) for i in range(each)]
    return spark.createDataFrame([*rows, (1000, None, 1), (1001, [0.0] * dim, 2), (1002, [], 3)], "id long, embedding array<double>, label int").repartition(6)


def nearest(rows, q, k):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    return [i for _, i in sorted((-round(float(unit(v) @ unit(q)), 6), i) for i, v in rows)[:k]]


def test_vector_index(spark, tmp_path):
    df = clustered(spark)
    rows = [(r.id, r.embedding) for r in df.where("size(embedding) > 0 AND label <> 2 OR id < 1000").collect()]
    index = N.VectorIndex.write(df, str(tmp_path / "v"), carried=["label"])
    assert index.rows.count() == len(rows) == 480
    asked = df.where("id % 20 = 0")
    want = {i: nearest(rows, v, 10) for i, v in rows if i % 20 == 0}
    for found in (N.exact(df, asked, 10), index.search(asked, 10, n=None)):
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want
    few = index.search(asked, 10)
    assert N.recall(few, N.exact(df, asked, 10)).first().recall >= 0.9
    assert index.probed <= len(index.centres) // 3  # these vectors gather
    one = index.nearest(rows[0][1], 5, F.col("label") < 100)
    assert one.orderBy("rank").first().id == rows[0][0]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "cell#" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_vector_blocks_and_odd_input(spark, tmp_path, monkeypatch):
    df = clustered(spark, 3, 10)
    want = sorted(map(tuple, N.exact(df, df.where("id < 20"), 3).collect()))
    monkeypatch.setattr(N, "BLOCK", 7)
    assert sorted(map(tuple, N.exact(df, df.where("id < 20"), 3).collect())) == want
    empty = df.where("false")
    assert N.exact(empty, df).count() == 0 and N.exact(df, empty).count() == 0
    with pytest.raises(Exception, match="several lengths"):
        N.exact(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, embedding array<double>").coalesce(1), df).collect()


def test_recall_of_given_vectors(spark):
    """Random directions: the sample calls for many cells, and nine in ten of the nearest are found."""
    t = registry.Tables(spark, "/root/testdata/sf0.01")
    index = q_retrieval.vector_index(t)
    asked = q_retrieval.vectors(t).where("id % 20 = 0")
    got = N.recall(index.search(asked), N.exact(q_retrieval.vectors(t), asked)).first()
    assert got.queries == 25 and got.recall >= 0.9 and index.probed < len(index.centres)


def test_trigram_index_gives_what_the_names_give(spark, tmp_path):
    draw = random.Random(4)
    part = lambda: draw.choice(["blue", "ring", "rings", "the", "blu", "도깨비", "deep", "r"])
    rows = [(i, " ".join(part() for _ in range(draw.randint(0, 6))), draw.choice([None, "", part()])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, aliases string").withColumn("year", F.col("doc_id") % 3)
    index = X.TrigramIndex.write(docs, str(tmp_path / "names"), ["title", "aliases"], carried=["year"], buckets=8)
    for said in ("blue ring", "rings", "도깨비 the", "zzz", ""):
        score = F.greatest(*(X.T.similar(F.lit(said), F.coalesce(F.col(c), F.lit("")), 0.35) for c in ("title", "aliases")))
        want = sorted((r.doc_id, round(r.s, 9)) for r in docs.select("doc_id", "year", score.alias("s")).where("s >= 0.35 AND year < 2").collect())
        assert sorted((r.id, round(r.score, 9)) for r in index.similar(said, 0.35, F.col("year") < 2).collect()) == want
        some = spark.range(1).select(F.array_distinct(X.T.trigrams(F.lit(said))).alias("g")).first().g
        assert X.grams_of(said) == some
    asked = set(X.grams_of("rings"))
    shared = {(r.doc_id, f) for r in docs.collect() for f, c in enumerate(("title", "aliases")) if r[c] and len(asked & set(X.grams_of(r[c]))) >= 0.35 * len(asked)}
    assert {(r.id, r.field) for r in index.candidates("rings", 0.35).collect()} == shared and len(shared) < 150
    with pytest.raises(ValueError):
        index.similar("x", 0.0)


def test_static_index(spark, tmp_path):
    import math

    rows = [(1, "blue steel", "ring"), (2, "steel blues bla", ""), (3, "ste", "blue"), (4, "black", None), (5, "red", "steel steel")]
    boosts = {"name": 4.0, "kind": 2.0}
    index = R.StaticIndex.write(spark.createDataFrame(rows, "doc_id long, name string, kind string"), str(tmp_path / "static"), boosts, 4)

    def brute(words, limit=30):
        own = {(i, f): (t or "").split() for i, *texts in rows for f, t in zip(boosts, texts, strict=True)}
        mean = {f: sum(len(t) for (_, g), t in own.items() if g == f) / len(rows) for f in boosts}
        score, met = {}, {}
        for (i, f), tokens in own.items():
            for word in words:
                for token in sorted({t for t in tokens if t.startswith(word)}):
                    df, tf = sum(token in t for (_, g), t in own.items() if g == f), tokens.count(token)
                    close = 1.0 if token == word else 0.375 * len(word) / len(token)
                    norm = 1.2 * (0.3 + 0.7 * len(tokens) / mean[f])
                    score[i] = score.get(i, 0) + boosts[f] * close * math.log(1 + (len(rows) - df + 0.5) / (df + 0.5)) * (0.5 + tf * 2.2 / (tf + norm))
                    met.setdefault(i, set()).add(word)
        most = max(map(len, met.values()), default=0)
        kept = [(round(s, 5), i) for i, s in score.items() if len(met[i]) == len(words) or most < len(words)]
        return sorted(((i, s) for s, i in kept), key=lambda r: (-r[1], r[0]))[:limit]

    for said in ("bl ste", "steel", "ring bla", "re zz", "zz", ""):
        assert [tuple(r) for r in index.search(said).collect()] == [(i, pytest.approx(s, abs=1e-5)) for i, s in brute(R.query_tokens(said))]
    assert [r.token for r in index.range("bl").orderBy("token", "field").collect()] == ["bla", "black", "blue", "blue", "blues"]
    filters = index.range("bl")._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    assert "GreaterThanOrEqual(token,bl)" in filters and "LessThan(token,bm)" in filters


def test_word_embedder_brings_like_texts_together(spark):
    embedder = R.WordEmbedder(256)
    a, b, c, none = (np.array(v) for v in embedder.embed(["the red apple tree", "The apple tree, red!", "a blue sea", " ?"]))
    assert a @ b == pytest.approx(1) and abs(a @ c) < 0.4 and not none.any()
    got = spark.createDataFrame([("the red apple tree",), (None,)], "t string").select(embedder.column()("t").alias("v")).collect()
    assert got[0].v == pytest.approx(a.tolist()) and got[1].v is None


def test_hybrid_search_query_against_brute_force(spark, sf):
    """Each list from the rows in Python, fused; the vector list from the cells that the index probes, or from all."""
    t = registry.Tables(spark, sf)
    rows = {r.doc_id: r for r in t.documents.collect()}
    words = {i: [w for w in X.re.findall("[0-9a-z가-힣]+", f"{r.source} {r.text or ''}".lower())] for i, r in rows.items()}
    plan = R.analyze("공유랑 the with")
    asked = X.wanted_tokens(X.websearch(plan.text))
    weight = lambda i, k: 1.0 if k < len(X.re.findall("[0-9a-z가-힣]+", rows[i].source.lower())) else 0.4
    mass = {i: round(sum(weight(i, k) for k, w in enumerate(ws) if w in asked), 6) for i, ws in words.items()}
    lists = {"fts_any": [i for s, i in sorted((-s, i) for i, s in mass.items() if s > 0)][:50]}
    mine = [i for i, r in sorted(rows.items(), key=lambda x: (-(1990 + x[1].n_chars % 40), x[0])) if r.source == "src1"]
    lists["graph"] = mine[:50]
    q = np.array(R.WordEmbedder().embed([plan.text])[0])
    near = q_retrieval.search_vectors(t).nearest(q.tolist(), 50).orderBy("rank").collect()
    score = {i: round(float(np.array(v) @ q), 6) for i, v in zip(rows, R.WordEmbedder().embed([r.text or "" for r in rows.values()]), strict=True)}
    assert all(r.score == pytest.approx(score[r.id], abs=2e-6) for r in near)
    best = sorted(score, key=lambda i: (-score[i], i))[:50]
    assert len({r.id for r in near} & set(best)) >= 40
    lists["vector"] = [r.id for r in near]
    fused = {}
    for name, ids in lists.items():
        for n, i in enumerate(ids, 1):
            fused.setdefault(i, []).append((name, n))
    want = sorted(((-round(sum(1 / (60 + n) for _, n in at), 8), i, " ".join(f"{name}#{n}" for name, n in sorted(at))) for i, at in fused.items()))[:10]
    got = registry.QUERIES["h03_hybrid_search"](spark, sf).collect()
    assert [(-r.score, r.doc_id, r.reasons) for r in got] == [(pytest.approx(s, abs=2e-8), i, why) for s, i, why in want]


def test_hybrid_search_query_fails_with_its_graph(spark, sf, monkeypatch):
    def broken(*_):
        raise ConnectionError("no graph")

    monkeypatch.setattr(R, "graph_list", broken)
    with pytest.raises(ConnectionError, match="no graph"):
        registry.QUERIES["h03_hybrid_search"](spark, sf).collect()
