"""Resolution ladders, batches, slugs, quality gates, reviews and merges on small tables."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import documents as D
from lumenfold.operators import graph as G
from lumenfold.operators import merge as M
from lumenfold.operators import quality as Q
from lumenfold.operators import resolve as E
from lumenfold.operators import retrieval as R
from lumenfold.operators import services as S
from lumenfold.operators.relational import numbered

WORK = "mention_id long, external_ref string, known_id long, channel string, year int"
CAND = "mention_id long, id long, c_channel string, c_year int, refs array<string>"


def test_works_ladder(spark):
    mentions = [(1, "x", 50, "tvn", 2016), (2, "x", None, "tvn", 2016), (3, None, None, "tvn", None), (4, None, None, None, None), (5, None, None, "tvn", 2016), (6, None, None, "tvn", 2016), (7, None, None, None, None), (8, "x", None, "tvn", 2016)]
    rows = [(2, 1, "tvn", 2016, []), (3, 1, "tvn", 2016, []), (4, 1, "tvn", 2016, []), (5, 1, "kbs", 2016, []), (5, 2, "tvn", 2010, []), (6, 1, "tvn", 2016, []), (6, 2, "tvn", 2016, []), (8, 1, "tvn", 2016, ["y"])]
    got = E.resolve_works(spark.createDataFrame(mentions, WORK), spark.createDataFrame(rows, CAND)).orderBy("mention_id").collect()
    assert [(r.decision, r.method, r.confidence, r.canonical_id) for r in got] == [
        ("AUTO_MERGE", "EXTERNAL_ID", 1.0, 50), ("AUTO_MERGE", "DETERMINISTIC", 1.0, 1), ("REVIEW", "SCORED", 0.9, 1), ("REVIEW", "SCORED", 0.8, 1), ("CREATE_NEW", "SCORED", 0.5, None),
        ("REVIEW", "SCORED", 0.9, 1), ("CREATE_NEW", "NEW", 1.0, None), ("CREATE_NEW", "NEW", 1.0, None),
    ]


def test_people_ladder(spark):
    day, other = dt.date(1979, 7, 10), dt.date(1980, 1, 1)
    mentions = [(1, None, None, None, 7), (2, None, None, day, 9), (3, None, None, day, 9), (4, None, None, day, 9), (5, None, None, None, 9), (6, None, None, None, 9)]
    rows = [(1, 1, None, [7], []), (1, 2, day, [8], []), (2, 1, day, [], []), (2, 2, other, [], []), (3, 1, day, [], []), (3, 2, day, [], []), (4, 1, other, [], []), (5, 1, day, [], []), (6, 1, None, [], []), (6, 2, day, [], [])]
    got = E.resolve_people(spark.createDataFrame(mentions, "mention_id long, external_ref string, known_id long, birth_date date, work long"), spark.createDataFrame(rows, "mention_id long, id long, c_birth date, works array<long>, refs array<string>")).orderBy("mention_id").collect()
    assert [(r.decision, r.confidence) for r in got] == [("AUTO_MERGE", 1.0), ("AUTO_MERGE", 0.98), ("REVIEW", 0.9), ("CREATE_NEW", 0.3), ("REVIEW", 0.85), ("REVIEW", 0.8)]


def test_songs_ladder(spark):
    mentions = [(1, None, None, ["a"], 7), (2, None, None, ["a"], 9), (3, None, None, ["z"], 9), (4, None, None, ["a"], 9)]
    rows = [(1, 1, ["b"], [7]), (2, 1, ["a", "b"], []), (3, 1, ["a"], []), (4, 1, ["a"], []), (4, 2, ["a"], [])]
    got = E.resolve_songs(spark.createDataFrame(mentions, "mention_id long, external_ref string, known_id long, artists array<string>, work long"), spark.createDataFrame(rows, "mention_id long, id long, c_artists array<string>, works array<long>")).orderBy("mention_id")
    assert [(r.decision, r.confidence) for r in got.collect()] == [("AUTO_MERGE", 1.0), ("AUTO_MERGE", 0.98), ("CREATE_NEW", 0.4), ("REVIEW", 0.9)]
    assert [r.mention_id for r in E.enrich_songs(got).orderBy("mention_id").collect()] == [1, 2, 3]


MATCH = "record_id long, mention string, decision string, method string, confidence double, canonical_id long"


def test_records_reviews_and_manual_decisions(spark):
    rows = spark.createDataFrame([(1, "title:a", "AUTO_MERGE", "SCORED", 1.0, 5), (1, "name:b", "REVIEW", "SCORED", 0.8, 6), (2, "title:c", "CREATE_NEW", "NEW", 1.0, None)], MATCH)
    resolved = E.record_resolution(rows)
    assert {r.record_id: r.needs_review for r in resolved.collect()} == {1: True, 2: False}
    staging = resolved.select(F.col("record_id").alias("id"), F.when(F.col("needs_review"), "REVIEW").otherwise("RESOLVED").alias("status"), "resolution")
    queue = S.ReviewQueue(staging)
    assert [(r.id, r.mention, r.canonical_id) for r in queue.pending().collect()] == [(1, "name:b", 6)]
    decided = queue.decide(spark.createDataFrame([(1, "name:b", "CREATE_NEW", None)], "id long, mention string, decision string, canonical_id long"))
    got = {r.id: r for r in decided.collect()}
    assert got[1].status == "RESOLVED" and got[1].resolution["name:b"].method == "MANUAL" and got[1].resolution["title:a"].canonical_id == 5
    both = decided.where("id = 1").select(F.col("resolution").alias("old")).crossJoin(staging.where("id = 1").select(F.col("resolution").alias("new")))
    kept = both.select(E.keep_manual(F.col("old"), F.col("new")).alias("m")).first().m
    assert kept["name:b"].method == "MANUAL" and kept["title:a"].method == "SCORED"
    assert queue.problems().count() == 0


def test_slugs(spark):
    rows = spark.createDataFrame([(1, "a", 2016), (2, "a", 2016), (3, "a", 2016), (4, "a", 2017), (5, "b", 2016), (6, "a", 2016)], "id long, base string, year int")
    taken = spark.createDataFrame([("b",), ("a-2016-2",)], "slug string")
    got = {r.id: r.slug for r in E.unique_slugs(rows, taken).collect()}
    assert got[1] == "a" and got[2] == "a-2016" and got[4] == "a-2017" and got[5] == "b-2016"
    assert len(set(got.values())) == 6 and not set(got.values()) & {"b", "a-2016-2"} and all(v.startswith("a-2016-") for v in (got[3], got[6]))


def test_batch_clusters(spark):
    day = "1979-07-10"
    rows = [(1, 1, 1, "q1", "kim", day, 10), (2, 2, 1, "q1", "gim", None, 11), (3, 3, 1, None, "kim", day, 12), (4, 4, 1, None, "kim", None, 10), (5, 5, 1, None, "kim", None, 99), (6, 6, 2, "q1", "lee", None, 10), (7, 7, 1, None, "kim", "1990-01-01", 98)]
    df = spark.createDataFrame(rows, "mention_id long, staging_id long, source_id long, external_ref string, name_normalized string, birth_date string, work long")
    got = {r.mention_id: r.entity for r in E.cluster_batch(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7}


def test_cluster_batch_plainly(spark):
    """Against the rules applied to a list of all people of the whole batch."""
    draw = random.Random(7)
    rows = [(i, draw.randrange(200), draw.randrange(2), draw.choice([None, None, *"pqrstuvw"]), draw.choice(["kim", "lee", "han"]), draw.choice([None, "1980-01-01", "1990-01-01"]), draw.choice([None, *range(6)])) for i in range(400)]
    people, want = [], {}
    for mention, _, source, ref, name, birth, work in sorted(rows, key=lambda r: (r[1], r[0])):
        same = [p for p in people if p["name"] == name]
        born = [p for p in same if birth and p["birth"] == birth]
        found = next((p for p in people if ref and (source, ref) in p["refs"]), None)
        found = found or (born[0] if len(born) == 1 else None) or next((p for p in same if work is not None and work in p["works"]), None)
        if not found:
            found = {"id": mention, "name": name, "birth": None, "works": set(), "refs": set()}
            people.append(found)
        if ref and not any((source, ref) in p["refs"] for p in people):
            found["refs"].add((source, ref))
        found["works"].add(work)
        found["birth"] = found["birth"] or birth
        want[mention] = found["id"]
    schema = "mention_id long, staging_id long, source_id long, external_ref string, name_normalized string, birth_date string, work long"
    assert {r.mention_id: r.entity for r in E.cluster_batch(spark.createDataFrame(rows, schema)).collect()} == want
    assert E.cluster_batch(spark.createDataFrame([], schema)).collect() == []


def test_cluster_batch_with_few_links(spark):
    """Many small groups: most mentions have no reference, and works and dates are many."""
    draw = random.Random(1)
    rows = [(i, draw.randrange(60), draw.randrange(2), draw.choice([None] * 300 + [str(k) for k in range(40)]), draw.choice([None, *(f"n{k}" for k in range(12))]), draw.choice([None] * 60 + [f"19{k}-01-01" for k in range(50, 99)]), draw.choice([None, *range(60)])) for i in range(250)]
    everything = E.Entities()
    want = {r[0]: everything.settle(*r[1:2], r[0], *r[2:]) for r in sorted(rows, key=lambda r: (r[1], r[0]))}
    schema = "mention_id long, staging_id long, source_id long, external_ref string, name_normalized string, birth_date string, work long"
    df = spark.createDataFrame(rows, schema).repartition(4)
    assert {r.mention_id: r.entity for r in E.cluster_batch(df).collect()} == want
    assert 20 < len({r.group for r in E.mention_groups(df).collect()}) < 250


def test_mentions_of_one_name_spread(spark):
    """A name alone brings nobody together; names that one reference has do, with each of their works."""
    schema = "mention_id long, staging_id long, source_id long, external_ref string, name_normalized string, birth_date string, work long"
    rows = [(i, i, 1, None, "kim", None, i) for i in range(2000)]
    rows += [(6000, 1, 1, "r", "han", None, 71), (6001, 2, 1, "r", "lee", None, 72), (6002, 3, 1, None, "han", None, 72), (6003, 4, 2, None, "lee", None, 72), (6004, 5, 2, None, None, "1980-01-01", None), (6005, 6, 2, None, None, "1980-01-01", None)]
    df = spark.createDataFrame(rows, schema)
    groups = {r.mention_id: r.group for r in E.mention_groups(df).collect()}
    assert len({groups[i] for i in range(2000)}) == 2000
    assert groups[6000] == groups[6001] == groups[6002] == groups[6003] and groups[6004] == groups[6005]
    got = {r.mention_id: r.entity for r in E.cluster_batch(df).collect()}
    assert [got[i] for i in range(6000, 6006)] == [6000, 6000, 6000, 6003, 6004, 6004] and all(got[i] == i for i in range(2000))


def test_components_of_long_chains(spark):
    rows = [(i, i + 1) for i in range(100)] + [(1000, 1001), (1001, 1000), (2000, 2000)]
    got = {r.id: r.component for r in G.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, 1000: 1000, 1001: 1000, 2000: 2000}


def test_numbered(spark):
    """Places run through all ranges, nulls come first, equal rows take neighbouring places, and an empty table has none."""
    draw = random.Random(3)
    rows = [(draw.choice([None, *range(300)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, id long").repartition(7)
    got = numbered(df, "place", F.col("k"), F.col("id")).orderBy("place").collect()
    assert [(r.k, r.id) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r.place for r in got] == list(range(1, 3001))
    tied = numbered(df, "place", F.desc("k")).collect()
    assert sorted(r.place for r in tied) == list(range(1, 3001))
    assert numbered(df.where("id < 0"), "place", F.col("k")).collect() == []


RECORD = "id int, external_id string, title_ko string, start_date date, end_date date, episode_count int, runtime_minutes int, broadcaster_code string, program_kind string, genres array<string>, credits array<struct<person: struct<name_ko: string, name_normalized: string>, credit_type: string, character_name: string, billing_order: int>>, osts array<struct<title: string, duration_seconds: int>>, links array<struct<url: string>>"


def test_quality(spark):
    day = dt.date(2016, 1, 1)
    credit = (("공유", "공유"), "ACTOR", None, 1)
    good = ("g", "t", day, day, 16, 60, "tvn", "DRAMA", ["romance"], [credit], [("s", 1)], [("https://x",)])
    rows = [good, ("", " ", None, None, 0, 0, "zz", "NOT_DRAMA", ["zz"], [], [(" ", 0)], [("http://x",)]), ("g", "t", day, dt.date(2015, 1, 1), None, None, None, None, None, [credit, credit, (("", ""), "ACTOR", None, 0)], None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], RECORD).withColumn("issues", Q.record_issues(["tvn"], ["romance"]))
    got = [[i.code for i in r.issues] for r in df.orderBy("id").collect()]
    assert got[0] == []
    assert got[1] == ["MISSING_TITLE", "MISSING_EXTERNAL_ID", "MISSING_START_DATE", "NO_CREDITS", "NOT_A_DRAMA", "EPISODE_COUNT", "RUNTIME", "UNKNOWN_BROADCASTER", "UNKNOWN_GENRE", "SONG_NO_TITLE", "SONG_DURATION", "LINK_NOT_HTTPS"]
    assert got[2] == ["DATE_ORDER", "CREDIT_NO_NAME", "DUPLICATE_CREDIT", "BILLING_ORDER"]
    Q.gate(df)
    many = df.crossJoin(spark.range(3).toDF("k"))
    with pytest.raises(Q.GateError):
        Q.gate(many)
    Q.gate(many.where("id <> 1"), most=0.7)


def test_publish_in_order(spark):
    """One record after another as a pipeline: new work, merged work, children, references and events."""
    works = spark.createDataFrame([(1, "old", None, 1)], "id long, title string, synopsis string, version int")
    rows = spark.createDataFrame([(1, "new", "s"), (2, "b", None)], "id long, title string, synopsis string")
    merged = M.fill_merge(works, rows, ["id"], always=["title"])
    assert sorted(tuple(r) for r in merged.collect()) == [(1, "new", "s", 2), (2, "b", None, 1)]
    aliases = M.insert_ignore(spark.createDataFrame([(1, "x")], "id long, alias string"), spark.createDataFrame([(1, "x"), (1, "y"), (1, "y")], "id long, alias string"), ["id", "alias"])
    assert aliases.count() == 2
    credits = spark.createDataFrame([(1, None, 5)], "id long, character string, billing int")
    again = M.overwrite(credits, spark.createDataFrame([(1, None, 6)], "id long, character string, billing int"), ["id", "character"])
    assert [r.billing for r in again.collect()] == [6]


def test_staging_and_identity(spark):
    table = spark.createDataFrame([(1, 10, "REVIEW", "r", "i", "p")], "id long, source_record_id long, status string, resolution string, issues string, payload string")
    fresh = spark.createDataFrame([(1, 10, "q"), (2, 11, "q")], "id long, source_record_id long, payload string")
    staged = {r.id: r for r in M.staged(table, fresh).collect()}
    assert staged[1].status == "NEW" and staged[1].resolution is None and staged[2].payload == "q"
    moved = M.transition(table, [1], "RESOLVED", resolution=F.lit("n")).first()
    assert (moved.status, moved.resolution, moved.issues) == ("RESOLVED", "n", "i")
    ids = spark.createDataFrame([("kakao", "s", "u1")], "provider string, subject string, user_id string")
    consents = spark.createDataFrame([("u2", "terms", "1")], "user_id string, type string, version string")
    links, given = M.link_identity(ids, consents, "u2", "kakao", "s", [("terms", "1"), ("privacy", "1")])
    assert [r.user_id for r in links.collect()] == ["u1"] and given.count() == 2


def test_store_swaps_snapshots(spark, tmp_path):
    store = M.Store(spark, f"file://{tmp_path}")
    assert store.current("t") is None
    store.swap("t", spark.range(3))
    seen = store.read("t")
    store.swap("t", M.insert_ignore(store.read("t"), spark.range(5).toDF("id"), ["id"]))
    assert seen.count() == 3 and store.read("t").count() == 5


def test_graph_routes_and_gate(spark):
    edges = spark.createDataFrame([(1, 1, "ACTED_IN"), (1, 2, "ACTED_IN"), (2, 1, "ACTED_IN"), (2, 1, "WROTE"), (3, 3, "ACTED_IN")], "work long, person long, type string")
    assert sorted(r.type for r in G.works_of(edges, 1).where("work = 2").collect()) == ["ACTED_IN", "WROTE"]
    assert [r.work for r in G.works_shared(edges, [1, 2]).collect()] == [1] and G.works_shared(edges, [1, 3]).count() == 0
    route = S.Graph(edges, edges.select("work", F.col("person").alias("song")), spark.createDataFrame([(1, 9), (2, 9)], "song long, artist long"))
    assert route.collaborators(1).first().other == 2 and route.limit(500) == 50
    assert route.related(1)["by_people"].first().strength == 2
    errors, warnings = G.integrity_errors({"works": 3, "orphans": 1, "no_channel": 2, "max_degree": 900}, 4)
    assert len(errors) == 2 and len(warnings) == 2
    vertices = spark.createDataFrame([("1",), ("9",)], "id string")
    assert [r.id for r in G.orphans(vertices, spark.createDataFrame([("1", "2")], "src string, dst string")).collect()] == ["9"]
    scores = {(r.a, r.b): r.score for r in G.collaboration_scores(edges.where("type = 'ACTED_IN'").select("work", "person")).collect()}
    assert scores == {(1, 2): 1.0}


def test_catalog_routes(spark):
    day = dt.date(2016, 12, 2)
    works = spark.createDataFrame([(1, "a", "tvn", day, "PUBLISHED", None, 5.0), (2, "b", "kbs", day, "HIDDEN", None, 9.0), (3, "c", "tvn", day, "MERGED", 1, 1.0), (4, "d", "tvn", dt.date(2015, 1, 1), "PUBLISHED", None, 0.0)], "id long, slug string, channel string, start_date date, status string, merged_into long, popularity double")
    channels = spark.createDataFrame([("tvn",), ("kbs",)], "channel string")
    credits = spark.createDataFrame([(1, 7, "ACTOR"), (2, 7, "ACTOR"), (4, 7, "ACTOR")], "id long, person long, type string")
    c = S.Catalog(works, channels, credits)
    assert [r.channel for r in c.broadcasters().collect()] == ["tvn"]
    assert [(r["year"], r["count"]) for r in c.years().collect()] == [(2016, 1), (2015, 1)]
    assert [(r.id, r.total) for r in c.year(2016).collect()] == [(1, 1)] and c.year(2016, "kbs").count() == 0
    assert [r.id for r in c.popular().collect()] == [1]
    assert [(c.drama(s).first().code, c.drama(s).first().target) for s in "abc"] == [(200, None), (404, None), (301, 1)]
    assert c.drama_by_id(1).first().credits[0].person == 7 and c.drama("zz").count() == 0
    assert [r.id for r in c.person(7).collect()] == [1, 4]


DOC = "doc_id long, title string, aliases string, body string, synopsis string, channel string, year int, embedding array<double>"


def test_hybrid_search(spark):
    emb = R.HashEmbedder(8)
    vec = lambda t: emb.embed([t])[0]
    rows = [(1, "도깨비", "Goblin", "출연 공유", "신", "tvn", 2016, vec("도깨비")), (2, "시그널", "Signal", "출연 김혜수", "무전", "tvn", 2016, vec("x")), (3, "응답하라 1988", "Reply 1988", "쌍문동", "", "tvn", 2015, None), (4, "도깨비 가족", "", "x", "", "kbs", None, None)]
    docs = spark.createDataFrame(rows, DOC)
    graph = lambda words: spark.createDataFrame([(2, 1)], "work long, rank long")
    r = R.Retriever(docs, emb, graph)
    top = r.search("도깨비").collect()
    assert top[0].doc_id == 1 and top[0].ranks["fts"] == 1 and {"fts", "fts_any", "trigram", "vector", "graph"} >= set(top[0].ranks)
    assert {x.doc_id for x in r.search("2016년 tvN").collect()} == {1, 2}
    assert r.search("응답하라 1988").first().doc_id == 3  # nothing in 1988: asked again without years
    lists = r.lists(R.analyze("도깨비"), {"graph": 0, "vector": 0})
    assert set(lists) == {"fts", "fts_any", "trigram"}
    assert r.search("도깨비 공유", rerank=True).first().doc_id == 1
    assert R.Retriever(docs).search("도깨비", broadcaster="kbs").first().doc_id == 4
    assert R.Retriever(docs).search("?").count() == 0


def test_web_search_syntax(spark):
    assert R.websearch('신 "두 말" -공유 or Goblin') == [[(True, ["신"]), (True, ["두", "말"]), (False, ["공유"])], [(True, ["goblin"])]]
    assert R.websearch('- "" ?') == []
    rows = [(1, "두 말 신"), (2, "신 말 두"), (3, "신 두 말 공유"), (4, "goblin"), (5, None), (6, "두")]
    docs = spark.createDataFrame([(i, None, None, b, None) for i, b in rows], "doc_id long, title string, aliases string, body string, synopsis string")
    got = R.matches(docs, R.websearch('신 "두 말" -공유 or Goblin'))
    assert {r.doc_id for r in got.where("every").collect()} == {1, 4} and {r.doc_id for r in got.collect()} == {1, 2, 3, 4, 6}
    assert R.matches(docs, R.websearch("-공유")).count() == 0


def test_graph_list_and_rerank(spark):
    people = spark.createDataFrame([(1, "공유"), (2, "김고은"), (3, "김혜수"), (4, "공유")], "id long, name string")
    credits = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12), (3, 13), (4, 14)], "person long, work long")
    works = spark.createDataFrame([(10, "2016-12-02"), (11, "2020-01-01"), (12, None), (13, "2001-01-01"), (14, "2002-01-01")], "work long, day string").selectExpr("work", "cast(day AS date) AS start_date")
    asked = lambda said: [(r.work, r.rank) for r in R.graph_list(people, credits, works, said).orderBy("rank").collect()]
    assert asked("공유랑 나온") == [(11, 1), (10, 2)]  # the first person of one name
    assert asked("김고은과 김혜수") == [(12, 1), (10, 2), (13, 3)]  # no work in common
    assert asked("nobody") == []
    single = people.where("id < 4")
    assert [(r.work, r.rank) for r in R.graph_list(single, credits, works, "공유랑 김고은").collect()] == [(10, 1)]
    docs = spark.createDataFrame([(10, "a", None, "x 공유", None, "tvn", 2016, "2016-12-02"), (11, "b", None, "x", "공유 y", "tvn", 2020, None), (12, "c", None, "x y", None, "tvn", 2016, "2016-01-01")], "doc_id long, title string, aliases string, body string, synopsis string, channel string, year int, start_date string")

    def broken(said):
        raise RuntimeError(said)

    r = R.Retriever(docs, None, broken)
    assert {x.doc_id for x in r.search("공유").collect()} == {10, 11} and r.failed == "RuntimeError"
    assert [x.doc_id for x in r.search("tvn").orderBy(F.desc("score")).collect()] == [12, 10, 11]  # by day, none last
    top = r.search("공유 x y", rerank=True).collect()
    assert [x.doc_id for x in top] == [11, 10, 12] and top[0].ranks["rerank"] == 1 and top[0].score == top[0].scores["rerank"] == 1.0


def test_similar_titles_are_bounded_exactly(spark):
    names = ["blue ring", "ring of blue", "blu", "the blue ringing", "", None, "red", "ring ring blue", "deep blue sea ring bl"]
    rows = spark.createDataFrame([(x,) for x in names], "n string")
    from lumenfold.functions import text as T

    for q in ("blue ring", "rings", ""):
        got = rows.select("n", T.word_similarity(F.lit(q), F.col("n")).alias("a"), T.similar(F.lit(q), F.col("n"), 0.35).alias("b")).collect()
        for r in got:
            want = brute_similarity(q, r.n or "")
            assert r.a == pytest.approx(want) and r.b == pytest.approx(want if want >= 0.35 else 0.0)


def brute_similarity(q, t):
    grams = lambda x: [p[i : i + 3] for w in re.findall("[0-9a-z]+", x) for p in [f"  {w} "] for i in range(len(p) - 2)]
    a, b = set(grams(q)), grams(t)
    return max((len(a & set(b[i:j])) / len(a | set(b[i:j])) for i in range(len(b)) for j in range(i + 1, len(b) + 1)), default=0.0) if a else 0.0


def test_fusion_properties(spark):
    rows = [("a", 1, 1, 9.0), ("b", 1, 2, 1.0), ("a", 2, 2, 8.0), ("b", 3, 1, 99.0)]
    lists = spark.createDataFrame(rows, "list_name string, doc_id long, rank long, score double")
    order = lambda **w: [r.doc_id for r in R.rrf(lists, w or None).orderBy(F.desc("score"), "doc_id").collect()]
    assert order() == [1, 3, 2] and order(a=0.001) == [3, 1, 2]
    one = R.rrf(lists).where("doc_id = 1").first()
    assert one.ranks == {"a": 1, "b": 2} and one.scores["a"] == 9.0


def test_embeddings_are_refreshed(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    rows = [(1, "a", "plot", None, None, None, t1), (2, "b", "", None, None, None, t1), (3, "c", "plot", [1.0], "m", t1, t0), (4, "d", "plot", [1.0], "old", t1, t0)]
    df = spark.createDataFrame(rows, "doc_id long, title string, synopsis string, embedding array<double>, embedding_model string, embedded_at timestamp, updated_at timestamp")
    got = {r.doc_id: r for r in R.refresh_embeddings(df, R.HashEmbedder(4), "m").collect()}
    assert len(got[1].embedding) == 4 and got[2].embedding is None and got[2].embedded_at == t1
    assert got[3].embedding == [1.0] and len(got[4].embedding) == 4 and got[4].embedding_model == "m"


def test_documents(spark):
    schema = "id long, slug string, title_ko string, title_en string, aliases array<string>, broadcaster_code string, broadcaster_name string, start_date date, end_date date, episode_count int, synopsis string, genres array<string>, cast array<struct<name: string, character: string>>, crew array<struct<name: string, type: string>>, osts array<struct<title: string, artists: array<string>>>, canonical_version long"
    row = (1, "s", "도깨비", "Goblin", ["쓸쓸"], "tvn", "tvN", dt.date(2016, 12, 2), None, 16, " plot ", ["fantasy"], [("공유", "김신"), ("김고은", None)], [("김은숙", "WRITER")], [("Stay", ["찬열"]), ("Cue", [])], 3)
    empty = (2, "t", "빈", None, [], None, None, None, None, None, None, [], [], [], [], 1)
    df = spark.createDataFrame([row, empty], schema)
    a, b = D.render(df).orderBy("id").collect()
    assert a.body == "방송사: tvN\n연도: 2016년\n장르: 판타지\n출연: 공유 (김신 역), 김고은\n극본: 김은숙\nOST: Stay - 찬열, Cue"
    assert a.aliases == "Goblin\n쓸쓸" and a.synopsis == "plot" and a.metadata.year == 2016 and list(a.metadata.cast) == ["공유", "김고은"]
    assert b.body == "" and b.aliases == ""
    newer = D.render(df.withColumn("canonical_version", F.lit(9).cast("long"))).orderBy("id").collect()
    assert [r.content_hash for r in newer] == [a.content_hash, b.content_hash]


def test_changed_rows_are_stamped(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    before = spark.createDataFrame([(1, "a", t0), (2, "b", t0)], "id long, v string, updated_at timestamp")
    after = spark.createDataFrame([(1, "a", t0), (2, "c", t0), (3, None, None)], "id long, v string, updated_at timestamp")
    got = {r.id: r.updated_at for r in M.stamped(before, after, ["id"], F.lit(t1)).collect()}
    assert got == {1: t0, 2: t1, 3: t1}
