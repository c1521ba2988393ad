"""Queries whose pairs are not listed or not shuffled, and vectors without a direction."""

import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import graph as G
from lumenfold.operators import resolve as E
from lumenfold.plans import registry


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def titled(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice(["a", "b", "c", ""]), draw.choice(["PUBLISHED", "HIDDEN", "MERGED"]), draw.choice(["a", "d"])) for i in range(60)]
    works = spark.createDataFrame(rows, "id long, title_normalized string, status string, alias_normalized string")
    asked = [(i % 50, draw.choice(["a", "b", "d", "", None]), draw.choice([None, "x", "y"]), draw.choice([None, 1, 2]), draw.choice([None, None, "r1", "r2"]), draw.choice([None, None, 7])) for i in range(60)]
    mentions = spark.createDataFrame([*asked, (None, "a", "x", 1, None, None)], "mention_id long, title_normalized string, channel string, year int, external_ref string, known_id long")
    facts = spark.createDataFrame([(i, draw.choice([None, "x", "y"]), draw.choice([None, 1, 2]), draw.choice([None, [], ["r1"], ["r2", "r3"]])) for i in [*range(60), 5]], "id long, c_channel string, c_year int, refs array<string>")
    return mentions, works.select("id", "title_normalized", "status"), works.select("id", "alias_normalized"), facts


def test_blocking_gives_each_pair_once(titled, monkeypatch):
    monkeypatch.setattr(E, "LOT", 3)
    mentions, works, aliases, _ = titled
    m = {(r.mention_id, r.title_normalized) for r in mentions.collect() if r.title_normalized}
    shown = {r.id: r.title_normalized for r in works.collect() if r.status != "MERGED"}
    keys = set(shown.items()) | {(r.id, r.alias_normalized) for r in aliases.collect() if r.id in shown}
    got = [tuple(r) for r in E.by_title(mentions, works, aliases).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, k in m for j, x in keys if k == x}


def test_works_judged_by_class_as_by_pairs(titled):
    mentions, works, aliases, facts = titled
    want = E.resolve_works(mentions, E.by_title(mentions, works, aliases).join(facts, "id"))
    got = E.resolve_works_by_title(mentions, works, aliases, facts)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_frequent_title_lists_no_pairs(spark, tmp_path):
    n = 3000  # all of one title: 9 million pairs
    part = spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("one").alias("p_name"), F.lit("t").alias("p_type"), F.concat(F.lit("Brand#"), F.col("id") % 3).alias("p_brand"), (F.col("id") % 9).cast("int").alias("p_size"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    df = registry.QUERIES["e05_resolve_works"](spark, str(tmp_path))
    assert df.count() == n
    rows = max(int(x) for x in _join_rows(df))
    assert rows < 20 * n


def _join_rows(df):
    """The rows that each join of an executed query put out."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    found, left = [], [node]
    while left:
        p = left.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            left.append(p.executedPlan())
        elif "QueryStage" in name:
            left.append(p.plan())
        if "Join" in name and p.metrics().contains("numOutputRows"):
            found.append(p.metrics().apply("numOutputRows").value())
        left += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_shared_works_are_shuffled_as_lists(spark, monkeypatch):
    monkeypatch.setattr(G, "LISTED", 4)
    monkeypatch.setattr(G, "COUNTED", 50)
    draw = random.Random(2)
    own = {(draw.randrange(30), draw.choice([1, 1, 1, 2, 3, 4])) for _ in range(120)} | {(None, 1), (3, None)}
    got = G.works_by_shared(spark.createDataFrame(sorted(own, key=str), "work long, artist long"), "n")
    want = {}
    for w, a in own:
        for r, b in own:
            if a == b and None not in (w, r, a) and w != r:
                want[w, r] = want.get((w, r), 0) + 1
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and {(w, r): n for w, r, n in rows} == want
    # Above the dealing by work pairs are listed, counted and turned; below it they are in lists.
    above = plan(got).split("RepartitionByExpression")
    assert len(above) == 2 and "explode(greater" in above[0]


def test_vectors_of_zeros_are_first_as_in_sql(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [1.0, 1.0], 1), (3, None, 1), (4, [0.0, 0.0], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [(r.vec_id, str(r.score)) for r in registry.QUERIES["t06_nearest"](spark, str(tmp_path)).collect()]
    assert got == [(1, "nan"), (4, "nan"), (0, "1.0"), (2, "0.70711"), (3, "None")]
