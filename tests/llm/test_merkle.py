"""The Merkle manifest against a tree built row by row, and its query against SQL."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout):
    """All levels from the leaves to one node, and the siblings of each leaf on its way there."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            a = i // fanout * fanout
            path.append(("".join(level[a:i]), "".join(level[i + 1 : a + fanout])))
            i //= fanout
        paths.append(path)
    return levels[-1][0], paths


def wanted(rows, fanout):
    """(id, leaf) to (subroot, root, path) from (id, lang, leaf)."""
    groups = {}
    for i, lang, leaf in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(lang, []).append((i, leaf))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf for _, leaf in groups[g]], fanout) for g in langs}
    root, tops = tree([trees[g][0] for g in langs], fanout)
    return [(i, leaf, trees[g][0], root, p + tops[k]) for k, g in enumerate(langs) for (i, leaf), p in zip(groups[g], trees[g][1], strict=True)]


@pytest.mark.parametrize("fanout", [2, 8])
def test_manifest_against_single_trees(spark, fanout):
    langs = ["en"] * 70 + [None, "de", "de", "", "é", "z"] + ["fr"] * 9
    rows = [(i * 7 % 101, lang, f"t{i}" if i % 5 else None) for i, lang in enumerate(langs)]
    rows += [(None, "en", "a"), (None, None, None), (3, "en", "same"), (3, "en", "same"), (3, "en", "Aé")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, lang string, text string, root string, node int").repartition(5)
    found = merkle.manifest(df.withColumn("leaf", merkle.leaf(F.col("doc_id"), F.col("lang"), F.col("text"))), fanout=fanout)
    assert found.columns == ["doc_id", "lang", "text", "node", "leaf", "index", "subroot", "root", "path"]
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.path]) for r in found.collect()]
    want = wanted([(i, lang, h(written(i), written(lang), written(t))) for i, lang, t in rows], fanout)
    assert sorted(got, key=str) == sorted(want, key=str)
    whole = found.select((merkle.fold(F.col("leaf"), "path") == F.col("root")).alias("ok"), merkle.proof("path").alias("p")).collect()
    assert all(r.ok for r in whole) and {r.p for r in whole} == {h(*(x for s in w[4] for x in s)) for w in want}


def test_manifest_shows_changed_and_unknown_rows(spark):
    df = spark.createDataFrame([(i, "en", f"text {i}") for i in range(20)], "doc_id long, lang string, text string")
    leaf = merkle.leaf(F.col("doc_id"), F.col("text"))
    found = merkle.manifest(df.withColumn("leaf", leaf))
    other = df.withColumn("text", F.when(F.col("doc_id") == 4, "text 5").otherwise(F.col("text"))).union(spark.createDataFrame([(99, "en", "new")], df.schema))
    got = {r.doc_id: r.verified for r in merkle.verified(other.withColumn("leaf", leaf), found, ["doc_id"]).collect()}
    assert got == {i: i not in (4, 99) for i in [*range(20), 99]}


def test_manifest_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([(1, "en", "aa")], "doc_id long, lang string, leaf string")
    assert [tuple(r)[2:] for r in merkle.manifest(df).collect()] == [("aa", 0, "aa", "aa", [])]
    assert merkle.manifest(df.where("doc_id > 1")).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(df, fanout=1)


def test_manifest_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.SQL["op12_merkle_manifest"])
    columns = [d[0] for d in want.description]
    got = queries.op12_merkle_manifest(spark, sf).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert {r.verified for r in got} == {True, False}
