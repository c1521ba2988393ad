"""Every query with SQL gives DuckDB's rows; results do not depend on partitioning; the entry point works without the llm folders."""

import math
import subprocess
import sys
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from lumenfold.plans import registry
from tests.conftest import ROOT

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for n in TABLES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf}/{n}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, sf, oracle, name):
    got = registry.QUERIES[name](spark, sf)
    want = oracle.execute(registry.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert table(got.columns, map(tuple, got.collect())) == table(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["w01_rank_candidates", "a11_ordered_nulls_last", "r07_weighted_rrf", "m06_newest_wins", "g07_bounded_traversal", "e05_resolve_works"])
def test_partitioning_does_not_matter(spark, sf, name):
    rows = []
    for n, adaptive in (("1", "true"), ("8", "false")):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        df = registry.QUERIES[name](spark, sf)
        rows.append(table(df.columns, map(tuple, df.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert rows[0] == rows[1]


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_llm_folders(tmp_path):
    import shutil

    shutil.copytree(f"{ROOT}/lumenfold", tmp_path / "lumenfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(registry.QUERIES)), "False"]
