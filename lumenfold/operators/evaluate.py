"""Offline evaluation: ranking metrics by golden query, their summary, the regression gate, and pools for generated queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def metrics(runs: DataFrame, golden: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, recall1, recall5, mrr, ndcg) of runs (query_id, doc, rank) against golden (query_id, expected array)."""
    ranked = runs.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("ranked"))
    rows = golden.join(ranked, "query_id", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast(golden.schema["expected"].dataType)))
    return rows.select("query_id", recall(F.col("ranked"), F.col("expected"), 1).alias("recall1"), recall(F.col("ranked"), F.col("expected"), k).alias("recall5"), mrr(F.col("ranked"), F.col("expected")).alias("mrr"), ndcg(F.col("ranked"), F.col("expected"), k).alias("ndcg"))


def recall(ranked: Column, expected: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(ranked, 1, k), expected)) / F.size(expected)


def mrr(ranked: Column, expected: Column) -> Column:
    hits = F.filter(F.transform(ranked, lambda d, i: F.when(F.array_contains(expected, d), i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(hits) > 0, 1 / F.get(hits, 0)).otherwise(0.0)


def ndcg(ranked: Column, expected: Column, k: int) -> Column:
    """Binary gain with a logarithmic discount, against the best order of as many as are expected, k at most."""

    def dcg(flags: Column) -> Column:
        return F.aggregate(F.transform(flags, lambda f, i: f / F.log2(i + 2.0)), F.lit(0.0), lambda a, b: a + b)

    gains = F.transform(F.slice(ranked, 1, k), lambda d: F.array_contains(expected, d).cast("double"))
    return dcg(gains) / dcg(F.array_repeat(F.lit(1.0), F.least(F.size(expected), F.lit(k))))


def failures(measured: DataFrame) -> DataFrame:
    return measured.where("recall5 < 1")


def regressed(now: float, before: float, slack: float = 0.02) -> bool:
    return now < before - slack


def unique_titles(works: DataFrame, key: str = "title") -> DataFrame:
    """Titles that one work alone has."""
    return works.groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select(key, "id")


def people_with_few(credits: DataFrame, most: int = 3) -> DataFrame:
    return credits.groupBy("person").agg(F.countDistinct("work").alias("works")).where(F.col("works").between(1, most))


def pairs_sharing_one(credits: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, work): people with works enough of whom exactly one is common."""
    own = credits.select("person", "work").distinct()
    busy = own.groupBy("person").count().where(F.col("count") >= least).select("person")
    rows = own.join(busy, "person")
    other = rows.select(F.col("person").alias("b"), "work")
    both = rows.select(F.col("person").alias("a"), "work").join(other, "work").where("a < b")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("work").alias("work")).where("n = 1").select("a", "b", "work")


def small_cells(works: DataFrame, keys: list[str], most: int = 4) -> DataFrame:
    return works.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n").between(1, most))


def sampled(df: DataFrame, seed: int, n: int, key: str = "id") -> DataFrame:
    """A fixed sample: the n least by a seeded hash."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
