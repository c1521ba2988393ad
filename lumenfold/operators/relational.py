"""Building blocks of the catalogue's reads: visibility, ranges, joins that keep shape, ordered nesting, top-k."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows up to which a dimension is broadcast; beyond it the join is left to the planner.
SMALL = 100_000


#: The folder that holds the package.
ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, also where only the driver knows the way to it."""
    sc = spark.sparkContext
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in paths or getattr(sc, "_lumenfold_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(), "lumenfold.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "lumenfold").rglob("*.py")):
            z.write(p, str(p.relative_to(ROOT)))
    sc.addPyFile(target)
    sc._lumenfold_shipped = True


def published(df: DataFrame, status: str = "status") -> DataFrame:
    """Only rows that may be shown."""
    return df.where(F.col(status) == "PUBLISHED")


def in_year(c: Column, first: int, last: int | None = None) -> Column:
    """A half-open range on the column itself, so that it reaches the scan."""
    return (c >= F.make_date(F.lit(first), F.lit(1), F.lit(1))) & (c < F.make_date(F.lit((last or first) + 1), F.lit(1), F.lit(1)))


def where_set(df: DataFrame, **values) -> DataFrame:
    """Equality filters for the parameters that are given; None filters nothing."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def latest(df: DataFrame, keys: Sequence[str], by: str, value: str) -> DataFrame:
    """Each key's value at the greatest ``by``; partial aggregation, no window."""
    return df.groupBy(*keys).agg(F.max_by(value, by).alias(value))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Sort and limit in one operator; every task keeps k rows."""
    return df.orderBy(*order).limit(k)


def ranked(df: DataFrame, k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The best k rows with their places. The window sees k rows, as the limit is taken first."""
    return top_k(df, k, *order).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def held(df: DataFrame) -> DataFrame:
    """Rows that are computed once and then read as they are: a checkpoint in the folder of spark.checkpoint.dir, or the cache of a
    session that names none."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() and folder:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.cache()


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """The rows with their places from 1 in ``order`` over the whole table, which no single task sees.

    Rows are dealt by ranges of the order and held, so that a row keeps its range; each range is numbered by itself and the rows
    of the ranges before it are added. The one-task window sees a row for each range.
    """
    dealt = held(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy(F.col("__range").alias("__r")).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__r", "__before")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    rows = dealt.withColumn(name, own).join(F.broadcast(before), F.col("__range") == F.col("__r"))
    return rows.withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__range", "__r", "__before")


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Rows of page ``number`` (from 0) with the total of all rows that the same predicate lets through."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(number * size).limit(size).crossJoin(F.broadcast(total))


def zero_filled(df: DataFrame, key: str, domain: Sequence[str], name: str = "n") -> DataFrame:
    """Counts for every value of a fixed domain, also those that do not occur."""
    values = df.sparkSession.createDataFrame([(v,) for v in domain], f"{key} string")
    counts = df.groupBy(key).agg(F.count("*").alias(name))
    return F.broadcast(values).join(counts, key, "left").select(key, F.coalesce(name, F.lit(0)).cast("long").alias(name))


def ordered_list(value: Column, *keys: Column) -> Column:
    """Values of a group in the order of the keys, nulls last, ties by value."""
    order = [x for k in keys for x in (k.isNull(), k)]
    parts = [x.alias(f"k{i}") for i, x in enumerate([*order, value])]
    return F.transform(F.array_sort(F.collect_list(F.struct(*parts))), lambda s: s[f"k{len(order)}"])


def with_children(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Each parent with an array of its children, empty where it has none (a correlated aggregate, decorrelated)."""
    return parents.join(children, key, "left").withColumn(name, F.coalesce(name, F.array().cast(children.schema[name].dataType)))


def shared_by_all(df: DataFrame, key: str, member: str, members: Sequence) -> DataFrame:
    """Keys that occur with every given member: relational division by counting."""
    wanted = list(dict.fromkeys(members))
    return df.where(F.col(member).isin(wanted)).groupBy(key).agg(F.countDistinct(member).alias("shared")).where(F.col("shared") == len(wanted)).select(key)


def full_outer_ranks(a: DataFrame, b: DataFrame, key: str, k: int = 60) -> DataFrame:
    """Two ranked lists in one, with the sum of reciprocal ranks."""
    one = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    both = a.withColumnRenamed("rank", "rank_a").join(b.withColumnRenamed("rank", "rank_b"), key, "full_outer")
    return both.withColumn("score", one("rank_a") + one("rank_b"))


def exists_either(left: DataFrame, keyed: Sequence[tuple[str, DataFrame, str]], key: str) -> DataFrame:
    """Rows of ``left`` that meet any of several tables, each by its own column: a union of semi joins instead of a join on OR."""
    parts = [left.join(other.select(F.col(c).alias(mine)).distinct(), mine, "left_semi").select(key) for mine, other, c in keyed]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return left.join(found.distinct(), key, "left_semi")


def survivors(df: DataFrame, key: str = "id", pointer: str = "merged_into", hops: int = 5) -> DataFrame:
    """(key, survivor): follow merge pointers up to ``hops`` times."""
    links = df.where(F.col(pointer).isNotNull()).select(F.col(key).alias("__from"), F.col(pointer).alias("__to"))
    out = df.select(key, F.col(key).alias("survivor"))
    for _ in range(hops):
        out = out.join(links, out["survivor"] == links["__from"], "left").select(key, F.coalesce("__to", "survivor").alias("survivor"))
    return out


def add_version(df: DataFrame) -> DataFrame:
    return df.withColumn("version", F.col("version") + 1)
