"""All queries of the reference's operators by name, with their SQL."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The driver's tables, read by attribute; timestamps come as they are stored."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Register a query under its function's name; ``sql`` gives the same rows in the oracle's dialect."""

    def register(f: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return register


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session of one machine may do without, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext._jsc.sc().isLocal():
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return (found or tempfile.mkdtemp(prefix="lumenfold-")).rstrip("/")


def long(c: str) -> F.Column:
    return F.col(c).cast("long").alias(c)


def load() -> None:
    from lumenfold.plans import q_catalog, q_extras, q_graph, q_merge, q_records, q_resolve, q_retrieval, q_sources  # noqa: F401


def kept_dir(t: Tables, table: str, name: str) -> str:
    """The folder of an index of a table, the same for the same files (names, lengths, times of change) in one session; it is deleted
    when the driver's JVM ends."""
    spark = t.spark
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    source = hadoop(f"{t.sf_dir}/{table}.parquet")
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    state = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in files.listStatus(source))
    if not hasattr(spark.sparkContext, "_lumenfold_kept"):
        spark.sparkContext._lumenfold_kept = f"{shared_dir(spark)}/indexes-{uuid.uuid4().hex}"
    path = f"{spark.sparkContext._lumenfold_kept}/{name}-{hashlib.sha256(str(state).encode()).hexdigest()[:24]}"
    target = hadoop(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
