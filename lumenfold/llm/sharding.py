"""Two-pass external shuffle into shards.

The first pass scatters the records uniformly over buckets, by a seeded hash of their contents, so many that one fits in
memory; equal records of one partition are numbered, so that copies of one row scatter too. The scattered records are written
once, and everything after reads what was written: a record's number among its copies depends on how its partition was cut, and
may differ from one reading of the input to the next. The second pass reads each bucket whole, puts it in an order that does not depend on how it came, shuffles it by Fisher and Yates with a generator of its own,
and writes it. The buckets one after another are a random permutation of all records; dealt in turn, position by position,
they make shards whose counts are at most one apart, and a bucket's records of one shard are a run of its slots: one file.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenfold.llm.common import lean, release_at_end, shared_dir, ship, stored

OWN = ("shard", "slot", "position")


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of n rows: for i from the last down, swap i with one of 0..i."""
    draw = np.random.Generator(np.random.PCG64([seed, bucket]))
    order = list(range(n))
    picks = (draw.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def copies(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """How many rows of the same hash went before in the partition. Rows of one hash are equal, so a partition that is read again
    in another order gives the same rows."""
    seen: Counter[int] = Counter()
    for part in hashes:
        values, at, many = np.unique(part.to_numpy(np.int64), return_inverse=True, return_counts=True)
        first = np.array([seen[v] for v in values.tolist()], np.int64)
        order = np.argsort(at, kind="stable")
        within = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        out = np.empty(len(at), np.int64)
        out[order] = within
        yield pd.Series(out + first[at])
        seen.update(dict(zip(values.tolist(), many.tolist(), strict=True)))


def own_name(names: list[str], name: str) -> str:
    """A column name that the input does not have."""
    while name in names:
        name += "_"
    return name


def shuffle(df: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 32 << 20) -> DataFrame:
    """All columns of the input with (shard int, slot long, position long): position in the permutation, shard = position
    modulo the number of shards, slot = position in the shard, gapless from 0. A bucket's rows come in the order of positions.

    Input columns of those names are replaced. Null ids and texts are records as any other; repeated ids scatter by their
    texts. Rows with equal id and text are records of their own; which of them comes first cannot be told. Bytes of a record: those
    of its text and 64 more.
    """
    ship(df.sparkSession)
    base = df.drop(*OWN)
    size = F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0)) + 64
    total = base.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first().n
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    # A null id or text is not an empty one.
    content = [F.col(id_col), F.col(id_col).isNull(), F.col(text_col), F.col(text_col).isNull()]
    copy = F.pandas_udf(copies, "long")(F.xxhash64(F.lit(seed + 2), *content))
    name, key = own_name(base.columns, "bucket"), own_name(base.columns, "key")
    keyed = base.withColumn(key, F.xxhash64(F.lit(seed), *content, copy))
    placed = stored(keyed.withColumn(name, F.pmod(F.col(key), F.lit(n_buckets)).cast("int")), "scattered", "zstd")
    # A long a bucket goes to the driver and back: 100 TB make about three million.
    counts = placed.groupBy(F.col(name).alias("b")).count().toPandas()
    sizes = np.zeros(n_buckets, np.int64)
    sizes[counts["b"].to_numpy(np.int64)] = counts["count"].to_numpy(np.int64)
    starts = df.sparkSession.sparkContext.broadcast(np.cumsum(sizes) - sizes)
    scattered = placed.repartitionById(n_buckets, F.col(name)).sortWithinPartitions(name, key, id_col, text_col).drop(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(bucket: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            table = table.remove_column(table.schema.get_field_index(name))
            order = fisher_yates(len(table), seed, bucket)
            for i in range(0, len(table), 2000):
                part = table.take(order[i : i + 2000]).combine_chunks()
                place = starts.value[bucket] + np.arange(i, i + len(part))
                part = part.append_column("shard", pa.array(place % shards, pa.int32())).append_column("slot", pa.array(place // shards, pa.int64())).append_column("position", pa.array(place, pa.int64()))
                yield from part.to_batches()

        held: list[pa.RecordBatch] = []
        current = None
        for b in batches:
            ids = b.column(name).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if held and ids[i] != current:
                    yield from whole(current, held)
                    held = []
                current = int(ids[i])
                held.append(b.slice(i, j - i))
        if held:
            yield from whole(current, held)

    schema = ", ".join(f"`{c}` {t}" for c, t in base.dtypes)
    return scattered.mapInArrow(lean(run), f"{schema}, shard int, slot long, position long")


def write_shards(shuffled: DataFrame, path: str | None = None) -> DataFrame:
    """Write a folder for each shard and read them back. A task writes a file for each shard and partition it has, with rows in the
    order of their slots; nothing is shuffled again. Files of a shard, ordered by their first slot, are the shard. Without a
    path they go to a new folder in the shared one, which is deleted when the driver's JVM ends."""
    spark = shuffled.sparkSession
    target = path or f"{shared_dir(spark)}/lumenfold/shards-{uuid.uuid4().hex}"
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(target)
    if not path:
        release_at_end(spark, target)
    return spark.read.schema(shuffled.schema).parquet(target).select(*[f"`{c}`" for c in shuffled.columns])
