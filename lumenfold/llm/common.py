"""Helpers shared by the training-data operators: shared storage, worker imports, byte views of Arrow columns and hashing."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
#: Bytes of text that the vectorised operators hold as numpy arrays at once (a longer single text is held whole).
CHUNK_BYTES = 1 << 19
#: Rows of an Arrow batch, where the session has Spark's default: whole texts are large, and several workers share an executor.
BATCH_ROWS, DEFAULT_ROWS = "1000", "10000"

pa.set_memory_pool(pa.system_memory_pool())  # large buffers go back to the system as soon as they are free



def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, also where the driver found it by its own path; keep batches of texts small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if str(ROOT) in paths or getattr(sc, "_lumenfold_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(), "lumenfold.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "lumenfold").rglob("*.py")):
            z.write(p, str(p.relative_to(ROOT)))
    sc.addPyFile(target)
    sc._lumenfold_shipped = True


def lean(run: Callable) -> Callable:
    """A task's function over Arrow batches, after which the worker gives the memory it no longer uses back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session of one machine may do without, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = getattr(sc, "_lumenfold_dir", None)
        if not found:
            found = sc._lumenfold_dir = tempfile.mkdtemp(prefix="lumenfold-")
    return found.rstrip("/")


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation. It
    is deleted when the driver's JVM ends, or earlier by ``release``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenfold/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    forget(spark)
    release_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenfold_path = path
    return out


def forget(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a finished query when the driver's JVM collects the query, which a large run may put off
    until the disk is full; a collection takes a fraction of a second."""
    spark.sparkContext._jvm.System.gc()


def release_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder that is there when the driver's JVM ends."""
    files, target = _files(spark, path)
    files.deleteOnExit(target)


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing still to be computed reads."""
    for t in tables:
        files, target = _files(t.sparkSession, t._lumenfold_path)
        files.delete(target, True)


def broadcast_file(spark: SparkSession, path: str):
    """The bytes of a driver-side file (a tokenizer's vocabulary, a few MB), sent to the executors."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values' UTF-8 bytes one after another, and the n + 1 offsets of the values in them; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if wide else pa.binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null may still own bytes of the buffer
        keep = np.asarray(column.is_valid())
        n = np.where(keep, np.diff(off), 0)
        if (n != np.diff(off)).any():
            raw = np.concatenate([raw[a:b] for a, b, k in zip(off[:-1], off[1:], keep, strict=True) if k] or [raw[:0]])
            return raw, np.concatenate([[0], np.cumsum(n)])
    return raw[off[0] : off[-1]], off - off[0]


def spans(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, of one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SEED = np.random.default_rng(20240229)
#: A random odd-spaced value for each byte, and the base of the polynomial hash with its inverse modulo 2**64.
BYTE_VALUE = _SEED.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        up, down = np.full(size, BASE), np.full(size, INVERSE)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums; ``window_hash`` takes any substring's hash from them."""
    out = np.zeros(len(data) + 1, np.uint64)
    values = BYTE_VALUE[data]
    values *= powers(len(data) + 1)[0][: len(data)]
    np.cumsum(values, out=out[1:])
    return out


def window_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:stop], equal for equal bytes wherever they stand."""
    return mix((sums[stop] - sums[start]) * powers(len(sums))[1][start])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


#: Bits of the bitmap of keys that ``maybe_in`` broadcasts: 4 MB whatever the number of keys.
BITMAP_BITS = 1 << 25


def bitmap(keys: DataFrame, column: str):
    """The broadcast bitmap of a long column, BITMAP_BITS bits in 64-bit words; a value's bit is its residue.

    The driver gets one word for each 64 bits at most, whatever the number of rows.
    """
    from pyspark.sql import functions as F

    bit = F.pmod(F.col(column), F.lit(BITMAP_BITS)).cast("long")
    words = keys.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 AS int)))").alias("m")).toPandas()
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64)
    return keys.sparkSession.sparkContext.broadcast(out)


def maybe_in(keys: DataFrame, column: str):
    """A predicate on a long column: false only where no row of ``keys`` has that value in ``column``.

    With many more keys than bits of the bitmap the predicate lets more rows through; whoever uses it has to be right for those
    too.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    shared = bitmap(keys, column)

    def there(k):
        import pandas as pd

        b = np.mod(k.to_numpy(np.int64), BITMAP_BITS)
        return pd.Series((shared.value[b >> 6] >> (b & 63) & 1).astype(bool))

    return pandas_udf(there, "boolean")
