"""Stored tables that change by partition: a write rewrites the partitions it touches and commits a new version of the table.

A row's partition is a hash of the table's key columns, so that whatever a merge policy compares lies in one partition. A version is
a small file, a list of the folder of each partition; committing gives it the next number under a name that must not be there
yet. Of two writers of one version the second finds the name taken: if the other one touched none of its partitions it goes
on from there, otherwise it is refused and nothing has changed. Data files are never changed, so readers keep what they read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Partitions of a new table; a version names them all, so the number is fixed by the table and not by its rows.
PARTITIONS = 64


class Conflict(RuntimeError):
    """Another writer has changed the same partitions since this one read them."""


class VersionedTable:
    """A table at ``path``: ``versions/<number>.json`` and ``data/<write>/p=<partition>``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._file = jvm.Path
        self._files = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.FileContext.getFileContext(self._files.getUri(), spark._jsc.hadoopConfiguration())
        self._options = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0)

    # Versions

    def versions(self) -> list[int]:
        folder = self._file(f"{self.path}/versions")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """What a version says; the newest without a number."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise LookupError(f"no version {'' if version is None else version} of {self.path}")
        name = f"{self.path}/versions/{known[-1] if version is None else version:012d}.json"
        return json.loads("".join(r.value for r in self.spark.read.text(name, wholetext=True).collect()))

    def _commit(self, said: dict) -> bool:
        """Give a manifest its number; False if that is taken. It is complete before it has its name."""
        own = self._file(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = self._files.create(own, False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        try:
            self._context.rename(own, self._file(f"{self.path}/versions/{said['version']:012d}.json"), self._options)
        except Py4JJavaError as e:
            self._files.delete(own, False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    # Reads

    def read(self, version: int | None = None) -> DataFrame:
        said = self.manifest(version)
        return self._rows(said, said["partitions"])

    def _rows(self, said: dict, partitions: Sequence[str]) -> DataFrame:
        schema = StructType.fromJson(said["schema"])
        paths = [f"{self.path}/data/{said['partitions'][p]}/p={p}" for p in partitions if p in said["partitions"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # Writes

    def _place(self, keys: Sequence[str], partitions: int) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(partitions)).cast("int")

    def _write(self, rows: DataFrame, keys: Sequence[str], partitions: int) -> tuple[str, list[str]]:
        """The folder of a write and the partitions in it."""
        write = uuid.uuid4().hex
        target = f"{self.path}/data/{write}"
        rows.withColumn("p", self._place(keys, partitions)).hint("rebalance", "p").write.partitionBy("p").parquet(target)
        return write, sorted(s.getPath().getName()[2:] for s in self._files.listStatus(self._file(target)) if s.isDirectory())

    def create(self, rows: DataFrame, keys: Sequence[str], partitions: int = PARTITIONS) -> VersionedTable:
        """The first version. ``keys``: the columns whose equal values a merge may compare."""
        write, found = self._write(rows, keys, partitions)
        said = {"version": 1, "schema": rows.schema.jsonValue(), "keys": list(keys), "count": partitions, "partitions": dict.fromkeys(found, write), "touched": found}
        if not self._commit(said):
            raise Conflict(f"{self.path} is there")
        return self

    def touched(self, keys: DataFrame, said: dict | None = None) -> list[str]:
        """The partitions of these keys; at most as many as the table has come to the driver."""
        said = said or self.manifest()
        places = keys.select(self._place(said["keys"], said["count"]).alias("p")).distinct().collect()
        return [str(r.p) for r in sorted(places)]

    def update(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """Rewrite the partitions of ``keys`` as what ``change`` makes of their rows, and give the new version. Rows may come, go
        and change but must stay within those partitions. No keys: nothing is written."""
        said = self.manifest()
        places = self.touched(keys, said)
        if not places:
            return said["version"]
        rows = change(self._rows(said, places)).select(*StructType.fromJson(said["schema"]).fieldNames())
        write, found = self._write(rows, said["keys"], said["count"])
        if not set(found) <= set(places):
            self._files.delete(self._file(f"{self.path}/data/{write}"), True)
            raise ValueError("rows have left the partitions of the keys that were to change")
        base = said["version"]
        while True:
            kept = {p: w for p, w in said["partitions"].items() if p not in places}
            new = said | {"version": said["version"] + 1, "partitions": kept | dict.fromkeys(found, write), "touched": places}
            if self._commit(new):
                return new["version"]
            said = self.manifest()
            others = {p for v in self.versions() if v > base for p in self.manifest(v)["touched"]}
            if others & set(places):
                self._files.delete(self._file(f"{self.path}/data/{write}"), True)
                raise Conflict(f"{self.path} has changed since version {base}")

    def merge(self, rows: DataFrame, policy: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Apply a merge policy (``overwrite``, ``fill_merge``, ``replace_children`` and others) to the partitions of the rows."""
        return self.update(rows, lambda table: policy(table, rows))

    def replace(self, rows: DataFrame) -> int:
        """A version with these rows only."""
        said = self.manifest()
        write, found = self._write(rows, said["keys"], said["count"])
        every = [str(p) for p in range(said["count"])]
        new = said | {"version": said["version"] + 1, "schema": rows.schema.jsonValue(), "partitions": dict.fromkeys(found, write), "touched": every}
        if not self._commit(new):
            self._files.delete(self._file(f"{self.path}/data/{write}"), True)
            raise Conflict(f"{self.path} has changed since version {said['version']}")
        return new["version"]

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the newest versions, and delete what only these read; gives the number of deleted folders. Not while a write
        is under way: what is not committed yet would go too."""
        known = self.versions()
        held = {(w, p) for v in known[-keep:] for p, w in self.manifest(v)["partitions"].items()}
        for v in known[:-keep]:
            self._files.delete(self._file(f"{self.path}/versions/{v:012d}.json"), False)
        gone = 0
        for write in self._files.listStatus(self._file(f"{self.path}/data")):
            places = [s.getPath() for s in self._files.listStatus(write.getPath()) if s.isDirectory()]
            free = [p for p in places if (write.getPath().getName(), p.getName()[2:]) not in held]
            for p in free:
                self._files.delete(p, True)
            gone += len(free)
            if len(free) == len(places):
                self._files.delete(write.getPath(), True)
        return gone
