"""Stages triggered by assets: a stage runs when any, or all, of several tables have something new, once for each combination.

An asset is a folder of files that only grows. A stage keeps, in numbered files under its own folder, which files of each of its
assets it has handled. A run first writes its plan, the files it will hand on, then hands them on under the plan's number, and at
last writes that the plan is done. A run that broke off is repeated under the same number with the same files, so that a
stage whose output is named by that number does nothing twice; new files wait for the next plan.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Handle = Callable[[dict[str, DataFrame], int], None]


class Asset:
    """A folder of Parquet files with a schema."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def files(self) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        return sorted(s.getPath().toString() for s in files.listStatus(folder) if not s.getPath().getName().startswith(("_", ".")))

    def read(self, files: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)


class Stage:
    """``rule``: ``any`` (something new in one of the assets) or ``all`` (in each). ``handle`` gets the new rows of each asset, none
    where there is nothing new, and the run's number. ``state``: the folder of the plans."""

    def __init__(self, spark: SparkSession, state: str, assets: dict[str, Asset], rule: str, handle: Handle) -> None:
        if rule not in ("any", "all"):
            raise ValueError(f"no rule: {rule}")
        self.spark, self.state, self.assets, self.rule, self.handle = spark, state.rstrip("/"), assets, rule, handle
        self._file = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._file(self.state).getFileSystem(spark._jsc.hadoopConfiguration())

    def _there(self, kind: str) -> list[int]:
        folder = self._file(self.state)
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(f".{kind}"))

    def _put(self, run: int, kind: str, said: dict) -> None:
        own = self._file(f"{self.state}/{run:012d}.{kind}.part")
        out = self._files.create(own, True)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        self._files.rename(own, self._file(f"{self.state}/{run:012d}.{kind}"))

    def _plan(self, run: int) -> dict[str, list[str]]:
        rows = self.spark.read.text(f"{self.state}/{run:012d}.plan", wholetext=True).collect()
        return json.loads("".join(r.value for r in rows))

    def handled(self) -> dict[str, set[str]]:
        """Files of the plans that are done."""
        out: dict[str, set[str]] = {name: set() for name in self.assets}
        for run in self._there("done"):
            for name, files in self._plan(run).items():
                out[name] |= set(files)
        return out

    def run(self) -> int | None:
        """Repeat a run that broke off, or make the next one if the rule holds; its number, or None."""
        plans, done = self._there("plan"), self._there("done")
        if len(plans) > len(done):
            number = plans[-1]
            plan = self._plan(number)
        else:
            seen = self.handled()
            plan = {name: [f for f in a.files() if f not in seen[name]] for name, a in self.assets.items()}
            new = [bool(files) for files in plan.values()]
            if not (any(new) if self.rule == "any" else all(new)):
                return None
            number = len(plans)
            self._put(number, "plan", plan)
        self.handle({name: self.assets[name].read(files) for name, files in plan.items()}, number)
        self._put(number, "done", {})
        return number


def chain(stages: Sequence[Stage], most: int = 100) -> int:
    """Run stages until none has anything to do; the number of runs. Stages that feed themselves end with an error."""
    runs = 0
    while any([stage.run() is not None for stage in stages]):
        runs += 1
        if runs > most:
            raise RuntimeError(f"after {most} rounds there is still something new")
    return runs
