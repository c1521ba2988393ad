"""The outbox's consumer: each event reaches the sink once, with its mark, whatever is replayed.

Events are files that only grow. The consumer is a stream with a checkpoint; a micro-batch is written with its marks under the
number of the batch, complete before it has that name. A crash before the name leaves nothing a reader sees; a crash after it,
before the checkpoint knows, has the same batch replayed, which finds its number taken and writes nothing more. So the rows of the
named batches are the events that were published, once each, and the marks cannot differ from them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lumenfold.streaming.events import run_available

#: For how long a producer may write an event again; ids are remembered for so long and no longer.
AGAIN = "1 day"


class Outbox:
    """The sink at ``path`` of events (event_id, occurred_at, published_at, ...): ``batches/<number>``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "event_id", at: str = "occurred_at") -> None:
        self.spark, self.path, self.key, self.at = spark, path.rstrip("/"), key, at
        self.schema = StructType([*schema.fields, *StructType.fromDDL("batch long, marked_at timestamp").fields])
        self._file = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._file(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        folder = self._file(f"{self.path}/batches")
        if not self._files.exists(folder):
            return []
        return sorted(s.getPath().toString() for s in self._files.listStatus(folder) if not s.getPath().getName().startswith("."))

    def take(self, events: DataFrame, batch: int) -> None:
        """Write a batch, unless it is there; then it is only run through, so that the stream's memory of ids advances."""
        target = self._file(f"{self.path}/batches/{batch:012d}")
        if self._files.exists(target):
            events.write.format("noop").mode("overwrite").save()
            return
        own = f"{self.path}/batches/.{uuid.uuid4().hex}"
        events.withColumns({"batch": F.lit(batch).cast("long"), "marked_at": F.current_timestamp()}).write.parquet(own)
        if not self._files.rename(self._file(own), target):
            self._files.delete(self._file(own), True)

    def consume(self, stream: DataFrame, seconds: float | None = None) -> None:
        """Publish what has arrived and is not marked yet. Events repeated within AGAIN are dropped; events behind the newest by more
        than that are late and dropped by the watermark, as it could not be told whether they are repeated."""
        fresh = stream.where("published_at IS NULL").withColumn("__at", F.col(self.at).cast("timestamp")).withWatermark("__at", AGAIN)
        once = fresh.dropDuplicatesWithinWatermark([self.key]).drop("__at")
        run_available(once, self.take, f"{self.path}/checkpoint", seconds)

    def published(self) -> DataFrame:
        """The events that were published, with their batch and mark."""
        found = self.batches()
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def marked(self, events: DataFrame) -> DataFrame:
        """The outbox as a table whose ``published_at`` says what this sink has taken. Rows of one id are one event."""
        marks = self.published().select(self.key, F.col("marked_at").alias("__mark"))
        return events.join(marks, self.key, "left").withColumn("published_at", F.coalesce(F.col("published_at"), F.col("__mark").cast(events.schema["published_at"].dataType))).drop("__mark")
