"""Queries of streams and stateful operators, and a few of the engine's own that the reference has no counterpart for."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenfold.plans.registry import query, shared_dir
from lumenfold.streaming import events as S


def _streamed(t, each, batches: int = 1):
    """All events through a checkpointed stream; gives what the stage wrote to the folder that executors share."""
    root = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    stream = S.read_stream(t.spark, t.sf_dir, t.events.schema, "events*.parquet")
    for _ in range(batches):
        S.run_available(stream, lambda df, n: each(df).write.mode("append").parquet(f"{root}/out"), f"{root}/checkpoint")
    return t.spark.read.parquet(f"{root}/out")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
c AS (SELECT user_id, event_id, r, s AS last, true AS ok FROM o WHERE r = 1
 UNION ALL SELECT o.user_id, o.event_id, o.r, CASE WHEN o.s - c.last < 60 THEN c.last ELSE o.s END, o.s - c.last >= 60 FROM c JOIN o ON o.user_id = c.user_id AND o.r = c.r + 1)
SELECT user_id % 5 AS bucket, user_id AS client, event_id AS call_id FROM c WHERE NOT ok""")
def p01_rate_limit_denials(t):
    """Of each user's events, with one call a minute allowed, those that come too early after the last allowed one."""
    calls = t.events.select((F.col("user_id") % 5).alias("bucket"), F.col("user_id").alias("client"), F.col("event_id").alias("call_id"), F.col("ts").alias("at"))
    return S.limited(calls, 1).where("NOT allowed").select("bucket", "client", "call_id")


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY 1")
def p02_incremental_stage(t):
    """Two runs over one folder: the second finds nothing new."""
    done = _streamed(t, lambda df: df.where("value > 50").select("event_id", "event_type"), batches=2)
    return done.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE user_id % 2 = 0")
def p03_outbox(t):
    outbox = t.events.withColumn("published_at", F.when(F.col("user_id") % 2 == 1, F.col("ts")))
    return S.unpublished(outbox).select("event_id")


@query("SELECT event_id, user_id % 2 = 0 AS by_sink FROM events")
def p03_consumed(t):
    """All events through the consumer, twice: those that were not marked before are marked by the sink, once each."""
    from lumenfold.streaming.outbox import Outbox

    events = lambda df: df.withColumn("published_at", F.when(F.col("user_id") % 2 == 1, F.col("ts")))
    box = Outbox(t.spark, f"{shared_dir(t.spark)}/outbox-{uuid.uuid4().hex}", events(t.events).schema, at="ts")
    for _ in range(2):
        box.consume(events(S.read_stream(t.spark, t.sf_dir, t.events.schema, "events*.parquet")))
    seen = box.published().groupBy("event_id").agg(F.count("*").alias("n"))
    marked = box.marked(t.events.withColumn("published_at", F.lit(None).cast("timestamp"))).join(seen, "event_id", "left")
    return marked.select("event_id", (F.col("published_at").isNotNull() & (F.coalesce("n", F.lit(0)) == 1)).alias("by_sink"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS distinct_n FROM events")
def p04_checkpointed_items(t):
    done = _streamed(t, lambda df: df.select("event_id"), batches=2)
    return done.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("distinct_n"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x01_hourly_windows(t):
    """Not in the reference: events by hour."""
    return S.windowed_counts(t.events).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("""SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
 FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2) GROUP BY 1""")
def x02_sessions(t):
    """Not in the reference: sessions with a gap of half an hour."""
    return S.sessions(t.events).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
