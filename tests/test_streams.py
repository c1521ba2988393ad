"""The limiter, incremental runs with checkpoints, windows and sessions."""

import datetime as dt

from pyspark.sql import functions as F

from lumenfold.streaming import events as S

CALLS = [(0, True), (10, True), (20, False), (59, False), (60, True), (69, False), (70, True), (200, True)]


def calls(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("b", "c", i, t0 + dt.timedelta(seconds=s)) for i, (s, _) in enumerate(CALLS)] + [("b", "d", 99, t0)]
    return spark.createDataFrame(rows, "bucket string, client string, call_id long, at timestamp")


def test_limiter_forgets_denied_calls(spark):
    got = {r.call_id: r.allowed for r in S.limited(calls(spark), 2).collect()}
    assert got == {i: ok for i, (_, ok) in enumerate(CALLS)} | {99: True}


def test_limiter_on_a_stream(spark, tmp_path):
    rows = calls(spark)
    seen = {}

    def take(df, n):
        seen.update({r.call_id: r.allowed for r in df.collect()})

    (tmp_path / "in").mkdir()
    stream = S.limited_stream(S.read_stream(spark, str(tmp_path / "in"), rows.schema), 2)
    for part in (rows.where("call_id < 4"), rows.where("call_id >= 4")):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        S.run_available(stream, take, str(tmp_path / "checkpoint"), 60)
    assert seen == {i: ok for i, (_, ok) in enumerate(CALLS)} | {99: True}


def test_limiter_forgets_idle_clients_and_drops_late_calls(spark, tmp_path):
    """Timers follow the calls' own time: a client goes when the newest call of all is far enough ahead."""
    t0 = dt.datetime(2024, 1, 1)
    at = lambda minutes: t0 + dt.timedelta(minutes=minutes)
    seen = {}
    (tmp_path / "in").mkdir()
    parts = [[("b", "idle", 1, at(0)), ("b", "busy", 2, at(0))], [("b", "busy", 3, at(9)), ("b", "idle", 4, at(0.5))], [("b", "busy", 5, at(60))], [("b", "idle", 6, at(30)), ("b", "idle", 7, at(61)), ("b", "busy", 8, at(60.5))]]
    schema = "bucket string, client string, call_id long, at timestamp"
    stream = S.limited_stream(S.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), 1)
    states = []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        S.run_available(stream, lambda df, n: seen.update({r.call_id: r.allowed for r in df.collect()}), str(tmp_path / "checkpoint"), 60)
        states.append({r.key.client for r in spark.read.format("statestore").load(str(tmp_path / "checkpoint")).collect()})
    assert seen == {1: True, 2: True, 3: True, 4: False, 5: True, 7: True, 8: False}  # 6 came half an hour late
    assert states[:3] == [{"idle", "busy"}, {"idle", "busy"}, {"busy"}] and states[3] == {"idle", "busy"}


def test_a_run_that_does_not_end_is_stopped(spark, sf, tmp_path):
    import time

    import pytest

    stream = S.read_stream(spark, sf, spark.read.parquet(f"{sf}/events.parquet").schema, "events*.parquet")
    with pytest.raises(TimeoutError):
        S.run_available(stream, lambda df, n: time.sleep(30), str(tmp_path / "checkpoint"), 3)


def test_stages_handle_each_file_once(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    stream = S.read_stream(spark, str(tmp_path / "in"), events.schema)
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        events.where(part).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):
            S.run_available(stream, lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "checkpoint"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_windows_and_sessions(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert S.windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()
    assert S.sessions(events).agg(F.sum("n")).first()[0] == events.count()
    outbox = events.withColumn("published_at", F.when(F.col("event_id") > 5, F.col("ts")))
    assert [r.event_id for r in S.unpublished(outbox).collect()] == sorted(r.event_id for r in events.where("event_id <= 5").collect())


OUTBOX = "event_id long, kind string, occurred_at timestamp, published_at timestamp"


def outbox_rows(spark, ids, minute=0, marked=()):
    t0 = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    return spark.createDataFrame([(i, f"k{i}", t0, t0 if i in marked else None) for i in ids], OUTBOX)


def test_outbox_publishes_each_event_once(spark, tmp_path):
    """Repeated events, marked ones, an empty run, and a run that breaks off before and after its batch has its name."""
    from lumenfold.streaming.outbox import Outbox

    (tmp_path / "in").mkdir()
    put = lambda df: df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = outbox_rows(spark, [1]).schema
    stream = S.read_stream(spark, str(tmp_path / "in"), schema)
    box = Outbox(spark, str(tmp_path / "sink"), schema)
    ids = lambda: sorted(r.event_id for r in box.published().collect())
    assert ids() == []
    put(outbox_rows(spark, [1, 2, 3, 4], marked=[4]))
    box.consume(stream, 90)
    assert ids() == [1, 2, 3]
    box.consume(stream, 90)
    put(outbox_rows(spark, [3, 5, 5], 1))
    whole = box.take

    def breaks_before(events, batch):
        events.write.mode("overwrite").parquet(f"{box.path}/batches/.half")
        raise RuntimeError("lost")

    def breaks_after(events, batch):
        whole(events, batch)
        raise RuntimeError("lost")

    for broken, want in ((breaks_before, [1, 2, 3]), (breaks_after, [1, 2, 3, 5])):
        box.take = broken
        try:
            box.consume(stream, 90)
            raise AssertionError("the run has to fail")
        except Exception as e:
            assert "lost" in str(e)
        assert ids() == want
    box.take = whole
    box.consume(stream, 90)
    assert ids() == [1, 2, 3, 5]
    put(outbox_rows(spark, [6], 2))
    box.consume(stream, 90)
    assert ids() == [1, 2, 3, 5, 6]
    table = box.marked(spark.read.parquet(str(tmp_path / "in")))
    assert table.where("published_at IS NULL").count() == 0


def test_stages_run_once_for_each_combination(spark, tmp_path):
    from lumenfold.streaming.assets import Asset, Stage, chain

    schema = spark.range(1).schema
    a, b, out = (Asset(spark, str(tmp_path / n), schema) for n in ("a", "b", "out"))
    put = lambda asset, n: spark.range(n, n + 1).coalesce(1).write.mode("append").parquet(asset.path)
    seen = []

    def both(rows, n):
        seen.append(("all", n, sorted(r.id for r in rows["a"].collect()), sorted(r.id for r in rows["b"].collect())))
        rows["a"].union(rows["b"]).coalesce(1).write.mode("overwrite").parquet(f"{out.path}-{n}")
        spark.read.parquet(f"{out.path}-{n}").coalesce(1).write.mode("append").parquet(out.path)

    stages = [Stage(spark, str(tmp_path / "s1"), {"a": a, "b": b}, "all", both), Stage(spark, str(tmp_path / "s2"), {"a": a, "out": out}, "any", lambda rows, n: seen.append(("any", n, sorted(r.id for r in rows["a"].collect()), sorted(r.id for r in rows["out"].collect()))))]
    assert chain(stages) == 0
    put(a, 1)
    chain(stages)
    assert seen == [("any", 0, [1], [])]  # the other one waits for b
    put(b, 2)
    put(a, 3)
    chain(stages)
    assert seen[1:] == [("all", 0, [1, 3], [2]), ("any", 1, [3], [1, 2, 3])]
    assert chain(stages) == 0

    broken = Stage(spark, str(tmp_path / "s3"), {"a": a}, "any", lambda rows, n: 1 / 0)
    for _ in range(2):
        try:
            broken.run()
            raise AssertionError("the run has to fail")
        except ZeroDivisionError:
            pass
    put(a, 4)  # comes after the plan that broke off, so it waits
    got = []
    whole = Stage(spark, str(tmp_path / "s3"), {"a": a}, "any", lambda rows, n: got.append((n, sorted(r.id for r in rows["a"].collect()))))
    assert (whole.run(), whole.run(), whole.run()) == (0, 1, None) and got == [(0, [1, 3]), (1, [4])]
