"""Streams give what the same functions give on the whole table."""

import random

import pytest

from gaugewright.operators.coverage import owners
from gaugewright.sources import sinks
from gaugewright.streaming import events as streams

PATH = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def stream(spark, tmp_path):
    rows = spark.read.parquet(PATH)
    folder = tmp_path / "in"
    rows.repartition(3).write.parquet(str(folder))
    return streams.read_events(spark, str(folder), rows.schema, files_per_trigger=1)


def same(a, b):
    return sorted(map(repr, (tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in a.collect()))) == sorted(map(repr, (tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in b.collect())))


def test_windows(spark, stream, tmp_path):
    batch = spark.read.parquet(PATH)
    for i, args in enumerate((("1 hour",), ("30 minutes", "10 minutes"))):
        got = streams.run_once(streams.windowed(stream, *args), f"w{i}", str(tmp_path / f"c{i}"), "complete")
        assert same(got, streams.windowed(batch, *args))


def test_sessions(spark, stream, tmp_path):
    got = streams.run_once(streams.sessions(stream, "2 hours"), "s", str(tmp_path / "c"), "complete")
    assert same(got, streams.sessions(spark.read.parquet(PATH), "2 hours"))


def test_late_rows_are_dropped_in_append_mode(spark, stream, tmp_path):
    got = streams.run_once(streams.windowed(stream, "1 hour", late="40 days"), "l", str(tmp_path / "c"), "append")
    assert got.count() == 0  # no window has closed yet


def test_distinct_and_interval_join(spark, stream, tmp_path):
    got = streams.run_once(streams.distinct_within(stream.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "60 days"), "d", str(tmp_path / "c"))
    batch = spark.read.parquet(PATH)
    assert got.select("user_id", "event_type").distinct().count() == got.count() == batch.select("user_id", "event_type").distinct().count()
    view, buy = "event_type = 'view'", "event_type = 'purchase'"
    got = streams.run_once(streams.within(stream.where(view), stream.where(buy), "user_id", "1 hour", "60 days"), "j", str(tmp_path / "e"))
    assert same(got, streams.within(batch.where(view), batch.where(buy), "user_id", "1 hour"))


def test_owners_are_retracted(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(20), rng.randrange(100)) for _ in range(300)]
    frame = spark.createDataFrame(rows, "unit long, seq long")
    frame.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streams.read_events(spark, str(tmp_path / "in"), frame.schema, files_per_trigger=1)
    got = streams.run_once(streams.first_owners(stream, "unit", "seq"), "o", str(tmp_path / "c"), "update")
    last = got.groupBy("unit").agg({"owner": "min"}).collect()
    want = owners(frame, frame.where("false"), ["unit"], "seq").collect()
    assert {tuple(r) for r in last} == {tuple(r) for r in want}


def test_upserting_sink(spark, tmp_path):
    frame = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "k int, seq int, v string")
    frame.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = streams.read_events(spark, str(tmp_path / "in"), frame.schema, files_per_trigger=1)
    sink = streams.upserting(str(tmp_path / "t"), ["k"], "seq")
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sinks.read_upserted(spark, str(tmp_path / "t"))
    assert {r["k"]: r["v"] for r in got.collect()}[2] == "c" and got.count() == 2


def test_log_consumption(spark, tmp_path):
    """Lines of a key add up over batches; a key whose deadline the watermark passes comes out a last time."""
    rows = [(1, "2024-01-01 00:00:00", "start"), (2, "2024-01-01 00:01:00", "start"), (2, "2024-01-01 00:02:00", "keep"), (3, "2024-01-01 05:00:00", "start"), (3, "2024-01-01 09:00:00", "start")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "k long, ts string, line string").selectExpr("k", "cast(ts as timestamp) ts", "line").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from pyspark.sql import functions as F

    stream = streams.read_events(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_trigger=1)
    got = streams.run_once(streams.consumed(stream, "k", F.col("line") == "keep", "10 minutes"), "logs", str(tmp_path / "c"), "update").collect()
    by = {}
    for r in got:
        by.setdefault(r["k"], []).append((r["seen"], r["decided"], r["status"]))
    assert (2, 1, "decided") in by[2] and by[1][0] == (1, 0, "open")
    assert by[1][-1][2] == "expired" and by[2][-1][2] == "decided" and by[3][-1][2] in ("open", "expired")


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """The keyed sink gets a batch twice, and an older one again: the table holds the last row of each key."""
    from pyspark.sql import functions as F

    sink = streams.upserting(str(tmp_path / "t"), ["k"])
    batch = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    read = lambda: sorted((r["k"], r["v"]) for r in sinks.read_upserted(spark, str(tmp_path / "t")).collect())
    sink(batch((1, "a"), (2, "b")), 0)
    sink(batch((2, "c"), (3, "d")), 1)
    assert read() == [(1, "a"), (2, "c"), (3, "d")]
    sink(batch((2, "c"), (3, "d")), 1)
    assert read() == [(1, "a"), (2, "c"), (3, "d")]
    empty = streams.run_keyed(streams.read_events(spark, str(tmp_path / "none"), batch().schema).select("k", F.upper("v").alias("v")), str(tmp_path / "e"), ["k"], str(tmp_path / "c")) if (tmp_path / "none").mkdir() is None else None
    assert empty.count() == 0 and empty.columns == ["k", "v"]


def test_log_timers_move_with_lines(spark, tmp_path):
    """A line before the deadline moves it: the key has not expired where the first deadline was."""
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:08:00"), (2, "2024-01-01 00:12:00"), (2, "2024-01-01 00:30:00"), (2, "2024-01-01 00:31:00")]
    for k, ts in rows:
        spark.createDataFrame([(k, ts, "x")], "k long, ts string, line string").selectExpr("k", "cast(ts as timestamp) ts", "line").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from pyspark.sql import functions as F

    stream = streams.read_events(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_trigger=1)
    got = streams.run_once(streams.consumed(stream, "k", F.col("line") == "keep", "10 minutes"), "timers", str(tmp_path / "c"), "update").collect()
    assert [(r["seen"], r["status"]) for r in got if r["k"] == 1] == [(1, "open"), (2, "open"), (2, "expired")]


def test_pending_targets(spark):
    targets = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    assert {r["k"] for r in streams.pending(targets, spark.createDataFrame([(2, "x"), (2, "y")], "k int, w string"), ["k"]).collect()} == {1, 3}


def test_inactivity_deadlines(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:03:00"), (1, "2024-01-01 01:00:00")], "user_id long, ts string").selectExpr("user_id", "cast(ts as timestamp) ts")
    got = sorted((str(r["last_start"]), str(r["deadline"])) for r in streams.inactive(rows, "user_id", "5 minutes").collect())
    assert got == [("2024-01-01 00:00:00", "2024-01-01 00:08:00"), ("2024-01-01 01:00:00", "2024-01-01 01:05:00")]


def test_a_batch_is_computed_once_and_a_bucket_is_one_file(spark, tmp_path):
    """A batch's step runs once though the sink reads its rows twice; its rows of a bucket come from one task."""
    from pyspark.sql import functions as F

    ran = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            ran.add(len(f))
            yield f

    sink = streams.upserting(str(tmp_path / "t"), ["k"])
    sink(spark.range(0, 2000, 1, 4).select(F.col("id").alias("k")).mapInPandas(counted, "k long"), 0)
    assert ran.value == 2000
    files = list((tmp_path / "t").glob("v*/__bucket=*/*.parquet"))
    assert len(files) == sinks.BUCKETS and sinks.read_upserted(spark, str(tmp_path / "t")).count() == 2000
