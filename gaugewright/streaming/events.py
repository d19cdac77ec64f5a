"""Event streams: windows with watermarks, de-duplication, keyed state and keyed sinks.

The window functions take streaming and batch frames alike, so a batch run is the streams' own reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.sinks import read_upserted, write_upsert


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _late(events: DataFrame, late: str | None) -> DataFrame:
    """events with a watermark; times without a zone are taken in the session's."""
    if not late:
        return events
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late)


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str | None = None, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """window_start, window_end, keys, n, total over tumbling or sliding windows of ``ts``."""
    rows = _late(events, late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = rows.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None, key: str = "user_id") -> DataFrame:
    """key, session_start, session_end, n: a session ends after a gap without events."""
    rows = _late(events, late)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def distinct_within(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """First rows of keys, on streams within the watermark's reach."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return _late(events, late).dropDuplicatesWithinWatermark(keys)


def within(left: DataFrame, right: DataFrame, key: str, reach: str, late: str = "10 minutes") -> DataFrame:
    """key, left_id, right_id of events of a key where right comes at most ``reach`` after left (a bounded interval join)."""
    a = _late(left, late).select(F.col(key).alias("__k"), F.col("event_id").alias("left_id"), F.col("ts").alias("left_ts"))
    b = _late(right, late).select(F.col(key), F.col("event_id").alias("right_id"), F.col("ts").alias("right_ts"))
    on = (F.col("__k") == F.col(key)) & (F.col("right_ts") >= F.col("left_ts")) & (F.col("right_ts") <= F.col("left_ts") + F.expr(f"interval {reach}"))
    return a.join(b, on).select(key, "left_id", "right_id")


def first_owners(candidates: DataFrame, unit: str, order: str, idle_ms: int | None = None) -> DataFrame:
    """unit, owner, changed: the least order of each unit so far.  Late, earlier candidates retract an owner, so rows come
    in update mode; ``changed`` counts the owners a unit has had.

    State is two numbers a unit.  With idle_ms a unit without candidates for so long (processing time) is forgotten, and a
    later candidate starts it anew; without it state grows with the units, which a run's own end bounds.
    """

    def run(key, frames, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        owner, changed = state.get if state.exists else (None, 0)
        least = min(int(f[order].min()) for f in frames)
        if owner is None or least < owner:
            owner, changed = least, changed + 1
        state.update((owner, changed))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({unit: [key[0]], "owner": [owner], "changed": [changed]})

    kind = candidates.schema[unit].dataType.simpleString()
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return candidates.select(unit, order).groupBy(unit).applyInPandasWithState(run, f"{unit} {kind}, owner long, changed long", "owner long, changed long", "update", timeout)


class LogState(StatefulProcessor):
    """What a log has said of a key: a value with lines, deciding lines and the last moment, and a timer for its deadline.

    Each line moves the deadline; a timer that was set for an earlier one is deleted, so a key has one timer."""

    def __init__(self, key: str, wait: int):
        self.key, self.wait = key, wait

    def init(self, handle) -> None:
        self.handle = handle
        self.said = handle.getValueState("said", "seen long, decided long, last_us long, timer long")

    def _row(self, key, seen: int, decided: int, last: int, ended: bool):
        import pandas as pd

        status = "decided" if decided else "expired" if ended else "open"
        return pd.DataFrame({self.key: [key[0]], "seen": [seen], "decided": [decided], "last_us": [last], "status": [status]})

    def handleInputRows(self, key, rows, timerValues):
        seen, decided, last, timer = self.said.get() if self.said.exists() else (0, 0, 0, 0)
        for f in rows:
            seen, decided = seen + len(f), decided + int(f["decides"].sum())
            last = max(last, int(f["ts"].max().value // 1000))
        due = max(last // 1000 + self.wait, timerValues.getCurrentWatermarkInMs() + 1)
        if timer and timer != due:
            self.handle.deleteTimer(timer)
        if timer != due:
            self.handle.registerTimer(due)
        self.said.update((seen, decided, last, due))
        yield self._row(key, seen, decided, last, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.said.exists():
            seen, decided, last, _ = self.said.get()
            self.said.clear()
            yield self._row(key, seen, decided, last, True)

    def close(self) -> None:
        pass


def consumed(lines: DataFrame, key: str, decides: Column, deadline: str, late: str = "0 seconds") -> DataFrame:
    """key, seen, decided, last_ts, status: what a log has said of each key so far, in update mode.

    lines: key, ts and whatever ``decides`` looks at.  A key is open until a line decides it; once the watermark is
    ``deadline`` past its last line its timer fires: it comes out a last time, as decided or expired, and its state goes.
    State is in RocksDB, which the session is set to for the stream.
    """
    spark = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = _late(lines, late)
    zone = dict(lines.dtypes)["ts"]
    rows = rows.select(key, "ts", F.coalesce(decides, F.lit(False)).cast("long").alias("decides"))
    kind = lines.schema[key].dataType.simpleString()
    out = rows.groupBy(key).transformWithStateInPandas(LogState(key, int(interval_ms(deadline))), f"{key} {kind}, seen long, decided long, last_us long, status string", "update", "eventTime")
    return out.select(key, "seen", "decided", F.timestamp_micros("last_us").cast(zone).alias("last_ts"), "status")


def interval_ms(text: str) -> int:
    """Milliseconds of an interval such as ``10 minutes``."""
    number, unit = text.split()
    return int(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def inactive(events: DataFrame, key: str, gap: str, late: str | None = None) -> DataFrame:
    """key, last_start, deadline: for each stretch of a key's events when it began and when its inactivity deadline is."""
    rows = sessions(events, gap, late, key)
    return rows.select(key, F.col("session_start").alias("last_start"), F.col("session_end").alias("deadline"))


def pending(targets: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Targets that an output table has no row for: what is left to do when a run is taken up again."""
    return targets.join(done.select(*keys).distinct(), keys, "left_anti")


def upserting(path: str, keys: list[str], seq: str | None = None):
    """A foreachBatch function that upserts each batch by key; a batch that is run again changes nothing.  Without ``seq`` the
    batch's number stands for it, in __batch."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # it is read twice, and a stream's step would run again for each
        try:
            write_upsert(kept if seq is not None else kept.withColumn("__batch", F.lit(number).cast("long")), path, keys, seq or "__batch")
        finally:
            kept.unpersist()

    return write


def run_keyed(query: DataFrame, path: str, keys: list[str], checkpoint: str, mode: str = "update") -> DataFrame:
    """Runs a stream over what is there into a table that holds the last row of each key, and reads that table."""
    q = query.writeStream.foreachBatch(upserting(path, keys)).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = StructType([*query.schema.fields, StructField("__batch", LongType())])
    return read_upserted(query.sparkSession, path, schema).drop("__batch")


def run_once(query: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its result from the driver's memory: for tests."""
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return query.sparkSession.table(name)
