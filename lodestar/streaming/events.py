"""Event time: windows over a stream with late rows, and sessions as keyed state with a timer."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import store

#: What a stream of events holds: the schema of the events table.
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_each: int = 1, schema: str = EVENTS) -> DataFrame:
    """A stream of the Parquet files in ``folder`` (or of one file), ``files_each`` a micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each)
    if store.is_file(spark, folder):
        above, name = folder.rsplit("/", 1)
        reader, folder = reader.option("pathGlobFilter", name), above
    rows = reader.parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time with a zone


def tumbling(time: str, length: str) -> Column:
    return F.window(time, length)


def sliding(time: str, length: str, step: str) -> Column:
    return F.window(time, length, step)


def sessions(time: str, gap: str) -> Column:
    return F.session_window(time, gap)


def windowed(rows: DataFrame, window: Column, time: str, keys: list[str], late: str, *measures: Column) -> DataFrame:
    """(keys, start, stop, measures) of each window. On a stream rows later than ``late`` behind the latest time seen are dropped, and a
    window appears once, when no row can come to it any more; on a table nothing is late. Rows without a time are in no window."""
    groups = rows.withWatermark(time, late).groupBy(*keys, window.alias("_w")).agg(*measures)
    names = [c for c in groups.columns if c not in keys and c != "_w"]
    return groups.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("stop"), *names)


SESSIONS = "user_id long, first timestamp, last timestamp, n long, total double, first_event long, last_event long"


class Session(StatefulProcessor):
    """A user's open sessions: first and last time, number of events, sum of values, ids of the first and last event.

    An event less than the gap from a session joins it, and may join two sessions to one. A session is given out when the watermark has
    passed its end, which a timer tells, so that an event that is not late finds every session it can belong to.
    """

    def __init__(self, gap_seconds: float):
        self.gap = timedelta(seconds=gap_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("sessions", SESSIONS.removeprefix("user_id long, "))

    def _ends(self, session: tuple) -> int:
        """The first whole millisecond at which no event can join a session any more."""
        return int((session[1] + self.gap).replace(tzinfo=UTC).timestamp() * 1000) + 1

    def _keep(self, held: list[tuple]) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if held:
            self.open.put(held)
            self.handle.registerTimer(min(map(self._ends, held)))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = []
        for frame in rows:
            for ts, event, value in zip(frame["ts"].tolist(), frame["event_id"], frame["value"], strict=True):
                event, value = int(event), 0.0 if value is None or value != value else float(value)
                at = ts.to_pydatetime().replace(tzinfo=None)
                new.append((at, at, 1, value, event, event))
        held: list[tuple] = []
        for s in sorted([*map(tuple, self.open.get()), *new], key=lambda s: (s[0], s[4])):
            if held and s[0] < held[-1][1] + self.gap:
                first, last, n, total, opened, ended = held[-1]
                end = max((last, ended), (s[1], s[5]))
                held[-1] = first, end[0], n + s[2], total + s[3], opened, end[1]
            else:
                held.append(s)
        self._keep(held)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, held = timerValues.getCurrentWatermarkInMs(), [tuple(s) for s in self.open.get()]
        over = [s for s in held if self._ends(s) <= now]
        self._keep([s for s in held if self._ends(s) > now])
        if over:
            yield pd.DataFrame([(key[0], *s) for s in over], columns=[c.split()[0] for c in SESSIONS.split(", ")])

    def close(self) -> None:
        pass


def user_sessions(events: DataFrame, gap_seconds: float, late: str) -> DataFrame:
    """(user_id, first, last, n, total, first_event, last_event): closed sessions of a stream of events, each once.

    State is the sessions of a user that the watermark has not passed. Events without a user or a time take no part; null values count 0.
    """
    known = events.filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select("user_id", "ts", "event_id", "value").withWatermark("ts", late)
    return known.groupBy("user_id").transformWithStateInPandas(Session(gap_seconds), SESSIONS, "Append", "EventTime")


def written(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Run a stream over what there is and append what it gives to Parquet ``folder``; run again with the same ``checkpoint``, it goes on
    behind what was read, and writes no row twice. State lies in RocksDB, which keyed state with timers needs."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
        query.awaitTermination()
    finally:
        conf.set(name, before)
