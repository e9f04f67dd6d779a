"""Sequence windows per host over a stream whose rows land out of order.

Rows of a host wait in list state until the watermark passes them, so that they
leave in event-time order whatever order they came in; the last ``length`` rows
that left stay as the history of the next one. Both lists end: the waiting rows
with the watermark's delay, the history after ``length`` rows, and an idle host's
state with an event-time timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Settings of a query with arbitrary state: list state and timers need this store.
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class started_with:
    """Session settings for the queries that are started inside; the former ones come back."""

    def __init__(self, spark, conf: dict[str, str]):
        self.conf, self.new = spark.conf, conf

    def __enter__(self):
        self.old = {k: self.conf.get(k, None) for k in self.new}
        for k, v in self.new.items():
            self.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.old.items():
            self.conf.unset(k) if v is None else self.conf.set(k, v)


class HostSequences(StatefulProcessor):
    """State of a host: ``waiting`` rows (event time in microseconds, id, features)
    and ``history``, the features of its last rows in order."""

    def __init__(self, key: str, length: int, width: int, idle_ms: int):
        self.key, self.length, self.width, self.idle_ms = key, length, width, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        values = T.ArrayType(T.DoubleType())
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("t", T.LongType()), T.StructField("id", T.LongType()), T.StructField("x", values)]))
        self.history = handle.getListState("history", T.StructType([T.StructField("x", values)]))
        self.last = handle.getValueState("last", T.StructType([T.StructField("t", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(i), [None if v is None or v != v else float(v) for v in x]) for part in rows for t, i, x in zip(part["at_micros"], part["row_id"], part["features"])]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(t for t, *_ in new) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((r for r in self.waiting.get()), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] < mark], [r for r in rows if r[0] >= mark]
        past = [list(r[0]) for r in self.history.get()] if self.history.exists() else []
        if due:
            out = []
            for t, i, x in due:
                out.append((key[0], i, t, past[-self.length:] if len(past) >= self.length else None))
                past.append(list(x))
            past = past[-self.length:]
            self.history.put([(x,) for x in past])
            self.last.update((due[-1][0],))
            self.waiting.clear()
            if later:
                self.waiting.appendList(later)
            yield pd.DataFrame(out, columns=[self.key, "row_id", "at_micros", "sequence"])
        if later:
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        elif self.last.exists():
            ends = self.last.get()[0] // 1000 + self.idle_ms
            if timerValues.getCurrentWatermarkInMs() >= ends:
                self.history.clear()
                self.last.clear()
                self.waiting.clear()
            else:
                self.handle.registerTimer(ends)

    def close(self) -> None:
        pass


def _rows(df: DataFrame, features: list[str], key: str, id_col: str, event_time: str) -> DataFrame:
    return df.select(F.col(event_time), F.col(key), F.unix_micros(event_time).alias("at_micros"), F.col(id_col).cast("long").alias("row_id"),
                     F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("features"))


def sequence_stream(stream: DataFrame, features: list[str], length: int = 5, key: str = "src_ip", id_col: str = "flow_id",
                    event_time: str = "event_time", delay: str | None = "1 hour", idle_ms: int = 24 * 3_600_000) -> DataFrame:
    """Every row of a stream that the watermark has passed: key, id, event time and
    ``sequence``, the features of the host's ``length`` rows before it, oldest first
    (null while there are fewer). Rows of one time go by id. Rows older than the
    watermark when they land are dropped by Spark and counted in its progress. A
    host that is idle for ``idle_ms`` of event time starts anew. Start the query with
    ``started_with(spark, STATE_CONF)``."""
    s = _rows(stream, features, key, id_col, event_time)
    if delay is not None:  # None: the stream has a watermark
        s = s.withWatermark(event_time, delay)
    out = T.StructType([T.StructField(key, T.StringType()), T.StructField("row_id", T.LongType()), T.StructField("at_micros", T.LongType()),
                        T.StructField("sequence", T.ArrayType(T.ArrayType(T.DoubleType())))])
    state = HostSequences(key, length, len(features), idle_ms)
    got = s.groupBy(key).transformWithStateInPandas(state, out, "Append", "EventTime")
    return got.select(key, F.col("row_id").alias(id_col), F.timestamp_micros("at_micros").alias(event_time), "sequence")


def sequence_batch(df: DataFrame, features: list[str], length: int = 5, key: str = "src_ip", id_col: str = "flow_id",
                   event_time: str = "event_time") -> DataFrame:
    """The batch form of ``sequence_stream`` (hosts never go idle)."""
    w = Window.partitionBy(key).orderBy("at_micros", "row_id").rowsBetween(-length, -1)
    d = _rows(df, features, key, id_col, event_time).withColumn("sequence", F.collect_list("features").over(w))
    return d.select(key, F.col("row_id").alias(id_col), F.col(event_time), F.when(F.size("sequence") == length, F.col("sequence")).alias("sequence"))
