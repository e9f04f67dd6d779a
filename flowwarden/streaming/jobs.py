"""Streaming jobs: landed flow events -> normalised flows -> scoring -> alerts.

* sources: file (JSON / parquet) or Kafka landing of live flow records,
  parsed with a fixed schema (no inference);
* event time: missing timestamps fall back to arrival time; all event times
  are session-zone TIMESTAMPs so watermarks apply;
* deduplication: ``dropDuplicatesWithinWatermark`` on the flow key, so a
  replayed record never yields a second alert;
* sink: ``foreachBatch`` writes each micro-batch into its own
  ``(run_id, batch_id)`` partition with dynamic overwrite (a retried batch replaces its
  own output: exactly-once files), then runs the user hooks;
* keyed state: per-host rolling statistics with ``applyInPandasWithState``
  keep only the last w-1 rows per host and evict idle hosts on an
  event-time timeout.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..schemas import FLOW_EVENT_SCHEMA
from ..session import checkpoint_dir, scratch


#: Batches whose progress the summary covers.
PROGRESS_KEPT = 1000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")


# --- sources ---------------------------------------------------------------------

def flow_events_from_flows(flows: DataFrame) -> DataFrame:
    """Live-capture records (FLOW_EVENT_SCHEMA) for a flows table: used to
    land test streams derived from the given tables."""
    p = F.col("protocol_type")
    return flows.select(
        F.col("flow_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"),
        F.col("packet_size").cast("long").alias("length"),
        F.when(p == "icmp", F.lit(None).cast("string")).otherwise(F.upper(p)).alias("protocol"),
        "src_ip", "dst_ip",
        F.when(p == "tcp", F.col("src_port")).alias("tcp_srcport"),
        F.when(p == "tcp", F.col("dst_port")).alias("tcp_dstport"),
        F.when(p == "udp", F.col("src_port")).alias("udp_srcport"),
        F.when(p == "udp", F.col("dst_port")).alias("udp_dstport"),
        F.when(p == "tcp", F.concat(F.lit("0x"), F.lpad(F.hex(F.col("tcp_flags")), 4, "0"))).alias("tcp_flags"))


def normalize_flow_events(df: DataFrame) -> DataFrame:
    """Live record -> flow row: duration 0, src_bytes = length, dst_bytes 0,
    protocol lower-cased or 'unknown', ports tcp then udp then 0, hex flags
    to int, count = srv_count = 1."""
    hexflags = F.regexp_replace(F.col("tcp_flags"), r"^0[xX]", "")
    return df.select(
        F.col("flow_id"),
        F.col("timestamp"),
        F.lit(0.0).alias("duration"),
        F.coalesce(F.col("length").cast("double"), F.lit(0.0)).alias("src_bytes"),
        F.lit(0.0).alias("dst_bytes"),
        F.coalesce(F.lower(F.col("protocol")), F.lit("unknown")).alias("protocol_type"),
        F.coalesce(F.col("tcp_srcport"), F.col("udp_srcport"), F.lit(0)).cast("int").alias("src_port"),
        F.coalesce(F.col("tcp_dstport"), F.col("udp_dstport"), F.lit(0)).cast("int").alias("dst_port"),
        F.col("length").cast("int").alias("packet_size"),
        F.coalesce(F.conv(hexflags, 16, 10).try_cast("int"), F.lit(0)).alias("tcp_flags"),
        F.lit(1).alias("count"), F.lit(1).alias("srv_count"),
        F.col("src_ip"), F.col("dst_ip"))


def read_flow_stream(spark: SparkSession, path: str | None = None, fmt: str = "json",
                     kafka: dict | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Landed live records (files, or Kafka with ``kafka`` options) as a
    normalised streaming flow frame."""
    if kafka:
        raw = spark.readStream.format("kafka").options(**kafka).load()
        rec = raw.select(F.from_json(F.col("value").cast("string"), FLOW_EVENT_SCHEMA).alias("r")).select("r.*")
    else:
        r = spark.readStream.schema(FLOW_EVENT_SCHEMA).format(fmt)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        rec = r.load(path)
    return normalize_flow_events(rec)


def default_event_time(df: DataFrame, ts: str = "timestamp", out: str = "event_time") -> DataFrame:
    """Event time from epoch seconds (or a timestamp); missing -> arrival time."""
    dt = df.schema[ts].dataType
    t = F.timestamp_micros((F.col(ts) * 1e6).cast("long")) if isinstance(dt, T.NumericType) else F.col(ts).cast("timestamp")
    return df.withColumn(out, F.coalesce(t, F.current_timestamp()))


def with_dedup(df: DataFrame, key: str = "flow_id", event_time: str = "event_time", delay: str = "1 hour") -> DataFrame:
    """Watermark on event time and drop replays of a key within it."""
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


# --- sinks -------------------------------------------------------------------------

SINK_KEYS = ["alert_date", "run_id", "batch_id"]


def run_id(checkpoint: str) -> str:
    """Batch ids count from 0 in each checkpoint; this tells checkpoints apart
    and stays the same when a query restarts from one."""
    return hashlib.md5(checkpoint.encode()).hexdigest()[:12]


def alert_batch_writer(path: str, hooks: Iterable[Callable[[DataFrame, int], None]] = (),
                       ts: str = "timestamp", run: str = "run",
                       scorer: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: alerts partitioned by date, run and batch id; a
    replayed batch overwrites only its own partitions. ``scorer`` turns the batch
    into alerts; it may look back over the rows of the batch. With hooks, the
    alerts are kept for them instead of being computed again."""
    hooks = list(hooks)

    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch():
            land(batch, batch_id)

    def land(batch: DataFrame, batch_id: int) -> None:
        alerts = scorer(batch) if scorer else batch
        if hooks:
            alerts = alerts.persist()
        try:
            out = alerts.withColumns({"alert_date": F.to_date(F.col(ts)), "run_id": F.lit(run), "batch_id": F.lit(batch_id)})
            (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SINK_KEYS).parquet(path))
            for h in hooks:
                h(alerts, batch_id)
        finally:
            if hooks:
                alerts.unpersist()
    return write


def compact_alerts(spark: SparkSession, path: str, to: str, rows_per_file: int = 1_000_000) -> None:
    """The alert table rewritten with one folder per date, in files of up to
    ``rows_per_file`` alerts, to a new path."""
    (spark.read.parquet(path).drop("run_id", "batch_id").repartition("alert_date")
          .write.option("maxRecordsPerFile", rows_per_file).partitionBy("alert_date").parquet(to))


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], sink_path: str, checkpoint: str,
                 hooks=(), trigger: dict | None = None, query_name: str | None = None, per_batch: bool = False):
    """Continuous detection: scorer(flow batch) -> alerts -> alert table. A scorer
    that looks back over rows runs on each micro-batch (``per_batch``)."""
    conf = stream.sparkSession.conf
    if int(conf.get("spark.sql.streaming.numRecentProgressUpdates")) < PROGRESS_KEPT:
        conf.set("spark.sql.streaming.numRecentProgressUpdates", str(PROGRESS_KEPT))
    writer = alert_batch_writer(sink_path, hooks, run=run_id(checkpoint), scorer=scorer if per_batch else None)
    alerts = stream if per_batch else scorer(stream)
    w = alerts.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint)
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(**(trigger or {"processingTime": "1 second"}))
    return w.start()


def write_windows(agg: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append closed windows of a watermarked aggregate to parquet."""
    return (agg.writeStream.outputMode("append").format("parquet").option("path", path)
               .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def totals_writer(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function for a global aggregate in complete mode: each batch
    publishes its totals as a version of its own, which a batch that runs again
    replaces. Readers take the highest version."""
    def write(totals: DataFrame, batch_id: int) -> None:
        totals.withColumn("version", F.lit(batch_id).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={batch_id}")
    return write


# --- keyed state: per-host rolling statistics ----------------------------------------

def rolling_state_per_host(stream: DataFrame, cols: list[str], key: str = "src_ip", order=("event_time", "flow_id"),
                           window: int = 20, idle_ms: int = 6 * 3_600_000,
                           watermark_delay: str | None = "1 hour") -> DataFrame:
    """Trailing-``window`` mean / sample std (one observation -> 0) of
    ``cols`` per host, across micro-batches. State per host is the last
    window-1 rows; a host idle for ``idle_ms`` of event time is evicted when
    the watermark passes (event-time timeout), so state is bounded by the
    active hosts, not by every host ever seen. Rows older than the watermark
    are dropped by Spark before they reach the state. Pass
    ``watermark_delay=None`` when the stream already has a watermark."""
    order = list(order)
    keep = window - 1
    if watermark_delay is not None:
        stream = stream.withWatermark(order[0], watermark_delay)
    out_fields = [T.StructField(key, T.StringType()), T.StructField("flow_id", T.LongType())]
    for c in cols:
        out_fields += [T.StructField(f"{c}_rolling_mean", T.DoubleType()),
                       T.StructField(f"{c}_rolling_std", T.DoubleType())]
    out_schema = T.StructType(out_fields)
    state_schema = T.StructType([T.StructField("t", T.ArrayType(T.LongType())),
                                 T.StructField("ids", T.ArrayType(T.LongType()))]
                                + [T.StructField(f"v{i}", T.ArrayType(T.DoubleType())) for i in range(len(cols))])

    def step(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(pdfs), ignore_index=True)
        new = new.assign(_t=new[order[0]].astype("int64") if new[order[0]].dtype.kind == "i"
                         else pd.to_datetime(new[order[0]]).astype("int64"))
        new = new.sort_values(["_t", order[1]]).reset_index(drop=True)
        new["_new"] = True
        allr = new[["_t", order[1], *cols, "_new"]]
        if state.exists:
            st = state.get
            old = pd.DataFrame({"_t": list(st[0]), order[1]: list(st[1]),
                                **{c: list(st[2 + i]) for i, c in enumerate(cols)}})
            old["_new"] = False
            if len(old):
                allr = pd.concat([old, allr], ignore_index=True)
        allr = allr.reset_index(drop=True)
        res = {key: k[0], "flow_id": allr[order[1]].astype("int64")}
        for c in cols:
            x = allr[c].astype("float64")
            res[f"{c}_rolling_mean"] = x.rolling(window, min_periods=1).mean()
            res[f"{c}_rolling_std"] = x.rolling(window, min_periods=1).std().fillna(0.0)
        out = pd.DataFrame(res)[allr["_new"].to_numpy()]
        tail = allr.tail(keep)
        state.update((tail["_t"].astype("int64").tolist(), tail[order[1]].astype("int64").tolist(),
                      *[tail[c].astype("float64").tolist() for c in cols]))
        last_ms = int(allr["_t"].max()) // 1_000_000  # event time is nanoseconds in pandas
        state.setTimeoutTimestamp(max(last_ms + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield out

    return stream.groupBy(key).applyInPandasWithState(
        step, out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


# --- progress --------------------------------------------------------------------------

def processing_time_summary(spark: SparkSession, query) -> DataFrame:
    """Batches, mean seconds and rows of the last ``PROGRESS_KEPT`` batches."""
    rows = [(p["batchId"], float(p["durationMs"].get("triggerExecution", 0)) / 1000.0, int(p["numInputRows"]))
            for p in query.recentProgress]
    df = spark.createDataFrame(rows, "batch_id long, seconds double, input_rows long")
    return df.agg(F.count(F.lit(1)).alias("batches"), F.avg("seconds").alias("mean_batch_seconds"),
                  F.sum("input_rows").alias("rows_processed"))
