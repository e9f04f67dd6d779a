"""Catalog: streaming detectors (K) in batch form, and end-to-end stream runs.

Traffic in the fixture is sparse (one flow every few minutes), so the window
detectors run here with scaled windows and thresholds; their defaults are the
declared detector configuration.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as S
from ..oracle import ALERTS_CTE, FLOWS_SQL, with_flows, with_scored
from ..sources.tables import read_flows, read_table
from ..streaming import jobs as J
from ..streaming import windows as W
from ..streaming.alert_log import AlertLog, logged_batch_writer
from ..streaming.progress import ProgressLog, progress_summary
from .catalog import register
from .detection import SCORE_COLS, alerts_from_flows, flat_alerts, with_model_scores

TS_FMT = "yyyy-MM-dd HH:mm:ss"
TS_SQL = "'%Y-%m-%d %H:%M:%S'"


def _fmt(c):
    return F.date_format(F.col(c), TS_FMT)


def _bucket_sql(seconds: int) -> str:
    return f"strftime(to_timestamp(floor(epoch(ts) / {seconds}) * {seconds}), {TS_SQL})"


@register("traffic_per_minute", with_flows(f"""
, c AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS flows FROM flows GROUP BY 1),
ax AS (SELECT unnest(generate_series((SELECT min(minute) FROM c), (SELECT max(minute) FROM c), INTERVAL 1 MINUTE))
       AS minute)
SELECT strftime(ax.minute, {TS_SQL}) AS minute, CAST(COALESCE(c.flows, 0) AS BIGINT) AS flows
FROM ax LEFT JOIN c USING (minute)"""))
def traffic_per_minute(spark, sf):
    t = W.traffic_per_minute_filled(read_flows(spark, sf))
    return t.select(_fmt("minute").alias("minute"), "flows")


@register("packets_per_second", with_flows(f"""
SELECT strftime(date_trunc('second', ts), {TS_SQL}) AS second, CAST(count(*) AS BIGINT) AS packets FROM flows GROUP BY 1"""))
def packets_per_second(spark, sf):
    return W.packets_per_second(read_flows(spark, sf)).select(_fmt("second").alias("second"), "packets")


_TW = {"short": 300, "medium": 1800, "long": 7200}


@register("traffic_windows", with_flows(" UNION ALL ".join(
    f"SELECT '{n}' AS window_name, {_bucket_sql(s)} AS window_start, CAST(count(*) AS BIGINT) AS flows, "
    f"round(sum(src_bytes + dst_bytes), 4) AS total_bytes FROM flows GROUP BY 2" for n, s in _TW.items())))
def traffic_windows(spark, sf):
    t = W.traffic_windows(read_flows(spark, sf))
    return t.select("window_name", _fmt("window_start").alias("window_start"), "flows",
                    F.round("total_bytes", 4).alias("total_bytes"))


@register("traffic_windows_sliding", with_flows(f"""
SELECT 'half_hour' AS window_name, strftime(to_timestamp((floor(epoch(ts) / 600) - k) * 600), {TS_SQL}) AS window_start,
 CAST(count(*) AS BIGINT) AS flows, round(sum(src_bytes + dst_bytes), 4) AS total_bytes FROM flows, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 2
UNION ALL SELECT 'ten', {_bucket_sql(600)}, CAST(count(*) AS BIGINT), round(sum(src_bytes + dst_bytes), 4) FROM flows GROUP BY 2"""))
def traffic_windows_sliding(spark, sf):
    """Half hours that start every ten minutes, rolled up from tens of minutes."""
    t = W.traffic_windows(read_flows(spark, sf), windows={"half_hour": "30 minutes", "ten": "10 minutes"}, slide={"half_hour": "10 minutes"})
    return t.select("window_name", _fmt("window_start").alias("window_start"), "flows", F.round("total_bytes", 4).alias("total_bytes"))


@register("port_scan_windows", with_flows(f"""
SELECT src_ip, {_bucket_sql(3600)} AS window_start, CAST(count(*) AS BIGINT) AS packets,
 CAST(count(DISTINCT dst_port) AS INTEGER) AS unique_ports, count(DISTINCT dst_port) > 1 AND count(*) >= 2 AS is_port_scan
FROM flows GROUP BY 1, 2"""))
def port_scan_windows(spark, sf):
    p = W.port_scan_windows(read_flows(spark, sf), window=3600, unique_ports=1, packets=2)
    return p.withColumn("window_start", _fmt("window_start"))


@register("dos_windows", with_flows(f"""
SELECT dst_ip, {_bucket_sql(3600)} AS window_start, CAST(count(*) AS BIGINT) AS packets,
 round(count(*) / 3600.0, 8) AS rate, count(*) > 3 AND count(*) / 3600.0 >= 0.001 AS is_dos FROM flows GROUP BY 1, 2"""))
def dos_windows(spark, sf):
    d = W.dos_windows(read_flows(spark, sf), window=3600, packets=3, rate=0.001)
    return d.select("dst_ip", _fmt("window_start").alias("window_start"), "packets", F.round("rate", 8).alias("rate"),
                    "is_dos")


@register("brute_force_windows", with_flows(f"""
SELECT src_ip, dst_ip, {_bucket_sql(86400)} AS window_start, CAST(count(*) AS BIGINT) AS attempts,
 count(*) > 1 AS is_brute_force FROM flows WHERE dst_port IN (22, 23, 21, 3389) GROUP BY 1, 2, 3"""))
def brute_force_windows(spark, sf):
    b = W.brute_force_windows(read_flows(spark, sf), window=86400, attempts=1)
    return b.withColumn("window_start", _fmt("window_start"))


@register("exfiltration_windows", with_flows(f"""
SELECT src_ip, {_bucket_sql(86400)} AS window_start, round(sum(src_bytes), 4) AS bytes_out,
 round(sum(dst_bytes), 4) AS bytes_in, round(sum(dst_bytes) / sum(src_bytes), 6) AS in_out_ratio,
 COALESCE(sum(src_bytes) > 20000 AND sum(dst_bytes) / sum(src_bytes) < 1.0, false) AS is_exfiltration
FROM flows GROUP BY 1, 2"""))
def exfiltration_windows(spark, sf):
    e = W.exfiltration_windows(read_flows(spark, sf), window=86400, bytes_threshold=20000, ratio=1.0)
    return e.select("src_ip", _fmt("window_start").alias("window_start"), F.round("bytes_out", 4).alias("bytes_out"),
                    F.round("bytes_in", 4).alias("bytes_in"), F.round("in_out_ratio", 6).alias("in_out_ratio"),
                    "is_exfiltration")


@register("running_totals", with_scored("""
SELECT CAST(count(*) AS BIGINT) AS total_flows,
 CAST(sum(CASE WHEN (rf_score + recon_score + lstm_score) / 3.0 > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS anomalies_detected,
 CAST(sum(CASE WHEN (rf_score + recon_score + lstm_score) / 3.0 > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS alerts_generated
FROM scored"""))
def running_totals(spark, sf):
    s = S.anomaly_scores(with_model_scores(read_flows(spark, sf)), SCORE_COLS)
    return W.running_totals(s)


@register("latest_rows", with_flows("""
SELECT flow_id, src_ip, dst_ip FROM flows ORDER BY ts DESC, flow_id DESC LIMIT 20"""))
def latest_rows(spark, sf):
    return W.latest_rows(read_flows(spark, sf), 20).select("flow_id", "src_ip", "dst_ip")


@register("dedup_flows", with_flows("""
SELECT protocol_type, CAST(count(DISTINCT flow_id) AS BIGINT) AS flows FROM flows GROUP BY 1"""))
def dedup_flows(spark, sf):
    f = read_flows(spark, sf)
    replayed = f.unionByName(f.where(F.col("protocol_type") != "tcp"))
    d = replayed.dropDuplicates(["flow_id"])
    return d.groupBy("protocol_type").agg(F.count(F.lit(1)).cast("bigint").alias("flows"))


# --- end-to-end stream runs ------------------------------------------------------------

def _events_stream(spark, sf, max_files=None):
    events = read_table(spark, sf, "events")
    r = spark.readStream.schema(events.schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    # the file source watches a directory; the glob picks the events table
    return r.option("pathGlobFilter", "events.parquet").parquet(sf.rstrip("/"))


def _await(q):
    """Run the stream until everything available is processed, then stop it
    (a keyed-state query with timeouts keeps scheduling timer batches)."""
    try:
        q.processAllAvailable()
    finally:
        err = q.exception()
        q.stop()
    if err:
        raise err


@register("stream_alerts", f"WITH {ALERTS_CTE}\n" + """
SELECT alert_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') AS alert_time, severity, alert_type, description,
 source_ip, destination_ip, round(confidence, 6) AS confidence, status FROM alerts""")
def stream_alerts(spark, sf):
    """events as a stream -> flows -> watermark + replay dedup -> scoring ->
    alerts -> foreachBatch parquet sink; returns the landed alert table."""
    from ..sources.tables import flows_from_events
    stream = W.event_time(flows_from_events(_events_stream(spark, sf)), "ts", "event_time")
    stream = J.with_dedup(stream, "flow_id", "event_time", "1 hour").drop("event_time")
    sink, ck = J.scratch_path(spark, "alerts"), J.scratch_path(spark, "alerts-ckpt")
    hits = []
    q = J.score_stream(stream, alerts_from_flows, sink, ck, hooks=[lambda b, i: hits.append(i)],
                       trigger={"availableNow": True})
    _await(q)
    return flat_alerts(spark.read.parquet(sink).drop(*J.SINK_KEYS))


@register("stream_alert_log", f"WITH {ALERTS_CTE}\n" + """
SELECT alert_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') AS alert_time, severity, alert_type, description,
 source_ip, destination_ip, round(confidence, 6) AS confidence, status FROM alerts""")
def stream_alert_log(spark, sf):
    """Four files of flows, one micro-batch each, into the alert log, which is
    compacted after every second batch; after a fifth batch that repeats the last one's id, the log is read."""
    folder, schema = _land_parts(spark, sf, 4)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    path, ck = J.scratch_path(spark, "alert-log"), J.scratch_path(spark, "alert-log-ckpt")
    writer = logged_batch_writer(path, J.run_id(ck), compact_every=2)
    _await(alerts_from_flows(stream).writeStream.foreachBatch(writer).option("checkpointLocation", ck).trigger(availableNow=True).start())
    flows = spark.read.schema(schema).parquet(folder)
    writer(alerts_from_flows(flows), 3)
    return flat_alerts(AlertLog(spark, path).read(alerts_from_flows(flows).schema))


@register("stream_progress", with_flows("""
SELECT CAST(4 AS BIGINT) AS batches, CAST(2 AS BIGINT) AS runs, CAST(count(*) AS BIGINT) AS rows_processed FROM flows"""))
def stream_progress(spark, sf):
    """Landed progress of one checkpoint's two runs, of two files each."""
    path, sink, ck = (J.scratch_path(spark, n) for n in ("progress", "progress-alerts", "progress-ckpt"))
    log = ProgressLog(spark, path)
    spark.streams.addListener(log)
    try:
        folder = None
        for half in (0, 1):
            folder, schema = _land_parts(spark, sf, 2, f"flow_id % 2 = {half}", folder)
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
            q = J.score_stream(stream, alerts_from_flows, sink, ck, trigger={"availableNow": True})
            _await(q)
            log.wait(q.runId)
    finally:
        spark.streams.removeListener(log)
    return progress_summary(spark, path).select("batches", "runs", "rows_processed")


def _land_parts(spark, sf, files: int, where: str = "true", folder: str | None = None):
    """The flows in ``files`` files; the folder and the schema."""
    flows = read_flows(spark, sf)
    folder = folder or J.scratch_path(spark, "flow-parts")
    flows.where(where).repartition(files).write.mode("append").parquet(folder)
    return folder, flows.schema


@register("stream_flow_events", with_flows("""
SELECT flow_id, CAST(0 AS DOUBLE) AS duration, CAST(packet_size AS DOUBLE) AS src_bytes, CAST(0 AS DOUBLE) AS dst_bytes,
 CASE WHEN protocol_type = 'icmp' THEN 'unknown' ELSE protocol_type END AS protocol_type,
 CASE WHEN protocol_type = 'icmp' THEN 0 ELSE src_port END AS src_port,
 CASE WHEN protocol_type = 'icmp' THEN 0 ELSE dst_port END AS dst_port,
 packet_size, CASE WHEN protocol_type = 'tcp' THEN tcp_flags ELSE 0 END AS tcp_flags,
 1 AS "count", 1 AS srv_count, src_ip, dst_ip FROM flows"""))
def stream_flow_events(spark, sf):
    """Live records landed as JSON (derived from the flows, several files out
    of time order) -> read as a stream -> normalised flow rows."""
    landing = J.scratch_path(spark, "landing")
    ev = J.flow_events_from_flows(read_flows(spark, sf))
    ev.repartition(4, "src_ip").write.json(landing)
    out, ck = J.scratch_path(spark, "flows"), J.scratch_path(spark, "flows-ckpt")
    s = J.read_flow_stream(spark, landing, "json", max_files_per_trigger=2)
    q = (s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
          .trigger(availableNow=True).start())
    _await(q)
    return spark.read.parquet(out).drop("timestamp")


@register("stream_traffic_windows", with_flows("""
, b AS (SELECT to_timestamp(floor(epoch(ts) / 3600) * 3600) AS ws, src_bytes + dst_bytes AS nbytes FROM flows)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(count(*) AS BIGINT) AS flows,
 round(sum(nbytes), 4) AS total_bytes FROM b
WHERE ws + INTERVAL 1 HOUR <= (SELECT max(ts) FROM flows) - INTERVAL 10 MINUTE GROUP BY ws"""))
def stream_traffic_windows(spark, sf):
    """Hourly traffic windows over the event stream with a 10-minute
    watermark, appended as windows close (the still-open tail is not
    emitted)."""
    from ..sources.tables import flows_from_events
    s = W.event_time(flows_from_events(_events_stream(spark, sf)), "ts", "event_time").withWatermark("event_time", "10 minutes")
    agg = (s.groupBy(F.window("event_time", "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("flows"), F.sum(F.col("src_bytes") + F.col("dst_bytes")).alias("total_bytes"))
            .select(F.col("w.start").alias("window_start"), "flows", "total_bytes"))
    out, ck = J.scratch_path(spark, "windows"), J.scratch_path(spark, "windows-ckpt")
    _await(J.write_windows(agg, out, ck))
    r = spark.read.parquet(out)
    return r.select(_fmt("window_start").alias("window_start"), "flows", F.round("total_bytes", 4).alias("total_bytes"))


@register("stream_rolling_per_host", with_flows("""
SELECT src_ip, flow_id, round(avg(packet_size) OVER w, 6) AS packet_size_rolling_mean,
 round(COALESCE(stddev_samp(packet_size) OVER w, 0), 4) AS packet_size_rolling_std
FROM flows WINDOW w AS (PARTITION BY src_ip ORDER BY ts, flow_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""))
def stream_rolling_per_host(spark, sf):
    """Per-host rolling statistics kept in streaming state across batches."""
    from ..sources.tables import flows_from_events
    s = W.event_time(flows_from_events(_events_stream(spark, sf)), "ts", "event_time")
    r = J.rolling_state_per_host(s.select("src_ip", "flow_id", "event_time", "packet_size"), ["packet_size"],
                                 "src_ip", ("event_time", "flow_id"), window=20)
    out, ck = J.scratch_path(spark, "rolling"), J.scratch_path(spark, "rolling-ckpt")
    q = (r.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
          .outputMode("append").trigger(availableNow=True).start())
    _await(q)
    x = spark.read.parquet(out)
    return x.select("src_ip", "flow_id", F.round("packet_size_rolling_mean", 6).alias("packet_size_rolling_mean"),
                    F.round("packet_size_rolling_std", 4).alias("packet_size_rolling_std"))


@register("stream_processing_summary")
def stream_processing_summary(spark, sf):
    """Micro-batch timing of a scoring stream (rows-only: timings vary)."""
    from ..sources.tables import flows_from_events
    stream = flows_from_events(_events_stream(spark, sf, max_files=1))
    sink, ck = J.scratch_path(spark, "alerts"), J.scratch_path(spark, "alerts-ckpt")
    q = J.score_stream(stream, alerts_from_flows, sink, ck, trigger={"availableNow": True})
    _await(q)
    return J.processing_time_summary(spark, q)


@register("stream_model_alerts")
def stream_model_alerts(spark, sf):
    """Train on the table, save, load (as a separate scoring job would), then
    score the event stream with the loaded feature pipeline and all three models
    (rows-only: model outputs). Returns alerts per attack type and severity."""
    from ..operators import clean as B
    from ..sources.tables import flows_from_events
    from .training import batch_scorer, load_detector, save_detector, train_detector
    scores = ["rf_score", "recon_error", "lstm_score", "label_raw"]
    lab = B.standardize_labels(read_flows(spark, sf), "label_raw", out="label").drop(*scores)
    path = J.scratch_path(spark, "detector")
    save_detector(spark, train_detector(lab), path)
    models = load_detector(spark, path)
    stream = flows_from_events(_events_stream(spark, sf)).drop(*scores)
    sink, ck = J.scratch_path(spark, "model-alerts"), J.scratch_path(spark, "model-alerts-ckpt")
    _await(J.score_stream(stream, batch_scorer(models), sink, ck, trigger={"availableNow": True}, per_batch=True))
    a = spark.read.parquet(sink)
    return a.groupBy("alert_type", "severity").agg(F.count(F.lit(1)).cast("bigint").alias("alert_count"))


def _land_late(spark, sf, files: int = 4):
    """The events as ``files`` files in time order, but for every third row, which
    comes up to 90 minutes late; and every file repeats the last half day of the one
    before. Returns the folder and the schema."""
    e = read_table(spark, sf, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp")) + F.when(F.col("event_id") % 3 == 0, F.lit(5400)).otherwise(F.lit(0))
    lo, hi = e.agg(F.min(at), F.max(at)).first()
    path, step = J.scratch_path(spark, "late"), -(-(hi - lo + 1) // files)
    for k in range(files):
        first = lo + k * step
        e.where(at.between(first - (43_200 if k else 0), first + step - 1)).coalesce(1).write.mode("append").parquet(path)
    return path, e.schema


def _once(spark, sf, delay="1 day"):
    """Those files as a stream of flows, one file a batch, under one watermark, each flow once."""
    from ..sources.tables import flows_from_events
    path, schema = _land_late(spark, sf)
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return J.with_dedup(W.event_time(flows_from_events(raw), "ts", "event_time"), "flow_id", "event_time", delay)


def _closed(spark, frame):
    out = J.scratch_path(spark, "closed")
    _await(J.write_windows(frame, out, J.scratch_path(spark, "closed-ckpt")))
    return spark.read.parquet(out).withColumn("window_start", _fmt("window_start"))


def _closed_sql(seconds: int) -> str:
    """Windows that the watermark, a day behind the newest event, has passed."""
    return f"floor(epoch(ts) / {seconds}) * {seconds} + {seconds} <= (SELECT epoch(max(ts)) FROM flows) - 86400"


@register("stream_port_scan", with_flows(f"""
SELECT src_ip, {_bucket_sql(3600)} AS window_start, CAST(count(*) AS BIGINT) AS packets,
 CAST(count(DISTINCT dst_port) AS INTEGER) AS unique_ports, count(DISTINCT dst_port) > 1 AND count(*) >= 2 AS is_port_scan
FROM flows WHERE {_closed_sql(3600)} GROUP BY 1, 2"""))
def stream_port_scan(spark, sf):
    """Port scans over files that land out of order and repeat rows: dedup state and
    window state under one watermark, ports as bitmaps."""
    return _closed(spark, W.port_scan_windows(_once(spark, sf), "event_time", 3600, 1, 2, bitmap=True))


@register("stream_dos", with_flows(f"""
SELECT dst_ip, {_bucket_sql(3600)} AS window_start, CAST(count(*) AS BIGINT) AS packets, round(count(*) / 3600.0, 8) AS rate,
 count(*) > 3 AND count(*) / 3600.0 >= 0.001 AS is_dos FROM flows WHERE {_closed_sql(3600)} GROUP BY 1, 2"""))
def stream_dos(spark, sf):
    """Floods over the same files."""
    return _closed(spark, W.dos_windows(_once(spark, sf), "event_time", 3600, 3, 0.001)).withColumn("rate", F.round("rate", 8))


@register("stream_brute_force", with_flows(f"""
SELECT src_ip, dst_ip, {_bucket_sql(86400)} AS window_start, CAST(count(*) AS BIGINT) AS attempts, count(*) > 1 AS is_brute_force
FROM flows WHERE dst_port IN (22, 23, 21, 3389) AND {_closed_sql(86400)} GROUP BY 1, 2, 3"""))
def stream_brute_force(spark, sf):
    """Login attempts over the same files."""
    return _closed(spark, W.brute_force_windows(_once(spark, sf), "event_time", 86400, 1))


@register("stream_exfiltration", with_flows(f"""
SELECT src_ip, {_bucket_sql(86400)} AS window_start, round(sum(src_bytes), 4) AS bytes_out, round(sum(dst_bytes), 4) AS bytes_in,
 round(sum(dst_bytes) / sum(src_bytes), 6) AS in_out_ratio,
 COALESCE(sum(src_bytes) > 20000 AND sum(dst_bytes) / sum(src_bytes) < 1.0, false) AS is_exfiltration
FROM flows WHERE {_closed_sql(86400)} GROUP BY 1, 2"""))
def stream_exfiltration(spark, sf):
    """Outgoing bytes over the same files."""
    e = _closed(spark, W.exfiltration_windows(_once(spark, sf), "event_time", 86400, 20000, 1.0))
    return e.withColumns({"bytes_out": F.round("bytes_out", 4), "bytes_in": F.round("bytes_in", 4), "in_out_ratio": F.round("in_out_ratio", 6)})


@register("stream_running_totals", with_scored("""
SELECT CAST(count(*) AS BIGINT) AS total_flows,
 CAST(sum(CASE WHEN (rf_score + recon_score + lstm_score) / 3.0 > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS anomalies_detected, true AS never_fell FROM scored"""))
def stream_running_totals(spark, sf):
    """Running totals in complete mode over the same files, published batch by batch;
    the last version, and whether no version fell below the one before."""
    from pyspark.sql import Window
    scored = S.anomaly_scores(with_model_scores(_once(spark, sf).drop("event_time")), SCORE_COLS)
    path = J.scratch_path(spark, "totals")
    _await(W.running_totals(scored).writeStream.outputMode("complete").foreachBatch(J.totals_writer(path))
           .option("checkpointLocation", J.scratch_path(spark, "totals-ckpt")).trigger(availableNow=True).start())
    v = spark.read.option("recursiveFileLookup", True).parquet(path)  # one row a version
    before = Window.orderBy("version")
    v = v.withColumn("fell", (F.col("total_flows") < F.lag("total_flows", 1, 0).over(before)) | (F.col("anomalies_detected") < F.lag("anomalies_detected", 1, 0).over(before)))
    last = F.max_by(F.struct("total_flows", "anomalies_detected"), "version")
    return v.agg(last.alias("last"), (~F.bool_or("fell")).alias("never_fell")).select("last.*", "never_fell")


@register("stream_sequences", with_flows("""
, s AS (SELECT flow_id, src_ip, ts, list(packet_size) OVER w AS sizes, list(src_bytes) OVER w AS bytes
  FROM flows WINDOW w AS (PARTITION BY src_ip ORDER BY ts, flow_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT flow_id, src_ip, coalesce(len(sizes) = 5, false) AS has_history, CASE WHEN len(sizes) = 5 THEN CAST(sizes[1] AS DOUBLE) END AS oldest_size,
 CASE WHEN len(sizes) = 5 THEN CAST(list_sum(sizes) AS DOUBLE) END AS total_size, CASE WHEN len(sizes) = 5 THEN bytes[5] END AS newest_bytes
FROM s WHERE ts < (SELECT max(ts) FROM flows) - INTERVAL 1 DAY"""))
def stream_sequences(spark, sf):
    """The five rows of its host before each row, over the same files: dedup, then
    keyed state that waits for the watermark."""
    from ..streaming.sequences import STATE_CONF, sequence_stream, started_with
    out = J.scratch_path(spark, "sequences")
    with started_with(spark, STATE_CONF):
        s = sequence_stream(_once(spark, sf), ["packet_size", "src_bytes"], 5, delay=None, idle_ms=400 * 24 * 3_600_000)
        q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", J.scratch_path(spark, "sequences-ckpt")).trigger(availableNow=True).start()
    _await(q)
    x = F.col("sequence")
    return spark.read.parquet(out).select(
        "flow_id", "src_ip", x.isNotNull().alias("has_history"), x[0][0].alias("oldest_size"),
        F.aggregate(x, F.lit(0.0), lambda n, row: n + row[0]).alias("total_size"), x[4][1].alias("newest_bytes"))


@register("stream_equals_batch", "SELECT CAST(0 AS BIGINT) AS only_in_batch, CAST(0 AS BIGINT) AS only_in_stream, CAST(0 AS BIGINT) AS late")
def stream_equals_batch(spark, sf):
    """Alerts of a stream in several batches, out of order, with fitted look-back
    features and models, against those of the batch job: what only one of them has."""
    from ..operators import clean as B
    from .training import batch_scorer, carried_scorer, train_detector
    scores = ["rf_score", "recon_error", "lstm_score", "label_raw"]
    f = read_flows(spark, sf)
    models = train_detector(B.standardize_labels(f, "label_raw", out="label").drop(*scores), window=20, k=20, forest_params={"numTrees": 20, "maxDepth": 8})
    f = f.drop(*scores)
    sink, ck = J.scratch_path(spark, "carried"), J.scratch_path(spark, "carried-ckpt")
    scorer = carried_scorer(models, sink, J.scratch_path(spark, "carried-state"), J.run_id(ck), delay_seconds=86_400)
    q = _once(spark, sf).drop("event_time", *scores).writeStream.foreachBatch(scorer).option("checkpointLocation", ck).trigger(availableNow=True).start()
    _await(q)
    scorer.finish(spark, q.lastProgress["batchId"], f.schema)
    key = ["alert_id", "severity", "alert_type"]
    got, want = spark.read.parquet(sink).select(*key).withColumn("side", F.lit(1)), batch_scorer(models)(f).select(*key).withColumn("side", F.lit(-1))
    d = got.unionByName(want).groupBy(*key).agg(F.sum("side").alias("d"))
    n = lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0))), F.lit(0)).cast("long")
    return d.agg(n(-F.col("d")).alias("only_in_batch"), n(F.col("d")).alias("only_in_stream"), F.lit(scorer.late).cast("long").alias("late"))


@register("stream_event_time", with_flows("""
SELECT flow_id, flow_id % 97 <> 0 AS had_time, CASE WHEN flow_id % 97 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS event_time, true AS has_event_time
FROM flows"""))
def stream_event_time(spark, sf):
    """Live records, some without a time, landed as JSON and read as a stream: event
    time is the record's, or else its arrival."""
    landing, out = J.scratch_path(spark, "timeless"), J.scratch_path(spark, "timed")
    ev = J.flow_events_from_flows(read_flows(spark, sf))
    ev.withColumn("timestamp", F.when(F.col("flow_id") % 97 != 0, F.col("timestamp"))).repartition(2).write.json(landing)
    s = J.default_event_time(J.read_flow_stream(spark, landing, "json", max_files_per_trigger=1))
    _await(s.writeStream.format("parquet").option("path", out).option("checkpointLocation", J.scratch_path(spark, "timed-ckpt")).trigger(availableNow=True).start())
    had = F.col("timestamp").isNotNull()
    return spark.read.parquet(out).select("flow_id", had.alias("had_time"), F.when(had, _fmt("event_time")).alias("event_time"),
                                          F.col("event_time").isNotNull().alias("has_event_time"))
