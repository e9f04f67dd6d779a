"""Streams equal their batch form; replays are dropped; state carries across
micro-batches."""

import os

from pyspark.sql import functions as F

from conftest import MEDIUM
from flowwarden.plans.detection import alerts_from_flows
from flowwarden.sources.tables import read_flows
from flowwarden.streaming import jobs as J
from flowwarden.streaming import windows as W


def _land_events(spark, n_files, replay=False):
    """events split into files out of time order (optionally with replayed rows)."""
    ev = spark.read.parquet(f"{MEDIUM}/events.parquet")
    path = J.scratch_path(spark, "landing-events")
    ev.repartition(n_files, "user_id").write.parquet(path)
    if replay:
        ev.where(F.col("event_type") == "error").write.mode("append").parquet(path)
    return ev.schema, path


def test_stream_alerts_dedup_equals_batch(spark):
    schema, path = _land_events(spark, 4, replay=True)
    from flowwarden.sources.tables import flows_from_events
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)
    s = W.event_time(flows_from_events(s), "ts", "event_time")
    s = J.with_dedup(s, "flow_id", "event_time", "40 days").drop("event_time")
    sink, ck = J.scratch_path(spark, "a"), J.scratch_path(spark, "ack")
    seen = []
    q = J.score_stream(s, alerts_from_flows, sink, ck, hooks=[lambda b, i: seen.append(i)],
                       trigger={"availableNow": True})
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(sink)
    want = alerts_from_flows(read_flows(spark, MEDIUM))
    assert got.count() == want.count()
    assert got.select("alert_id").distinct().count() == want.count()
    assert len(seen) >= 2


def test_rolling_state_across_batches(spark):
    schema, path = _land_events(spark, 1)
    # land in 3 time-ordered files so state must carry the tail between batches
    ev = spark.read.parquet(f"{MEDIUM}/events.parquet")
    ordered = J.scratch_path(spark, "ordered")
    for i, (lo, hi) in enumerate([("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-02-01")]):
        ev.where((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.parquet(os.path.join(ordered, f"part{i}"))
    from flowwarden.sources.tables import flows_from_events
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
              .parquet(ordered))
    s = W.event_time(flows_from_events(s), "ts", "event_time").select("src_ip", "flow_id", "event_time", "packet_size")
    r = J.rolling_state_per_host(s, ["packet_size"], window=20)
    out, ck = J.scratch_path(spark, "r"), J.scratch_path(spark, "rck")
    q = r.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.processAllAvailable()
    q.stop()
    got = {x.flow_id: x.packet_size_rolling_mean for x in spark.read.parquet(out).collect()}
    from pyspark.sql import Window
    f = read_flows(spark, MEDIUM)
    w = Window.partitionBy("src_ip").orderBy("ts", "flow_id").rowsBetween(-19, 0)
    want = {x.flow_id: x.m for x in f.select("flow_id", F.avg("packet_size").over(w).alias("m")).collect()}
    assert len(got) == len(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_flow_event_normalisation(spark):
    rows = [(1, 1.7e9, 60, "TCP", "1.1.1.1", "2.2.2.2", 1234, 80, None, None, "0x0018"),
            (2, None, 70, None, None, None, None, None, 53, 5353, None)]
    df = spark.createDataFrame(rows, J.FLOW_EVENT_SCHEMA)
    out = J.default_event_time(J.normalize_flow_events(df)).collect()
    assert (out[0].protocol_type, out[0].src_port, out[0].dst_port, out[0].tcp_flags) == ("tcp", 1234, 80, 24)
    assert (out[1].protocol_type, out[1].src_port, out[1].dst_port, out[1].tcp_flags) == ("unknown", 53, 5353, 0)
    assert out[1].event_time is not None and out[0].src_bytes == 60.0 and out[0]["count"] == 1


def test_late_rows_are_dropped_from_windows(spark):
    """Rows older than the watermark do not reach closed windows. Spark
    filters late rows with the previous batch's watermark, so the late file
    lands after two on-time files; the closed windows equal the batch form."""
    import datetime as dt
    day2 = [(i, dt.datetime(2024, 1, 2, 0, 0) + dt.timedelta(minutes=10 * i)) for i in range(30)]
    day3 = [(50 + i, dt.datetime(2024, 1, 3, 0, 0) + dt.timedelta(minutes=10 * i)) for i in range(30)]
    late = [(100 + i, dt.datetime(2024, 1, 1, 1, 0) + dt.timedelta(minutes=i)) for i in range(5)]
    base = J.scratch_path(spark, "late")
    for name, rows in (("a", day2), ("b", day3), ("c", late)):
        spark.createDataFrame(rows, "flow_id long, ts timestamp").coalesce(1).write.parquet(os.path.join(base, name))
    s = (spark.readStream.schema("flow_id long, ts timestamp").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(base))
    agg = (s.withWatermark("ts", "30 minutes").groupBy(F.window("ts", "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n"))
    out, ck = J.scratch_path(spark, "lo"), J.scratch_path(spark, "lock")
    q = J.write_windows(agg, out, ck)
    q.processAllAvailable()
    dropped = sum(p["stateOperators"][0].get("numRowsDroppedByWatermark", 0) for p in q.recentProgress
                  if p["stateOperators"])
    q.stop()
    got = {r.start: r.n for r in spark.read.parquet(out).collect()}
    # the five late rows reach the state operator as one partial aggregate
    assert dropped >= 1 and all(k.day in (2, 3) for k in got)
    batch = W.traffic_windows(spark.createDataFrame(day2 + day3, "flow_id long, ts timestamp"), "ts",
                              windows={"h": "1 hour"}, bytes_cols=())
    want = {r.window_start.replace(tzinfo=None): r.flows for r in batch.collect()}
    assert all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 1


def test_stream_scoring_with_loaded_models_equals_batch(spark):
    from flowwarden.operators import clean as B
    from flowwarden.plans.training import batch_scorer, load_detector, save_detector, train_detector
    from flowwarden.sources.tables import flows_from_events
    scores = ["rf_score", "recon_error", "lstm_score", "label_raw"]
    lab = B.standardize_labels(read_flows(spark, MEDIUM), "label_raw", out="label").drop(*scores)
    path = J.scratch_path(spark, "det")
    save_detector(spark, train_detector(lab, window=20, k=20, forest_params={"numTrees": 10, "maxDepth": 5}), path)
    models = load_detector(spark, path)
    schema, land = _land_events(spark, 3)
    s = flows_from_events(spark.readStream.schema(schema).parquet(land)).drop(*scores)
    sink, ck = J.scratch_path(spark, "ms"), J.scratch_path(spark, "msck")
    q = J.score_stream(s, batch_scorer(models), sink, ck, trigger={"availableNow": True}, per_batch=True)
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(sink).select("alert_id", "severity", "alert_type")
    want = batch_scorer(models)(read_flows(spark, MEDIUM).drop(*scores)).select("alert_id", "severity", "alert_type")
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_two_checkpoints_share_a_sink(spark):
    """Batch 0 of a second checkpoint leaves the first one's alerts; a replay of a
    batch replaces its own; hooks see what was written."""
    sink, seen = J.scratch_path(spark, "shared"), []
    rows = lambda ids: spark.createDataFrame([(f"A{i}", "2024-01-02 00:00:00") for i in ids], "alert_id string, t string").select(
        "alert_id", F.col("t").cast("timestamp").alias("timestamp"))
    one, two = (J.alert_batch_writer(sink, [lambda b, i: seen.append(b.count())], run=J.run_id(c)) for c in ("ck1", "ck2"))
    one(rows([1, 2, 3]), 0)
    two(rows([4]), 0)
    one(rows([1, 2, 3]), 0)
    assert sorted(r.alert_id for r in spark.read.parquet(sink).collect()) == ["A1", "A2", "A3", "A4"] and seen == [3, 1, 3]
    to = J.scratch_path(spark, "compact")
    J.compact_alerts(spark, sink, to)
    assert spark.read.parquet(to).count() == 4 and set(spark.read.parquet(to).columns) == {"alert_id", "timestamp", "alert_date"}


def test_zero_is_a_threshold(spark):
    df = spark.createDataFrame([("a", "b", 1, "2024-01-01 00:00:00")], "src_ip string, dst_ip string, dst_port int, t string").withColumn(
        "ts", F.col("t").cast("timestamp"))
    assert W.port_scan_windows(df, window=60, unique_ports=0, packets=0).first().is_port_scan
    assert W.dos_windows(df, window=60, packets=0, rate=0).first().is_dos
