"""Scoring a stream equals the batch job, however rows are dealt to batches; keyed
sequences equal their batch form; late rows are counted."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import MEDIUM, SMALL
from flowwarden.operators import clean as B
from flowwarden.plans import training as P
from flowwarden.sources.tables import flows_from_events, read_flows
from flowwarden.streaming import jobs as J
from flowwarden.streaming import sequences as S
from flowwarden.streaming import windows as W
from flowwarden.streaming.carried import CarriedScorer

UNSCORED = ["rf_score", "recon_error", "lstm_score", "label_raw"]


@pytest.fixture(scope="module")
def models(spark):
    lab = B.standardize_labels(read_flows(spark, SMALL), "label_raw", out="label").drop(*UNSCORED)
    return P.train_detector(lab, window=20, k=20, forest_params={"numTrees": 10, "maxDepth": 5})


def deal(spark, flows, n, jitter="0 seconds"):
    """``flows`` as ``n`` files in time order, but for rows that are up to ``jitter`` late."""
    path = J.scratch_path(spark, "dealt")
    at = F.unix_seconds(F.col("ts").cast("timestamp") + F.when(F.col("flow_id") % 3 == 0, F.expr(f"INTERVAL {jitter}")).otherwise(F.expr("INTERVAL 0 SECONDS")))
    lo, hi = flows.agg(F.min(at), F.max(at)).first()
    part = F.least(F.floor((at - lo) * n / (hi - lo)), F.lit(n - 1))
    for k in range(n):
        flows.where(part == k).coalesce(1).write.mode("append").parquet(path)
    return path


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("batches,rows", [(3, None), (5, 24)])
def test_carried_scores_equal_batch(spark, models, batches, rows):
    flows = read_flows(spark, SMALL).drop(*UNSCORED)
    if rows:  # batches of at most five rows or so
        flows = spark.createDataFrame(flows.orderBy("ts").limit(rows).collect(), flows.schema)
    path = deal(spark, flows, batches, "2 hours")
    sink, state, ck = (J.scratch_path(spark, x) for x in ("cs", "cst", "csc"))
    scorer = P.carried_scorer(models, sink, state, J.run_id(ck), delay_seconds=4 * 3600)
    q = stream_of(spark, path, flows.schema).writeStream.foreachBatch(scorer).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.recentProgress[-1]["batchId"]
    scorer.finish(spark, last, flows.schema)
    got = spark.read.parquet(sink).select("alert_id", "severity", "alert_type")
    want = P.batch_scorer(models)(flows).select("alert_id", "severity", "alert_type")
    assert scorer.late == 0 and last >= batches - 1 and want.count() > 0
    assert sorted(got.collect()) == sorted(want.collect())


def test_a_batch_that_runs_again_replaces_itself(spark):
    """Rows pass through in order, context is cut to the look-back, late rows are counted."""
    t0, seen = dt.datetime(2024, 1, 1), {}
    rows = lambda *minutes: spark.createDataFrame([(m, t0 + dt.timedelta(minutes=m)) for m in minutes], "flow_id long, ts timestamp")
    scorer = CarriedScorer(lambda d: seen.__setitem__("given", sorted(r.flow_id for r in d.collect())) or d, lambda d: d,
                           lambda d, i: seen.__setitem__(i, sorted(r.flow_id for r in d.collect())), J.scratch_path(spark, "again"), 2, 600)
    scorer(rows(30, 10, 21), 0)
    assert seen[0] == [10] and seen["given"] == [10]  # the watermark stands at minute 20
    scorer(rows(25, 45, 5), 1)
    assert seen[1] == [21, 25, 30] and seen["given"] == [10, 21, 25, 30] and scorer.late == 1
    scorer(rows(25, 45, 5), 1)
    assert seen[1] == [21, 25, 30] and scorer.late == 1
    scorer(rows(), 2)
    assert 2 not in seen
    scorer.finish(spark, 2, rows().schema)
    assert seen[3] == [45] and seen["given"] == [25, 30, 45]


def test_sequences_equal_batch(spark):
    flows = read_flows(spark, MEDIUM)
    path = deal(spark, flows, 6, "90 minutes")
    s = W.event_time(stream_of(spark, path, flows.schema), "ts", "event_time")
    out, ck, feats = J.scratch_path(spark, "seq"), J.scratch_path(spark, "seqc"), ["packet_size", "src_bytes"]
    with S.started_with(spark, S.STATE_CONF):
        q = (S.sequence_stream(s, feats, 5, delay="2 hours", idle_ms=400 * 24 * 3_600_000).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    f = W.event_time(flows, "ts", "event_time")
    newest = f.agg(F.max("event_time")).first()[0]
    want = S.sequence_batch(f, feats, 5).where(F.col("event_time") < F.lit(newest) - F.expr("INTERVAL 2 HOURS"))
    got = spark.read.parquet(out)
    assert got.count() == want.count() > 9000 and got.exceptAll(want).count() == 0
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress) == 0
