"""Physical-plan properties: no single-partition exchange over data rows in
the ordered operators, pushdown into the parquet scan, and halo blocks equal
to the plain window for any block size."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import MEDIUM
from flowwarden.operators.rolling import global_index, rolling_features
from flowwarden.sources.tables import read_flows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rolling_plan_has_no_data_single_partition(spark):
    f = read_flows(spark, MEDIUM).select("flow_id", "ts", "packet_size")
    r = rolling_features(f, ["ts", "flow_id"], window=100, cols=["packet_size"], block_size=1000)
    plan = _plan(r)
    # exactly one single-partition exchange, over the P-row partition-offset
    # table (its input is the per-partition count aggregate), and the rows
    # themselves are shuffled by block
    assert plan.count("SinglePartition") == 1
    tail = plan.split("SinglePartition")[1]
    assert "HashAggregate(keys=[_pid" in tail.split("\n")[1]
    assert "hashpartitioning(_block" in plan


def test_global_index_dense_and_ordered(spark):
    f = read_flows(spark, MEDIUM).select("flow_id", "ts")
    idx = global_index(f, ["ts", "flow_id"], 7)
    rows = idx.orderBy("_idx").collect()
    assert [r._idx for r in rows] == list(range(len(rows)))
    keys = [(r.ts, r.flow_id) for r in rows]
    assert keys == sorted(keys)


def test_halo_equals_plain_window_random_blocks(spark):
    f = read_flows(spark, MEDIUM).select("flow_id", "ts", "packet_size").where(F.col("flow_id") < 3000)
    w = Window.orderBy("ts", "flow_id").rowsBetween(-29, 0)
    plain = {r.flow_id: r.m for r in f.select("flow_id", F.avg("packet_size").over(w).alias("m")).collect()}
    rnd = random.Random(7)
    for _ in range(3):
        b = rnd.randint(29, 700)
        got = rolling_features(f, ["ts", "flow_id"], window=30, cols=["packet_size"], block_size=b)
        for r in got.collect():
            assert abs(r.packet_size_rolling_mean - plain[r.flow_id]) < 1e-9


def test_filter_and_projection_reach_the_scan(spark):
    ev = spark.read.parquet(f"{MEDIUM}/events.parquet")
    q = ev.where(F.col("user_id") == 7).select("event_id", "value")
    plan = _plan(q)
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,7)]" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan


def test_fixture_rolling_sums(spark):
    f = read_flows(spark, MEDIUM).select("flow_id", "ts", "packet_size")
    r = rolling_features(f, ["flow_id"], window=100, cols=["packet_size"])
    s = r.agg(F.sum("packet_size_rolling_mean"), F.sum("packet_size_rolling_std")).first()
    assert round(s[0], 4) == 7794383.2925 and round(s[1], 4) == 4146646.0626
