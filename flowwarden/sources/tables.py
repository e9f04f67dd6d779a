"""Readers for the parquet tables and the ``flows`` view derived from ``events``.

``flows`` is a pure projection of ``events`` (no shuffle): every network-flow
column is a deterministic expression of one event row, so the view scales with
the events table and keeps its partitioning. The same definition, written in
DuckDB SQL, is ``FLOWS_SQL`` and is used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def flows_from_events(events: DataFrame, keep=()) -> DataFrame:
    """The flow view of event rows; ``keep`` carries extra event columns."""
    e = events.withColumn("_k", F.regexp_extract("props", r"([0-9]+)", 1).try_cast("int"))
    eid, k, et, v = F.col("event_id"), F.col("_k"), F.col("event_type"), F.col("value")
    return e.select(
        eid.alias("flow_id"),
        F.col("ts"),
        F.concat(F.lit("192.168."), (F.col("user_id") % 4).cast("string"), F.lit("."),
                 (F.col("user_id") % 254 + 1).cast("string")).alias("src_ip"),
        F.concat(F.lit("10.0.0."), ((eid * 7) % 50 + 1).cast("string")).alias("dst_ip"),
        F.when(et == "signup", "udp").when(et == "error", "icmp").otherwise("tcp").alias("protocol_type"),
        (F.lit(1) + (eid * 7919) % 65535).cast("int").alias("src_port"),
        F.when(k % 5 == 0, 22).when(k % 5 == 1, 3389).when(k % 5 == 2, 443)
         .otherwise(F.lit(1) + (eid * 104729) % 65535).cast("int").alias("dst_port"),
        F.when(k % 10 == 0, F.lit(0.0)).otherwise(v / 50).alias("duration"),
        F.when(et == "purchase", v * 1000).otherwise(v * 100).alias("src_bytes"),
        F.when(k % 7 == 0, F.lit(0.0)).otherwise(k.cast("double") * 250).alias("dst_bytes"),
        (F.lit(64) + (eid * 31) % 1436).cast("int").alias("packet_size"),
        F.when(et.isin("signup", "error"), 0).otherwise(eid % 64).cast("int").alias("tcp_flags"),
        (F.lit(1) + (eid * 13) % 150).cast("int").alias("count"),
        ((eid * 7) % 40).cast("int").alias("srv_count"),
        F.when(k >= 90, k % 10).otherwise(0).cast("int").alias("num_failed_logins"),
        F.when(et == "error", " DoS ").when(et == "signup", "zero_day").otherwise("Normal").alias("label_raw"),
        (k.cast("double") / 100).alias("rf_score"),
        v.alias("recon_error"),
        ((eid % 101).cast("double") / 100).alias("lstm_score"),
        *[F.col(c) for c in keep],
    )


def read_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_from_events(read_table(spark, sf_dir, "events"))


# DuckDB twin of ``flows_from_events`` (used as a CTE by the oracle SQL).
FLOWS_SQL = """
SELECT event_id AS flow_id, ts,
 concat('192.168.', CAST(user_id % 4 AS VARCHAR), '.', CAST(user_id % 254 + 1 AS VARCHAR)) AS src_ip,
 concat('10.0.0.', CAST((event_id * 7) % 50 + 1 AS VARCHAR)) AS dst_ip,
 CASE event_type WHEN 'signup' THEN 'udp' WHEN 'error' THEN 'icmp' ELSE 'tcp' END AS protocol_type,
 CAST(1 + (event_id * 7919) % 65535 AS INT) AS src_port,
 CAST(CASE k % 5 WHEN 0 THEN 22 WHEN 1 THEN 3389 WHEN 2 THEN 443
      ELSE 1 + (event_id * 104729) % 65535 END AS INT) AS dst_port,
 CASE WHEN k % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE value / 50 END AS duration,
 CASE WHEN event_type = 'purchase' THEN value * 1000 ELSE value * 100 END AS src_bytes,
 CASE WHEN k % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(k AS DOUBLE) * 250 END AS dst_bytes,
 CAST(64 + (event_id * 31) % 1436 AS INT) AS packet_size,
 CAST(CASE WHEN event_type IN ('signup','error') THEN 0 ELSE event_id % 64 END AS INT) AS tcp_flags,
 CAST(1 + (event_id * 13) % 150 AS INT) AS "count",
 CAST((event_id * 7) % 40 AS INT) AS srv_count,
 CAST(CASE WHEN k >= 90 THEN k % 10 ELSE 0 END AS INT) AS num_failed_logins,
 CASE event_type WHEN 'error' THEN ' DoS ' WHEN 'signup' THEN 'zero_day' ELSE 'Normal' END AS label_raw,
 CAST(k AS DOUBLE) / 100 AS rf_score,
 value AS recon_error,
 CAST(event_id % 101 AS DOUBLE) / 100 AS lstm_score
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
"""


def flows_with_gaps(flows: DataFrame) -> DataFrame:
    """``flows`` with missing, infinite and blank values injected from the
    event content (every row is kept): duration is null for error events,
    src_ip is null for signup events with k >= 50, src_bytes is +Inf where
    the recon error exceeds 190, and label_raw is null where k = 0."""
    return flows.withColumns({
        "duration": F.when(F.col("protocol_type") == "icmp", F.lit(None).cast("double")).otherwise(F.col("duration")),
        "src_ip": F.when((F.col("protocol_type") == "udp") & (F.col("rf_score") >= 0.5), F.lit(None).cast("string"))
                   .otherwise(F.col("src_ip")),
        "src_bytes": F.when(F.col("recon_error") > 190, F.lit(float("inf"))).otherwise(F.col("src_bytes")),
        "label_raw": F.when(F.col("rf_score") == 0, F.lit(None).cast("string")).otherwise(F.col("label_raw")),
    })


FLOWS_GAPS_SQL = """
SELECT * REPLACE (
  CASE WHEN protocol_type = 'icmp' THEN CAST(NULL AS DOUBLE) ELSE duration END AS duration,
  CASE WHEN protocol_type = 'udp' AND rf_score >= 0.5 THEN CAST(NULL AS VARCHAR) ELSE src_ip END AS src_ip,
  CASE WHEN recon_error > 190 THEN CAST('inf' AS DOUBLE) ELSE src_bytes END AS src_bytes,
  CASE WHEN rf_score = 0 THEN CAST(NULL AS VARCHAR) ELSE label_raw END AS label_raw)
FROM flows
"""
