"""Catalog: sources and sinks (A). Inputs are written from the given tables
into the shared checkpoint folder, then read back with the source under test."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import models as G
from ..operators.features import extract_network_features
from ..operators import clean as B
from ..schemas import CONN_FEATURES
from ..sources import files as A
from ..sources.pcap import normalize_packets, read_packets, write_pcap_files
from ..sources.tables import read_flows
from ..streaming.jobs import scratch_path
from ..oracle import with_flows, with_alerts
from .catalog import register
from .detection import alerts_from_flows
from ..operators.alerts import attack_type_counts

CSV_COLS = ["flow_id", "src_ip", "protocol_type", "dst_port", "duration", "src_bytes", "label_raw"]


@register("csv_with_header", with_flows("""
SELECT CAST(flow_id AS BIGINT) AS flow_id, src_ip, protocol_type, CAST(dst_port AS BIGINT) AS dst_port, duration,
 src_bytes, label_raw FROM flows"""))
def csv_with_header(spark, sf):
    path = scratch_path(spark, "csv-header")
    (read_flows(spark, sf).select(*CSV_COLS).write.option("header", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    d = A.read_flows_csv(spark, path, header=True)
    return d.select(F.col("flow_id").cast("bigint"), "src_ip", "protocol_type", F.col("dst_port").cast("bigint"),
                    F.col("duration").cast("double"), F.col("src_bytes").cast("double"), "label_raw")


def _conn_record(f):
    """The 41 connection features + label from a flow row (absent ones 0)."""
    have = {"duration": F.col("duration"), "protocol_type": F.col("protocol_type"),
            "service": F.when(F.col("dst_port") == 22, "ssh").when(F.col("dst_port") == 443, "https").otherwise("other"),
            "flag": F.when(F.col("tcp_flags") > 0, "SF").otherwise("S0"), "src_bytes": F.col("src_bytes").cast("long"),
            "dst_bytes": F.col("dst_bytes").cast("long"), "num_failed_logins": F.col("num_failed_logins"),
            "count": F.col("count"), "srv_count": F.col("srv_count")}
    cols = [(have[c] if c in have else F.lit(0)).alias(c) for c in CONN_FEATURES]
    return f.select(*cols, F.trim(F.col("label_raw")).alias("label"))


@register("csv_headerless_conn", with_flows("""
SELECT duration, protocol_type,
 CASE WHEN dst_port = 22 THEN 'ssh' WHEN dst_port = 443 THEN 'https' ELSE 'other' END AS service,
 CAST(trunc(src_bytes) AS BIGINT) AS src_bytes, CAST(num_failed_logins AS BIGINT) AS num_failed_logins,
 CAST("count" AS BIGINT) AS "count", CAST(0 AS BIGINT) AS root_shell, CAST(0.0 AS DOUBLE) AS serror_rate,
 trim(label_raw) AS label FROM flows"""))
def csv_headerless_conn(spark, sf):
    path = scratch_path(spark, "csv-conn")
    _conn_record(read_flows(spark, sf)).write.option("header", False).csv(path)
    d = A.read_flows_csv(spark, path, header=False)
    return d.select("duration", "protocol_type", "service", "src_bytes", "num_failed_logins", "count", "root_shell",
                    "serror_rate", "label")


@register("pcap_packets", with_flows("""
SELECT CAST(epoch_us(ts) AS BIGINT) AS timestamp_us, packet_size,
 CASE WHEN arp THEN '0.0.0.0' ELSE src_ip END AS src_ip, CASE WHEN arp THEN '0.0.0.0' ELSE dst_ip END AS dst_ip,
 CASE WHEN arp THEN 0 ELSE packet_size - 14 END AS ip_len, CASE WHEN arp THEN 0 ELSE 2 END AS ip_flags,
 CASE WHEN arp THEN 0 ELSE 64 END AS ip_ttl,
 CASE WHEN arp THEN 0 WHEN protocol_type = 'tcp' THEN 6 WHEN protocol_type = 'udp' THEN 17 ELSE 1 END AS protocol,
 CASE WHEN arp THEN 'other' ELSE protocol_type END AS protocol_type,
 CASE WHEN protocol_type IN ('tcp', 'udp') THEN src_port ELSE 0 END AS src_port,
 CASE WHEN protocol_type IN ('tcp', 'udp') THEN dst_port ELSE 0 END AS dst_port,
 CASE WHEN protocol_type = 'tcp' THEN tcp_flags ELSE 0 END AS tcp_flags,
 CASE WHEN protocol_type = 'udp' THEN packet_size - 34 ELSE 0 END AS udp_len, 0 AS label
FROM (SELECT *, protocol_type = 'icmp' AND rf_score >= 0.9 AS arp FROM flows)"""))
def pcap_packets(spark, sf):
    """Flows written as capture files (about 5,000 frames each), decoded as
    a Spark job over the files and normalised."""
    f = read_flows(spark, sf)
    folder = scratch_path(spark, "pcap")
    write_pcap_files(f, folder, max(1, f.count() // 5000))
    p = normalize_packets(read_packets(spark, os.path.join(folder, "*.pcap")))
    return p.select(F.round(F.col("timestamp") * 1e6).cast("bigint").alias("timestamp_us"), "packet_size", "src_ip",
                    "dst_ip", "ip_len", "ip_flags", "ip_ttl", "protocol", "protocol_type", "src_port", "dst_port",
                    "tcp_flags", "udp_len", "label")


@register("pcap_ranges", with_flows("""
SELECT CAST(epoch_us(ts) AS BIGINT) AS timestamp_us, CASE WHEN v6 THEN greatest(packet_size, 70) ELSE packet_size END AS packet_size,
 CASE WHEN arp THEN '0.0.0.0' WHEN v6 THEN '::ffff:' || src_ip ELSE src_ip END AS src_ip,
 CASE WHEN arp THEN '0.0.0.0' WHEN v6 THEN '::ffff:' || dst_ip ELSE dst_ip END AS dst_ip,
 CASE WHEN arp THEN 0 WHEN v6 THEN greatest(packet_size, 70) - 14 ELSE packet_size - 14 END AS ip_len,
 CASE WHEN arp OR v6 THEN 0 ELSE 2 END AS ip_flags, CASE WHEN arp THEN 'other' ELSE protocol_type END AS protocol_type,
 CASE WHEN protocol_type IN ('tcp', 'udp') THEN src_port ELSE 0 END AS src_port,
 CASE WHEN protocol_type IN ('tcp', 'udp') THEN dst_port ELSE 0 END AS dst_port,
 CASE WHEN v6 THEN greatest(packet_size, 70) - 62 WHEN protocol_type = 'udp' THEN packet_size - 34 ELSE 0 END AS udp_len
FROM (SELECT *, protocol_type = 'icmp' AND rf_score >= 0.9 AS arp, protocol_type = 'udp' AND flow_id % 3 = 0 AS v6 FROM flows)"""))
def pcap_ranges(spark, sf):
    """Flows in two classic and two next-generation files, some as IPv6, decoded in ranges of 256 KiB."""
    folder = scratch_path(spark, "pcap-mixed")
    write_pcap_files(read_flows(spark, sf), folder, 4, mixed=True)
    p = normalize_packets(read_packets(spark, os.path.join(folder, "*.pcap"), range_bytes=256 << 10))
    return p.select(F.round(F.col("timestamp") * 1e6).cast("bigint").alias("timestamp_us"), "packet_size", "src_ip", "dst_ip", "ip_len",
                    "ip_flags", "protocol_type", "src_port", "dst_port", "udp_len")


@register("file_manifest")
def file_manifest(spark, sf):
    """MD5 and size of the given table files, with the acceptance check
    (rows-only: the oracle has no file access)."""
    m = A.file_manifest(spark, os.path.join(sf, "*.parquet"))
    return A.accepted_inputs(m, extensions=["parquet", "csv", "pcap", "pcapng"]).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "size_bytes", "md5", "extension", "accepted")


@register("export_report", with_alerts("""
SELECT alert_type, CAST(count(*) AS BIGINT) AS alert_count FROM alerts GROUP BY 1"""))
def export_report(spark, sf):
    """Attack-type report exported as CSV, JSON and parquet and read back;
    the three copies must agree (checked in tests), the CSV copy is returned."""
    rep = attack_type_counts(alerts_from_flows(read_flows(spark, sf)))
    base = scratch_path(spark, "report")
    for fmt in ("csv", "json", "parquet"):
        A.export_report(rep, os.path.join(base, fmt), fmt)
    back = A.read_report(spark, os.path.join(base, "csv"), "csv", schema="alert_type string, alert_count bigint")
    return back


@register("model_roundtrip")
def model_roundtrip(spark, sf):
    """Forest saved and loaded again: scores of both copies per row, and
    whether they are identical (rows-only)."""
    d = extract_network_features(B.standardize_labels(read_flows(spark, sf), "label_raw", out="label"), time_col="ts")
    feats = ["duration", "src_bytes", "dst_bytes", "packet_size", "count", "srv_count", "is_udp", "is_icmp"]
    m = G.train_forest(d, feats, "label")
    path = scratch_path(spark, "models")
    G.save_models(spark, {"random_forest": m}, path, {"features": feats, "threshold": 0.5})
    loaded, info = G.load_models(spark, path, ["random_forest"])
    a = G.forest_scores(m, d).select("flow_id", F.col("rf_score").alias("score_saved"))
    b = G.forest_scores(loaded["random_forest"], d).select("flow_id", F.col("rf_score").alias("score_loaded"))
    return a.join(b, "flow_id").withColumn("identical", F.col("score_saved") == F.col("score_loaded"))
