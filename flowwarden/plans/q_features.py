"""Catalog: derived flow columns (D), cleaning (B) and scalar helpers (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as L
from ..functions.aggregates import entropy_by_group, metric_summary
from ..operators import clean as B
from ..operators.features import extract_network_features, feature_interactions
from ..oracle import AS_OF, ip_int_sql, label_sql, with_flows, with_gaps
from ..sources.tables import flows_with_gaps, read_flows
from .catalog import register
from .detection import AS_OF as AS_OF_TEXT


def _r6(c):
    return F.round(c, 6)


D_COLS_ROUND = ["packet_size_log", "byte_ratio", "bytes_per_second", "srv_ratio"]


@register("derived_flow_features", with_flows("""
SELECT flow_id,
 round(ln(1 + packet_size), 6) AS packet_size_log,
 CAST(packet_size AS BIGINT) * CAST(packet_size AS BIGINT) AS packet_size_squared,
 src_bytes + dst_bytes AS total_bytes,
 round(CASE WHEN dst_bytes > 0 THEN src_bytes / dst_bytes ELSE src_bytes END, 6) AS byte_ratio,
 round(CASE WHEN duration > 0 THEN (src_bytes + dst_bytes) / duration ELSE src_bytes + dst_bytes END, 6)
   AS bytes_per_second,
 round(CASE WHEN "count" > 0 THEN CAST(srv_count AS DOUBLE) / "count" ELSE 0.0 END, 6) AS srv_ratio,
 CAST(src_port <= 1024 AS INTEGER) AS is_well_known_src_port,
 CAST(dst_port <= 1024 AS INTEGER) AS is_well_known_dst_port,
 abs(CAST(src_port AS BIGINT) - dst_port) AS port_diff,
 CAST(protocol_type = 'tcp' AS INTEGER) AS is_tcp,
 CAST(protocol_type = 'udp' AS INTEGER) AS is_udp,
 CAST(protocol_type = 'icmp' AS INTEGER) AS is_icmp,
 CAST(hour(ts) AS INTEGER) AS hour,
 CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
 CAST(isodow(ts) - 1 >= 5 AS INTEGER) AS is_weekend,
 CAST((tcp_flags & 2) > 0 AS INTEGER) AS has_syn,
 CAST((tcp_flags & 16) > 0 AS INTEGER) AS has_ack,
 CAST((tcp_flags & 1) > 0 AS INTEGER) AS has_fin,
 CAST((tcp_flags & 4) > 0 AS INTEGER) AS has_rst
FROM flows"""))
def derived_flow_features(spark, sf):
    f = read_flows(spark, sf)
    d = extract_network_features(f, time_col="ts")
    new = [c for c in d.columns if c not in f.columns]
    return d.select("flow_id", *[_r6(F.col(c)).alias(c) if c in D_COLS_ROUND else F.col(c) for c in new])


_PAIRS = [("src_port", "dst_port"), ("src_port", "duration"), ("src_port", "src_bytes"),
          ("src_port", "dst_bytes"), ("dst_port", "duration")]


def _pair_sql(a, b):
    x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    return (f"{x} * {y} AS {a}_x_{b}, "
            f"CASE WHEN {y} != 0 THEN {x} / {y} ELSE 0.0 END AS {a}_div_{b}")


@register("feature_interactions", with_flows(
    "SELECT flow_id, " + ", ".join(_pair_sql(a, b) for a, b in _PAIRS) + " FROM flows"))
def feature_interactions_q(spark, sf):
    f = read_flows(spark, sf)
    d = feature_interactions(f, max_interactions=10, exclude=("label", "flow_id"))
    new = [c for c in d.columns if c not in f.columns]
    return d.select("flow_id", *new)


# --- B: cleaning ----------------------------------------------------------------

@register("fill_missing", with_gaps("""
SELECT flow_id, COALESCE(duration, 0.0) AS duration, COALESCE(src_ip, '0') AS src_ip, label_raw FROM gaps"""))
def fill_missing_q(spark, sf):
    g = B.fill_missing(flows_with_gaps(read_flows(spark, sf)), exclude=("label_raw",))
    return g.select("flow_id", "duration", "src_ip", "label_raw")


@register("replace_infinite", with_gaps("""
SELECT flow_id, CASE WHEN isinf(src_bytes) OR isnan(src_bytes) THEN 0.0 ELSE src_bytes END AS src_bytes FROM gaps"""))
def replace_infinite_q(spark, sf):
    return B.replace_infinite(flows_with_gaps(read_flows(spark, sf))).select("flow_id", "src_bytes")


@register("category_codes", with_flows("""
SELECT flow_id, CAST(dense_rank() OVER (ORDER BY protocol_type) - 1 AS INTEGER) AS protocol_type,
 CAST(dense_rank() OVER (ORDER BY label_raw) - 1 AS INTEGER) AS label_raw FROM flows"""))
def category_codes_q(spark, sf):
    f = read_flows(spark, sf).select("flow_id", "protocol_type", "label_raw")
    return B.category_codes(f, ["protocol_type", "label_raw"])


@register("standardize_labels", with_gaps(f"""
SELECT flow_id, label_raw, {label_sql('label_raw')} AS label FROM gaps"""))
def standardize_labels_q(spark, sf):
    g = flows_with_gaps(read_flows(spark, sf))
    return B.standardize_labels(g, "label_raw", out="label").select("flow_id", "label_raw", "label")


@register("preprocess", with_gaps(f"""
SELECT flow_id, {ip_int_sql("COALESCE(src_ip, '0')")} AS src_ip, {ip_int_sql('dst_ip')} AS dst_ip,
 CAST(dense_rank() OVER (ORDER BY protocol_type) - 1 AS INTEGER) AS protocol_type,
 src_port, dst_port, COALESCE(duration, 0.0) AS duration,
 CASE WHEN isinf(src_bytes) THEN 0.0 ELSE src_bytes END AS src_bytes, dst_bytes, packet_size, tcp_flags,
 "count", srv_count, num_failed_logins, {label_sql('label_raw')} AS label_raw, rf_score, recon_error, lstm_score
FROM gaps"""))
def preprocess_q(spark, sf):
    g = flows_with_gaps(read_flows(spark, sf)).drop("ts")
    return B.preprocess(g, label="label_raw")


@register("coerce_numeric", """
SELECT event_id AS flow_id, TRY_CAST(regexp_extract(props, ':\\s*([0-9]+)', 1) AS DOUBLE) AS k_value,
 TRY_CAST(CASE event_type WHEN 'error' THEN ' DoS ' WHEN 'signup' THEN 'zero_day' ELSE 'Normal' END AS DOUBLE)
   AS label_value
FROM events""")
def coerce_numeric_q(spark, sf):
    from ..sources.tables import flows_from_events, read_table
    # the raw props text rides along in the same projection (no self join)
    f = flows_from_events(read_table(spark, sf, "events"), keep=("props",))
    x = f.select("flow_id", F.regexp_extract("props", r":\s*([0-9]+)", 1).alias("k_value"),
                 F.col("label_raw").alias("label_value"))
    return B.coerce_numeric(x, ["k_value", "label_value"])


@register("coerce_timestamp", with_flows("""
SELECT flow_id, strftime(to_timestamp(TRY_CAST(
   CASE WHEN protocol_type = 'icmp' THEN 'n/a' ELSE CAST(1704067200 + flow_id * 60 AS VARCHAR) END AS DOUBLE)),
   '%Y-%m-%d %H:%M:%S') AS event_time
FROM flows"""))
def coerce_timestamp_q(spark, sf):
    f = read_flows(spark, sf)
    raw = F.when(F.col("protocol_type") == "icmp", F.lit("n/a")).otherwise((F.lit(1704067200) + F.col("flow_id") * 60).cast("string"))
    x = B.coerce_timestamp(f.withColumn("event_time", raw), "event_time")
    return x.select("flow_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"))


# --- L: scalar helpers ----------------------------------------------------------

@register("safe_divide", with_flows("""
SELECT flow_id, round(CASE WHEN dst_bytes != 0 THEN src_bytes / dst_bytes ELSE 0.0 END, 6) AS bytes_ratio,
 round(CASE WHEN duration != 0 THEN "count" / duration ELSE -1.0 END, 6) AS count_rate FROM flows"""))
def safe_divide_q(spark, sf):
    f = read_flows(spark, sf)
    return f.select("flow_id", _r6(L.safe_divide("src_bytes", "dst_bytes")).alias("bytes_ratio"),
                    _r6(L.safe_divide(F.col("count").cast("double"), "duration", -1.0)).alias("count_rate"))


def _norm_sql(x):
    parts = [f"TRY_CAST(split_part({x}, '.', {i}) AS BIGINT)" for i in range(1, 5)]
    ok = f"len(string_split({x}, '.')) = 4 AND " + " AND ".join(f"{p} IS NOT NULL" for p in parts)
    return f"CASE WHEN {ok} THEN concat_ws('.', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)}) ELSE {x} END"


def _priv_sql(x):
    p = [f"TRY_CAST(split_part({x}, '.', {i}) AS BIGINT)" for i in range(1, 5)]
    ok = f"len(string_split({x}, '.')) = 4 AND " + " AND ".join(f"{q} IS NOT NULL" for q in p)
    return (f"COALESCE(CASE WHEN {ok} THEN ({p[0]} = 10 OR ({p[0]} = 172 AND {p[1]} BETWEEN 16 AND 31) "
            f"OR ({p[0]} = 192 AND {p[1]} = 168)) ELSE false END, false)")


def _mixed_spark():
    return F.concat(F.lit("172."), (F.col("src_port") % 40).cast("string"), F.lit(".1.1"))



_MIXED_SQL = "concat('172.', CAST(src_port % 40 AS VARCHAR), '.1.1')"
def _bad_spark():
    return F.concat(F.col("src_ip"), F.when(F.col("protocol_type") == "udp", F.lit(".7")).otherwise(F.lit("")))



_BAD_SQL = "concat(src_ip, CASE WHEN protocol_type = 'udp' THEN '.7' ELSE '' END)"


@register("ip_helpers", with_flows(f"""
SELECT flow_id, {ip_int_sql('src_ip')} AS src_ip_int, {ip_int_sql('dst_ip')} AS dst_ip_int,
 {ip_int_sql(_BAD_SQL)} AS odd_ip_int,
 {_norm_sql("concat('00', dst_ip)")} AS dst_ip_norm, {_norm_sql(_BAD_SQL)} AS odd_ip_norm,
 {_priv_sql('src_ip')} AS src_private, {_priv_sql(_MIXED_SQL)} AS mixed_private
FROM flows"""))
def ip_helpers(spark, sf):
    f = read_flows(spark, sf)
    return f.select("flow_id", L.ip_to_int("src_ip").alias("src_ip_int"), L.ip_to_int("dst_ip").alias("dst_ip_int"),
                    L.ip_to_int(_bad_spark()).alias("odd_ip_int"),
                    L.normalize_ip(F.concat(F.lit("00"), F.col("dst_ip"))).alias("dst_ip_norm"),
                    L.normalize_ip(_bad_spark()).alias("odd_ip_norm"),
                    L.is_private_ip("src_ip").alias("src_private"), L.is_private_ip(_mixed_spark()).alias("mixed_private"))


@register("unit_conversions", with_flows("""
SELECT flow_id, round(src_bytes / 1048576.0, 6) AS src_mb, CAST(trunc(duration * 1048576.0) AS BIGINT) AS duration_as_bytes,
 format('{:,.2f}', src_bytes) AS src_bytes_text, format('{:,}', CAST("count" * 1000 AS BIGINT)) AS count_text
FROM flows"""))
def unit_conversions(spark, sf):
    f = read_flows(spark, sf)
    return f.select("flow_id", _r6(L.bytes_to_mb("src_bytes")).alias("src_mb"),
                    L.mb_to_bytes("duration").alias("duration_as_bytes"),
                    L.format_number_("src_bytes", 2).alias("src_bytes_text"),
                    L.format_number_(F.col("count").cast("bigint") * 1000, integral=True).alias("count_text"))


@register("time_helpers", with_flows(f"""
SELECT flow_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text, round(epoch_us(ts) / 1e6, 6) AS epoch_seconds,
 CASE WHEN d > 0 THEN CAST(d AS VARCHAR) || ' day' || CASE WHEN d != 1 THEN 's' ELSE '' END || ' ago'
      WHEN s > 3600 THEN CAST(s // 3600 AS VARCHAR) || ' hour' || CASE WHEN s // 3600 != 1 THEN 's' ELSE '' END || ' ago'
      WHEN s > 60 THEN CAST(s // 60 AS VARCHAR) || ' minute' || CASE WHEN s // 60 != 1 THEN 's' ELSE '' END || ' ago'
      ELSE CAST(s AS VARCHAR) || ' second' || CASE WHEN s != 1 THEN 's' ELSE '' END || ' ago' END AS age,
 ts >= {AS_OF} - INTERVAL 72 HOUR AND ts <= {AS_OF} AS in_range,
 strftime(to_timestamp(epoch_us(ts) / 1e6 + 90), '%Y-%m-%d %H:%M:%S') AS plus_90s
FROM (SELECT *, (epoch_us({AS_OF}) - epoch_us(ts)) // 86400000000 AS d,
             ((epoch_us({AS_OF}) - epoch_us(ts)) % 86400000000) // 1000000 AS s FROM flows)"""))
def time_helpers(spark, sf):
    f = read_flows(spark, sf)
    as_of = F.to_timestamp(F.lit(AS_OF_TEXT))
    lo = as_of - F.make_interval(hours=F.lit(72))
    t = L.as_ltz(F.col("ts"))
    return f.select("flow_id", L.format_timestamp("ts").alias("ts_text"),
                    _r6(L.timestamp_to_epoch("ts")).alias("epoch_seconds"),
                    L.time_ago("ts", as_of).alias("age"), ((t >= lo) & (t <= as_of)).alias("in_range"),
                    L.format_timestamp(L.epoch_to_timestamp(L.timestamp_to_epoch("ts") + 90)).alias("plus_90s"))


@register("port_protocol_risk", with_flows("""
SELECT flow_id, dst_port IN (22, 23, 135, 139, 445, 1433, 1521, 3389, 5432, 5900) AS suspicious_dst_port,
 CASE WHEN lower(svc) IN ('telnet', 'ftp', 'http', 'snmp') THEN 'high'
      WHEN lower(svc) IN ('ssh', 'smtp', 'pop3', 'imap') THEN 'medium' ELSE 'low' END AS protocol_risk
FROM (SELECT *, CASE dst_port WHEN 22 THEN 'SSH' WHEN 443 THEN 'Http' WHEN 3389 THEN 'rdp' ELSE 'Telnet' END AS svc
      FROM flows)"""))
def port_protocol_risk(spark, sf):
    f = read_flows(spark, sf)
    svc = (F.when(F.col("dst_port") == 22, "SSH").when(F.col("dst_port") == 443, "Http")
           .when(F.col("dst_port") == 3389, "rdp").otherwise("Telnet"))
    return f.select("flow_id", L.is_suspicious_port("dst_port").alias("suspicious_dst_port"),
                    L.protocol_risk(svc).alias("protocol_risk"))


@register("entropy_by_source", with_flows("""
SELECT src_ip, round(log2(n) - s / n, 6) AS dst_port_entropy, CAST(n AS BIGINT) AS flow_count
FROM (SELECT src_ip, sum(c) AS n, sum(c * log2(c)) AS s
      FROM (SELECT src_ip, dst_port, CAST(count(*) AS DOUBLE) AS c FROM flows GROUP BY 1, 2) GROUP BY 1)"""))
def entropy_by_source(spark, sf):
    e = entropy_by_group(read_flows(spark, sf), "src_ip", "dst_port", out="dst_port_entropy")
    return e.select("src_ip", _r6(F.col("dst_port_entropy")).alias("dst_port_entropy"), "flow_count")


@register("metric_summary", with_flows("""
SELECT name, CAST(count(value) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS min_value,
 round(max(value), 6) AS max_value
FROM (UNPIVOT (SELECT duration, src_bytes, dst_bytes, CAST(packet_size AS DOUBLE) AS packet_size FROM flows)
      ON duration, src_bytes, dst_bytes, packet_size INTO NAME name VALUE value) GROUP BY name"""))
def metric_summary_q(spark, sf):
    f = read_flows(spark, sf).withColumn("packet_size", F.col("packet_size").cast("double"))
    m = metric_summary(f, ["duration", "src_bytes", "dst_bytes", "packet_size"])
    return m.select("name", "n", *[_r6(F.col(c)).alias(c) for c in ("mean", "min_value", "max_value")])
