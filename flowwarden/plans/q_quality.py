"""Catalog: profiling and data quality (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as B
from ..operators import quality as C
from ..oracle import label_sql, with_flows, with_gaps
from ..sources.tables import flows_with_gaps, read_flows
from .catalog import register


def _labelled(spark, sf):
    f = read_flows(spark, sf)
    return B.standardize_labels(f, "label_raw", out="label").drop("label_raw")


_GAP_COLS = ["flow_id", "ts", "src_ip", "dst_ip", "protocol_type", "src_port", "dst_port", "duration", "src_bytes",
             "dst_bytes", "packet_size", "tcp_flags", '"count"', "srv_count", "num_failed_logins", "label_raw",
             "rf_score", "recon_error", "lstm_score"]


@register("table_shape", with_flows("""
SELECT CAST(count(*) AS BIGINT) AS total_records, 19 AS total_features FROM flows"""))
def table_shape(spark, sf):
    return C.table_shape(read_flows(spark, sf))


@register("missing_cells", with_gaps(
    "SELECT CAST(" + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in _GAP_COLS)
    + " AS BIGINT) AS missing_values FROM gaps"))
def missing_cells(spark, sf):
    return C.missing_cells(flows_with_gaps(read_flows(spark, sf)))


@register("duplicate_rows", with_flows("""
SELECT CAST(COALESCE(sum(n - 1), 0) AS BIGINT) AS duplicate_records
FROM (SELECT count(*) AS n FROM flows GROUP BY src_ip, protocol_type, label_raw, num_failed_logins)"""))
def duplicate_rows(spark, sf):
    f = read_flows(spark, sf).select("src_ip", "protocol_type", "label_raw", "num_failed_logins")
    return C.duplicate_rows(f)


@register("duplicate_rows_all", with_gaps("""
SELECT CAST(COALESCE(sum(n - 1), 0) AS BIGINT) AS duplicate_records
FROM (SELECT count(*) AS n FROM (SELECT * FROM gaps UNION ALL SELECT * FROM gaps WHERE flow_id % 7 = 0) GROUP BY ALL)""".replace(
    "GROUP BY ALL", f"GROUP BY {', '.join(_GAP_COLS)}")))
def duplicate_rows_all(spark, sf):
    """Every seventh row twice, over all columns, nulls included."""
    f = flows_with_gaps(read_flows(spark, sf))
    return C.duplicate_rows(f.unionByName(f.where("flow_id % 7 = 0")))


@register("label_distribution", with_flows(f"""
SELECT {label_sql('label_raw')} AS label, CAST(count(*) AS BIGINT) AS label_count FROM flows GROUP BY 1"""))
def label_distribution(spark, sf):
    return C.label_distribution(_labelled(spark, sf))


@register("anomaly_rate", with_flows(f"""
SELECT round(avg(CASE WHEN {label_sql('label_raw')} = 1 THEN 1.0 ELSE 0.0 END), 6) AS anomaly_rate FROM flows"""))
def anomaly_rate(spark, sf):
    return C.anomaly_rate(_labelled(spark, sf)).select(F.round("anomaly_rate", 6).alias("anomaly_rate"))


@register("quality_flags", with_gaps("""
SELECT (count(*) FILTER (WHERE flow_id < 0 OR src_port < 0 OR dst_port < 0 OR duration < 0 OR src_bytes < 0
          OR dst_bytes < 0 OR packet_size < 0 OR tcp_flags < 0 OR "count" < 0 OR srv_count < 0
          OR num_failed_logins < 0 OR rf_score < 0 OR recon_error < 0 OR lstm_score < 0)) > 0 AS has_negative_values,
 (count(*) FILTER (WHERE isinf(duration) OR isinf(src_bytes) OR isinf(dst_bytes) OR isinf(rf_score)
          OR isinf(recon_error) OR isinf(lstm_score))) > 0 AS has_infinite_values,
 (count(*) FILTER (WHERE duration IS NULL OR src_ip IS NULL OR label_raw IS NULL)) > 0 AS has_null_values
FROM gaps"""))
def quality_flags(spark, sf):
    return C.quality_flags(flows_with_gaps(read_flows(spark, sf)))


_LAB_NUM = ["flow_id", "src_port", "dst_port", "duration", "src_bytes", "dst_bytes", "packet_size", "tcp_flags",
            '"count"', "srv_count", "num_failed_logins", "rf_score", "recon_error", "lstm_score", "label"]
_LAB_ALL = _LAB_NUM + ["ts", "src_ip", "dst_ip", "protocol_type"]
_LAB_DBL = ["duration", "src_bytes", "dst_bytes", "rf_score", "recon_error", "lstm_score"]


@register("validate_report", with_flows(f"""
, lab AS (SELECT * EXCLUDE (label_raw), {label_sql('label_raw')} AS label FROM flows)
SELECT 'total_records' AS metric, CAST(count(*) AS DOUBLE) AS value FROM lab
UNION ALL SELECT 'total_features', 19.0
UNION ALL SELECT 'missing_values', CAST({" + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in _LAB_ALL)} AS DOUBLE)
  FROM lab
UNION ALL SELECT 'anomaly_rate', round(avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END), 6) FROM lab
UNION ALL SELECT 'has_negative_values', CAST(count(*) FILTER (WHERE {" OR ".join(f"{c} < 0" for c in _LAB_NUM)}) > 0
  AS DOUBLE) FROM lab
UNION ALL SELECT 'has_infinite_values', CAST(count(*) FILTER (WHERE {" OR ".join(f"isinf({c})" for c in _LAB_DBL)}) > 0
  AS DOUBLE) FROM lab
UNION ALL SELECT 'has_null_values', CAST(count(*) FILTER (WHERE {" OR ".join(f"{c} IS NULL" for c in _LAB_ALL)}) > 0
  AS DOUBLE) FROM lab
UNION ALL SELECT 'duplicate_records', CAST(COALESCE(sum(n - 1), 0) AS DOUBLE)
  FROM (SELECT count(*) AS n FROM lab GROUP BY ALL_COLUMNS)
UNION ALL SELECT 'label_' || CAST(label AS VARCHAR), CAST(count(*) AS DOUBLE) FROM lab GROUP BY label""".replace(
    "ALL_COLUMNS", ", ".join(_LAB_ALL))))
def validate_report(spark, sf):
    r = C.validate(_labelled(spark, sf), "label")
    return r.select("metric", F.when(F.col("metric") == "anomaly_rate", F.round("value", 6))
                    .otherwise(F.col("value")).alias("value"))


_FLOW_TYPES = [("flow_id", "bigint"), ("ts", "timestamp_ntz"), ("src_ip", "string"), ("dst_ip", "string"),
               ("protocol_type", "string"), ("src_port", "int"), ("dst_port", "int"), ("duration", "double"),
               ("src_bytes", "double"), ("dst_bytes", "double"), ("packet_size", "int"), ("tcp_flags", "int"),
               ("count", "int"), ("srv_count", "int"), ("num_failed_logins", "int"), ("label_raw", "string"),
               ("rf_score", "double"), ("recon_error", "double"), ("lstm_score", "double")]


@register("column_profile", with_gaps(
    "SELECT column_name, dtype, non_null FROM (VALUES "
    + ", ".join(f"('{c}', '{t}')" for c, t in _FLOW_TYPES) + ") v(column_name, dtype) JOIN (UNPIVOT (SELECT "
    + ", ".join(f"CAST(count({q}) AS BIGINT) AS {q}" for q in _GAP_COLS)
    + " FROM gaps) ON COLUMNS(*) INTO NAME column_name VALUE non_null) u USING (column_name)"))
def column_profile(spark, sf):
    return C.column_profile(flows_with_gaps(read_flows(spark, sf)))


@register("preview", with_flows("""
SELECT flow_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text, src_ip, dst_ip, protocol_type
FROM flows ORDER BY ts, flow_id LIMIT 100"""))
def preview(spark, sf):
    p = C.preview(read_flows(spark, sf), ("ts", "flow_id"), 100)
    return p.select("flow_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts_text"), "src_ip", "dst_ip",
                    "protocol_type")


@register("numeric_histogram", with_flows("""
, mm AS (SELECT CAST(min(packet_size) AS DOUBLE) AS lo, CAST(max(packet_size) AS DOUBLE) AS hi FROM flows)
SELECT CAST(b AS INTEGER) AS bin, round(lo + b * (hi - lo) / 10, 6) AS bin_start,
 round(lo + (b + 1) * (hi - lo) / 10, 6) AS bin_end, CAST(count(*) AS BIGINT) AS bin_count
FROM (SELECT CASE WHEN hi = lo THEN 0 ELSE least(floor((packet_size - lo) / ((hi - lo) / 10)), 9) END AS b, lo, hi
      FROM flows, mm) GROUP BY b, lo, hi"""))
def numeric_histogram(spark, sf):
    h = C.numeric_histogram(read_flows(spark, sf), "packet_size", 10)
    return h.select("bin", F.round("bin_start", 6).alias("bin_start"), F.round("bin_end", 6).alias("bin_end"),
                    "bin_count")
