"""Catalog: scoring (H), threat rules (I) and alert reports (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import attack_type, rule_columns
from ..functions.scalars import severity
from ..operators import alerts as A
from ..operators import scoring as S
from ..oracle import ATTACK_SQL, AS_OF, severity_sql, with_alerts, with_flows, with_scored
from ..sources.tables import read_flows
from ..schemas import ALERT_MAX_ROWS, ALERT_RETENTION_DAYS
from .catalog import register
from .detection import (AS_OF as AS_OF_TEXT, SCORE_COLS, alerts_from_flows, flat_alerts,
                        with_model_scores)


def _alerts(spark, sf):
    return alerts_from_flows(read_flows(spark, sf))


def _r6(c):
    return F.round(c, 6)


# --- I: threat rules ---------------------------------------------------------

@register("threat_rules", with_flows(f"""
SELECT flow_id,
 COALESCE("count" > 20 AND srv_count < 5, false) AS port_scan,
 COALESCE("count" > 100 AND duration < 1, false) AS dos_attack,
 COALESCE(num_failed_logins > 5, false) AS brute_force,
 COALESCE(src_bytes + dst_bytes > 10000 AND dst_bytes > src_bytes, false) AS data_exfiltration,
 {ATTACK_SQL} AS attack_type
FROM flows"""))
def threat_rules(spark, sf):
    f = read_flows(spark, sf)
    r = rule_columns(f)
    return f.select("flow_id", *[v.alias(k) for k, v in r.items()], attack_type(f).alias("attack_type"))


@register("attack_type_distribution", with_flows(f"""
SELECT {ATTACK_SQL} AS attack_type, CAST(count(*) AS BIGINT) AS flow_count FROM flows GROUP BY 1"""))
def attack_type_distribution(spark, sf):
    f = read_flows(spark, sf)
    return f.groupBy(attack_type(f).alias("attack_type")).agg(F.count(F.lit(1)).cast("bigint").alias("flow_count"))


# --- H: scoring ---------------------------------------------------------------

@register("ensemble_scores", with_scored(f"""
SELECT flow_id, round(recon_score, 6) AS recon_score,
 round((rf_score + recon_score + lstm_score) / 3.0, 6) AS anomaly_score,
 CAST((rf_score + recon_score + lstm_score) / 3.0 > 0.5 AS INTEGER) AS prediction,
 {severity_sql('(rf_score + recon_score + lstm_score) / 3.0')} AS severity
FROM scored"""))
def ensemble_scores(spark, sf):
    s = S.anomaly_scores(with_model_scores(read_flows(spark, sf)), SCORE_COLS)
    return s.select("flow_id", _r6(F.col("recon_score")).alias("recon_score"),
                    _r6(F.col("anomaly_score")).alias("anomaly_score"), "prediction", "severity")


@register("severity_distribution", with_scored(f"""
SELECT {severity_sql('(rf_score + recon_score + lstm_score) / 3.0')} AS severity, CAST(count(*) AS BIGINT) AS flow_count
FROM scored GROUP BY 1"""))
def severity_distribution(spark, sf):
    s = S.anomaly_scores(with_model_scores(read_flows(spark, sf)), SCORE_COLS)
    return s.groupBy("severity").agg(F.count(F.lit(1)).cast("bigint").alias("flow_count"))


WEIGHTS = {"rf_score": 0.5, "recon_score": 0.3, "lstm_score": 0.2}


@register("ensemble_weighted", with_scored("""
SELECT flow_id, round(rf_score * 0.5 + recon_score * 0.3 + lstm_score * 0.2, 6) AS weighted_score FROM scored"""))
def ensemble_weighted(spark, sf):
    s = with_model_scores(read_flows(spark, sf))
    return s.select("flow_id", _r6(S.ensemble_weighted(SCORE_COLS, WEIGHTS)).alias("weighted_score"))


@register("ensemble_vote", with_scored("""
SELECT flow_id, CAST((CAST(rf_score > 0.5 AS INTEGER) + CAST(recon_error > 110.0 AS INTEGER)
  + CAST(lstm_score > 0.5 AS INTEGER)) / 3.0 > 0.5 AS INTEGER) AS vote FROM scored"""))
def ensemble_vote(spark, sf):
    s = with_model_scores(read_flows(spark, sf))
    s = s.withColumns({"rf_flag": (F.col("rf_score") > 0.5).cast("int"),
                       "recon_flag": (F.col("recon_error") > 110.0).cast("int"),
                       "lstm_flag": (F.col("lstm_score") > 0.5).cast("int")})
    return s.select("flow_id", S.ensemble_vote(["rf_flag", "recon_flag", "lstm_flag"]).alias("vote"))


@register("recon_maxnorm", with_flows("""
SELECT flow_id, round(recon_error / max(recon_error) OVER (), 6) AS recon_score,
 CAST(recon_error > 110.0 AS INTEGER) AS recon_flag FROM flows"""))
def recon_maxnorm(spark, sf):
    f = S.reconstruction_score_maxnorm(read_flows(spark, sf), "recon_error", 110.0)
    return f.select("flow_id", _r6(F.col("recon_score")).alias("recon_score"), "recon_flag")


@register("detect_anomalies", with_scored(f"""
SELECT flow_id, round(anomaly_score, 6) AS anomaly_score, severity, attack_type,
 round(rf_score, 6) AS rf_score, round(recon_score, 6) AS recon_score, round(lstm_score, 6) AS lstm_score
FROM (SELECT *, {severity_sql('anomaly_score')} AS severity, {ATTACK_SQL} AS attack_type
      FROM (SELECT *, (rf_score + recon_score + lstm_score) / 3.0 AS anomaly_score FROM scored))
WHERE anomaly_score > 0.5"""))
def detect_anomalies_q(spark, sf):
    from .detection import anomalies_from_flows
    a = anomalies_from_flows(read_flows(spark, sf))
    ms = F.col("model_scores")
    return a.select("flow_id", _r6(F.col("anomaly_score")).alias("anomaly_score"), "severity", "attack_type",
                    *[_r6(ms[c]).alias(c) for c in SCORE_COLS])


# --- J: alerts and reports ------------------------------------------------------

@register("alerts_per_attack_type", with_alerts("""
SELECT alert_type, CAST(count(*) AS BIGINT) AS alert_count FROM alerts GROUP BY 1"""))
def alerts_per_attack_type(spark, sf):
    return A.attack_type_counts(_alerts(spark, sf))


@register("build_alerts", with_alerts("""
SELECT alert_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') AS alert_time, severity, alert_type, description,
 source_ip, destination_ip, round(confidence, 6) AS confidence, status FROM alerts"""))
def build_alerts_q(spark, sf):
    return flat_alerts(_alerts(spark, sf))


@register("recent_alerts", with_alerts(f"""
SELECT alert_id, severity, alert_type FROM alerts WHERE "timestamp" >= {AS_OF} - INTERVAL 24 HOUR"""))
def recent_alerts_q(spark, sf):
    return A.recent_alerts(_alerts(spark, sf), AS_OF_TEXT, 24).select("alert_id", "severity", "alert_type")


@register("alert_statistics", with_alerts(f"""
, recent AS (SELECT * FROM alerts WHERE "timestamp" >= {AS_OF} - INTERVAL 24 HOUR)
SELECT 'total_alerts' AS section, 'all' AS name, CAST(count(*) AS BIGINT) AS value FROM recent
UNION ALL
SELECT 'severity', l.severity, CAST(count(r.alert_id) AS BIGINT)
FROM (VALUES ('low'), ('medium'), ('high'), ('critical')) l(severity) LEFT JOIN recent r ON r.severity = l.severity
GROUP BY l.severity
UNION ALL
SELECT 'attack_type', alert_type, CAST(count(*) AS BIGINT) FROM recent GROUP BY alert_type"""))
def alert_statistics_q(spark, sf):
    return A.alert_statistics(_alerts(spark, sf), AS_OF_TEXT, 24)


@register("severity_counts", with_alerts("""
SELECT l.severity, CAST(count(a.alert_id) AS BIGINT) AS alert_count
FROM (VALUES ('low'), ('medium'), ('high'), ('critical')) l(severity) LEFT JOIN alerts a ON a.severity = l.severity
GROUP BY l.severity"""))
def severity_counts_q(spark, sf):
    return A.severity_counts(_alerts(spark, sf))


@register("latest_alerts", with_alerts("""
SELECT alert_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') AS alert_time, severity, alert_type
FROM alerts ORDER BY "timestamp" DESC, alert_id DESC LIMIT 10"""))
def latest_alerts_q(spark, sf):
    a = A.latest_alerts(_alerts(spark, sf), 10)
    return a.select("alert_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("alert_time"),
                    "severity", "alert_type")


@register("filter_alerts", with_alerts("""
SELECT alert_id, severity, alert_type FROM alerts
WHERE severity IN ('high', 'critical') AND alert_type IN ('port_scan', 'dos_attack', 'unknown_anomaly')
  AND "timestamp" >= TIMESTAMP '2024-01-10 00:00:00' AND "timestamp" <= TIMESTAMP '2024-01-20 00:00:00'"""))
def filter_alerts_q(spark, sf):
    a = A.filter_alerts(_alerts(spark, sf), ["high", "critical"], ["port_scan", "dos_attack", "unknown_anomaly"],
                        since="2024-01-10 00:00:00", until="2024-01-20 00:00:00")
    return a.select("alert_id", "severity", "alert_type")


@register("alert_timeline", with_alerts("""
SELECT strftime(date_trunc('hour', "timestamp"), '%Y-%m-%d %H:%M:%S') AS bucket, severity,
 CAST(count(*) AS BIGINT) AS alert_count FROM alerts GROUP BY 1, 2"""))
def alert_timeline_q(spark, sf):
    t = A.alert_timeline(_alerts(spark, sf), "hour")
    return t.select(F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "severity", "alert_count")


@register("top_sources", with_alerts("""
SELECT source_ip AS ip, CAST(count(*) AS BIGINT) AS alert_count FROM alerts GROUP BY 1
ORDER BY alert_count DESC, ip LIMIT 10"""))
def top_sources(spark, sf):
    return A.top_endpoints(_alerts(spark, sf), "source_ip", 10)


@register("top_targets", with_alerts("""
SELECT destination_ip AS ip, CAST(count(*) AS BIGINT) AS alert_count FROM alerts GROUP BY 1
ORDER BY alert_count DESC, ip LIMIT 10"""))
def top_targets(spark, sf):
    return A.top_endpoints(_alerts(spark, sf), "destination_ip", 10)


@register("confidence_histogram", with_alerts("""
, mm AS (SELECT min(confidence) AS lo, max(confidence) AS hi FROM alerts)
SELECT CAST(b AS INTEGER) AS bin, round(lo + b * (hi - lo) / 20, 6) AS bin_start,
 round(lo + (b + 1) * (hi - lo) / 20, 6) AS bin_end, CAST(count(*) AS BIGINT) AS bin_count
FROM (SELECT CASE WHEN hi = lo THEN 0 ELSE least(floor((confidence - lo) / ((hi - lo) / 20)), 19) END AS b, lo, hi
      FROM alerts, mm)
GROUP BY b, lo, hi"""))
def confidence_histogram_q(spark, sf):
    h = A.confidence_histogram(_alerts(spark, sf), 20)
    return h.select("bin", _r6(F.col("bin_start")).alias("bin_start"), _r6(F.col("bin_end")).alias("bin_end"),
                    "bin_count")


@register("alerts_by_hour", with_alerts("""
SELECT CAST(hour("timestamp") AS INTEGER) AS hour, CAST(count(*) AS BIGINT) AS alert_count FROM alerts GROUP BY 1"""))
def alerts_by_hour_q(spark, sf):
    return A.alerts_by_hour(_alerts(spark, sf))


@register("alerts_by_day", with_alerts("""
SELECT CAST("timestamp" AS DATE) AS day, CAST(count(*) AS BIGINT) AS alert_count FROM alerts GROUP BY 1"""))
def alerts_by_day_q(spark, sf):
    return A.alerts_by_day(_alerts(spark, sf))


@register("alert_kpis", with_alerts("""
SELECT CAST(count(*) AS BIGINT) AS total_alerts,
 CAST(count(*) FILTER (WHERE severity = 'critical') AS BIGINT) AS critical_alerts,
 CAST(count(*) FILTER (WHERE severity = 'high') AS BIGINT) AS high_alerts,
 round(avg(confidence), 6) AS mean_confidence FROM alerts"""))
def alert_kpis_q(spark, sf):
    k = A.alert_kpis(_alerts(spark, sf))
    return k.withColumn("mean_confidence", _r6(F.col("mean_confidence")))


@register("alert_intervals", with_alerts("""
SELECT alert_type, strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') AS "start",
 strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') AS "end", alert_id, severity FROM alerts"""))
def alert_intervals_q(spark, sf):
    a = A.alert_intervals(_alerts(spark, sf))
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return a.select("alert_type", F.date_format("start", fmt).alias("start"), F.date_format("end", fmt).alias("end"),
                    "alert_id", "severity")


@register("retain_alerts", with_alerts(f"""
SELECT alert_id, severity FROM alerts WHERE "timestamp" >= {AS_OF} - INTERVAL 30 DAY
ORDER BY "timestamp" DESC, alert_id DESC LIMIT {ALERT_MAX_ROWS}"""))
def retain_alerts_q(spark, sf):
    return A.retain_alerts(_alerts(spark, sf), AS_OF_TEXT, days=ALERT_RETENTION_DAYS, max_rows=ALERT_MAX_ROWS).select("alert_id", "severity")


@register("update_thresholds", with_alerts("""
, cfg AS (SELECT * FROM (VALUES ('critical', 0.9), ('high', 0.7), ('medium', 0.5), ('low', 0.3)) t(name, value)),
new AS (SELECT * FROM (VALUES ('high', 0.65), ('medium', 0.55)) t(name, value)),
th AS (SELECT COALESCE(n.name, c.name) AS name, COALESCE(n.value, c.value) AS value
       FROM cfg c FULL OUTER JOIN new n ON c.name = n.name),
p AS (SELECT max(value) FILTER (WHERE name = 'critical') AS crit, max(value) FILTER (WHERE name = 'high') AS hi,
             max(value) FILTER (WHERE name = 'medium') AS med FROM th)
SELECT CASE WHEN confidence >= crit THEN 'critical' WHEN confidence >= hi THEN 'high'
            WHEN confidence >= med THEN 'medium' ELSE 'low' END AS severity, CAST(count(*) AS BIGINT) AS alert_count
FROM alerts, p GROUP BY 1"""))
def update_thresholds_q(spark, sf):
    cfg = spark.createDataFrame([("critical", 0.9), ("high", 0.7), ("medium", 0.5), ("low", 0.3)], "name string, value double")
    new = spark.createDataFrame([("high", 0.65), ("medium", 0.55)], "name string, value double")
    th = A.update_thresholds(cfg, new)
    # the threshold table is bounded (one row per level): its values feed the
    # severity expression as literals
    t = {r["name"]: r["value"] for r in th.collect()}
    c = F.col("confidence")
    sev = (F.when(c >= t["critical"], "critical").when(c >= t["high"], "high")
           .when(c >= t["medium"], "medium").otherwise("low"))
    return _alerts(spark, sf).groupBy(sev.alias("severity")).agg(F.count(F.lit(1)).cast("bigint").alias("alert_count"))
