"""Alert table construction and the alert reports.

Reports are grouped aggregates over the alert table; every `as_of` is an
explicit argument (never the wall clock) so results are reproducible.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import as_ltz
from ..schemas import SEVERITY_LEVELS


def build_alerts(anomalies: DataFrame, key: str = "flow_id", ts: str = "ts") -> DataFrame:
    """Anomaly records -> alerts. The alert id is deterministic
    (ALT_<epoch seconds>_<key>) so a re-scored row yields the same alert."""
    data = F.col("data")
    fields = anomalies.schema["data"].dataType.fieldNames()
    src = F.coalesce(data["src_ip"].cast("string"), F.lit("unknown")) if "src_ip" in fields else F.lit("unknown")
    dst = F.coalesce(data["dst_ip"].cast("string"), F.lit("unknown")) if "dst_ip" in fields else F.lit("unknown")
    typ = F.col("attack_type")
    return anomalies.select(
        F.concat(F.lit("ALT_"), F.unix_seconds(as_ltz(F.col(ts))).cast("string"), F.lit("_"),
                 F.col(key).cast("string")).alias("alert_id"),
        F.col(ts).alias("timestamp"),
        F.col("severity"),
        typ.alias("alert_type"),
        F.concat(F.initcap(F.regexp_replace(typ, "_", " ")), F.lit(" detected from "), src,
                 F.lit(" to "), dst).alias("description"),
        src.alias("source_ip"),
        dst.alias("destination_ip"),
        F.col("anomaly_score").alias("confidence"),
        F.struct(F.col("model_scores"), data.alias("raw_data")).alias("additional_info"),
        F.lit("new").alias("status"),
    )


def _ts_lit(as_of):
    if isinstance(as_of, str):
        return F.to_timestamp(F.lit(as_of))
    if isinstance(as_of, _dt.datetime):
        return F.lit(as_of)
    return as_of


def recent_alerts(alerts: DataFrame, as_of, hours: float = 24, ts: str = "timestamp") -> DataFrame:
    """Alerts with time >= as_of - hours."""
    lo = _ts_lit(as_of) - F.make_interval(secs=F.lit(float(hours) * 3600.0))
    return alerts.where(as_ltz(F.col(ts)) >= lo)


def severity_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s) for i, s in enumerate(SEVERITY_LEVELS)], "level_order int, severity string")


def severity_counts(alerts: DataFrame) -> DataFrame:
    """Counts for all four levels, zero-filled (4-row dimension, broadcast)."""
    counts = alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("alert_count"))
    dim = severity_dimension(alerts.sparkSession)
    return (F.broadcast(dim).join(counts, "severity", "left")
            .select("severity", F.coalesce("alert_count", F.lit(0)).cast("bigint").alias("alert_count")))


def attack_type_counts(alerts: DataFrame, type_col: str = "alert_type") -> DataFrame:
    return (alerts.groupBy(F.col(type_col).alias("alert_type"))
                  .agg(F.count(F.lit(1)).cast("bigint").alias("alert_count"))
                  .orderBy(F.desc("alert_count"), "alert_type"))


def alert_statistics(alerts: DataFrame, as_of, hours: float = 24) -> DataFrame:
    """Last-24h totals, severity distribution (zero-filled) and attack-type
    distribution as one long table (section, name, value). One scan: a
    grouping-sets aggregate, each grouping set projected to its section, and
    the zero rows of the fixed sections added before a final tiny sum."""
    recent = recent_alerts(alerts, as_of, hours)
    g = (recent.groupingSets([[], [F.col("severity")], [F.col("alert_type")]], "severity", "alert_type")
               .agg(F.count(F.lit(1)).cast("bigint").alias("value"), F.grouping_id().alias("_gid")))
    gid = F.col("_gid")
    rows = g.select(F.when(gid == 3, "total_alerts").when(gid == 1, "severity").otherwise("attack_type").alias("section"),
                    F.when(gid == 3, "all").when(gid == 1, F.col("severity")).otherwise(F.col("alert_type")).alias("name"),
                    "value")
    zeros = alerts.sparkSession.createDataFrame(
        [("total_alerts", "all", 0)] + [("severity", lv, 0) for lv in SEVERITY_LEVELS],
        "section string, name string, value bigint")
    return (rows.unionByName(zeros).groupBy("section", "name")
                .agg(F.sum("value").cast("bigint").alias("value")))


def latest_alerts(alerts: DataFrame, k: int = 10, ts: str = "timestamp") -> DataFrame:
    """Newest k alerts (top-k, ties broken by id)."""
    return alerts.orderBy(F.desc(ts), F.desc("alert_id")).limit(k)


def filter_alerts(alerts: DataFrame, severities=None, types=None, since=None, until=None,
                  ts: str = "timestamp") -> DataFrame:
    out = alerts
    if severities is not None:
        out = out.where(F.col("severity").isin(list(severities)))
    if types is not None:
        out = out.where(F.col("alert_type").isin(list(types)))
    if since is not None:
        out = out.where(as_ltz(F.col(ts)) >= _ts_lit(since))
    if until is not None:
        out = out.where(as_ltz(F.col(ts)) <= _ts_lit(until))
    return out


def alert_timeline(alerts: DataFrame, bucket: str = "hour", ts: str = "timestamp") -> DataFrame:
    """Alert counts per time bucket and severity."""
    return (alerts.groupBy(F.date_trunc(bucket, F.col(ts)).alias("bucket"), "severity")
                  .agg(F.count(F.lit(1)).cast("bigint").alias("alert_count")))


def top_endpoints(alerts: DataFrame, col: str = "source_ip", k: int = 10) -> DataFrame:
    """Most frequent source (or destination) addresses in alerts, ties by address."""
    return (alerts.groupBy(F.col(col).alias("ip")).agg(F.count(F.lit(1)).cast("bigint").alias("alert_count"))
                  .orderBy(F.desc("alert_count"), "ip").limit(k))


def confidence_histogram(alerts: DataFrame, bins: int = 20, col: str = "confidence") -> DataFrame:
    """Equal-width bins between min and max confidence (max falls in the last
    bin)."""
    return numeric_histogram(alerts, col, bins)


def numeric_histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width bin counts between min and max (max in the last bin).
    min/max are one aggregate, used as literals in the binning expression."""
    x = F.col(col).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_start double, bin_end double, bin_count bigint")
    lo, hi = float(lo), float(hi)
    width = (hi - lo) / bins
    b = (F.lit(0) if hi == lo else F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))).cast("int")
    return (df.where(x.isNotNull()).groupBy(b.alias("bin"))
              .agg(F.count(F.lit(1)).cast("bigint").alias("bin_count"))
              .select("bin", (F.lit(lo) + F.col("bin") * F.lit(hi - lo) / bins).alias("bin_start"),
                      (F.lit(lo) + (F.col("bin") + 1) * F.lit(hi - lo) / bins).alias("bin_end"), "bin_count"))


def alerts_by_hour(alerts: DataFrame, ts: str = "timestamp") -> DataFrame:
    return alerts.groupBy(F.hour(F.col(ts)).alias("hour")).agg(F.count(F.lit(1)).cast("bigint").alias("alert_count"))


def alerts_by_day(alerts: DataFrame, ts: str = "timestamp") -> DataFrame:
    return alerts.groupBy(F.to_date(F.col(ts)).alias("day")).agg(F.count(F.lit(1)).cast("bigint").alias("alert_count"))


def alert_kpis(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_alerts"),
        F.count(F.when(F.col("severity") == "critical", 1)).cast("bigint").alias("critical_alerts"),
        F.count(F.when(F.col("severity") == "high", 1)).cast("bigint").alias("high_alerts"),
        F.avg("confidence").alias("mean_confidence"))


def alert_intervals(alerts: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Per-type event intervals (start = end = alert time), ordered."""
    return (alerts.select(F.col("alert_type"), F.col(ts).alias("start"), F.col(ts).alias("end"),
                          "alert_id", "severity")
                  .orderBy("alert_type", "start", "alert_id"))


def update_thresholds(config: DataFrame, new: DataFrame) -> DataFrame:
    """Shallow override of (name, value) threshold rows: new values win,
    untouched names keep theirs, new names are added."""
    n = new.select(F.col("name"), F.col("value").alias("_new"))
    return (config.join(n, "name", "full_outer")
                  .select("name", F.coalesce("_new", "value").alias("value")))


def retain_alerts(alerts: DataFrame, as_of, days: int = 30, max_rows: int = 10000,
                  ts: str = "timestamp") -> DataFrame:
    """Age- and count-bounded alert table (newest ``max_rows`` within ``days``)."""
    lo = _ts_lit(as_of) - F.make_interval(days=F.lit(days))
    return (alerts.where(as_ltz(F.col(ts)) >= lo)
                  .orderBy(F.desc(ts), F.desc("alert_id")).limit(max_rows))
