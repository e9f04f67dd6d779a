"""Time-window traffic statistics and windowed attack detectors.

All are ``groupBy(window(ts, size[, slide]), key...)`` aggregates: partial
aggregation per task, one shuffle of (window, key) groups. Thresholds and
window sizes default to the declared detector configuration and are
parameters. Distinct counts use ``size(collect_set)`` so the same code is
valid in streaming (exact distinct aggregation is not supported there); the
set per (window, source) is bounded by the 65,536 possible ports.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import as_ltz
from ..schemas import TRAFFIC_WINDOWS, WINDOW_PATTERNS


def _time(df: DataFrame, ts: str) -> Column:
    """Event time for windows; a TIMESTAMP column as it is, with its watermark."""
    return F.col(ts) if df.schema[ts].dataType == T.TimestampType() else as_ltz(F.col(ts))


def _secs(n):
    return f"{int(n)} seconds"


def event_time(df: DataFrame, ts: str = "ts", out: str = "event_time") -> DataFrame:
    """Session-zone TIMESTAMP event time (watermarks refuse TIMESTAMP_NTZ)."""
    return df.withColumn(out, as_ltz(F.col(ts)))


def traffic_per_minute(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows per 1-minute bin (non-empty bins; streaming-safe)."""
    return (df.groupBy(F.window(as_ltz(F.col(ts)), "1 minute").alias("w"))
              .agg(F.count(F.lit(1)).cast("bigint").alias("flows"))
              .select(F.col("w.start").alias("minute"), "flows"))


def traffic_per_minute_filled(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Batch form with empty minutes as 0: the minute axis is a distributed
    ``spark.range`` between the first and last minute (its size is the span
    of the data in minutes), left-joined to the non-empty counts."""
    spark: SparkSession = df.sparkSession
    counts = traffic_per_minute(df, ts)
    b = counts.agg(F.min(F.unix_seconds("minute")).alias("lo"), F.max(F.unix_seconds("minute")).alias("hi")).first()
    if b["lo"] is None:
        return counts
    axis = spark.range(b["lo"] // 60, b["hi"] // 60 + 1).select(F.timestamp_seconds(F.col("id") * 60).alias("minute"))
    return axis.join(counts, "minute", "left").select("minute", F.coalesce("flows", F.lit(0)).cast("bigint").alias("flows"))


def packets_per_second(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows per 1-second tumbling window (non-empty seconds)."""
    return (df.groupBy(F.window(as_ltz(F.col(ts)), "1 second").alias("w"))
              .agg(F.count(F.lit(1)).cast("bigint").alias("packets"))
              .select(F.col("w.start").alias("second"), "packets"))


def packets_in_last_second(df: DataFrame, as_of, ts: str = "ts") -> DataFrame:
    t = as_ltz(F.col(ts))
    a = F.to_timestamp(F.lit(as_of)) if isinstance(as_of, str) else as_of
    return df.where((t > a - F.expr("INTERVAL 1 SECOND")) & (t <= a)).agg(
        F.count(F.lit(1)).cast("bigint").alias("packets"))


def traffic_windows(df: DataFrame, ts: str = "ts", windows: dict | None = None, bytes_cols=("src_bytes", "dst_bytes"),
                    slide: dict | None = None) -> DataFrame:
    """Flows and bytes per tumbling (or sliding) window for each named size. In a
    batch, windows are rolled up from the largest smaller tumbling ones that divide
    their size and slide: the rows are read and shuffled once, for the smallest."""
    windows = windows or TRAFFIC_WINDOWS
    slide = slide or {}
    seconds = lambda size: pd.Timedelta(size).total_seconds()
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in bytes_cols), F.lit(0.0))
    rows = df.select(as_ltz(F.col(ts)).alias("_at"), F.lit(1).cast("bigint").alias("flows"), total.alias("total_bytes"))
    made, parts = {}, []
    for name, size in sorted(windows.items(), key=lambda w: seconds(w[1])):
        step = slide.get(name, size)
        base = [n for n in made if not seconds(size) % seconds(windows[n]) and not seconds(step) % seconds(windows[n])] if not df.isStreaming else []
        source = made[base[-1]].select(F.col("window_start").alias("_at"), "flows", "total_bytes") if base else rows
        part = (source.groupBy(F.window("_at", size, step).alias("w")).agg(F.sum("flows").alias("flows"), F.sum("total_bytes").alias("total_bytes"))
                .select(F.lit(name).alias("window_name"), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "flows", "total_bytes"))
        if step == size:
            made[name] = part
        parts.append(part)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _given(config: dict, **values) -> list:
    """Each value, or the configured one where it is None (0 is a value)."""
    return [config[k] if v is None else v for k, v in values.items()]


def port_bitmap_count(port: str) -> Column:
    """Distinct ports as an aggregate whose state is two bitmaps of 32,768 bits,
    however many ports there are; what is no port counts as missing."""
    half = 1 << 15
    at = F.col(port).cast("long")
    low, high = F.when(at.between(0, half - 1), at), F.when(at.between(half, 2 * half - 1), at - half)
    return (F.bitmap_count(F.bitmap_construct_agg(low)) + F.bitmap_count(F.bitmap_construct_agg(high))).cast("int")


def port_scan_windows(df: DataFrame, ts: str = "ts", window: int | None = None, unique_ports: int | None = None,
                      packets: int | None = None, bitmap: bool = False) -> DataFrame:
    """Per source and window: packets, distinct destination ports, and the
    port-scan flag (distinct ports > threshold and packets >= minimum). With
    ``bitmap`` the ports are kept as a bitmap of fixed size instead of a growing
    set, as streams want it."""
    c = WINDOW_PATTERNS["port_scan"]
    window, unique_ports, packets = _given(c, window=window, unique_ports=unique_ports, packets=packets)
    g = df.groupBy("src_ip", F.window(_time(df, ts), _secs(window)).alias("w")).agg(
        F.count(F.lit(1)).cast("bigint").alias("packets"),
        (port_bitmap_count("dst_port") if bitmap else F.size(F.collect_set("dst_port"))).alias("unique_ports"))
    return g.select("src_ip", F.col("w.start").alias("window_start"), "packets", "unique_ports",
                    ((F.col("unique_ports") > unique_ports) & (F.col("packets") >= packets)).alias("is_port_scan"))


def dos_windows(df: DataFrame, ts: str = "ts", window: int | None = None, packets: int | None = None,
                rate: float | None = None) -> DataFrame:
    """Per destination and window: packets, packets per second, DoS flag."""
    c = WINDOW_PATTERNS["dos_attack"]
    window, packets, rate = _given(c, window=window, packets=packets, rate=rate)
    g = df.groupBy("dst_ip", F.window(_time(df, ts), _secs(window)).alias("w")).agg(
        F.count(F.lit(1)).cast("bigint").alias("packets"))
    r = F.col("packets") / F.lit(float(window))
    return g.select("dst_ip", F.col("w.start").alias("window_start"), "packets", r.alias("rate"),
                    ((F.col("packets") > packets) & (r >= rate)).alias("is_dos"))


def brute_force_windows(df: DataFrame, ts: str = "ts", window: int | None = None, attempts: int | None = None,
                        ports=None) -> DataFrame:
    """Per (source, destination) and window, on login ports: attempts and flag."""
    c = WINDOW_PATTERNS["brute_force"]
    window, attempts, ports = _given(c, window=window, attempts=attempts, ports=ports)
    g = (df.where(F.col("dst_port").isin(list(ports)))
           .groupBy("src_ip", "dst_ip", F.window(_time(df, ts), _secs(window)).alias("w"))
           .agg(F.count(F.lit(1)).cast("bigint").alias("attempts")))
    return g.select("src_ip", "dst_ip", F.col("w.start").alias("window_start"), "attempts",
                    (F.col("attempts") > attempts).alias("is_brute_force"))


def exfiltration_windows(df: DataFrame, ts: str = "ts", window: int | None = None, bytes_threshold: float | None = None,
                         ratio: float | None = None) -> DataFrame:
    """Per source and window: bytes out, bytes in, in/out ratio and the flag
    (bytes out > threshold and in/out < ratio)."""
    c = WINDOW_PATTERNS["data_exfiltration"]
    window, bytes_threshold, ratio = _given(c, window=window, bytes=bytes_threshold, ratio=ratio)
    g = df.groupBy("src_ip", F.window(_time(df, ts), _secs(window)).alias("w")).agg(
        F.sum("src_bytes").alias("bytes_out"), F.sum("dst_bytes").alias("bytes_in"))
    r = F.when(F.col("bytes_out") > 0, F.col("bytes_in") / F.col("bytes_out"))
    return g.select("src_ip", F.col("w.start").alias("window_start"), "bytes_out", "bytes_in", r.alias("in_out_ratio"),
                    F.coalesce((F.col("bytes_out") > bytes_threshold) & (r < ratio), F.lit(False)).alias("is_exfiltration"))


def running_totals(scored: DataFrame) -> DataFrame:
    """Flows seen, anomalies and alerts so far (a global aggregate; in
    streaming run it in complete mode)."""
    return scored.agg(F.count(F.lit(1)).cast("bigint").alias("total_flows"),
                      F.sum(F.col("prediction").cast("long")).alias("anomalies_detected"),
                      F.sum(F.col("prediction").cast("long")).alias("alerts_generated"))


def latest_rows(df: DataFrame, n: int = 20, ts: str = "ts", key: str = "flow_id") -> DataFrame:
    """Newest n rows of a landed table (top-k)."""
    return df.orderBy(F.desc(ts), F.desc(key)).limit(n)
