"""Small group aggregates: Shannon entropy and per-metric summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entropy_by_group(df: DataFrame, group, value: str, out: str = "entropy") -> DataFrame:
    """Shannon entropy (log2) of ``value`` within each group.

    Two aggregations: counts per (group, value) are combined map-side, so a
    hot group only ships its distinct values, never its rows; the second
    aggregate uses H = log2(n) - sum(c log2 c) / n.
    """
    group = [group] if isinstance(group, str) else list(group)
    c = df.groupBy(*group, value).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    g = c.groupBy(*group).agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.log2("_c")).alias("_s"))
    return g.select(*group, F.when(F.col("_n") > 0, F.log2("_n") - F.col("_s") / F.col("_n"))
                    .otherwise(F.lit(0.0)).alias(out), F.col("_n").cast("bigint").alias("flow_count"))


def metric_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Per metric name: count, mean, min, max (wide -> long with unpivot, then
    one grouped aggregate)."""
    long = df.unpivot([], metrics, "name", "value")
    return long.groupBy("name").agg(F.count("value").cast("bigint").alias("n"), F.avg("value").alias("mean"),
                                    F.min("value").alias("min_value"), F.max("value").alias("max_value"))
