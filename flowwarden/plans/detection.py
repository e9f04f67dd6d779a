"""Batch detection plan: flow rows with per-model scores -> alerts.

The whole plan is projections plus one filter (no shuffle): it runs as one
scan-and-codegen stage per input split, so it scales linearly with the flow
table and needs no tuning beyond the scan split size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.alerts import build_alerts
from ..operators.scoring import detect_anomalies, reconstruction_score

SCORE_COLS = ["rf_score", "recon_score", "lstm_score"]
RECON_THRESHOLD = 110.0
AS_OF = "2024-01-31 00:00:00"


def with_model_scores(flows: DataFrame, recon_threshold: float = RECON_THRESHOLD) -> DataFrame:
    """Turn the reconstruction error into a 0..1 score next to the other model scores."""
    return flows.withColumn("recon_score", reconstruction_score("recon_error", recon_threshold))


def anomalies_from_flows(flows: DataFrame, recon_threshold: float = RECON_THRESHOLD,
                         threshold: float = 0.5, weights: dict | None = None) -> DataFrame:
    return detect_anomalies(with_model_scores(flows, recon_threshold), SCORE_COLS,
                            weights=weights, threshold=threshold)


def alerts_from_flows(flows: DataFrame, recon_threshold: float = RECON_THRESHOLD,
                      threshold: float = 0.5, weights: dict | None = None) -> DataFrame:
    return build_alerts(anomalies_from_flows(flows, recon_threshold, threshold, weights))


def flat_alerts(alerts: DataFrame) -> DataFrame:
    """Alert columns without the nested info, time as text (report form)."""
    return alerts.select("alert_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("alert_time"),
                         "severity", "alert_type", "description", "source_ip", "destination_ip",
                         F.round("confidence", 6).alias("confidence"), "status")
