"""Row-level threat rules and the first-match attack classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import RULE_DEFAULTS

__all__ = ["rule_columns", "attack_type", "ATTACK_TYPES"]

ATTACK_TYPES = ["port_scan", "dos_attack", "brute_force", "data_exfiltration", "unknown_anomaly"]


def _get(df: DataFrame, name: str) -> Column:
    # an absent column reads as 0; a null value makes the comparison false
    return F.col(f"`{name}`") if name in df.columns else F.lit(0)


def rule_columns(df: DataFrame, params: dict | None = None) -> dict[str, Column]:
    p = dict(RULE_DEFAULTS)
    p.update(params or {})
    g = lambda n: _get(df, n)
    port_scan = (F.lit("dst_port" in df.columns and "count" in df.columns)
                 & (g("count") > p["port_scan_count"]) & (g("srv_count") < p["port_scan_srv_count"]))
    dos = (g("count") > p["dos_count"]) & (g("duration") < p["dos_duration"])
    brute = g("num_failed_logins") > p["brute_force_failed_logins"]
    total = g("src_bytes") + g("dst_bytes")
    exfil = (total > p["exfil_total_bytes"]) & (g("dst_bytes") > g("src_bytes"))
    return {name: F.coalesce(cond, F.lit(False)) for name, cond in
            zip(ATTACK_TYPES[:4], [port_scan, dos, brute, exfil])}


def attack_type(df: DataFrame, params: dict | None = None) -> Column:
    """First matching rule in the order port_scan, dos_attack, brute_force,
    data_exfiltration; otherwise unknown_anomaly."""
    r = rule_columns(df, params)
    expr = F.when(r["port_scan"], "port_scan")
    for name in ATTACK_TYPES[1:4]:
        expr = expr.when(r[name], name)
    return expr.otherwise("unknown_anomaly")
