"""Derived flow columns (projections only: no shuffle, one codegen stage).

Each block is added only when its input columns exist, so the same call works
on connection tables, packet tables and live flow records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import epoch_to_timestamp


def _has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def q(name: str):
    return F.col(f"`{name}`")


def packet_size_features(df: DataFrame) -> dict:
    if not _has(df, "packet_size"):
        return {}
    x = q("packet_size")
    return {"packet_size_log": F.log1p(x.cast("double")),
            "packet_size_squared": x.cast("bigint") * x.cast("bigint")}


def byte_features(df: DataFrame) -> dict:
    if not _has(df, "src_bytes", "dst_bytes"):
        return {}
    s, d = q("src_bytes").cast("double"), q("dst_bytes").cast("double")
    total = s + d
    out = {"total_bytes": total,
           "byte_ratio": F.when(d > 0, s / d).otherwise(s)}
    if _has(df, "duration"):
        dur = q("duration").cast("double")
        out["bytes_per_second"] = F.when(dur > 0, total / dur).otherwise(total)
    return out


def service_ratio(df: DataFrame) -> dict:
    if not _has(df, "count", "srv_count"):
        return {}
    c, s = q("count").cast("double"), q("srv_count").cast("double")
    return {"srv_ratio": F.when(c > 0, s / c).otherwise(F.lit(0.0))}


def port_features(df: DataFrame) -> dict:
    if not _has(df, "src_port", "dst_port"):
        return {}
    s, d = q("src_port"), q("dst_port")
    return {"is_well_known_src_port": (s <= 1024).cast("int"),
            "is_well_known_dst_port": (d <= 1024).cast("int"),
            "port_diff": F.abs(s.cast("bigint") - d.cast("bigint"))}


def protocol_flags(df: DataFrame) -> dict:
    if not _has(df, "protocol_type"):
        return {}
    p = q("protocol_type")
    return {f"is_{n}": F.coalesce((p == n).cast("int"), F.lit(0)) for n in ("tcp", "udp", "icmp")}


def _event_time(df: DataFrame, time_col: str | None):
    col = time_col or ("timestamp" if "timestamp" in df.columns else "ts" if "ts" in df.columns else None)
    if col is None or col not in df.columns:
        return None
    dt = df.schema[col].dataType
    return epoch_to_timestamp(q(col)) if isinstance(dt, T.NumericType) else q(col).cast("timestamp")


def time_features(df: DataFrame, time_col: str | None = None) -> dict:
    ts = _event_time(df, time_col)
    if ts is None:
        return {}
    dow = F.weekday(ts)  # Monday = 0
    return {"hour": F.hour(ts), "day_of_week": dow, "is_weekend": (dow >= 5).cast("int")}


def tcp_flag_bits(df: DataFrame) -> dict:
    if not _has(df, "tcp_flags"):
        return {}
    f = q("tcp_flags").cast("bigint")
    bits = {"has_syn": 2, "has_ack": 16, "has_fin": 1, "has_rst": 4}
    return {k: F.coalesce((f.bitwiseAND(b) > 0).cast("int"), F.lit(0)) for k, b in bits.items()}


def extract_network_features(df: DataFrame, time_col: str | None = None) -> DataFrame:
    """All derived flow columns in one projection."""
    cols = {}
    for block in (packet_size_features, byte_features, service_ratio, port_features,
                  protocol_flags):
        cols.update(block(df))
    cols.update(time_features(df, time_col))
    cols.update(tcp_flag_bits(df))
    return df.withColumns(cols)


def numeric_columns(df: DataFrame, exclude=("label",)) -> list[str]:
    """Numeric (not boolean) columns in schema order, minus ``exclude``."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=("label",)) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def feature_interactions(df: DataFrame, max_interactions: int = 10, top_n: int = 5,
                         exclude=("label",)) -> DataFrame:
    """Products and guarded ratios of the first ``top_n`` numeric columns,
    pairs (i < j) in column order, two columns per pair, stopping once
    ``max_interactions`` columns exist."""
    cols = numeric_columns(df, exclude)[:top_n]
    if len(cols) < 2:
        return df
    new, n = {}, 0
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            if n >= max_interactions:
                break
            x, y = q(a).cast("double"), q(b).cast("double")
            new[f"{a}_x_{b}"] = x * y
            new[f"{a}_div_{b}"] = F.when(y != 0, x / y).otherwise(F.lit(0.0))
            n += 2
        if n >= max_interactions:
            break
    return df.withColumns(new)
