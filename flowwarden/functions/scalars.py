"""Scalar column functions: IPs, labels, units, time, ports, severity.

Each function returns a ``Column`` built only from Spark built-ins, so the
expressions stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import (HIGH_RISK_PROTOCOLS, LABEL_MAP, MEDIUM_RISK_PROTOCOLS,
                       SEVERITY_THRESHOLDS, SUSPICIOUS_PORTS, UNKNOWN_LABEL)

__all__ = [
    "col_", "safe_divide", "ip_parts", "ip_to_int", "normalize_ip", "is_private_ip",
    "bytes_to_mb", "mb_to_bytes", "format_number_", "format_timestamp",
    "epoch_to_timestamp", "timestamp_to_epoch", "as_ltz", "time_ago",
    "is_suspicious_port", "protocol_risk", "standardize_label", "severity",
    "clip01", "finite", "strip_ws", "round_half_up",
]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """The value as a double, or null when it is null, NaN or infinite."""
    x = col_(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def safe_divide(a, b, default: float = 0.0) -> Column:
    """a / b, or ``default`` when b is 0 or null (the division is guarded, so
    ANSI mode never sees a zero divisor)."""
    a, b = col_(a), col_(b)
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def strip_ws(c) -> Column:
    """Trim all leading/trailing whitespace (tabs and newlines too)."""
    return F.regexp_replace(col_(c), r"^\s+|\s+$", "")


def ip_parts(c) -> Column:
    """Dotted-quad split into an array of 4 BIGINTs, or null when the string
    does not have exactly four integer parts."""
    parts = F.split(col_(c), r"\.", -1)
    nums = F.transform(parts, lambda p: p.try_cast("bigint"))
    ok = (F.size(parts) == 4) & F.forall(nums, lambda x: x.isNotNull())
    return F.when(ok, nums)


def ip_to_int(c) -> Column:
    """Dotted quad -> integer (octet ranges unchecked); null, 0.0.0.0,
    wrong part count and non-numeric parts give 0."""
    p = ip_parts(c)
    val = (p[0] * 16777216 + p[1] * 65536 + p[2] * 256 + p[3])
    return F.coalesce(F.when(col_(c) != "0.0.0.0", val), F.lit(0).cast("bigint"))


def normalize_ip(c) -> Column:
    """Strip leading zeros of the four parts; anything not a 4-part integer
    address is returned unchanged."""
    p = ip_parts(c)
    norm = F.concat_ws(".", F.transform(p, lambda x: x.cast("string")))
    return F.when(p.isNotNull(), norm).otherwise(col_(c))


def is_private_ip(c) -> Column:
    p = ip_parts(c)
    priv = ((p[0] == 10) | ((p[0] == 172) & p[1].between(16, 31)) |
            ((p[0] == 192) & (p[1] == 168)))
    return F.coalesce(priv, F.lit(False))


def bytes_to_mb(c) -> Column:
    return col_(c).cast("double") / F.lit(1048576.0)


def mb_to_bytes(c) -> Column:
    return (col_(c).cast("double") * F.lit(1048576.0)).cast("bigint")


def format_number_(c, precision: int = 2, integral: bool = False) -> Column:
    """Thousands separators; integers without decimals."""
    return F.format_number(col_(c), 0 if integral else precision)


def format_timestamp(c, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(col_(c), fmt)


def as_ltz(c) -> Column:
    """Any timestamp (NTZ included) as a session-zone TIMESTAMP; the session
    zone is pinned to UTC."""
    return col_(c).cast("timestamp")


def epoch_to_timestamp(c) -> Column:
    """Epoch seconds (fractional allowed) -> TIMESTAMP; invalid -> null."""
    return F.timestamp_micros((col_(c).try_cast("double") * 1e6).try_cast("bigint"))


def timestamp_to_epoch(c) -> Column:
    return F.unix_micros(as_ltz(c)) / F.lit(1e6)


def time_ago(ts, as_of) -> Column:
    """Human-readable age: days if at least one day, else hours if more than
    3600 s, minutes if more than 60 s, else seconds (plural 's' unless 1)."""
    us = F.unix_micros(as_ltz(col_(as_of))) - F.unix_micros(as_ltz(col_(ts)))
    day_us = F.lit(86400 * 1_000_000)
    rem = F.pmod(us, day_us)
    days = ((us - rem) / day_us).cast("bigint")
    secs = (rem / F.lit(1_000_000)).cast("bigint")

    def unit(n, name):
        return F.concat(n.cast("string"), F.lit(" " + name),
                        F.when(n != 1, F.lit("s")).otherwise(F.lit("")), F.lit(" ago"))

    return (F.when(days > 0, unit(days, "day"))
            .when(secs > 3600, unit(F.floor(secs / 3600), "hour"))
            .when(secs > 60, unit(F.floor(secs / 60), "minute"))
            .otherwise(unit(secs, "second")))


def is_suspicious_port(c, ports=None) -> Column:
    return F.coalesce(col_(c).isin(list(ports or SUSPICIOUS_PORTS)), F.lit(False))


def protocol_risk(c) -> Column:
    p = F.lower(col_(c))
    return (F.when(p.isin(HIGH_RISK_PROTOCOLS), "high")
            .when(p.isin(MEDIUM_RISK_PROTOCOLS), "medium").otherwise("low"))


def standardize_label(c, numeric: bool = False, label_map: dict | None = None) -> Column:
    """Raw label -> 0/1. Strings are lower-cased and trimmed and looked up in
    the label map; unknown or null strings are attacks (1). Numeric labels keep
    0 as 0 and everything else (null included) becomes 1."""
    c = col_(c)
    if numeric:
        return F.when(c == 0, 0).otherwise(1).cast("int")
    m = label_map or LABEL_MAP
    key = F.lower(strip_ws(c))
    # one set-membership test per output value (``isin`` over more than a few
    # literals is a hash-set lookup; a literal map would scan all its keys)
    expr = None
    for v in sorted(set(m.values())):
        keys = [k for k, x in m.items() if x == v]
        expr = F.when(key.isin(keys), F.lit(v)) if expr is None else expr.when(key.isin(keys), F.lit(v))
    return (expr.otherwise(F.lit(UNKNOWN_LABEL)) if expr is not None else F.lit(UNKNOWN_LABEL)).cast("int")


def severity(score, thresholds: dict | None = None) -> Column:
    """critical / high / medium at >= each bound; below medium (or no score)
    is low."""
    t = dict(SEVERITY_THRESHOLDS)
    t.update(thresholds or {})
    s = col_(score)
    return (F.when(s >= t["critical"], "critical").when(s >= t["high"], "high")
            .when(s >= t["medium"], "medium").otherwise("low"))


def clip01(c) -> Column:
    return F.least(F.greatest(col_(c), F.lit(0.0)), F.lit(1.0))


def round_half_up(c, digits: int = 4) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the same IEEE steps in any engine, so
    equal inputs give equal outputs (``round`` rounds the decimal string)."""
    s = float(10 ** digits)
    return F.floor(col_(c) * F.lit(s) + F.lit(0.5)) / F.lit(s)
