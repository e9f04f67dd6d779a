"""DuckDB twins of the catalog queries (the correctness oracle).

Only the base tables are registered in the oracle engine, so every statement
starts from ``events`` through the ``flows`` CTE (same definition as
``sources.tables.flows_from_events``).
"""

from __future__ import annotations

from .functions.rules import ATTACK_TYPES
from .sources.tables import FLOWS_SQL

RECON_THRESHOLD = 110.0
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

ATTACK_SQL = """CASE WHEN "count" > 20 AND srv_count < 5 THEN 'port_scan'
 WHEN "count" > 100 AND duration < 1 THEN 'dos_attack'
 WHEN num_failed_logins > 5 THEN 'brute_force'
 WHEN src_bytes + dst_bytes > 10000 AND dst_bytes > src_bytes THEN 'data_exfiltration'
 ELSE 'unknown_anomaly' END"""


def severity_sql(x: str) -> str:
    return (f"CASE WHEN {x} >= 0.9 THEN 'critical' WHEN {x} >= 0.7 THEN 'high' "
            f"WHEN {x} >= 0.5 THEN 'medium' ELSE 'low' END")


TITLE_SQL = "CASE alert_type " + " ".join(
    f"WHEN '{t}' THEN '{t.replace('_', ' ').title()}'" for t in ATTACK_TYPES) + " END"

SCORED_CTE = f"""flows AS ({FLOWS_SQL}),
scored AS (SELECT *, LEAST(GREATEST((recon_error - {RECON_THRESHOLD}) / {RECON_THRESHOLD}, 0.0), 1.0) AS recon_score
           FROM flows),
ens AS (SELECT *, (rf_score + recon_score + lstm_score) / 3.0 AS anomaly_score FROM scored)"""

ALERTS_CTE = SCORED_CTE + f""",
anom AS (SELECT *, {severity_sql('anomaly_score')} AS severity, {ATTACK_SQL} AS alert_type
         FROM ens WHERE anomaly_score > 0.5),
alerts AS (SELECT 'ALT_' || CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) || '_' || CAST(flow_id AS VARCHAR) AS alert_id,
   ts AS "timestamp", severity, alert_type,
   ({TITLE_SQL}) || ' detected from ' || src_ip || ' to ' || dst_ip AS description,
   src_ip AS source_ip, dst_ip AS destination_ip, anomaly_score AS confidence, 'new' AS status
 FROM anom)"""


def with_flows(sql: str) -> str:
    return f"WITH flows AS ({FLOWS_SQL})\n{sql}"


def with_scored(sql: str) -> str:
    return f"WITH {SCORED_CTE}\n{sql}"


def with_alerts(sql: str) -> str:
    return f"WITH {ALERTS_CTE}\n{sql}"


def label_sql(x: str) -> str:
    from .schemas import LABEL_MAP, UNKNOWN_LABEL
    key = f"lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LABEL_MAP.items())
    return f"CAST(COALESCE(CASE {key} {cases} END, {UNKNOWN_LABEL}) AS INTEGER)"


def ip_int_sql(x: str) -> str:
    parts = [f"TRY_CAST(split_part({x}, '.', {i}) AS BIGINT)" for i in range(1, 5)]
    ok = f"len(string_split({x}, '.')) = 4 AND " + " AND ".join(f"{p} IS NOT NULL" for p in parts)
    val = f"{parts[0]} * 16777216 + {parts[1]} * 65536 + {parts[2]} * 256 + {parts[3]}"
    return f"CAST(CASE WHEN {x} IS NULL OR {x} = '0.0.0.0' THEN 0 WHEN {ok} THEN {val} ELSE 0 END AS BIGINT)"


def with_gaps(sql: str) -> str:
    from .sources.tables import FLOWS_GAPS_SQL
    return f"WITH flows AS ({FLOWS_SQL}), gaps AS ({FLOWS_GAPS_SQL})\n{sql}"


def rnd(x: str, digits: int = 4) -> str:
    """DuckDB twin of ``functions.scalars.round_half_up``."""
    s = f"{10 ** digits}.0"
    return f"(floor(({x}) * {s} + 0.5) / {s})"
