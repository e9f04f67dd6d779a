"""Table schemas and the fixed values the scoring semantics depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced; do not edit)
# ---------------------------------------------------------------------------

# The 41 connection-record features, in file order; a headerless CSV with 42
# columns gets these names plus "label".
CONN_FEATURES = [
    "duration", "protocol_type", "service", "flag", "src_bytes",
    "dst_bytes", "land", "wrong_fragment", "urgent", "hot",
    "num_failed_logins", "logged_in", "num_compromised",
    "root_shell", "su_attempted", "num_root", "num_file_creations",
    "num_shells", "num_access_files", "num_outbound_cmds",
    "is_host_login", "is_guest_login", "count", "srv_count",
    "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate",
    "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate",
    "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate",
    "dst_host_diff_srv_rate", "dst_host_same_src_port_rate",
    "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate",
    "dst_host_srv_rerror_rate",
]

# Label strings (lower-cased, trimmed) -> 0/1; anything else is an attack (1).
LABEL_MAP = {
    "normal": 0,
    "benign": 0,
    "anomaly": 1,
    "malicious": 1,
    "dos": 1, "ddos": 1, "syn_flood": 1, "smurf": 1,
    "probe": 1, "portsweep": 1, "ipsweep": 1, "nmap": 1,
    "u2r": 1, "buffer_overflow": 1, "rootkit": 1,
    "r2l": 1, "ftp_write": 1, "guess_passwd": 1, "imap": 1,
}
UNKNOWN_LABEL = 1

# Severity cut-offs on the ensemble score (>= each bound). "low" is listed but
# never consulted: everything below "medium" is low.
SEVERITY_THRESHOLDS = {"low": 0.3, "medium": 0.5, "high": 0.7, "critical": 0.9}
SEVERITY_LEVELS = ["low", "medium", "high", "critical"]

# Ports commonly targeted by attacks.
SUSPICIOUS_PORTS = [22, 23, 135, 139, 445, 1433, 1521, 3389, 5432, 5900]

# Protocol risk classes (case-insensitive); everything else is "low".
HIGH_RISK_PROTOCOLS = ["telnet", "ftp", "http", "snmp"]
MEDIUM_RISK_PROTOCOLS = ["ssh", "smtp", "pop3", "imap"]

# IP protocol numbers -> protocol names; others are "other".
IP_PROTOCOL_NAMES = {1: "icmp", 6: "tcp", 17: "udp"}

# Row-rule thresholds of the attack classifier.
RULE_DEFAULTS = {
    "port_scan_count": 20, "port_scan_srv_count": 5,
    "dos_count": 100, "dos_duration": 1,
    "brute_force_failed_logins": 5,
    "exfil_total_bytes": 10000,
}

# Windowed detectors (declared configuration): window seconds and thresholds.
WINDOW_PATTERNS = {
    "port_scan": {"window": 60, "unique_ports": 20, "packets": 50},
    "dos_attack": {"window": 10, "packets": 1000, "rate": 100},
    "brute_force": {"window": 300, "attempts": 10, "ports": [22, 23, 21, 3389]},
    "data_exfiltration": {"window": 600, "bytes": 100000, "ratio": 0.1},
}
# Traffic windows of the detector: short / medium / long.
TRAFFIC_WINDOWS = {"short": "5 minutes", "medium": "30 minutes", "long": "2 hours"}

# Accepted input files (declared): size bound and extensions.
MAX_INPUT_MB = 500
INPUT_EXTENSIONS = ["csv", "pcap", "pcapng"]

# Alert retention (declared).
ALERT_RETENTION_DAYS = 30
ALERT_MAX_ROWS = 10000

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

_STRING_CONN = {"protocol_type", "service", "flag"}
_RATE = lambda n: n.endswith("_rate")

CONN_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType() if n in _STRING_CONN else
                   T.DoubleType() if (n == "duration" or _RATE(n)) else T.LongType())
     for n in CONN_FEATURES] + [T.StructField("label", T.StringType())])

PACKET_SCHEMA = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("packet_index", T.LongType()),
    T.StructField("packet_size", T.IntegerType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("ip_len", T.IntegerType()),
    T.StructField("ip_flags", T.IntegerType()),
    T.StructField("ip_ttl", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("tcp_window", T.IntegerType()),
    T.StructField("tcp_seq", T.LongType()),
    T.StructField("tcp_ack", T.LongType()),
    T.StructField("udp_src_port", T.IntegerType()),
    T.StructField("udp_dst_port", T.IntegerType()),
    T.StructField("udp_len", T.IntegerType()),
])

# Raw live flow record as it lands (JSON lines or Kafka value).
FLOW_EVENT_SCHEMA = T.StructType([
    T.StructField("flow_id", T.LongType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("length", T.LongType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("tcp_srcport", T.IntegerType()),
    T.StructField("tcp_dstport", T.IntegerType()),
    T.StructField("udp_srcport", T.IntegerType()),
    T.StructField("udp_dstport", T.IntegerType()),
    T.StructField("tcp_flags", T.StringType()),
])

ALERT_SCHEMA = T.StructType([
    T.StructField("alert_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("severity", T.StringType()),
    T.StructField("alert_type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("destination_ip", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("additional_info", T.StructType([
        T.StructField("model_scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("raw_data", T.StringType()),
    ])),
    T.StructField("status", T.StringType()),
])
