"""Catalog: ordered rolling statistics, frequency encoding, sequence windows (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as B
from ..operators.rolling import frequency_encode, importance_summary, rolling_features, sequence_windows
from ..functions.scalars import round_half_up
from ..oracle import label_sql, rnd, with_flows, with_gaps
from ..sources.tables import flows_with_gaps, read_flows
from .catalog import register

# The first ten numeric columns of a flow. Over the view with gaps: infinite
# values count as missing. Two decimals, moved off the ties that means of decimals
# fall on, so that the engines' summation orders don't show.
OFF_TIE = 1e-7
ROLL_COLS = ["src_port", "dst_port", "duration", "src_bytes", "dst_bytes", "packet_size", "tcp_flags", "count", "srv_count",
             "num_failed_logins"]
ROLL_W = 100


def _r4(c):
    return round_half_up(c, 6)


def _roll_sql(c, w="w", digits=6, off=0.0):
    q, plus = f'"{c}"', f" + {off:.7f}" if off else ""
    return (f"{rnd(f'avg({q}) OVER {w}{plus}', digits)} AS {c}_rolling_mean, "
            f"{rnd(f'COALESCE(stddev_samp({q}) OVER {w}, 0){plus}', digits)} AS {c}_rolling_std, "
            f"{rnd(f'abs({q} - avg({q}) OVER {w}){plus}', digits)} AS {c}_deviation")


@register("rolling_features", with_gaps(
    "SELECT flow_id, " + ", ".join(_roll_sql(c, digits=2, off=OFF_TIE) for c in ROLL_COLS)
    + " FROM (SELECT * REPLACE (CASE WHEN isinf(src_bytes) THEN NULL ELSE src_bytes END AS src_bytes) FROM gaps) WINDOW w AS"
    + f" (ORDER BY ts, flow_id ROWS BETWEEN {ROLL_W - 1} PRECEDING AND CURRENT ROW)"))
def rolling_features_q(spark, sf):
    f = flows_with_gaps(read_flows(spark, sf))
    r = rolling_features(f, key=["ts", "flow_id"], window=ROLL_W, max_cols=10, exclude=("label", "flow_id"))
    return r.select("flow_id", *[round_half_up(F.col(c) + OFF_TIE, 2).alias(c) for c in r.columns if c not in f.columns])


@register("rolling_features_per_host", with_flows(
    "SELECT flow_id, src_ip, " + _roll_sql("packet_size") + ", " + _roll_sql("tcp_flags")
    + " FROM flows WINDOW w AS (PARTITION BY src_ip ORDER BY ts, flow_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def rolling_features_per_host(spark, sf):
    f = read_flows(spark, sf).select("flow_id", "ts", "src_ip", "packet_size", "tcp_flags")
    r = rolling_features(f, key=["ts", "flow_id"], window=20, cols=["packet_size", "tcp_flags"], partition_by=["src_ip"],
                         block_size=256)
    new = [c for c in r.columns if c not in f.columns]
    return r.select("flow_id", "src_ip", *[_r4(F.col(c)).alias(c) for c in new])


@register("frequency_encode", with_flows("""
SELECT flow_id, CAST(count(*) OVER (PARTITION BY src_ip) AS BIGINT) AS src_ip_frequency,
 CAST(count(*) OVER (PARTITION BY dst_ip) AS BIGINT) AS dst_ip_frequency FROM flows"""))
def frequency_encode_q(spark, sf):
    f = read_flows(spark, sf).select("flow_id", "src_ip", "dst_ip")
    return frequency_encode(f, ["src_ip", "dst_ip"]).select("flow_id", "src_ip_frequency", "dst_ip_frequency")


SEQ_L = 5
SEQ_FEATURES = ["duration", "packet_size"]


@register("sequence_windows", with_flows(
    "SELECT flow_id, CAST(rn - 1 AS BIGINT) AS row_index, target, "
    + ", ".join(f"seq[{i + 1}][{j + 1}] AS lag{SEQ_L - i}_{c}" for i in range(SEQ_L) for j, c in enumerate(SEQ_FEATURES))
    + f" FROM (SELECT flow_id, {label_sql('label_raw')} AS target, row_number() OVER o AS rn,"
    + " list([CAST(duration AS DOUBLE), CAST(packet_size AS DOUBLE)]) OVER (o ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS seq"
    + " FROM flows WINDOW o AS (ORDER BY ts, flow_id)) WHERE rn > 5"))
def sequence_windows_q(spark, sf):
    f = B.standardize_labels(read_flows(spark, sf).select("flow_id", "ts", "label_raw", *SEQ_FEATURES),
                             "label_raw", out="label")
    s = sequence_windows(f, SEQ_FEATURES, label="label", key=["ts", "flow_id"], length=SEQ_L)
    return s.select("flow_id", "row_index", "target",
                    *[F.col("sequence")[i][j].alias(f"lag{SEQ_L - i}_{c}")
                      for i in range(SEQ_L) for j, c in enumerate(SEQ_FEATURES)])


IMP_COLS = ["duration", "src_bytes", "dst_bytes", "packet_size", "tcp_flags", "count", "srv_count", "num_failed_logins"]


@register("importance_summary", with_flows(f"""
, lab AS (SELECT *, {label_sql('label_raw')} AS label FROM flows),
imp AS (SELECT feature, round(abs(COALESCE(corr(value, label), 0)), 6) AS importance
        FROM (UNPIVOT (SELECT label, {", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in IMP_COLS)} FROM lab)
              ON {", ".join(f'"{c}"' for c in IMP_COLS)} INTO NAME feature VALUE value) GROUP BY feature)
SELECT feature, importance,
 round(sum(importance) OVER (ORDER BY importance DESC, feature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6)
   AS cumulative_importance,
 CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM imp"""))
def importance_summary_q(spark, sf):
    f = B.standardize_labels(read_flows(spark, sf), "label_raw", out="label")
    f = f.select("label", *[F.col(f"`{c}`").cast("double").alias(c) for c in IMP_COLS])
    long = f.unpivot(["label"], IMP_COLS, "feature", "value")
    imp = long.groupBy("feature").agg(F.round(F.abs(F.coalesce(F.corr("value", F.col("label").cast("double")),
                                                              F.lit(0.0))), 6).alias("importance"))
    s = importance_summary(imp)
    return s.select("feature", "importance", F.round("cumulative_importance", 6).alias("cumulative_importance"), "rank")
