"""Hand-written edge rows: zero divisors, nulls, NaN, Inf, malformed IPs,
single-row windows, unseen categories, ties, empty tables."""

import datetime as dt
import math
import statistics

from pyspark.sql import functions as F

from flowwarden.functions import scalars as L
from flowwarden.functions.rules import attack_type
from flowwarden.operators import clean as B
from flowwarden.operators import quality as C
from flowwarden.operators.encode import LabelEncoderModel, MinMaxScalerModel, StandardScalerModel, align_features
from flowwarden.operators.features import extract_network_features, feature_interactions
from flowwarden.operators.rolling import exact_percentile, fitted_length, rolling_features, sequence_windows
from flowwarden.operators.scoring import reconstruction_score


def test_ip_helpers(spark):
    rows = [("192.168.1.10",), ("0.0.0.0",), (None,), ("1.2.3",), ("a.b.c.d",), ("010.001.000.007",), ("300.1.1.1",),
            ("1.2.3.4.5",), ("172.20.0.1",), ("172.32.0.1",)]
    df = spark.createDataFrame(rows, "ip string")
    out = df.select("ip", L.ip_to_int("ip").alias("n"), L.normalize_ip("ip").alias("norm"),
                    L.is_private_ip("ip").alias("priv")).collect()
    got = {r.ip: (r.n, r.norm, r.priv) for r in out}
    assert got["192.168.1.10"] == (3232235786, "192.168.1.10", True)
    assert got["0.0.0.0"][0] == 0 and got[None][0] == 0 and got["1.2.3"][0] == 0 and got["a.b.c.d"][0] == 0
    assert got["010.001.000.007"][1] == "10.1.0.7"
    assert got["300.1.1.1"][0] == 300 * 16777216 + 65536 + 256 + 1  # octet range unchecked
    assert got["1.2.3.4.5"][1] == "1.2.3.4.5" and got["a.b.c.d"][1] == "a.b.c.d"
    assert got["172.20.0.1"][2] is True and got["172.32.0.1"][2] is False and got["a.b.c.d"][2] is False


def test_labels_and_severity(spark):
    df = spark.createDataFrame([(" DoS ",), ("normal",), ("BENIGN\t",), ("zero_day",), (None,), ("Smurf",)], "l string")
    got = [r[0] for r in df.select(L.standardize_label("l")).collect()]
    assert got == [1, 0, 0, 1, 1, 1]
    num = spark.createDataFrame([(0.0,), (1.0,), (None,)], "l double")
    assert [r[0] for r in num.select(L.standardize_label("l", numeric=True)).collect()] == [0, 1, 1]
    s = spark.createDataFrame([(0.95,), (0.9,), (0.7,), (0.5,), (0.49,), (None,)], "s double")
    assert [r[0] for r in s.select(L.severity("s")).collect()] == ["critical", "critical", "high", "medium", "low", "low"]


def test_time_ago(spark):
    as_of = dt.datetime(2024, 1, 31, 0, 0, 0)
    ts = [as_of - dt.timedelta(days=2), as_of - dt.timedelta(days=1), as_of - dt.timedelta(seconds=3601),
          as_of - dt.timedelta(seconds=3600), as_of - dt.timedelta(seconds=61), as_of - dt.timedelta(seconds=60),
          as_of - dt.timedelta(seconds=1)]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp")
    got = [r[0] for r in df.select(L.time_ago("ts", F.lit(as_of).cast("timestamp"))).collect()]
    assert got == ["2 days ago", "1 day ago", "1 hour ago", "60 minutes ago", "1 minute ago", "60 seconds ago",
                   "1 second ago"]


def test_derived_features_zero_divisors(spark):
    df = spark.createDataFrame([(0.0, 10.0, 0.0, 0, 5, 22, 80, "tcp", 18, 0.0)],
                               "duration double, src_bytes double, dst_bytes double, count int, srv_count int, "
                               "src_port int, dst_port int, protocol_type string, tcp_flags int, timestamp double")
    r = extract_network_features(df).first()
    assert r.byte_ratio == 10.0 and r.bytes_per_second == 10.0 and r.srv_ratio == 0.0
    assert (r.is_well_known_src_port, r.port_diff, r.is_tcp, r.is_udp) == (1, 58, 1, 0)
    assert (r.has_syn, r.has_ack, r.has_fin, r.has_rst) == (1, 1, 0, 0)
    assert (r.hour, r.day_of_week, r.is_weekend) == (0, 3, 0)  # 1970-01-01 was a Thursday


def test_missing_inputs_skip_blocks(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "src_bytes double, dst_bytes double")
    out = extract_network_features(df)
    assert "total_bytes" in out.columns and "bytes_per_second" not in out.columns


def test_interactions_pair_order(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.0, 4.0, 5.0, 6.0)], "a double, b double, c double, d double, e double, f double")
    out = feature_interactions(df, 10)
    new = [c for c in out.columns if c not in df.columns]
    assert new == ["a_x_b", "a_div_b", "a_x_c", "a_div_c", "a_x_d", "a_div_d", "a_x_e", "a_div_e", "b_x_c", "b_div_c"]
    assert out.first()["a_div_c"] == 0.0


def test_rules_null_and_absent(spark):
    df = spark.createDataFrame([(None, 1, 0.5), (150, 1, 0.5), (30, 1, 5.0)], "count int, srv_count int, duration double")
    got = [r[0] for r in df.select(attack_type(df)).collect()]
    # no dst_port column: the port-scan rule cannot fire
    assert got == ["unknown_anomaly", "dos_attack", "unknown_anomaly"]


def test_fill_inf_nan(spark):
    df = spark.createDataFrame([(float("nan"), None, "x"), (float("inf"), 2, None), (float("-inf"), 3, "y")],
                               "a double, b int, s string")
    out = B.replace_infinite(B.fill_missing(df)).collect()
    assert [r.a for r in out] == [0.0, 0.0, 0.0] and [r.b for r in out] == [0, 2, 3] and out[1].s == "0"


def test_quality_on_edge_rows(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (float("inf"), None), (-1.0, "b")], "x double, s string")
    assert C.missing_cells(df).first()[0] == 1
    assert C.duplicate_rows(df).first()[0] == 1
    f = C.quality_flags(df).first()
    assert (f.has_negative_values, f.has_infinite_values, f.has_null_values) == (True, True, True)
    empty = spark.createDataFrame([], "x double, s string")
    assert C.missing_cells(empty).first()[0] == 0 and C.duplicate_rows(empty).first()[0] == 0


def test_unseen_category(spark):
    train = spark.createDataFrame([("tcp",), ("udp",), ("icmp",)], "p string")
    live = spark.createDataFrame([("udp",), ("gre",), (None,)], "p string")
    enc = LabelEncoderModel.fit(train, ["p"])
    assert [r[0] for r in enc.transform(live).collect()] == [2, 3, 3]
    train2 = spark.createDataFrame([("a",), ("unknown",)], "p string")
    enc2 = LabelEncoderModel.fit(train2, ["p"])
    assert [r[0] for r in enc2.transform(live).collect()] == [1, 1, 1]


def test_scaler_constant_and_align(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    m = StandardScalerModel.fit(df)
    out = m.transform(df).collect()
    assert [r.a for r in out] == [-1.0, 1.0] and [r.b for r in out] == [0.0, 0.0]
    al = align_features(df, ["b", "z", "a"])
    assert al.columns == ["b", "z", "a"] and al.first().z == 0


def test_rolling_single_row_and_ties(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 5.0)], "flow_id long, ts timestamp, x double")
    r = rolling_features(df, key=["ts", "flow_id"], window=100, cols=["x"]).first()
    assert (r.x_rolling_mean, r.x_rolling_std, r.x_deviation) == (5.0, 0.0, 0.0)
    # equal timestamps: the flow id breaks the tie
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(2, t, 4.0), (1, t, 2.0), (3, t, 6.0)], "flow_id long, ts timestamp, x double")
    got = {r.flow_id: r.x_rolling_mean for r in rolling_features(df, ["ts", "flow_id"], window=2, cols=["x"]).collect()}
    assert got == {1: 2.0, 2: 3.0, 3: 5.0}


def test_sequence_short_table(spark):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), float(i), i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "flow_id long, ts timestamp, x double, label int")
    assert fitted_length(6, 5) == 1 and fitted_length(9, 5, min_sequences=1) == 3 and fitted_length(1000, 5) == 5
    s = sequence_windows(df, ["x"], "label", ["ts", "flow_id"], length=2).orderBy("row_index").collect()
    assert len(s) == 4 and s[0].sequence == [[0.0], [1.0]] and s[0].target == 0
    # a fitted length holds for any table: 6 rows have one row with five before it
    assert len(sequence_windows(df, ["x"], "label", ["ts", "flow_id"], length=5).collect()) == 1
    assert sequence_windows(df, ["x"], "label", ["ts", "flow_id"], length=6).count() == 0


def test_rolling_of_wild_values(spark):
    """One huge, one infinite and one NaN value: every frame equals the plain
    window, where NaN and infinite values count as missing."""
    values = [float(i % 7) + 0.25 for i in range(400)]
    values[50], values[120], values[200], values[300] = 1e12, float("inf"), float("nan"), None
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "flow_id long, ts timestamp, x double")
    for block in (19, 64, 1000):
        got = {r.flow_id: r for r in rolling_features(df, ["ts", "flow_id"], window=20, cols=["x"], block_size=block).collect()}
        for i in range(400):
            frame = [v for v in values[max(0, i - 19):i + 1] if v is not None and abs(v) < float("inf")]
            mean = sum(frame) / len(frame)
            std = statistics.stdev(frame) if len(frame) > 1 else 0.0
            assert math.isclose(got[i].x_rolling_mean, mean, rel_tol=1e-9), (block, i)
            assert math.isclose(got[i].x_rolling_std, std, rel_tol=1e-9, abs_tol=1e-9), (block, i)
            ok = values[i] is not None and abs(values[i]) < float("inf")
            assert (got[i].x_deviation is not None) == ok


def test_rolling_has_four_window_steps_for_any_number_of_columns(spark):
    df = spark.range(50).select(F.col("id").alias("flow_id"), F.col("id").cast("timestamp").alias("ts"),
                                *[F.col("id").cast("double").alias(f"c{i}") for i in range(10)])
    for n in (1, 10):
        plan = rolling_features(df, ["ts", "flow_id"], window=5, cols=[f"c{i}" for i in range(n)])._jdf.queryExecution().optimizedPlan().toString()
        assert sum("Window [" in line for line in plan.splitlines()) == 5  # four, and one over the partition offsets


def test_scalers_ignore_wild_values(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("inf"),), (float("nan"),), (None,)], "a double")
    assert StandardScalerModel.fit(df).stats["a"] == (2.0, 1.0)
    assert MinMaxScalerModel.fit(df).stats["a"] == (1.0, 3.0)


def test_both_label_code_paths_agree(spark):
    rows = [(v,) for v in ["b", "a", "unknown", "c", None, "b"]]
    fit, live = spark.createDataFrame(rows, "s string"), spark.createDataFrame([("c",), ("new",), (None,), ("a",)], "s string")
    for data in (fit, fit.where("s <> 'unknown'")):
        literal, joined = (LabelEncoderModel.fit(data, ["s"], max_literal=m) for m in (64, 1))
        assert literal.labels and joined.tables
        a, b = (sorted(x.transform(live.withColumn("k", F.col("s"))).collect(), key=str) for x in (literal, joined))
        assert a == b


def test_error_score_with_threshold_zero(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (None,)], "e double")
    assert [r[0] for r in df.select(reconstruction_score("e", 0.0)).collect()] == [0.0, 1.0, None]


def test_exact_percentile_equals_interpolation(spark):
    values = [float((i * 7919) % 1000) for i in range(997)] + [0.0] * 50
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted(values)
    for q in (0.0, 0.03, 0.5, 0.9, 0.999, 1.0):
        pos = q * (len(values) - 1)
        lo = int(pos)
        want = ordered[lo] + (ordered[min(lo + 1, len(values) - 1)] - ordered[lo]) * (pos - lo)
        for accuracy in (50, 100_000):
            assert math.isclose(exact_percentile(df, "x", q, accuracy=accuracy).first()[0], want, abs_tol=1e-9)


def test_hashed_duplicates_tell_nulls_apart(spark):
    from flowwarden.operators.quality import duplicate_rows
    rows = [(None, "a", "b", 1.0), ("a", None, "b", 1.0), ("a", "b", None, 1.0), ("a", "b", None, 1.0), ("a", "b", None, None), (None, None, None, None),
            (None, None, None, None), ("", "a", "b", 1.0), ("a", "b", "", float("nan")), ("a", "b", "", float("nan")), ("ab", "", "", 0.0), ("a", "b", "", 0.0)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d double")
    assert duplicate_rows(df).first()[0] == 3 and duplicate_rows(df.limit(0)).first()[0] == 0
    assert duplicate_rows(df.select("a")).first()[0] == df.count() - df.select("a").distinct().count()
    assert "_h1" in df.transform(duplicate_rows)._jdf.queryExecution().toString()


def test_rolled_up_windows_equal_each_alone(spark):
    from conftest import SMALL
    from flowwarden.sources.tables import read_flows
    from flowwarden.streaming import windows as W
    f = read_flows(spark, SMALL)
    sizes = {"long": "2 hours", "odd": "7 minutes", "short": "5 minutes", "medium": "30 minutes"}
    whole = lambda d: {(r.window_name, r.window_start): (r.flows, round(r.total_bytes, 4)) for r in d.collect()}
    alone = {k: v for name, size in sizes.items() for k, v in whole(W.traffic_windows(f, windows={name: size})).items()}
    assert whole(W.traffic_windows(f, windows=sizes)) == alone
