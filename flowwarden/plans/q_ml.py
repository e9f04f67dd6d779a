"""Catalog: fitted transforms (F) and models / evaluation (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import round_half_up
from ..operators import clean as B
from ..operators import models as G
from ..operators.grid import grid_search_forest
from ..operators.encode import LabelEncoderModel, MinMaxScalerModel, StandardScalerModel, align_features, select_columns
from ..operators.features import extract_network_features
from ..operators.rolling import exact_percentile, importance_summary
from ..operators.select import anova_f_scores, mutual_info_scores, top_k
from ..oracle import label_sql, rnd, with_flows, with_gaps, with_scored
from ..sources.tables import flows_with_gaps, read_flows
from .catalog import register
from .detection import with_model_scores
from .pipeline import FlowFeaturePipeline

SCALE_COLS = ["src_port", "dst_port", "duration", "src_bytes", "dst_bytes", "packet_size", "tcp_flags", "count", "srv_count",
              "num_failed_logins"]
SELECT_COLS = ["duration", "src_bytes", "dst_bytes", "packet_size", "tcp_flags", "count", "srv_count",
               "num_failed_logins"]
MODEL_FEATURES = ["duration", "src_bytes", "dst_bytes", "packet_size", "tcp_flags", "count", "srv_count",
                  "num_failed_logins", "src_port", "dst_port", "total_bytes", "byte_ratio", "srv_ratio",
                  "is_tcp", "is_udp", "is_icmp", "has_syn", "has_ack"]


def _labelled(spark, sf):
    return B.standardize_labels(read_flows(spark, sf), "label_raw", out="label")


def _model_frame(spark, sf):
    return extract_network_features(_labelled(spark, sf), time_col="ts")


def _r6(c):
    return round_half_up(c, 6)


# --- F: fitted transforms ---------------------------------------------------------

@register("label_encode", with_flows("""
, pc AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
         FROM (SELECT DISTINCT protocol_type AS v FROM flows)),
lc AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT label_raw AS v FROM flows))
SELECT t.flow_id, COALESCE(pc.code, (SELECT CAST(count(*) AS INTEGER) FROM pc)) AS protocol_type,
 COALESCE(lc.code, (SELECT CAST(count(*) AS INTEGER) FROM lc)) AS label_raw
FROM (SELECT flow_id, CASE WHEN dst_port = 443 THEN 'gre' ELSE protocol_type END AS p, label_raw FROM flows) t
LEFT JOIN pc ON pc.v = t.p LEFT JOIN lc ON lc.v = t.label_raw"""))
def label_encode(spark, sf):
    f = read_flows(spark, sf)
    enc = LabelEncoderModel.fit(f, ["protocol_type", "label_raw"])
    live = f.withColumn("protocol_type", F.when(F.col("dst_port") == 443, "gre").otherwise(F.col("protocol_type")))
    return enc.transform(live).select("flow_id", "protocol_type", "label_raw")


@register("standard_scale", with_flows(
    "SELECT flow_id, " + ", ".join(
        f"""{rnd(f'("{c}" - avg("{c}") OVER ()) / CASE WHEN stddev_pop("{c}") OVER () = 0 THEN 1 ELSE stddev_pop("{c}") OVER () END', 5)} AS "{c}" """
        for c in SCALE_COLS) + " FROM flows"))
def standard_scale(spark, sf):
    f = read_flows(spark, sf)
    m = StandardScalerModel.fit(f, SCALE_COLS)
    return m.transform(f).select("flow_id", *[round_half_up(F.col(c), 5).alias(c) for c in SCALE_COLS])


@register("minmax_scale", with_flows(
    "SELECT flow_id, " + ", ".join(
        f"""{rnd(f'CAST("{c}" - min("{c}") OVER () AS DOUBLE) / CASE WHEN max("{c}") OVER () = min("{c}") OVER () THEN 1 ELSE max("{c}") OVER () - min("{c}") OVER () END', 5)} AS "{c}" """
        for c in SCALE_COLS) + " FROM flows"))
def minmax_scale(spark, sf):
    f = read_flows(spark, sf)
    m = MinMaxScalerModel.fit(f, SCALE_COLS)
    return m.transform(f).select("flow_id", *[round_half_up(F.col(c), 5).alias(c) for c in SCALE_COLS])


_POS = ", ".join(f"('{c}', {i})" for i, c in enumerate(SELECT_COLS))
_LONG = (f"(UNPIVOT (SELECT {label_sql('label_raw')} AS y, "
         + ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in SELECT_COLS) + " FROM flows) ON "
         + ", ".join(f'"{c}"' for c in SELECT_COLS) + " INTO NAME feature VALUE value)")


@register("anova_f_scores", with_flows(f"""
, g AS (SELECT feature, y, CAST(count(*) AS DOUBLE) AS n, sum(value) AS s, sum(value * value) AS ss
        FROM {_LONG} WHERE value IS NOT NULL GROUP BY feature, y),
t AS (SELECT feature, sum(n) AS nn, sum(s) AS sa, sum(ss) AS ssa, CAST(count(*) AS DOUBLE) AS k,
             sum(s * s / n) AS br FROM g GROUP BY feature),
f AS (SELECT feature, CASE WHEN k > 1 AND nn > k AND ssa - br > 0
             THEN ((br - sa * sa / nn) / (k - 1)) / ((ssa - br) / (nn - k)) END AS score FROM t),
p AS (SELECT * FROM (VALUES {_POS}) v(feature, position))
SELECT feature, {rnd('score', 4)} AS f_score,
 CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, position) AS INTEGER) AS rank,
 row_number() OVER (ORDER BY score DESC NULLS LAST, position) <= 4 AS selected
FROM f JOIN p USING (feature)"""))
def anova_f_scores_q(spark, sf):
    s = top_k(anova_f_scores(_labelled(spark, sf), "label", SELECT_COLS), 4)
    return s.select("feature", round_half_up(F.col("score"), 4).alias("f_score"), F.col("rank").cast("int"), "selected")


@register("select_fitted", with_flows(f"""
, g AS (SELECT feature, y, CAST(count(*) AS DOUBLE) AS n, sum(value) AS s, sum(value * value) AS ss
        FROM {_LONG} WHERE value IS NOT NULL GROUP BY feature, y),
t AS (SELECT feature, sum(n) AS nn, sum(s) AS sa, sum(ss) AS ssa, CAST(count(*) AS DOUBLE) AS k,
             sum(s * s / n) AS br FROM g GROUP BY feature),
f AS (SELECT feature, CASE WHEN k > 1 AND nn > k AND ssa - br > 0
             THEN ((br - sa * sa / nn) / (k - 1)) / ((ssa - br) / (nn - k)) END AS score FROM t),
p AS (SELECT * FROM (VALUES {_POS}) v(feature, position)),
best AS (SELECT feature FROM f JOIN p USING (feature) ORDER BY score DESC NULLS LAST, position LIMIT 4)
SELECT feature, CAST(count(*) AS BIGINT) AS rows, round(sum(value), 2) AS total FROM {_LONG} l JOIN best USING (feature) GROUP BY feature"""))
def select_fitted(spark, sf):
    """A fitted selection applied to flows without fitting again."""
    d = _labelled(spark, sf)
    best = [r.feature for r in top_k(anova_f_scores(d, "label", SELECT_COLS), 4).where("selected").collect()]  # four names
    x = select_columns(d, best, keep=["flow_id"])
    long = x.unpivot(["flow_id"], [F.col(f"`{c}`").cast("double").alias(c) for c in best], "feature", "value").where("value IS NOT NULL")
    return long.groupBy("feature").agg(F.count(F.lit(1)).cast("bigint").alias("rows"), F.round(F.sum("value"), 2).alias("total"))


@register("mutual_info_scores", with_flows(f"""
, l AS (SELECT * FROM {_LONG} WHERE value IS NOT NULL),
mm AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY feature),
j AS (SELECT l.feature, CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / ((hi - lo) / 10)), 9) END AS bin, y,
             CAST(count(*) AS DOUBLE) AS nxy FROM l JOIN mm USING (feature) GROUP BY 1, 2, 3),
w AS (SELECT *, sum(nxy) OVER (PARTITION BY feature) AS n, sum(nxy) OVER (PARTITION BY feature, bin) AS nx,
             sum(nxy) OVER (PARTITION BY feature, y) AS ny FROM j),
m AS (SELECT feature, sum((nxy / n) * ln(nxy * n / (nx * ny))) AS score FROM w GROUP BY feature),
p AS (SELECT * FROM (VALUES {_POS}) v(feature, position))
SELECT feature, {rnd('score', 6)} AS mi_score,
 CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, position) AS INTEGER) AS rank
FROM m JOIN p USING (feature)"""))
def mutual_info_scores_q(spark, sf):
    s = top_k(mutual_info_scores(_labelled(spark, sf), "label", SELECT_COLS, bins=10), 4)
    return s.select("feature", _r6(F.col("score")).alias("mi_score"), F.col("rank").cast("int"))


@register("align_features", with_flows("""
SELECT packet_size, 0 AS window_bytes, duration, flow_id FROM flows"""))
def align_features_q(spark, sf):
    return align_features(read_flows(spark, sf), ["packet_size", "window_bytes", "duration", "flow_id"])


@register("feature_pipeline")
def feature_pipeline(spark, sf):
    """Fit the full feature pipeline on the labelled flows and transform them
    (rows-only check: the output is the model input matrix)."""
    f = _labelled(spark, sf).drop("label_raw")
    pipe = FlowFeaturePipeline(label="label", key=("ts", "flow_id"), id_cols=("flow_id",))
    _, out = pipe.fit_transform(f, keep=["flow_id", "label"])
    return out


# --- G: models and evaluation -------------------------------------------------------

@register("train_test_split", with_flows("""
SELECT flow_id, substr(md5(CAST(flow_id AS VARCHAR) || '|42'), 1, 4) < '3333' AS is_test FROM flows"""))
def train_test_split_q(spark, sf):
    return read_flows(spark, sf).select("flow_id", G.split_flag("flow_id", 42, 0.2).alias("is_test"))


@register("stratified_split", with_flows("""
SELECT flow_id, label_raw, row_number() OVER (PARTITION BY label_raw ORDER BY md5(CAST(flow_id AS VARCHAR) || '|42'), flow_id)
 <= floor(count(*) OVER (PARTITION BY label_raw) * CAST(0.2 AS DOUBLE) + 0.5) AS is_test FROM flows"""))
def stratified_split_q(spark, sf):
    """Exactly a fifth of each class, to the nearest row, is held out."""
    return G.stratified_split(read_flows(spark, sf).select("flow_id", "label_raw"), "flow_id", "label_raw")


@register("class_weights", with_flows(f"""
, c AS (SELECT {label_sql('label_raw')} AS label, count(*) AS nc FROM flows GROUP BY 1)
SELECT label, {rnd('(SELECT sum(nc) FROM c) / ((SELECT count(*) FROM c) * nc)', 6)} AS weight,
 CAST(nc AS BIGINT) AS n FROM c"""))
def class_weights(spark, sf):
    w = G.balanced_class_weights(_labelled(spark, sf), "label")
    return w.groupBy("label", "weight").agg(F.count(F.lit(1)).cast("bigint").alias("n")).select(
        "label", _r6(F.col("weight")).alias("weight"), "n")


_PRED = "(rf_score + recon_score + lstm_score) / 3.0"


def _scored_labelled(spark, sf):
    s = with_model_scores(_labelled(spark, sf))
    return s.withColumn("score", (F.col("rf_score") + F.col("recon_score") + F.col("lstm_score")) / 3.0) \
            .withColumn("prediction", (F.col("score") > 0.5).cast("int"))


def _metrics_sql(y, p):
    return f"""CAST(sum(CASE WHEN {y} = 1 AND {p} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
 CAST(sum(CASE WHEN {y} = 0 AND {p} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
 CAST(sum(CASE WHEN {y} = 0 AND {p} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
 CAST(sum(CASE WHEN {y} = 1 AND {p} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn"""


_METRIC_COLS = """, {a} AS accuracy, {p} AS precision, {r} AS recall,
 {f} AS f1_score""".format(
    a=rnd("CASE WHEN tp + fp + tn + fn > 0 THEN CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) ELSE 0 END", 6),
    p=rnd("CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END", 6),
    r=rnd("CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END", 6),
    f=rnd("CASE WHEN tp > 0 THEN 2 * (CAST(tp AS DOUBLE) / (tp + fp)) * (CAST(tp AS DOUBLE) / (tp + fn)) / "
          "((CAST(tp AS DOUBLE) / (tp + fp)) + (CAST(tp AS DOUBLE) / (tp + fn))) ELSE 0 END", 6))


def _round_metrics(m, keep, *more):
    return m.select(*keep, "tp", "fp", "tn", "fn", *[_r6(F.col(c)).alias(c) for c in
                                                     ("accuracy", "precision", "recall", "f1_score", *more)])


@register("classification_metrics", with_scored(f"""
, m AS (SELECT {_metrics_sql(label_sql('label_raw'), f'CAST({_PRED} > 0.5 AS INTEGER)')} FROM scored)
SELECT tp, fp, tn, fn {_METRIC_COLS} FROM m"""))
def classification_metrics_q(spark, sf):
    return _round_metrics(G.classification_metrics(_scored_labelled(spark, sf), "label", "prediction"), [])


def _auc_sql(group):
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""SELECT {g}CASE WHEN sum(pos) > 0 AND sum(neg) > 0
  THEN {rnd('sum(pos * (neg_below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg))', 6)} ELSE 0.5 END AS roc_auc
FROM (SELECT *, COALESCE(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
      FROM (SELECT {g}s, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS neg
            FROM src GROUP BY {g}s))
{('GROUP BY ' + group) if group else ''}"""


@register("roc_auc", with_scored(f"""
, src AS (SELECT {label_sql('label_raw')} AS y, {_PRED} AS s FROM scored)
{_auc_sql('')}"""))
def roc_auc_q(spark, sf):
    a = G.roc_auc(_scored_labelled(spark, sf), "label", "score")
    return a.select(_r6(F.col("roc_auc")).alias("roc_auc"))


_LONG_MODELS = f"""long AS (
 SELECT 'random_forest' AS model, y, CAST(rf_score > 0.5 AS INTEGER) AS p, rf_score AS s FROM lab
 UNION ALL SELECT 'reconstruction', y, CAST(recon_error > 110.0 AS INTEGER), recon_error / max(recon_error) OVER ()
   FROM lab
 UNION ALL SELECT 'sequence', y, CAST(lstm_score > 0.5 AS INTEGER), lstm_score FROM lab)"""


def _long_models(spark, sf):
    """(model, label, prediction, score) rows for the three models from one
    scan: each flow row explodes into one row per model."""
    s = with_model_scores(_labelled(spark, sf))
    mx = float(s.agg(F.max("recon_error")).first()[0])
    def entry(name, pred, score):
        return F.struct(F.lit(name).alias("model"), pred.cast("int").alias("prediction"), score.alias("score"))

    per_model = F.array(entry("random_forest", F.col("rf_score") > 0.5, F.col("rf_score")),
                        entry("reconstruction", F.col("recon_error") > 110.0, F.col("recon_error") / F.lit(mx)),
                        entry("sequence", F.col("lstm_score") > 0.5, F.col("lstm_score")))
    return s.select("label", F.explode(per_model).alias("m")).select("m.model", "label", "m.prediction", "m.score")


@register("evaluate_models", with_scored(f"""
, lab AS (SELECT *, {label_sql('label_raw')} AS y FROM scored),
{_LONG_MODELS},
m AS (SELECT model, {_metrics_sql('y', 'p')} FROM long GROUP BY model),
src AS (SELECT model, y, s FROM long),
a AS ({_auc_sql('model')})
SELECT m.model, tp, fp, tn, fn {_METRIC_COLS}, roc_auc FROM m JOIN a USING (model)"""))
def evaluate_models_q(spark, sf):
    e = G.evaluate_models(_long_models(spark, sf))
    return _round_metrics(e, ["model"], "roc_auc")


@register("model_comparison", with_scored(f"""
, lab AS (SELECT *, {label_sql('label_raw')} AS y FROM scored),
{_LONG_MODELS},
m AS (SELECT model, {_metrics_sql('y', 'p')} FROM long GROUP BY model)
SELECT model {_METRIC_COLS.replace(', tp', '')} FROM m"""))
def model_comparison(spark, sf):
    e = G.classification_metrics(_long_models(spark, sf), "label", "prediction", by=["model"])
    return e.select("model", *[_r6(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")])


@register("error_threshold", with_flows(f"""
SELECT {rnd('quantile_cont(recon_error, 0.9)', 6)} AS percentile FROM flows"""))
def error_threshold(spark, sf):
    p = exact_percentile(read_flows(spark, sf), "recon_error", 0.9, tiebreak="flow_id")
    return p.select(_r6(F.col("percentile")).alias("percentile"))


@register("reconstruction_summary", with_flows(f"""
SELECT {rnd('avg(recon_error)', 6)} AS mean_error, {rnd('stddev_pop(recon_error)', 6)} AS std_error,
 {rnd('avg(CASE WHEN recon_error > 110.0 THEN 1.0 ELSE 0.0 END)', 6)} AS anomaly_share FROM flows"""))
def reconstruction_summary_q(spark, sf):
    s = G.reconstruction_summary(read_flows(spark, sf), 110.0)
    return s.select(*[_r6(F.col(c)).alias(c) for c in s.columns])


@register("forest_scores")
def forest_scores_q(spark, sf):
    """Forest trained on the hash-split training rows, scoring every row."""
    d = _model_frame(spark, sf)
    train, _ = G.train_test_split(d, "flow_id")
    model = G.train_forest(train, MODEL_FEATURES, "label")
    return G.forest_scores(model, d).select("flow_id", "label", "rf_score")


@register("train_and_score")
def train_and_score(spark, sf):
    """Train all three models on the split, score every flow, raise alerts,
    count them per attack type (rows-only: model outputs)."""
    from ..operators.alerts import attack_type_counts
    from .training import train_and_alert
    return attack_type_counts(train_and_alert(_unscored(spark, sf)))


def _unscored(spark, sf):
    return _labelled(spark, sf).drop("rf_score", "recon_error", "lstm_score", "label_raw")


@register("evaluate_trained", with_gaps(f"""
, t AS (SELECT DISTINCT flow_id, {label_sql('label_raw')} AS y FROM gaps
        WHERE substr(md5(CAST(flow_id AS VARCHAR) || '|42'), 1, 4) < '3333')
SELECT model, CAST(count(*) AS BIGINT) AS rows, CAST(sum(y) AS BIGINT) AS positives, true AS forest_beats_chance
FROM t, (VALUES ('random_forest'), ('reconstruction'), ('sequence'), ('ensemble')) m(model) GROUP BY model"""))
def evaluate_trained_q(spark, sf):
    """The whole chain over flows with missing values: clean, feature pipeline
    and three models fitted on training rows, evaluated on held-out rows. The
    oracle states what doesn't depend on a model's outputs."""
    from .training import evaluate_trained
    g = flows_with_gaps(read_flows(spark, sf)).dropDuplicates(["flow_id"])
    g = B.standardize_labels(g, "label_raw", out="label").drop("rf_score", "recon_error", "lstm_score", "label_raw")
    e = evaluate_trained(g)
    return e.select("model", (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("rows"),
                    (F.col("tp") + F.col("fn")).alias("positives"),
                    ((F.col("model") != "random_forest") | (F.col("roc_auc") > 0.5)).alias("forest_beats_chance"))


GRID_SQL = """
SELECT CAST(n AS INTEGER) AS num_trees, CAST(d AS INTEGER) AS max_depth, CAST(l AS INTEGER) AS min_instances, CAST(g AS DOUBLE) AS min_info_gain,
 true AS f1_in_bounds FROM (VALUES (50), (100), (200)) a(n), (VALUES (10), (20), (30)) b(d), (VALUES (1), (2), (4)) c(l), (VALUES (0.0), (0.01), (0.05)) e(g)"""


@register("tune_forest", GRID_SQL)
def tune_forest_q(spark, sf):
    """Grid search with 3-fold cross-validation on F1 of class 1 over the full grid of
    81 points (81 forests of 200 trees, whose first 50 and 100 trees are the smaller
    candidates). The oracle states the points, and that each has an F1."""
    d = _model_frame(spark, sf)
    rows = grid_search_forest(d, MODEL_FEATURES, "label", "flow_id", folds=3)
    return rows.select("num_trees", "max_depth", "min_instances", "min_info_gain", F.col("mean_f1").between(0, 1).alias("f1_in_bounds"))


@register("feature_importance")
def feature_importance_q(spark, sf):
    d = _model_frame(spark, sf)
    model = G.train_forest(d, MODEL_FEATURES, "label")
    return importance_summary(G.feature_importance(model, MODEL_FEATURES)).orderBy("rank").limit(15)


@register("reconstruction_errors")
def reconstruction_errors(spark, sf):
    d = _model_frame(spark, sf)
    m = G.ReconstructionModel.fit(d, MODEL_FEATURES, k=8, contamination=0.1, key="flow_id")
    e = m.errors(d)
    return e.select("flow_id", "recon_error", (F.col("recon_error") > F.lit(m.threshold)).cast("int").alias("recon_flag"))


@register("sequence_scores")
def sequence_scores_q(spark, sf):
    d = _model_frame(spark, sf)
    feats = ["duration", "packet_size", "count", "srv_count", "is_udp", "is_icmp"]
    model, length = G.train_sequence(d, feats, "label", length=5)
    return G.sequence_scores(model, length, d, feats, "label").select("flow_id", "label", "lstm_score")


@register("score_invariants", with_flows("""
, n AS (SELECT CAST(count(*) AS BIGINT) AS n FROM flows)
SELECT model, n AS rows, CAST(0 AS BIGINT) AS out_of_bounds, CAST(CASE model WHEN 'sequence' THEN 5 ELSE 0 END AS BIGINT) AS without_history,
 CAST(0 AS BIGINT) AS changed_by_reload
FROM n, (VALUES ('random_forest'), ('reconstruction'), ('sequence')) m(model)"""))
def score_invariants(spark, sf):
    """What scores of fitted models obey, whatever the models are: one score for
    each flow, within 0 and 1, 0 where the sequence model has no history, and the
    same after saving and loading."""
    from ..session import settled
    from ..streaming.jobs import scratch_path
    from .training import SCORES, load_detector, save_detector, score_flows, train_detector
    f = _unscored(spark, sf)
    models = train_detector(f)
    path = scratch_path(spark, "invariants")
    save_detector(spark, models, path)
    a = settled(lambda: score_flows(models, f).select("flow_id", "ts", *SCORES))
    b = settled(lambda: score_flows(load_detector(spark, path), f).select("flow_id", *[F.col(c).alias(f"{c}_again") for c in SCORES]))
    first = f.orderBy("ts", "flow_id").limit(5).select(F.col("flow_id").alias("early"))
    s = a.join(b, "flow_id").join(F.broadcast(first), F.col("flow_id") == F.col("early"), "left")
    entry = lambda name, c: F.struct(F.lit(name).alias("model"), F.col(c).alias("score"), F.col(f"{c}_again").alias("again"))
    long = s.select("early", F.explode(F.array(entry("random_forest", "rf_score"), entry("reconstruction", "recon_score"),
                                               entry("sequence", "lstm_score"))).alias("m")).select("early", "m.*")
    count = lambda c: F.sum(F.coalesce(c, F.lit(True)).cast("long"))  # noqa: E731  an unknown counts against the model
    return long.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"), count(~F.col("score").between(0, 1)).alias("out_of_bounds"),
        F.sum(((F.col("model") == "sequence") & F.col("early").isNotNull() & (F.col("score") == 0)).cast("long")).alias("without_history"),
        count(F.col("score") != F.col("again")).alias("changed_by_reload"))
