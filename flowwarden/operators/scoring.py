"""Model-score combination: per-model score columns -> ensemble score,
prediction, severity and anomaly records. Pure projections, except the
max-normalised reconstruction score, which needs one global max (a one-row
aggregate, used as a literal)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import attack_type
from ..functions.scalars import clip01, col_, severity


def reconstruction_score(err, threshold: float) -> Column:
    """clip((err - thr) / thr, 0, 1); with threshold 0, 1 for any error above 0."""
    e = col_(err).cast("double")
    if not threshold:
        return F.when(e > 0, F.lit(1.0)).when(e.isNotNull(), F.lit(0.0))
    return clip01((e - F.lit(float(threshold))) / F.lit(float(threshold)))


def reconstruction_score_maxnorm(df: DataFrame, err_col: str, threshold: float,
                                 score_col: str = "recon_score", flag_col: str = "recon_flag") -> DataFrame:
    """err / max(err) over the whole table, and the flag err > threshold.
    The maximum is one aggregate; it enters the projection as a literal."""
    mx = df.agg(F.max(F.col(err_col).cast("double"))).first()[0]
    e = F.col(err_col).cast("double")
    score = e / F.lit(float(mx)) if mx else F.lit(0.0)
    return df.withColumns({score_col: score, flag_col: (e > F.lit(float(threshold))).cast("int")})


def ensemble_score(score_cols: list[str], weights: dict | None = None) -> Column:
    """Mean of the available (non-null) model scores; weighted when weights
    are given (normalised over the models present in the row); 0 with no
    model score at all."""
    if not score_cols:
        return F.lit(0.0)
    w = {c: float((weights or {}).get(c, 1.0 if weights is None else 0.0)) for c in score_cols}
    num = sum((F.coalesce(F.col(c).cast("double") * F.lit(w[c]), F.lit(0.0)) for c in score_cols), F.lit(0.0))
    den = sum((F.when(F.col(c).isNotNull(), F.lit(w[c])).otherwise(F.lit(0.0)) for c in score_cols), F.lit(0.0))
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def ensemble_weighted(score_cols: list[str], weights: dict) -> Column:
    """Sum of w * score with weights normalised over the given weights."""
    total = float(sum(weights.values()))
    if total == 0:
        return F.lit(0.0)
    return sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(weights.get(c, 0.0) / total)
                for c in score_cols), F.lit(0.0))


def ensemble_vote(flag_cols: list[str]) -> Column:
    """1 when more than half of the per-model 0/1 flags are set."""
    if not flag_cols:
        return F.lit(0)
    mean = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in flag_cols), F.lit(0.0)) / len(flag_cols)
    return (mean > 0.5).cast("int")


def anomaly_scores(df: DataFrame, score_cols: list[str], weights: dict | None = None,
                   threshold: float = 0.5, severity_thresholds: dict | None = None) -> DataFrame:
    """Every row with its ensemble score, prediction and severity."""
    s = ensemble_score(score_cols, weights)
    return (df.withColumn("anomaly_score", s)
              .withColumn("prediction", (F.col("anomaly_score") > F.lit(threshold)).cast("int"))
              .withColumn("severity", severity("anomaly_score", severity_thresholds)))


def detect_anomalies(df: DataFrame, score_cols: list[str], weights: dict | None = None,
                     threshold: float = 0.5, severity_thresholds: dict | None = None,
                     rule_params: dict | None = None, key: str = "flow_id", ts: str = "ts") -> DataFrame:
    """Rows predicted anomalous, as anomaly records: key, time, the raw row,
    score, per-model scores, severity and attack type."""
    scored = anomaly_scores(df, score_cols, weights, threshold, severity_thresholds)
    raw = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    model_scores = F.create_map(*[x for c in score_cols for x in (F.lit(c), F.col(c).cast("double"))])
    return (scored.where(F.col("prediction") == 1)
                  .select(F.col(key), F.col(ts), raw.alias("data"), F.col("anomaly_score"),
                          model_scores.alias("model_scores"), F.col("severity"),
                          attack_type(df, rule_params).alias("attack_type")))
