"""Models and evaluation on Spark ML.

* forest: ``RandomForestClassifier`` (100 trees, depth 20, seed 42 by default)
* reconstruction model: PCA bottleneck on standardised input; the error of a
  row is mean((x - P P^T x)^2) = (sum x^2 - sum z^2) / d because P is
  orthonormal, evaluated as JVM column expressions (no Python UDF)
* sequence model: scaled logistic regression with balanced class weights over
  lagged feature windows, which tasks form as they read the rows (``sequence``)
* metrics: one aggregate of the confusion counts; AUC from per-score counts
  and a distributed prefix sum (Mann-Whitney form, ties counted half)
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..session import cut_lineage, scratch
from .rolling import exact_percentile, fitted_length, global_index, prefix_sums, range_partitions
from .ordered import HISTORY, MARKS, KeptRows
from .sequence import Chunks, KeptChunks, OrderedChunks, SequenceModel, number  # noqa: F401

FOREST_DEFAULTS = {"numTrees": 100, "maxDepth": 20, "minInstancesPerNode": 1, "seed": 42}
#: Bound of the class counts that weighting collects.
MAX_CLASSES = 10_000
SEQUENCE_DEFAULTS = {"maxIter": 30, "regParam": 1e-4}


def split_flag(key_col: str, seed: int = 42, test_fraction: float = 0.2):
    """Deterministic per-row train/test split (no shuffle, same rows in any
    engine): test when the first 4 hex digits of md5(key|seed) fall below
    the fraction of 16^4."""
    bound = format(int(round(test_fraction * 65536)), "04x")
    h = F.substring(F.md5(F.concat(F.col(key_col).cast("string"), F.lit(f"|{seed}"))), 1, 4)
    return h < F.lit(bound)


def train_test_split(df: DataFrame, key_col: str, seed: int = 42, test_fraction: float = 0.2):
    flag = split_flag(key_col, seed, test_fraction)
    return df.where(~flag), df.where(flag)


def stratified_split(df: DataFrame, key_col: str, label: str = "label", seed: int = 42, test_fraction: float = 0.2, out: str = "is_test") -> DataFrame:
    """Rows with a flag that is true for the given share of each class, to the nearest row
    (halves up): the rows whose md5(key|seed) comes first. Ranks within classes are positions in one
    range-partitioned order by class and digest, less the class's first position, so that no
    class is one task's work. A null label is a class; rows of one key and label take any order."""
    order = df.withColumns({"_class": F.col(label).cast("string"), "_digest": F.md5(F.concat(F.coalesce(F.col(key_col).cast("string"), F.lit("")), F.lit(f"|{seed}")))})
    indexed = cut_lineage(global_index(order, ["_class", "_digest", key_col], range_partitions(df.sparkSession, df.count())))
    classes = indexed.groupBy("_class").agg(F.min("_idx").alias("_first"), F.count(F.lit(1)).alias("_n")).limit(MAX_CLASSES + 1)
    classes = cut_lineage(classes)
    if classes.count() > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    c = F.broadcast(classes.withColumnRenamed("_class", "_of"))
    test = F.col("_idx") - F.col("_first") < F.floor(F.col("_n") * F.lit(test_fraction) + 0.5)
    return indexed.join(c, F.col("_class").eqNullSafe(F.col("_of"))).withColumn(out, test).select(*df.columns, out)


def input_stages(features: list[str], out: str = "features") -> list:
    """Pipeline stages from raw columns to a vector: missing, NaN and infinite
    values become 0 in copies of the columns, at fitting and at scoring."""
    clean = ", ".join(f"CASE WHEN isnan(CAST(`{f}` AS DOUBLE)) OR abs(CAST(`{f}` AS DOUBLE)) = double('Infinity') THEN 0D "
                      f"ELSE coalesce(CAST(`{f}` AS DOUBLE), 0D) END AS `_in{i}`" for i, f in enumerate(features))
    return [SQLTransformer(statement=f"SELECT *, {clean} FROM __THIS__"),
            VectorAssembler(inputCols=[f"_in{i}" for i in range(len(features))], outputCol=out)]


def drop_inputs(df: DataFrame, *more: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_in") and c[3:].isdigit()], *more)


def balanced_class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """weight = n / (classes * n_class). The class counts (one row per class)
    come back as a small literal map."""
    rows = df.groupBy(label).agg(F.count(F.lit(1))).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    counts = {r[0]: r[1] for r in rows}
    n, k = sum(counts.values()), len(counts)
    m = F.create_map(*[x for c, nc in counts.items() if c is not None for x in (F.lit(c), F.lit(n / (k * nc)))])
    return df.withColumn(out, F.try_element_at(m, F.col(label)) if counts else F.lit(None).cast("double"))


def train_forest(df: DataFrame, features: list[str], label: str = "label", assembled: bool = False, **params):
    """``assembled``: ``df`` has the features as a vector in ``features``, as ``input_stages`` makes it."""
    p = dict(FOREST_DEFAULTS)
    p.update(params)
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, probabilityCol="probability", **p)
    if assembled:
        return PipelineModel(stages=[*input_stages(features), rf.fit(df)])
    return Pipeline(stages=[*input_stages(features), rf]).fit(df)


def tune_forest(df: DataFrame, features: list[str], label: str = "label", grid: dict | None = None,
                folds: int = 3, parallelism: int = 4, seed: int = 42):
    """Grid search with k-fold CV on the F1 of class 1. Unlimited depth maps
    to MLlib's maximum of 30."""
    g = grid or {"numTrees": [50, 100, 200], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2, 4],
                 "minInfoGain": [0.0, 0.01, 0.05]}
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed)
    b = ParamGridBuilder()
    for k, vals in g.items():
        b = b.addGrid(rf.getParam(k), vals)
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0)
    cv = CrossValidator(estimator=rf, estimatorParamMaps=b.build(), evaluator=ev, numFolds=folds,
                        parallelism=parallelism, seed=seed)
    return cv.fit(drop_inputs(Pipeline(stages=input_stages(features)).fit(df).transform(df)))


def forest_scores(model, df: DataFrame, out: str = "rf_score") -> DataFrame:
    """P(class 1); a one-class model gives its only probability column."""
    s = model.transform(df)
    p = vector_to_array("probability")
    return drop_inputs(s.withColumn(out, F.when(F.size(p) > 1, p[1]).otherwise(p[0])),
                       "features", "rawPrediction", "probability", "prediction")


def feature_importance(model, features: list[str]):
    """(feature, importance) rows from a fitted forest (model metadata)."""
    rf = model.stages[-1] if hasattr(model, "stages") else model
    imp = rf.featureImportances.toArray().tolist()
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")


class ReconstructionModel:
    """Linear bottleneck (PCA on standardised features) and its error threshold."""

    def __init__(self, pipeline_model, k: int, d: int, threshold: float | None):
        self.model, self.k, self.d, self.threshold = pipeline_model, k, d, threshold

    @staticmethod
    def fit(df: DataFrame, features: list[str], k: int = 32, contamination: float = 0.1,
            key: str | None = None, assembled: bool = False) -> "ReconstructionModel":
        """``assembled``: ``df`` has the features as a vector in ``_raw``, as ``input_stages`` makes it."""
        d = len(features)
        k = max(1, min(k, d // 2))  # a bottleneck: as many components as features would leave no error
        inputs = input_stages(features, "_raw")
        fitted = Pipeline(stages=[*([] if assembled else inputs), StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True),
                                  PCA(k=k, inputCol="_std", outputCol="_z")]).fit(df)
        of = ReconstructionModel(fitted, k, d, None)
        m = ReconstructionModel(PipelineModel(stages=[*inputs, *fitted.stages]), k, d, None) if assembled else of
        with scratch():  # errors of the rows are read several times
            err = cut_lineage(of.errors(df).select("recon_error", *([key] if key else [])))
            m.threshold = exact_percentile(err, "recon_error", 1.0 - contamination, tiebreak=key).first()[0]
        return m

    def errors(self, df: DataFrame, out: str = "recon_error") -> DataFrame:
        s = self.model.transform(df)
        x, z = vector_to_array("_std"), vector_to_array("_z")
        sq = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)
        return drop_inputs(s.withColumn(out, F.greatest(sq(x) - sq(z), F.lit(0.0)) / F.lit(float(self.d))), "_raw", "_std", "_z")


def reconstruction_summary(df: DataFrame, threshold: float, err: str = "recon_error") -> DataFrame:
    """Mean, population std and share of rows strictly over the threshold."""
    return df.agg(F.avg(err).alias("mean_error"), F.stddev_pop(err).alias("std_error"),
                  F.avg(F.when(F.col(err) > F.lit(threshold), 1.0).otherwise(0.0)).alias("anomaly_share"))


def _no_gaps(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: F.coalesce(finite(F.col(f"`{f}`")), F.lit(0.0)) for f in features})


def train_sequence(df: DataFrame, features: list[str], label: str = "label", key=("ts", "flow_id"),
                   length: int = 5, min_sequences: int = 100, targets=None, **lr_params):
    """Logistic regression on the L previous rows' features, over windows of the
    whole order; ``targets`` (a condition on the key columns) picks the rows to
    learn from. L follows ``fitted_length``. Missing values count as 0. Class 1 is told
    from all others. Rows that lie in order with their history (``ordered``, at least L rows of
    it) are read as they are, also where ``df`` is ``KeptRows`` of them (then ``label`` is a double and ``targets``
    a column's name), others ordered and kept as chunks. Returns the model and L."""
    if isinstance(df, KeptRows):
        length = fitted_length(df.n, length, min_sequences)
        return SequenceModel.fit(KeptChunks(df, features, length, [label, targets]), **(SEQUENCE_DEFAULTS | lr_params)), length
    in_order = HISTORY in df.columns
    n = (df.where(~F.col(HISTORY)) if in_order else df).count()
    length = fitted_length(n, length, min_sequences)
    if in_order:
        rows = df.withColumns({"_target": F.col(label).cast("double"), "_use": F.lit(True) if targets is None else targets})
        return SequenceModel.fit(OrderedChunks(rows, features, length, ["_target", "_use"]), **(SEQUENCE_DEFAULTS | lr_params)), length
    rows = _no_gaps(df, features).withColumns({"_target": F.col(label).cast("double"), "_use": F.lit(True) if targets is None else targets})
    with scratch():
        chunks = Chunks(rows, features, list(key), length, ["_target", "_use"], n)
        return SequenceModel.fit(chunks, **(SEQUENCE_DEFAULTS | lr_params)), length


def sequence_scores(model, length: int, df: DataFrame, features: list[str], label: str = "label",
                    key=("ts", "flow_id"), out: str = "lstm_score") -> DataFrame:
    """Score of row i from rows i-L..i-1; the first L rows (no history) get 0. Rows that lie
    in order with their history get it as they are read (and lose their marks), others by a join."""
    if HISTORY in df.columns:
        s = model.margins_in_order(OrderedChunks(df.drop(out), features, length), "_margin").drop(*MARKS)
        return s.withColumn(out, F.coalesce(1 / (1 + F.exp(-F.col("_margin"))), F.lit(0.0))).drop("_margin")
    key = list(key)
    chunks = Chunks(_no_gaps(df, features), features, key, length)
    s = model.margins(chunks, key, "_margin").select(*key, (1 / (1 + F.exp(-F.col("_margin")))).alias(out))
    return df.drop(out).join(s, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0.0)))


def _metric_columns() -> list:
    """Metrics from the columns tp, fp, tn, fn; 0 on a zero divisor."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    return ["tp", "fp", "tn", "fn", F.when(tp + fp + tn + fn > 0, (tp + tn) / (tp + fp + tn + fn)).otherwise(F.lit(0.0)).alias("accuracy"),
            prec.alias("precision"), rec.alias("recall"), F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0)).alias("f1_score")]


def _confusion(label: str, pred: str) -> list:
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    cells = {"tp": (1, 1), "fp": (0, 1), "tn": (0, 0), "fn": (1, 0)}
    return [F.sum(((y == a) & (p == b)).cast("long")).alias(c) for c, (a, b) in cells.items()]


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "prediction", by=()) -> DataFrame:
    """Accuracy, precision, recall, F1 of class 1 (0 on a zero divisor) and
    the confusion counts, in one aggregate (per ``by`` group)."""
    m = df.groupBy(*by).agg(*_confusion(label, pred)) if by else df.agg(*_confusion(label, pred))
    return m.select(*by, *_metric_columns())


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", by=()) -> DataFrame:
    """AUC = sum over distinct scores of pos * (negatives below + neg / 2)
    / (P * N); single-class truth gives 0.5. Per-score counts are a grouped
    aggregate; negatives-below is a distributed prefix sum."""
    by = list(by)
    y = F.col(label).cast("int")
    g = df.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(
        F.sum((y == 1).cast("long")).alias("_pos"), F.sum((y == 0).cast("long")).alias("_neg"))
    c = prefix_sums(g, ["_s"], ["_neg"], partition_by=by, inclusive=False)
    t = c.groupBy(*by).agg(F.sum("_pos").cast("double").alias("_P"), F.sum("_neg").cast("double").alias("_N"),
                           F.sum(F.col("_pos") * (F.col("_neg_cum") + F.col("_neg") / 2.0)).alias("_u"))
    return t.select(*by, F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_u") / (F.col("_P") * F.col("_N")))
                    .otherwise(F.lit(0.5)).alias("roc_auc"))


def evaluate_models(long: DataFrame) -> DataFrame:
    """Long (model, label, prediction, score) rows -> per-model metrics: the rows
    are read once into counts per model and score, which give the confusion counts
    (summed) and the AUC (by the negatives below each score)."""
    y = F.col("label").cast("int")
    per_score = long.groupBy("model", F.col("score").cast("double").alias("_s")).agg(
        F.sum((y == 1).cast("long")).alias("_pos"), F.sum((y == 0).cast("long")).alias("_neg"), *_confusion("label", "prediction"))
    below = prefix_sums(per_score, ["_s"], ["_neg"], partition_by=["model"], inclusive=False)
    t = below.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")], F.sum("_pos").cast("double").alias("_P"),
                                   F.sum("_neg").cast("double").alias("_N"), F.sum(F.col("_pos") * (F.col("_neg_cum") + F.col("_neg") / 2.0)).alias("_u"))
    auc = F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_u") / (F.col("_P") * F.col("_N"))).otherwise(F.lit(0.5))
    return t.select("model", *_metric_columns(), auc.alias("roc_auc"))


def save_models(spark, models: dict, path: str, side_info: dict | None = None) -> None:
    """One MLlib artefact per model under ``path/<name>`` and the side
    information (thresholds, sequence length, feature lists) as one JSON row."""
    import json
    import os
    for name, m in models.items():
        m.write().overwrite().save(os.path.join(path, name))
    spark.createDataFrame([(json.dumps(side_info or {}, sort_keys=True),)], "info string") \
         .coalesce(1).write.mode("overwrite").text(os.path.join(path, "_side_info"))


def load_models(spark, path: str, names: list[str]):
    import json
    import os
    from pyspark.ml import PipelineModel
    models = {n: PipelineModel.load(os.path.join(path, n)) for n in names}
    info = json.loads(spark.read.text(os.path.join(path, "_side_info")).first()[0])
    return models, info
