"""Model invariants: split fraction, AUC agreement and above chance,
save -> load gives identical scores, metrics on edge cases."""

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import MEDIUM
from flowwarden.operators import clean as B
from flowwarden.operators import models as G
from flowwarden.operators.features import extract_network_features
from flowwarden.plans.pipeline import FlowFeatureModel, FlowFeaturePipeline
from flowwarden.sources.tables import read_flows
from flowwarden.streaming.jobs import scratch_path

FEATS = ["duration", "src_bytes", "dst_bytes", "packet_size", "count", "srv_count", "is_udp", "is_icmp"]


def _frame(spark):
    f = B.standardize_labels(read_flows(spark, MEDIUM), "label_raw", out="label")
    return extract_network_features(f, time_col="ts")


def test_split_fraction(spark):
    d = _frame(spark)
    train, test = G.train_test_split(d, "flow_id")
    n, t = d.count(), test.count()
    assert train.count() + t == n and abs(t / n - 0.2) < 0.02


def test_auc_matches_mllib_and_beats_chance(spark):
    d = _frame(spark)
    m = G.train_forest(d, FEATS, "label", numTrees=10, maxDepth=5)
    s = G.forest_scores(m, d)
    ours = G.roc_auc(s, "label", "rf_score").first()[0]
    ev = BinaryClassificationEvaluator(rawPredictionCol="rf_score", labelCol="label", numBins=0)
    ref = ev.evaluate(s.withColumn("label", F.col("label").cast("double")))
    assert abs(ours - ref) < 1e-9 and ours > 0.9


def test_single_class_auc_and_zero_division(spark):
    df = spark.createDataFrame([(1, 0, 0.3), (1, 0, 0.7)], "label int, prediction int, score double")
    assert G.roc_auc(df, "label", "score").first()[0] == 0.5
    m = G.classification_metrics(df, "label", "prediction").first()
    assert (m.precision, m.recall, m.f1_score, m.accuracy) == (0.0, 0.0, 0.0, 0.0)


def test_save_load_identical(spark):
    d = _frame(spark)
    m = G.train_forest(d, FEATS, "label", numTrees=5, maxDepth=4)
    path = scratch_path(spark, "m")
    G.save_models(spark, {"rf": m}, path, {"features": FEATS})
    loaded, info = G.load_models(spark, path, ["rf"])
    a = G.forest_scores(m, d).select("flow_id", F.col("rf_score").alias("a"))
    b = G.forest_scores(loaded["rf"], d).select("flow_id", F.col("rf_score").alias("b"))
    assert a.join(b, "flow_id").where(F.col("a") != F.col("b")).count() == 0 and info["features"] == FEATS


def test_reconstruction_threshold_and_share(spark):
    d = _frame(spark)
    rm = G.ReconstructionModel.fit(d, FEATS, k=3, contamination=0.1, key="flow_id")
    e = rm.errors(d)
    share = e.agg(F.avg((F.col("recon_error") > rm.threshold).cast("double"))).first()[0]
    assert abs(share - 0.1) < 0.01


def test_pipeline_save_load_same_output(spark):
    f = B.standardize_labels(read_flows(spark, MEDIUM), "label_raw", out="label").drop("label_raw")
    f = f.where(F.col("ts") < "2024-01-08")
    model = FlowFeaturePipeline(k=10, window=20).fit(f)
    path = scratch_path(spark, "pipe")
    model.save(path)
    again = FlowFeatureModel.load(spark, path)
    a = model.transform(f, keep=["flow_id"])
    b = again.transform(f, keep=["flow_id"])
    assert a.columns == b.columns and len(a.columns) == 11
    assert a.exceptAll(b).count() == 0


def test_tune_forest_small_grid(spark):
    d = _frame(spark)
    cv = G.tune_forest(d, FEATS, "label", grid={"numTrees": [5, 10], "maxDepth": [3]}, folds=2, parallelism=2)
    assert len(cv.avgMetrics) == 2 and max(cv.avgMetrics) > 0.8


def test_grid_search_votes_are_the_models(spark, tmp_path):
    """Votes of all trees are the model's probabilities, those of the first trees a
    part of them; every point of the grid has an F1 of its folds."""
    import numpy as np
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    from flowwarden.operators.grid import Nodes, grid_search_forest
    d = _frame(spark)
    x = G.drop_inputs(G.Pipeline(stages=G.input_stages(FEATS)).fit(d).transform(d)).select("label", "features")
    m = RandomForestClassifier(labelCol="label", numTrees=6, maxDepth=5, seed=3).fit(x)
    m.write().save(f"{tmp_path}/m")
    nodes = Nodes(spark.read.parquet(f"{tmp_path}/m/data").collect())
    rows = m.transform(x).select(vector_to_array("features").alias("x"), vector_to_array("probability")[1].alias("p")).limit(300).collect()
    votes = nodes.votes(np.array([r.x for r in rows]), [2, 6])
    assert np.allclose(votes[6], [r.p for r in rows]) and not np.allclose(votes[2], votes[6])
    assert nodes.depth() == max(t.depth for t in m.trees)
    got = grid_search_forest(d, FEATS, grid={"numTrees": [3, 6], "maxDepth": [2, 4], "minInstancesPerNode": [1], "minInfoGain": [0.0]}, folds=2).collect()
    assert {(r.num_trees, r.max_depth) for r in got} == {(3, 2), (6, 2), (3, 4), (6, 4)} and all(0 <= r.mean_f1 <= 1 for r in got)
    assert max(r.mean_f1 for r in got) > 0.8
    f1 = {(r.num_trees, r.max_depth): r.mean_f1 for r in grid_search_forest(d, FEATS, grid={"numTrees": [3], "maxDepth": [2, 25, 30], "minInstancesPerNode": [40], "minInfoGain": [0.01]}, folds=2).collect()}
    alone = grid_search_forest(d, FEATS, grid={"numTrees": [3], "maxDepth": [25], "minInstancesPerNode": [40], "minInfoGain": [0.01]}, folds=2).first()
    assert f1[3, 25] == f1[3, 30] == alone.mean_f1  # one forest stands for both


def _gaps(spark):
    from flowwarden.sources.tables import flows_with_gaps
    g = B.standardize_labels(flows_with_gaps(read_flows(spark, MEDIUM)), "label_raw", out="label")
    return g.drop("rf_score", "recon_error", "lstm_score", "label_raw")


def test_models_take_missing_and_infinite_values(spark):
    d = extract_network_features(_gaps(spark), time_col="ts")
    rf = G.train_forest(d, FEATS, "label", numTrees=5, maxDepth=4)
    s = G.forest_scores(rf, d)
    assert s.count() == d.count() and s.columns == d.columns + ["rf_score"]
    rec = G.ReconstructionModel.fit(d, FEATS, key="flow_id")  # default size
    assert rec.k < len(FEATS) and rec.threshold > 0
    assert rec.errors(d).where("recon_error IS NULL OR isnan(recon_error)").count() == 0


def test_sequence_scores_of_short_batches(spark):
    """A fitted length holds for a batch of any size; rows without history get 0."""
    d = _frame(spark)
    model, length = G.train_sequence(d, ["duration", "count"], "label", length=5)
    assert length == 5
    for n in (0, 1, 5, 8, 10):
        part = d.where(F.col("flow_id") < n)
        got = G.sequence_scores(model, length, part, ["duration", "count"], "label").collect()
        assert len(got) == n and sum(r.lstm_score == 0 for r in got) >= min(n, 5)
        assert sum(r.lstm_score > 0 for r in got) == max(0, n - 5)


def test_infinite_cell_equals_missing_cell(spark):
    f = B.standardize_labels(read_flows(spark, MEDIUM), "label_raw", out="label").drop("label_raw")
    f = f.where(F.col("ts") < "2024-01-04")
    out = []
    for bad in (float("inf"), None):
        g = f.withColumn("src_bytes", F.when(F.col("flow_id") == 17, F.lit(bad)).otherwise(F.col("src_bytes")))
        out.append(FlowFeaturePipeline(k=12, window=20).fit_transform(g)[1])
    assert out[0].columns == out[1].columns and out[0].exceptAll(out[1]).count() == 0


def test_chain_with_held_out_rows(spark):
    from flowwarden.plans import training as T
    f = _gaps(spark).where(F.col("ts") < "2024-01-08")
    models, prepared = T._train(f, window=20, k=20, forest_params={"numTrees": 10, "maxDepth": 6})
    assert prepared.count() == f.count()
    s = T.score_prepared(models, prepared).where("is_test")
    for c in T.SCORES:
        bounds = s.agg(F.min(c), F.max(c)).first()
        assert 0 <= bounds[0] <= bounds[1] <= 1
    assert G.roc_auc(s, "label", "rf_score").first()[0] > 0.8
    assert G.roc_auc(s, "label", "lstm_score").first()[0] > 0.3
    path = scratch_path(spark, "det")
    T.save_detector(spark, models, path)
    again = T.score_flows(T.load_detector(spark, path), f)
    a = T.score_flows(models, f).select("flow_id", *T.SCORES)
    assert a.exceptAll(again.select("flow_id", *T.SCORES)).count() == 0


def test_stratified_split_is_exact_per_class(spark):
    from pyspark.sql import functions as F

    from flowwarden.operators.models import stratified_split
    sizes = {"hot": 4000, "a": 13, "b": 12, "one": 1, "two": 2, "three": 3, None: 8}
    rows = [(None if i == 5 else f"{c}{i}", c, i) for c, n in sizes.items() for i in range(n)] + [("a1", "a", 1)]  # a repeated row
    df = spark.createDataFrame(rows, "k string, label string, _of_row int").repartition(7)
    split = stratified_split(df, "k")
    got = {r.label: (r.n, r.t) for r in split.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert got == {c: (n + (c == "a"), int((n + (c == "a")) * 0.2 + 0.5)) for c, n in sizes.items()}
    again = stratified_split(df.repartition(3), "k")
    assert split.where("is_test").select("k", "label").exceptAll(again.where("is_test").select("k", "label")).count() == 0
    assert stratified_split(df.limit(0), "k").count() == 0


def test_sequence_windows_need_their_columns_alone(spark):
    """Scores of other models beside a sequence's columns are neither computed nor kept."""
    from pyspark.sql import functions as F

    from flowwarden.operators.rolling import sequence_windows
    d = spark.range(50).select(F.col("id").alias("flow_id"), F.col("id").alias("ts"), (F.col("id") % 2).alias("label"), (F.col("id") * 1.0).alias("x"),
                               F.raise_error(F.lit("computed")).alias("other"))
    rows = {r.flow_id: r for r in sequence_windows(d, ["x"], length=3).collect()}
    assert sorted(rows) == list(range(3, 50)) and rows[9].sequence == [[6.0], [7.0], [8.0]] and rows[9].target == 1


def test_scratch_ends_with_its_rows(spark):
    """What is settled stays, what it was made from is deleted."""
    import glob

    from flowwarden.session import checkpoint_dir, cut_lineage, scratch, settled
    left = lambda: glob.glob(checkpoint_dir(spark).removeprefix("file:") + "/scratch/*")
    before = set(left())
    with scratch():
        out = settled(lambda: cut_lineage(spark.range(100)).where("id % 2 = 0"))
        assert len(set(left()) - before) == 1 and out.count() == 50
        kept = cut_lineage(out.where("id > 50"), lasting=True)
        done = settled(lambda: out)
        assert done.count() == 50
    assert set(left()) == before and kept.count() == 24


def test_scratch_ends_with_its_shuffles(spark):
    """Shuffle files of a step inside go with its query, not with the session."""
    import time

    from flowwarden.session import SHUFFLE_CLEANUP, cut_lineage, scratch
    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
                     if "/shuffle_" in f}
    before, was = files(), spark.conf.get(SHUFFLE_CLEANUP)
    with scratch():
        kept = cut_lineage(spark.range(20_000).repartitionByRange(4, "id"))
        end = time.time() + 15
        while files() - before and time.time() < end:
            time.sleep(0.2)  # files are deleted in the background
        assert not files() - before
        counts = kept.groupBy((F.col("id") % 10).alias("k")).count()
        assert len(counts.collect()) == len(counts.collect()) == 10  # a frame that is read again shuffles again
    assert spark.conf.get(SHUFFLE_CLEANUP) == was


def test_limited_forest_is_the_one_fitted_with_the_limits(spark, tmp_path):
    """Trees cut at a depth or a least gain are those that MLlib grows with it (all features at every node,
    as drawn ones depend on the order of nodes); all points of a fold share a fit."""
    import numpy as np
    from pyspark.ml.classification import RandomForestClassifier

    from flowwarden.operators import grid
    d = _frame(spark)
    x = G.drop_inputs(G.Pipeline(stages=G.input_stages(FEATS)).fit(d).transform(d)).select(
        F.when(F.xxhash64("flow_id") % 4 == 0, F.lit(1.0)).otherwise(F.col("label").cast("double")).alias("label"), "features")

    def nodes(depth, gain):
        path = f"{tmp_path}/{depth}-{gain}"
        RandomForestClassifier(numTrees=3, maxDepth=depth, minInfoGain=gain, minInstancesPerNode=20, featureSubsetStrategy="all", seed=5).fit(x).write().save(path)
        return grid.Nodes(spark.read.parquet(f"{path}/data").collect())

    whole = nodes(10, 0.0)
    rows = np.array([r.features.toArray() for r in x.limit(500).collect()])
    seen = set()
    for depth, gain in [(10, 0.002), (4, 0.0), (7, 0.001), (0, 0.0), (10, 0.4), (9, 0.0)]:
        cut, fitted = whole.limited(depth, gain), nodes(depth, gain)
        assert cut.depth() == fitted.depth() <= depth
        assert np.allclose(cut.votes(rows, [1, 3])[3], fitted.votes(rows, [3])[3])
        assert np.allclose(whole.votes(rows, [3], [whole.shares(cut), whole.share])[3], [cut.votes(rows, [3])[3], whole.votes(rows, [3])[3]])
        seen.add(cut.depth())
    assert len(seen) > 2 and whole.depth() == 10

    fits = []
    fit = RandomForestClassifier.fit
    RandomForestClassifier.fit = lambda self, *a: fits.append(self) or fit(self, *a)
    try:
        got = grid.grid_search_forest(d, FEATS, grid={"numTrees": [2, 4], "maxDepth": [2, 5], "minInstancesPerNode": [1, 9], "minInfoGain": [0.0, 0.3]}, folds=2).collect()
    finally:
        RandomForestClassifier.fit = fit
    assert len(fits) == 4 and len(got) == 16 and all(0 <= r.mean_f1 <= 1 for r in got)


def test_sequence_model_is_the_logistic_regression_of_its_windows(spark, monkeypatch):
    """The model of the chunks is MLlib's of whole windows (which keeps all windows, so it is no longer fitted on them), also over
    partitions of one row, and a score doesn't depend on where a chunk begins."""
    import numpy as np
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from flowwarden.operators.rolling import sequence_windows
    from flowwarden.operators.sequence import Chunks
    feats = ["duration", "packet_size", "count", "is_udp", "zero"]
    d = _frame(spark).withColumn("zero", F.lit(0.0)).withColumn("duration", F.when(F.col("flow_id") % 9 > 0, F.col("duration")))
    d = d.withColumn("label", F.when(F.lag("count").over(Window.orderBy("ts", "flow_id")) > 90, 1).otherwise(F.col("label")))
    test = G.split_flag("flow_id")
    windows = sequence_windows(d.fillna(0, feats), feats).withColumn("v", array_to_vector(F.flatten("sequence"))).withColumn("y", F.col("target").cast("double"))
    ml = Pipeline(stages=[StandardScaler(inputCol="v", outputCol="z", withMean=True),
                          LogisticRegression(featuresCol="z", labelCol="y", weightCol="weight", regParam=0.01, maxIter=500, tol=1e-12)]).fit(
        G.balanced_class_weights(windows.where(~test), "y"))
    want = {r.flow_id: r.p for r in ml.transform(windows).select("flow_id", vector_to_array("probability")[1].alias("p")).collect()}

    def no(*a):
        raise AssertionError("keeps all windows")

    monkeypatch.setattr(LogisticRegression, "_fit", no)
    model, length = G.train_sequence(d, feats, "label", targets=~test, regParam=0.01)
    got = {r.flow_id: r.lstm_score for r in G.sequence_scores(model, length, d, feats).collect()}
    assert length == 5 and len(want) == len(got) - 5 and sum(got[k] == 0 for k in set(got) - set(want)) == 5
    assert max(abs(got[k] - p) for k, p in want.items()) < 1e-5
    assert np.std(list(want.values())) > 0.05
    few = d.orderBy("ts", "flow_id").limit(40)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    margins = []
    try:
        for partitions, rows in (("40", 1024), ("1", 3), ("3", 7)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            c = Chunks(few.fillna(0, feats), feats, ["ts", "flow_id"], 5, chunk_rows=rows)
            margins.append({r.flow_id: r.m for r in model.margins(c, ["ts", "flow_id"], "m").collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(margins[0]) == 35 and margins[0] == margins[1] == margins[2]


def test_raw_columns_pass_through_the_chain_without_a_join(spark):
    """Each flow stays one row with its raw values, also where an id occurs twice (a join by id made more rows, and moved all columns)."""
    from flowwarden.plans import training as T
    f = _gaps(spark).where(F.col("ts") < "2024-01-03")
    models, prepared = T._train(f, window=20, k=20, forest_params={"numTrees": 3, "maxDepth": 3})
    raw = ["flow_id", "label", *T.CONTEXT]
    assert prepared.select(raw).exceptAll(f.select(raw)).count() == 0 and prepared.count() == f.count()
    twice = f.withColumn("flow_id", F.when(F.col("flow_id") == 3, F.lit(2)).otherwise(F.col("flow_id")).cast("long"))
    s = T.score_flows(models, twice)
    assert s.count() == f.count() and s.select(f.columns).exceptAll(twice).count() == 0
    assert s.where(F.greatest(*T.SCORES).between(0, 1)).count() == f.count()


def test_rolling_columns_of_ordered_rows_are_those_of_the_operator(spark, monkeypatch):
    """Read from rows kept in order, whatever the chunks, partitions and slices; values don't depend on where chunks begin."""
    from flowwarden.operators import ordered as O
    from flowwarden.operators.rolling import rolling_features
    d = spark.range(3000).select(F.col("id").alias("k"), F.floor(F.col("id") / 7).alias("t"), (F.sin(F.col("id") * 1.7) * 100 + F.when(F.col("id") == 900, 1e9).otherwise(0.0)).alias("x"),
                                 (F.col("id") * 37 % 11).cast("int").alias("y"), F.col("id").cast("string").alias("s")).orderBy(F.rand(3))
    d = d.withColumn("t", F.when(F.col("k") >= 14, F.col("t")))  # a key without a value comes first
    names = [f"{c}_{s}" for c in "xy" for s in ("rolling_mean", "rolling_std", "deviation")]
    want = {r.k: r for r in rolling_features(d, key=("t", "k"), window=20, cols=["x", "y"]).collect()}
    got = []
    for chunk, slice_rows, parts in ((100, 10_000, 4), (256, 700, 3), (2000, 100, 16)):
        with monkeypatch.context() as m:
            m.setattr(O, "range_partitions", lambda *a, parts=parts: parts)
            o = O.OrderedRows(d, ["t", "k"], 24, chunk, slice_rows)
            x = o.rolling({"x": "x", "y": "y"}, 20, 5)
            assert o.n == 3000
            rows = {r.k: r for r in x.where(f"NOT {O.HISTORY}").collect()}
            assert len(rows) == 3000 and x.count() >= 3000 and all(rows[k].s == str(k) for k in rows)
            got.append([[rows[k][n] for n in names] for k in sorted(rows)])
    assert got[0] == got[1] == got[2]
    for k, row in enumerate(got[0]):
        assert row == pytest.approx([want[k][n] for n in names], rel=1e-6, abs=1e-6), k


def test_training_and_scoring_keep_rows_as_they_came(spark):
    """Wide rows (features, rolling columns) are neither kept nor shuffled: what a step keeps is a few bytes a row
    (features and their rolling columns were kept, and moved again for the sequence model)."""
    import glob
    import os
    from flowwarden.plans import training as T
    from flowwarden.session import checkpoint_dir, scratch
    f = _gaps(spark).where(F.col("ts") < "2024-01-08")
    n = f.count()
    with scratch():
        models, prepared = T._train_in_order(f, window=20, k=20, forest_params={"numTrees": 3, "maxDepth": 3})
        s = T.score_flows(models, f)
        assert s.count() == n and prepared.where("NOT _history").count() == n
        plan = s._jdf.queryExecution().executedPlan().toString()
        assert "RangePartitioning" not in plan and "hashpartitioning" not in plan and "Window" not in plan
        kept = sum(os.path.getsize(p) for p in glob.glob(checkpoint_dir(spark).removeprefix("file:") + "/scratch/*/*.parquet"))
        assert kept < 2 * 60 * n  # two orders of 17 columns; features alone are 20 doubles
    # scores in order equal those by a join
    general = T.score_prepared(models, T._own(T.prepare(f, window=20, k=20, history=5)[1])).select("flow_id", "lstm_score").collect()
    in_order = {r.flow_id: r.lstm_score for r in T.score_flows(models, f).select("flow_id", "lstm_score").collect()}
    assert all(abs(in_order[r.flow_id] - r.lstm_score) < 1e-9 for r in general) and len(general) == n


def test_models_are_fitted_on_kept_features(spark, monkeypatch):
    """Features are worked out once for all fits (each step of the sequence model, each reading of the forest and of the
    reconstruction worked them out again), and the sequence model is the same."""
    from flowwarden.operators import ordered as O
    from flowwarden.operators import sequence as Q
    from flowwarden.plans import training as T
    from flowwarden.session import scratch
    f = _gaps(spark).where(F.col("ts") < "2024-01-03")
    with scratch():
        pipe, x = T.prepare(f, window=20, k=20, history=5)
        feats = T.feature_columns(pipe)
        monkeypatch.setattr(O, "CHUNK_ROWS", 64)
        kept = T._kept(x, feats, "flow_id")
        own = T._own(x).select("flow_id", "label", "is_test", *feats)
        assert kept.n == own.count() and kept.rows(own.columns).exceptAll(own).count() == 0
        (a, n), (b, m) = G.train_sequence(x, feats, targets=~G.split_flag("flow_id")), G.train_sequence(kept, feats, "_target", targets="_use")
        assert n == m and a.coefficients == pytest.approx(b.coefficients, rel=1e-6, abs=1e-9) and a.intercept == pytest.approx(b.intercept, rel=1e-6)

        v = {r.flow_id: r.features.toArray().tolist() for r in kept.vectors(feats, ["flow_id"]).collect()}
        assert v == {r.flow_id: [float(r[c]) for c in feats] for r in own.collect()}
        train = own.where("NOT is_test")
        rec = [G.ReconstructionModel.fit(d, feats, key="flow_id", assembled=made) for d, made in ((train, False), (kept.vectors(feats, ["is_test", "flow_id"], "_raw").where("NOT is_test"), True))]
        assert rec[0].threshold == pytest.approx(rec[1].threshold, rel=1e-9) and len(rec[0].model.stages) == len(rec[1].model.stages)

        def no(*a):
            raise AssertionError("works features out at each step")

        monkeypatch.setattr(Q.OrderedChunks, "map", no)
        T.fit_models(x, feats, forest_params={"numTrees": 2, "maxDepth": 2})


def test_moments_and_bins_are_those_of_the_aggregates(spark):
    """Without values, constant, with gaps and infinite values; no row per column and value is made."""
    from flowwarden.functions.scalars import finite
    from flowwarden.operators.moments import bin_counts, column_moments
    from flowwarden.operators.select import mutual_info_scores
    i = F.col("id")
    x = spark.range(5000).select("id", F.sin("id").alias("a"), F.when(i % 7 > 0, i % 11).alias("b"), F.lit(0.1).alias("k"), F.lit(None).cast("double").alias("n"),
                                 F.when(i % 13 == 0, float("inf")).when(i % 17 == 0, float("nan")).otherwise(F.sqrt("id")).alias("c"), F.when(i % 5 > 0, F.concat(F.lit("y"), i % 300)).alias("y"))
    cols = ["a", "b", "k", "n", "c"]
    got = column_moments(x, cols)
    for c, (n, mean, squares, low, high) in zip(cols, got):
        want = x.agg(F.count(finite(c)), F.avg(finite(c)), F.var_pop(finite(c)), F.min(finite(c)), F.max(finite(c))).first()
        assert n == want[0]
        if n:
            assert [mean, squares / n, low, high] == pytest.approx(want[1:], rel=1e-9, abs=1e-12)
    assert got[2][2] == 0
    assert column_moments(x.where("id < 0"), ["a"])[0][0] == 0
    bounds = [(None, None) if not m[0] else (m[3], m[4]) for m in got]
    n = {(r.feature, r.bin, r._y): r.nxy for r in bin_counts(x, cols, "y", bounds, 10).collect()}
    width = (bounds[4][1] - bounds[4][0]) / 10
    at = F.least(F.floor((F.col("c") - F.lit(bounds[4][0])) / F.lit(width)), F.lit(9))
    want = {("c", r.bin, r.y): r["count"] for r in x.where(finite("c").isNotNull()).groupBy(at.alias("bin"), "y").count().collect()}
    assert {k: v for k, v in n.items() if k[0] == "c"} == want
    assert "Expand" not in mutual_info_scores(x, "y", cols)._jdf.queryExecution().executedPlan().toString()
