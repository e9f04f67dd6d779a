"""The alert table's commit log: readers see batches and compactions whole."""

import pytest
from pyspark.sql import functions as F

from flowwarden.streaming import jobs as J
from flowwarden.streaming.alert_log import AlertLog, Taken, logged_batch_writer

SCHEMA = "alert_id string, timestamp timestamp"


def _alerts(spark, ids):
    return spark.createDataFrame([(f"A{i:03d}", f"2024-01-{1 + i % 9:02d} 00:00:00") for i in ids], "alert_id string, t string").select(
        "alert_id", F.col("t").cast("timestamp").alias("timestamp"))


def _ids(log):
    return sorted(r.alert_id for r in log.read(SCHEMA).collect())


def test_killed_writers_and_compactions_are_not_seen(spark, monkeypatch):
    log = AlertLog(spark, J.scratch_path(spark, "log"))
    assert _ids(log) == [] and log.compact(SCHEMA) == 0 and log.vacuum() == 0
    for b in range(3):
        assert log.append(_alerts(spark, [2 * b, 2 * b + 1]), "one", b)
    assert not log.append(_alerts(spark, [0, 1]), "one", 0)  # a batch that runs again
    log.append(_alerts(spark, [6]), "two", 0)
    want = [f"A{i:03d}" for i in range(7)]
    assert _ids(log) == want

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(AlertLog, "_publish", killed)
        for act in (lambda: log.compact(SCHEMA), lambda: log.append(_alerts(spark, [7]), "one", 3)):
            with pytest.raises(KeyboardInterrupt):
                act()
            assert _ids(log) == want
    early = log.read(SCHEMA)  # a reader from before the compaction
    assert log.compact(SCHEMA) == 1 and _ids(log) == want and len(log.live().paths) == 1
    assert early.count() == 7
    assert not log.append(_alerts(spark, [4, 5]), "one", 2)  # replayed after it was taken in
    assert log.append(_alerts(spark, [7]), "one", 3) and _ids(log) == want + ["A007"]
    assert log.vacuum() == 0 and log.vacuum(older_than_seconds=-60) == 6  # four batches and two killed folders
    assert _ids(log) == want + ["A007"] and log.compact(SCHEMA) == 2 and _ids(log) == want + ["A007"]


def test_one_of_two_compactions_wins(spark, monkeypatch):
    log = AlertLog(spark, J.scratch_path(spark, "log"))
    log.append(_alerts(spark, range(5)), "one", 0)
    publish = AlertLog._publish

    def late(self, name, entry):  # another compaction ends first
        monkeypatch.setattr(AlertLog, "_publish", publish)
        assert AlertLog(spark, log.path).compact(SCHEMA) == 1
        log.append(_alerts(spark, [5]), "one", 1)
        publish(self, name, entry)

    monkeypatch.setattr(AlertLog, "_publish", late)
    with pytest.raises(Taken):
        log.compact(SCHEMA)
    assert _ids(log) == [f"A{i:03d}" for i in range(6)] and log.live().version == 1


def test_files_follow_the_rows(spark):
    log = AlertLog(spark, J.scratch_path(spark, "log"))
    for b in range(2):
        log.append(_alerts(spark, range(50 * b, 50 * b + 50)), "one", b)
    log.compact(SCHEMA, rows_per_file=30)
    files = log.read(SCHEMA).groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 4 and max(r["count"] for r in files) <= 30


def test_stream_with_compactions(spark):
    src, path, ck = (J.scratch_path(spark, n) for n in ("log-in", "log-out", "log-ck"))
    for i in range(5):
        _alerts(spark, [3 * i, 3 * i + 1, 3 * i + 2]).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    seen = []
    q = (stream.writeStream.foreachBatch(logged_batch_writer(path, J.run_id(ck), [lambda b, i: seen.append(b.count())], compact_every=2))
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    log = AlertLog(spark, path)
    assert _ids(log) == [f"A{i:03d}" for i in range(15)] and seen == [3] * 5
    assert log.live().version == 2 and len(log.live().paths) == 2
