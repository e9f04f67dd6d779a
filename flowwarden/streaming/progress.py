"""Progress of streaming queries, landed so that it outlives the query and the driver."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

PROGRESS = "query_id string, run_id string, batch_id long, started timestamp_ntz, seconds double, input_rows long"


class ProgressLog(StreamingQueryListener):
    """Writes one row for each progress report to Parquet below ``path``: every ``every`` reports, and when
    a query ends. A driver that dies loses at most ``every`` reports, and the batch that then
    runs again reports anew. Register it with ``spark.streams.addListener``."""

    def __init__(self, spark: SparkSession, path: str, every: int = 100):
        self.spark, self.path, self.every = spark, path, every
        self._rows, self._lock, self._ended = [], threading.Lock(), {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:  # noqa: N802
        from datetime import datetime
        p = event.progress
        row = (str(p.id), str(p.runId), int(p.batchId), datetime.fromisoformat(p.timestamp.rstrip("Z")),
               p.durationMs.get("triggerExecution", 0) / 1000.0, int(p.numInputRows))
        with self._lock:
            self._rows.append(row)
            due = len(self._rows) >= self.every
        if due:
            self.flush()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.flush()
        self._ended.setdefault(str(event.runId), threading.Event()).set()

    def flush(self) -> None:
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def wait(self, run_id: str, seconds: float = 60.0) -> bool:
        """Waits until the reports of a run that has ended are landed."""
        return self._ended.setdefault(str(run_id), threading.Event()).wait(seconds)


def progress_summary(spark: SparkSession, path: str) -> DataFrame:
    """For each query (one checkpoint, whatever its runs): batches, rows, runs, mean and longest seconds. A batch
    that ran again counts once, by its last report; reports without a batch's rows (idle triggers) don't count."""
    last = Window.partitionBy("query_id", "batch_id").orderBy(F.col("started").desc(), F.col("input_rows").desc())
    batches = (spark.read.schema(PROGRESS).parquet(path).where("input_rows > 0")
               .withColumn("_n", F.row_number().over(last)).where("_n = 1"))
    return batches.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("input_rows").alias("rows_processed"), F.count_distinct("run_id").alias("runs"),
        F.avg("seconds").alias("mean_batch_seconds"), F.max("seconds").alias("max_batch_seconds"))
