"""Landed progress: what a query reported outlives it."""

from types import SimpleNamespace as Event

from flowwarden.streaming import jobs as J
from flowwarden.streaming.progress import ProgressLog, progress_summary


def _report(run, batch, rows, ms, second):
    return Event(progress=Event(id="q", runId=run, batchId=batch, timestamp=f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}.500Z",
                                durationMs={"triggerExecution": ms}, numInputRows=rows))


def test_a_thousand_batches_of_two_runs(spark):
    path = J.scratch_path(spark, "progress")
    for run, batches in (("one", range(0, 600)), ("two", range(599, 1000))):  # batch 599 ran again
        log = ProgressLog(spark, path, every=300)
        for b in batches:
            log.onQueryProgress(_report(run, b, 10, 100 if run == "one" else 200, b + (run == "two")))
        log.onQueryProgress(_report(run, max(batches) + 1, 0, 1, 1200))  # an idle trigger
        log.onQueryTerminated(Event(runId=run))
        assert log.wait(run, 1)
    got = progress_summary(spark, path).collect()
    assert [(r.query_id, r.batches, r.rows_processed, r.runs, r.max_batch_seconds) for r in got] == [("q", 1000, 10_000, 2, 0.2)]
    assert abs(got[0].mean_batch_seconds - (599 * 0.1 + 401 * 0.2) / 1000) < 1e-9
