"""Alert table with a commit log: batches and compactions become visible as a whole.

Every micro-batch writes a folder of its own below ``data`` and then publishes
one small entry below ``log``; entries are moved there by a rename that fails if
the name is taken, so an entry is whole or absent. A compaction rewrites the live
folders into a new one and publishes a version: the folders it made and, for each
run, the last batch it took in. Readers go by the highest version and the later
batches, never by listing ``data``. A writer or compaction that dies leaves a
folder that nothing names; ``vacuum`` deletes such and replaced folders.

The log is read on the driver: one entry for each batch since the last vacuum and
one for each version, never alerts.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Taken(RuntimeError):
    """Another writer has published this entry."""


@dataclass
class Live:
    """What readers see: folders of the highest version, and batches after it."""
    version: int = 0
    folders: list[str] = field(default_factory=list)
    upto: dict[str, int] = field(default_factory=dict)
    batches: dict[tuple[str, int], str] = field(default_factory=dict)

    @property
    def paths(self) -> list[str]:
        return self.folders + [self.batches[k] for k in sorted(self.batches)]


class AlertLog:
    """The log below ``path``, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop, self._conf = jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(self._conf)

    def _at(self, path: str):
        return self._hadoop.fs.Path(path)

    def _publish(self, name: str, entry: dict) -> None:
        """An entry under its final name, or ``Taken``."""
        draft, final = self._at(f"{self.path}/log/.{uuid.uuid4().hex}"), self._at(f"{self.path}/log/{name}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        context = self._hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(draft, final, none)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise Taken(name) from e
            raise

    def _entries(self) -> dict[str, dict]:
        log = self._at(f"{self.path}/log")
        if not self._fs.exists(log):
            return {}
        entries = {}
        for status in self._fs.listStatus(log):
            name = status.getPath().getName()
            if name.endswith(".json") and not name.startswith("."):
                stream = self._fs.open(status.getPath())
                try:
                    entries[name] = json.loads(bytes(stream.readAllBytes()))
                except Exception:
                    if self._fs.exists(status.getPath()):  # else it was vacuumed meanwhile
                        raise
                finally:
                    stream.close()
        return entries

    def live(self) -> Live:
        entries = self._entries()
        versions = sorted(n for n in entries if n.startswith("version-"))
        newest = entries[versions[-1]] if versions else {"version": 0, "folders": [], "upto": {}}
        live = Live(newest["version"], newest["folders"], newest["upto"])
        for name, e in entries.items():
            if name.startswith("batch-") and e["batch"] > live.upto.get(e["run"], -1):
                live.batches[e["run"], e["batch"]] = e["folder"]
        return live

    def read(self, schema: StructType | str) -> DataFrame:
        """The live alerts; none before the first batch."""
        paths = [f"{self.path}/{p}" for p in self.live().paths]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def append(self, alerts: DataFrame, run: str, batch: int) -> bool:
        """Publishes a batch of a run; false if that was done before, by a batch that runs again."""
        live = self.live()
        if batch <= live.upto.get(run, -1) or (run, batch) in live.batches:
            return False
        folder = f"data/batch-{run}-{batch:012d}-{uuid.uuid4().hex[:12]}"
        alerts.write.parquet(f"{self.path}/{folder}")
        try:
            self._publish(f"batch-{run}-{batch:012d}.json", {"run": run, "batch": batch, "folder": folder})
        except Taken:
            return False
        return True

    def compact(self, schema: StructType | str, ts: str = "timestamp", rows_per_file: int = 1_000_000) -> int:
        """Rewrites the live alerts ordered by time, in files of up to ``rows_per_file``, and publishes them as the next
        version. Batches that arrive meanwhile stay as they are. Of two
        compactions at a time one ends with ``Taken`` and changes nothing."""
        live = self.live()
        if not live.paths:
            return live.version
        folder = f"data/version-{live.version + 1:012d}-{uuid.uuid4().hex[:12]}"
        alerts = self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in live.paths])
        parts = max(1, -(-alerts.count() // rows_per_file))
        (alerts.repartitionByRange(parts, F.col(ts)).sortWithinPartitions(ts)
               .write.option("maxRecordsPerFile", rows_per_file).parquet(f"{self.path}/{folder}"))
        upto = dict(live.upto)
        for run, batch in live.batches:
            upto[run] = max(batch, upto.get(run, -1))
        self._publish(f"version-{live.version + 1:012d}.json", {"version": live.version + 1, "folders": [folder], "upto": upto})
        return live.version + 1

    def vacuum(self, older_than_seconds: float = 86_400) -> int:
        """Deletes folders that no reader has needed for so long, and the entries of
        batches and versions that the highest version replaces. The age must
        exceed the longest read and the longest batch or compaction."""
        live, before, gone = self.live(), (time.time() - older_than_seconds) * 1000, 0
        published = {e.get("folder") for e in self._entries().values()} | set(live.paths)
        for name, e in self._entries().items():
            status = self._at(f"{self.path}/log/{name}")
            replaced = e["batch"] <= live.upto.get(e["run"], -1) if name.startswith("batch-") else e["version"] < live.version
            if replaced and self._fs.getFileStatus(status).getModificationTime() <= before:
                self._fs.delete(status, False)
                published -= {e.get("folder")} - set(live.paths)
        data = self._at(f"{self.path}/data")
        for status in self._fs.listStatus(data) if self._fs.exists(data) else ():
            if f"data/{status.getPath().getName()}" not in published and status.getModificationTime() <= before:
                gone += self._fs.delete(status.getPath(), True)
        return gone


def logged_batch_writer(path: str, run: str, hooks: Iterable[Callable[[DataFrame, int], None]] = (),
                        compact_every: int | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: each batch of alerts is published once in the log;
    after every ``compact_every`` batches the live folders are rewritten."""
    hooks = list(hooks)

    def write(alerts: DataFrame, batch_id: int) -> None:
        log = AlertLog(alerts.sparkSession, path)
        alerts = alerts.persist() if hooks else alerts
        try:
            log.append(alerts, run, batch_id)
            for h in hooks:
                h(alerts, batch_id)
        finally:
            if hooks:
                alerts.unpersist()
        if compact_every and (batch_id + 1) % compact_every == 0:
            try:
                log.compact(alerts.schema)
            except Taken:  # another stream of this log has compacted
                pass
    return write
