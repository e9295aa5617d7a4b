"""Streams: an inbox of arriving files, heartbeats, deduplicated events, expiry."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tomewright.sources.files import BOOK_FORMATS

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch_inbox(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "5 seconds", content: bool = False) -> StreamingQuery:
    """Call ``handle`` with each batch of new book files; files that are there already come first.

    A trigger gathers all that has arrived since the last one, so nothing is lost between triggers. The checkpoint
    remembers what was handled over restarts and lets one query run at a time.
    """
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(folder)
    fmt = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    wanted = files.where(fmt.isin(*BOOK_FORMATS)).withColumn("format", fmt)
    writer = (wanted if content else wanted.drop("content")).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def heartbeats(events: DataFrame) -> DataFrame:
    """Latest row of each instance; on a stream, as state by key in complete or update mode."""
    rows = F.struct(*[c for c in events.columns if c != "instance_id"])
    return events.groupBy("instance_id").agg(F.max_by(rows, F.col("id")).alias("r")).select("instance_id", "r.*")


class ProgressLog(StreamingQueryListener):
    """What streams and batch stages are doing, in logs of bounded length: the latest messages, and how long the latest
    stages and phases took. Add it to ``spark.streams`` to hear of every query; batch code tells it of its own stages."""

    def __init__(self, messages: int = 500, stages: int = 50, phases: int = 20, clock: Callable[[], float] = time.time):
        self.messages, self.stages, self.phases = deque(maxlen=messages), deque(maxlen=stages), deque(maxlen=phases)
        self.counts: dict[str, int] = {}
        self.running: dict[str, str] = {}
        self._clock, self._lock, self._open = clock, threading.Lock(), {}

    def say(self, text: str) -> None:
        with self._lock:
            self.messages.append({"time": self._clock(), "text": text})

    def begin(self, kind: str, name: str) -> None:
        """A stage or a phase begins; the one before it ends."""
        with self._lock:
            self._end(kind)
            self._open[kind] = (name, self._clock())

    def end(self, kind: str) -> None:
        with self._lock:
            self._end(kind)

    def _end(self, kind: str) -> None:
        if kind in self._open:
            name, began = self._open.pop(kind)
            (self.stages if kind == "stage" else self.phases).append({"name": name, "seconds": round(self._clock() - began, 3)})

    def snapshot(self, latest: int = 50) -> dict:
        """Copies of the logs, the latest messages alone; how long what is open has run."""
        with self._lock:
            now = self._clock()
            opened = {kind: {"name": name, "seconds": round(now - began, 3)} for kind, (name, began) in self._open.items()}
            return {"messages": list(self.messages)[-latest:], "stages": list(self.stages), "phases": list(self.phases), "counts": dict(self.counts), "running": dict(self.running), "open": opened}

    # --- what Spark tells -------------------------------------------------------------------------

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self.running[str(event.runId)] = event.name or str(event.id)
        self.say(f"started {event.name or event.id}")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        with self._lock:
            self.counts[name] = self.counts.get(name, 0) + p.numInputRows
            self.stages.append({"name": f"{name} {p.batchId}", "seconds": round(p.durationMs.get("triggerExecution", 0) / 1000, 3)})
        if p.numInputRows:
            self.say(f"{name}: batch {p.batchId}, {p.numInputRows} rows")

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            name = self.running.pop(str(event.runId), str(event.id))
        self.say(f"failed {name}: {event.exception[:300]}" if event.exception else f"ended {name}")


def bursts(events: DataFrame, key: str, quiet: str = "5 minutes", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """``key, first, last, n``: runs of a key's events with no gap as long as ``quiet``: what a watcher handles at once,
    when the last of them has been quiet for so long.

    The same on a table and on a stream, where a run comes out once the watermark, ``late`` behind the latest event of
    any key, has passed its end: a last run needs no successor of its own key. State is a run a key. Rows without a key
    or a time are left out.
    """
    stamped = events.withColumn("_at", F.col(time).cast("timestamp")).where(F.col(key).isNotNull() & F.col("_at").isNotNull())
    runs = stamped.withWatermark("_at", late).groupBy(F.session_window("_at", quiet).alias("run"), key)
    return runs.agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count("*").alias("n")).select(key, "first", "last", "n")


def expired(folders: DataFrame, now: str, days: int = 14) -> DataFrame:
    """Folders that nothing has touched for so many days."""
    return folders.where(F.col("touched_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))
