"""Watching a folder. At every tick the tree is listed and held against the stored
index: what was added, changed or unlinked is the tick's change, so a file that goes
is seen when nothing comes, and a file that changes is seen again. A new or changed
file waits until its size and time have been the same for ``stable_ms``, as it may be
half written; then it is indexed, once. What waits is kept as a table of the files
that changed lately; after a restart they wait anew, and nothing is lost, as the next
listing is held against the index again."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import detect_changes
from ..plans.storage import cut, publish, read_text, rows
from ..plans.store import Store
from ..sources import ingest
from .ticks import ticks

# What a change is called, by its status.
EVENTS = {"added": "add", "modified": "change", "deleted": "unlink"}


def changes(store: Store, root: str) -> DataFrame:
    """(relative_path, event, size, mtime): the tree as it is now against the index.
    event is add, change or unlink; an unlinked file has no size."""
    now = cut(ingest.scan(store.spark, root, with_content=False), "listing")
    found = detect_changes(store.table("files", store.project_of(root)), now, "relative_path", ["size", "mtime"]).where("status <> 'unchanged'")
    event = F.element_at(F.create_map(*[F.lit(x) for pair in EVENTS.items() for x in pair]), F.col("status"))
    return found.join(now.select("relative_path", "size", "mtime"), "relative_path", "left").select("relative_path", event.alias("event"), "size", "mtime")


class Waiting:
    """Changes that have been seen, each with the time since when it is as it is."""

    def __init__(self, stable_ms: int) -> None:
        self.stable_ms, self.seen = stable_ms, None

    def ready(self, found: DataFrame, now_ms: int) -> DataFrame:
        """What of ``found`` held for long enough, or went."""
        since = F.lit(now_ms).cast("long")
        if self.seen is not None:
            before = self.seen.select("relative_path", F.col("size").alias("_s"), F.col("mtime").alias("_m"), "since")
            same = (F.col("size") == F.col("_s")) & (F.col("mtime") == F.col("_m"))
            found = found.join(before, "relative_path", "left").select("relative_path", "event", "size", "mtime", F.when(same, F.col("since")).otherwise(since).alias("since"))
        else:
            found = found.withColumn("since", since)
        self.seen = cut(found, "waiting")
        return self.seen.where((F.col("event") == "unlink") | (F.col("since") <= now_ms - self.stable_ms)).drop("since")


def _name(spark: SparkSession, checkpoint: str) -> str:
    """A name that belongs to a checkpoint: a new one gets a new name."""
    path = f"{checkpoint.rstrip('/')}-name"
    publish(spark, path, f"watch-{uuid.uuid4().hex}")
    return read_text(spark, path)


def watch(spark: SparkSession, root: str, store: Store, checkpoint: str, every: str | None = "1 second", stable_ms: int = 500) -> StreamingQuery:
    """Keeps ``store`` up to date; ``every`` None handles what is there, once it is
    stable, and stops."""
    name, pid, waiting = _name(spark, checkpoint), store.project_of(root), Waiting(stable_ms)

    def apply(batch: DataFrame, number: int) -> None:
        while True:
            found = waiting.ready(changes(store, root), int(time.time() * 1000))
            if not found.isEmpty():
                fresh = found.where("event <> 'unlink'").select("relative_path")
                gone = found.where("event = 'unlink'").select(F.xxhash64(F.lit(pid), "relative_path").alias("id"))
                store.replace_files(ingest.scan(spark, root).join(fresh, "relative_path", "left_semi"), f"{name}-{number}-{uuid.uuid4().hex}", gone, pid)
            if every is not None or rows(waiting.seen) == 0:
                return
            time.sleep(stable_ms / 1000)

    writer = ticks(spark).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
