"""Debounced change streams: changes of one key with a gap at most between them
are one session. The same code serves batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounce(changes: DataFrame, key: str, ts: str, gap: str = "1 second", lateness: str | None = None) -> DataFrame:
    """(key, started, ended, changes). A stream needs ``lateness``, its watermark; a
    session is then emitted once it cannot grow."""
    if lateness:
        changes = changes.withWatermark(ts, lateness)
    window = F.session_window(F.col(ts), gap)
    return changes.groupBy(F.col(key), window).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("changes")).select(key, "started", "ended", "changes")
