"""Ledger streams: refusals by event-time window (an extension), and a feed of finished micro-batches."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Batches that a feed keeps for a reader that is late.
SLOTS = 256


def windowed_refusals(events: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """A stream or table of ledger events -> refusals by window, class and channel."""
    timed = events.withColumn("at", F.to_timestamp("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).withWatermark("at", late)
    counts = timed.filter("action = 'refused'").groupBy(F.window("at", width), "entity_class", "channel").count()
    return counts.select(F.col("window.start").alias("start"), "entity_class", "channel", F.col("count").alias("n"))


class Feed(StreamingQueryListener):
    """The last SLOTS progress reports of all streaming queries of a session; older ones are dropped."""

    def __init__(self, slots: int = SLOTS):
        self.reports: deque[dict] = deque(maxlen=slots)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.reports.append({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.reports.append({"event": "progress", "id": str(event.progress.id), "batch": event.progress.batchId, "rows": event.progress.numInputRows})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.reports.append({"event": "ended", "id": str(event.id)})
