"""Index maintenance as a stream of change events.

A stream of ``file_key, change, text, language, at`` (text null for deletions)
keeps a chunk table current: within a micro-batch the latest event of a file
wins, its old chunks go and its new ones come (``foreachBatch``).  The windowed
count of events drops late ones by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import embedding
from ..operators.chunking import build
from ..operators.maintenance import patched


def latest_events(events: DataFrame) -> DataFrame:
    """The last event of each file; of equal times the greatest row, so the choice is the same on every run."""
    last = events.where(F.col("file_key").isNotNull()).groupBy("file_key").agg(F.max(F.struct("at", "change", "text", "language")).alias("e"))
    return last.select("file_key", "e.change", "e.text", "e.language", "e.at")


def apply_events(chunks: DataFrame, events: DataFrame, model: str = "hash-256") -> DataFrame:
    """The chunk table (``file_key, language, chunk_ord``, the chunk columns and ``embedding``) after a batch of events."""
    last = latest_events(events)
    alive = last.where((F.col("change") != "deleted") & F.col("text").isNotNull())
    fresh = embedding.with_embeddings(build.chunk_files(alive, ["file_key"], "file_key", "text", "language").drop("path"), name=model)
    return patched(chunks, last, fresh, ["file_key"])


def maintain(stream: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts the query: every micro-batch loads the table, applies its events and saves it under the batch's number."""
    return stream.writeStream.foreachBatch(lambda batch, number: save(apply_events(load(), batch), number)).option("checkpointLocation", checkpoint).start()


def event_counts(stream: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events a window and kind of change, without those later than the watermark."""
    return stream.withWatermark("at", late).groupBy(F.window("at", window), "change").agg(F.count("*").alias("events")).select(F.col("window.start").alias("window_start"), "change", "events")
