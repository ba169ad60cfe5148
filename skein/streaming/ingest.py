"""Continuous ingest of a change feed, and windowed counts over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.collection import Collection

#: A change feed has these columns; a later `position` wins.
CHANGES = "op string, id string, vector array<float>, metadata variant, text string, position long"


def last_changes(changes: DataFrame) -> DataFrame:
    """The last change of each id, ties by op."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("position").desc(), F.col("op").desc()))
    return changes.withColumn("_r", place).where("_r = 1").drop("_r")


def apply_batch(collection: Collection, changes: DataFrame, batch: int, name: str) -> int:
    """Commits one micro-batch, once: a batch that the log already has under this name is passed over."""
    if batch <= collection.commits.batches().get(name, -1):
        return 0
    return collection.apply(last_changes(changes), stream=name, batch=batch)


def ingest(collection: Collection, feed: DataFrame, checkpoint: str, *, name: str = "feed", available_now: bool = True) -> StreamingQuery:
    """Starts a query that applies a streaming `feed` (see CHANGES) to a collection, one commit a micro-batch.

    A batch that is run again after a failure is applied once. A compaction keeps the last batch number.
    """
    writer = feed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: apply_batch(collection, df, batch, name) and None)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", value: str = "value", *, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and sum per tumbling (or sliding) window and `by`; for streams and tables alike. Rows more than `late`
    behind a stream's latest one may be left out."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    found = events.withWatermark(ts, late).groupBy(window.alias("w"), F.col(by)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", by: str = "user_id", *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per `by`: rows that follow one another within `gap`."""
    found = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(by)).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n")
