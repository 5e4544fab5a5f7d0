"""Changes as they come: bursts of file events become one flush once a repository has been quiet for a while."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "repository string, path string, kind string, at timestamp"


def file_events(spark: SparkSession, folder: str, most_files: int = 50) -> DataFrame:
    """A stream of events from JSON files that appear in a folder, at most so many files a trigger."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", most_files).json(folder)


def bursts(events: DataFrame, by: str = "repository", at: str = "at", gap: str = "500 milliseconds", watermark: str | None = "1 minute", what: str = "path") -> DataFrame:
    """(by, start, stop, events, paths): sessions with no pause longer than ``gap``. On a stream, a session comes out once the
    watermark has passed it; later events of it are late."""
    e = events.withWatermark(at, watermark) if events.isStreaming and watermark else events
    s = e.groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events"), F.array_sort(F.collect_set(what)).alias("paths"))
    return s.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "events", "paths")


def portions(burst: DataFrame, most: int = 50, by: str = "repository") -> DataFrame:
    """(by, start, portion, paths): the paths of each burst in portions of at most so many, the first of which is flushed at once
    and the others after it."""
    n = F.ceil(F.size("paths") / most).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(i.alias("portion"), F.slice("paths", i * most + 1, most).alias("paths")))
    return burst.select(by, "start", F.explode(cuts).alias("c")).select(by, "start", "c.portion", "c.paths").filter(F.size("paths") > 0)


def flush(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Each batch of changes once: ``apply(batch, number)`` must be idempotent in the number, as a batch may be repeated."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def drain(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that is there, then stop."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
