"""Streams of review and audit events: current state, windows, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def current_state(events: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Last event of each key so far; for ``update`` or ``complete`` output. The state kept is one
    struct a key, whatever the number of its events."""
    got = F.max_by(F.struct(*fields), F.struct(*order))
    return events.groupBy(*key).agg(got.alias("s"), F.count(F.lit(1)).alias("n_events")).select(*key, "n_events", *[F.col(f"s.{f}").alias(f) for f in fields])


def windowed_counts(events: DataFrame, time: str, by: list[str], size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums in tumbling or sliding windows; events later than ``late`` are dropped by
    the watermark, which bounds the state."""
    frame = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.withWatermark(time, late).groupBy(frame.alias("w"), *by).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n_events", "total")


def sessions(events: DataFrame, time: str, key: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key: runs of events with pauses under ``gap``."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *key).agg(F.count(F.lit(1)).alias("n_events"))
    return out.select(*key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def first_of_each(events: DataFrame, time: str, ident: list[str], late: str = "1 hour") -> DataFrame:
    """Events without repeats, with state bounded by the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(ident)


def to_versions(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch of changed state as a version folder of its own, written once: readers take the
    newest complete one."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, path: str, key: list[str], order: list[str], schema: StructType) -> DataFrame:
    """The state that versions say: of each key the row of its last version. Nothing is gathered on
    the driver; the versions are a table like any other."""
    rows = spark.read.schema(schema).option("basePath", path).parquet(f"{path}/version=*")
    names = [c for c in schema.fieldNames() if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("s"))
    return last.select(*key, *[F.col(f"s.{c}").alias(c) for c in names]).select(*schema.fieldNames())


def run_to_memory(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All available input into a memory table of the driver; for tests of small results only."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
