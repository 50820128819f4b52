"""Streams of file rows: a replica kept current, and duplicates found as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftstone.schema import in_scope


def upsert_replica(stream: DataFrame, files_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep ``files_path`` (partitioned by archive_id) as the latest rows of every archive that the stream delivers.

    A micro-batch replaces the partitions of its archives only, by dynamic partition overwrite, so that a batch that is
    run again after a failure leaves the same files. Repeated rows of one key count once; the rows of one archive must
    arrive in one micro-batch, as when an index is published as one file set.
    """

    def write(batch: DataFrame, _: int) -> None:
        once = batch.dropDuplicates(["archive_id", "file_id"])
        once.repartition("archive_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("archive_id").parquet(files_path)

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def first_copies(stream: DataFrame, event_time: str, horizon: str = "7 days") -> DataFrame:
    """The first in-scope row of every content within the horizon; state of older contents is dropped.

    Late rows are compared as long as they are within the watermark of the given horizon.
    """
    return stream.where(in_scope()).withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["content_hash"])


def arrivals(stream: DataFrame, event_time: str, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Files and bytes per archive and window of arrival, final once the watermark has passed."""
    return (
        stream.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, window).alias("w"), "archive_id")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "archive_id", "files", "bytes")
    )
