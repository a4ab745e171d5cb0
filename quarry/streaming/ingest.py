"""Incremental ingest: new files of a folder become artifacts as they arrive (an extension)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators.history import History

_FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_stream(spark: SparkSession, folder: str, root: str, checkpoint: str):
    """A query that ingests every file that appears below folder once, and ends when none is left.

    Batches that run again after a failure change nothing: known contents are not stored twice.
    """
    history = History(spark, root)

    def take(batch: DataFrame, batch_id: int) -> None:
        uploads = batch.select(F.xxhash64("path").alias("ord"), F.col("path").alias("filename"), "content")
        history.ingest(uploads, datetime.now(timezone.utc).isoformat())

    files = spark.readStream.format("binaryFile").schema(_FILES).load(folder)
    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
