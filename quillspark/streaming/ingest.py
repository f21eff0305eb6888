"""Extension: files that arrive are reconciled batch by batch.

Each batch is idempotent: its decisions are written under the number of the
batch, so that a batch delivered again replaces its own output.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.reconcile import reconcile

LIVE = "path string, byte_size bigint, mtime_ns bigint, sha256 string, url string"


def stream_inventory(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Inventory rows from JSON files that appear in a folder."""
    return spark.readStream.schema(LIVE).option("maxFilesPerTrigger", files_per_batch).json(folder)


def reconcile_stream(rows: DataFrame, ledger: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the decisions of every batch to a folder of its own."""

    def batch(df: DataFrame, number: int) -> None:
        # a batch holds new files only: records it doesn't name aren't missing
        seen = ledger.join(df.select("path").distinct(), "path", "left_semi")
        reconcile(df, seen).write.mode("overwrite").parquet(os.path.join(out, f"batch={number}"))

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(events: DataFrame, at: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts and sums a window of event time; rows later than the watermark are dropped by the stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
