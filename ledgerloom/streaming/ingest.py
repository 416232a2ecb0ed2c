"""Structured Streaming over arriving snapshot files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.sources.snapshots import FAMILIES


def stream_snapshots(spark: SparkSession, root: str, family: str, sink: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 64) -> StreamingQuery:
    """Hand each batch of new files of a family to ``sink``; files are read once, by the checkpoint."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in FAMILIES[family]])
    rows = (
        spark.readStream.option("header", True).option("maxFilesPerTrigger", files_per_batch).schema(schema).csv(f"{root}/{family}")
        .select("*", F.regexp_extract("_metadata.file_name", r"([^/]+)\.csv$", 1).alias("snapshot_date"))
        .na.fill("")
    )
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watermarked_counts(events: DataFrame, time_col: str, key: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per key and tumbling window; rows later than ``late`` are left out."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")
