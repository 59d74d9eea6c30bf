"""Timelines that grow: captures arrive as files of events, counts per window are kept with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "plugin string, description string, kind string, time timestamp"


def read_events(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """Event files as they arrive."""
    return spark.readStream.schema(schema).parquet(folder)


def window_counts(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per plugin and tumbling window; a window is final when the watermark passes its end, later rows fall out."""
    return events.withWatermark("time", late).groupBy(F.window("time", size), "plugin").agg(F.count(F.lit(1)).alias("n_rows")).select(F.col("window.start").alias("window_start"), "plugin", "n_rows")


def write_counts(counts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append final windows as Parquet, each once, until all files present are read."""
    return counts.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
