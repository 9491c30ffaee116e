"""Incremental ingestion of Markdown files: what is new since the last run, then stop."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_markdown(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the new *.md files of source to the Parquet table target as (path, md, ingested_at).

    The checkpoint folder remembers what was read; a file is ingested once.
    """
    files = (
        spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(source)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("md"), F.current_timestamp().alias("ingested_at"))
    )
    return files.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
