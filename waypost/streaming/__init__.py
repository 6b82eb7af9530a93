"""Structured Streaming over a folder of texts (an addition; the batch operators are the same)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waypost.operators.blocks import structured_blocks


def stream_blocks(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream of (doc_id, block_ord, block, facility_name_line) from new .txt files; doc_id is the path. Stateless."""
    from pyspark.sql import functions as F

    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.txt").load(folder)
    return structured_blocks(files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")))
