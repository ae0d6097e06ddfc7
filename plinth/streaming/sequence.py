"""Features from a folder of text sequences that grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import format as kinds
from plinth.sources import sequences


def stream_features(spark: SparkSession, path: str, max_files: int = 100, suffix: str = "*.jsonl") -> DataFrame:
    """A streaming DataFrame of the features in new files; headers and blank lines are left out.

    ``feature_seq`` is a hash of the line, as a stream has no line numbers.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).option("pathGlobFilter", suffix).load(path)
    rows = lines.where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.xxhash64("value").alias("line_no"), "value")
    return sequences.parse_features(rows.where(F.try_variant_get(F.parse_json("value"), "$.type", "string").endswith(kinds.FEATURE_ENDING)))


def stream_headers(spark: SparkSession, path: str, suffix: str = "*.jsonl") -> DataFrame:
    """The headers in the folder now, to be joined as a static side."""
    lines = spark.read.option("pathGlobFilter", suffix).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    head = sequences.judged(lines).where("kind = 'header'")
    return head.select("file", F.from_json("value", sequences.HEADER).alias("h")).select("file", "h.*")


def windowed_counts(events: DataFrame, time: str, by: Column | str, size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Rows of each tumbling window and ``by``; rows that come later than ``late`` are left out of a stream."""
    by = F.col(by) if isinstance(by, str) else by
    grouped = events.withWatermark(time, late).groupBy(F.window(time, size), by.alias("by")).agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "by", "n")
