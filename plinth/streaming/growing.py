"""A dataset that a stream of features makes grow, and its compaction.

Each micro-batch is a folder named by its number, so that a batch that is run again
replaces what it wrote.  A feature whose id an earlier batch has is left out, and of
several in one batch the one of the last line stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plinth.errors import BadInput
from plinth.sources import catalogue, dataset

ID = ["file", "feature_id"]


def batch_path(path: str, batch: int) -> str:
    return f"{path}/batch={batch}"


def append_batch(features: DataFrame, batch: int, path: str) -> None:
    """Adds a batch's features that earlier batches don't have; the same batch again changes nothing."""
    spark = features.sparkSession
    last = features.groupBy(*ID).agg(F.max_by(F.struct(*features.columns), "feature_seq").alias("f")).select("f.*")
    before = earlier(spark, path, batch)
    new = last if before is None else last.join(before.select(*ID), ID, "left_anti")
    new.write.mode("overwrite").parquet(batch_path(path, batch))


def earlier(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame | None:
    """The features of all batches, or of those before ``batch``; None without any."""
    if not catalogue.exists(spark, path):
        return None
    files, where = catalogue.file_system(spark, path)
    numbers = sorted(int(n.removeprefix("batch=")) for n in (f.getPath().getName() for f in files.listStatus(where)) if n.startswith("batch="))
    kept = [n for n in numbers if batch is None or n < batch]
    return spark.read.parquet(*(batch_path(path, n) for n in kept)) if kept else None


def grow(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts appending a stream of features (``sequence.stream_features``) under ``path``; with ``once``, what is there now."""
    writer = stream.writeStream.foreachBatch(lambda df, batch: append_batch(df, batch, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def compact(spark: SparkSession, path: str, header: DataFrame, target: str, **options) -> dataset.Dataset:
    """All batches as one stored dataset in Hilbert order, in a folder of its own."""
    features = earlier(spark, path)
    if features is None:
        raise BadInput(f"no batches in {path}")
    dataset.write_dataset(features, header, target, **options)
    return dataset.Dataset.open(spark, target)
