"""Folders of stored datasets, each beside the text sequence of its name, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.errors import BadInput
from plinth.functions import format as kinds
from plinth.functions import values

PART = r"^(.*)/(?:features|objects|geometries|header|attributes|by/[^/]+|statistics/[^/]+)/[^/]*\.parquet$"
SEQUENCE = r"^(.*?)(\.city)?\.jsonl$"


def _plain(path: Column) -> Column:
    """A file's path as listings spell it: not percent-encoded, and one slash after ``file:``."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def pairs(spark: SparkSession, root: str, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """city, path and stored_bytes of each stored dataset under ``root``, with sequence and sequence_bytes.

    The sequence is the file of the same name in the same folder, ``.city.jsonl``
    before ``.jsonl``; datasets without one are left out.  With ``prefixes``, only
    cities whose name begins with one of them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"))
    stored = files.select(F.regexp_extract("path", PART, 1).alias("at"), "bytes").where("at <> ''").groupBy("at").agg(F.sum("bytes").alias("stored_bytes"))
    texts = files.select(F.regexp_extract("path", SEQUENCE, 1).alias("at"), F.regexp_extract("path", SEQUENCE, 2).alias("kind"), "path", "bytes").where("at <> ''")
    chosen = texts.groupBy("at").agg(F.max_by(F.struct("path", "bytes"), "kind").alias("text"))
    found = stored.join(chosen, "at").select(F.regexp_extract("at", "([^/]+)$", 1).alias("city"), F.col("at").alias("path"), "stored_bytes", F.col("text.path").alias("sequence"), F.col("text.bytes").alias("sequence_bytes"))
    if prefixes:
        wanted = F.lit(False)
        for p in prefixes:
            wanted = wanted | F.col("city").startswith(p)
        found = found.where(wanted)
    return found


def report(spark: SparkSession, root: str, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """A row for each pair: counts, sizes and ratios.

    The list of pairs comes to the driver, a row for each dataset; features and
    lines are counted where they are, attributes in the datasets' own tables of
    them, all in one read.  No pairs give no rows.
    """
    kept = pairs(spark, root, prefixes).collect()
    listed = F.broadcast(spark.createDataFrame(kept, "city string, path string, stored_bytes long, sequence string, sequence_bytes long"))
    counts = ("features long, objects long, vertices long, path string", "mean_line_bytes double, sequence string")
    own = F.regexp_extract(_plain(F.col("_metadata.file_path")), PART, 1).alias("path")
    if kept:
        named = spark.read.parquet(*(f"{r['path']}/attributes" for r in kept)).select(own, "name").groupBy("path").agg(F.count("name").cast("int").alias("columns"))
        listed = listed.join(named, "path", "left").withColumn("columns", F.coalesce("columns", F.lit(0)))
        placed = spark.read.parquet(*(f"{r['path']}/features" for r in kept)).select(own, F.size("objects").alias("o"), F.size("vertices").alias("v"))
        stored = placed.groupBy("path").agg(F.count("*").alias("features"), F.sum(F.greatest("o", F.lit(0))).alias("objects"), F.sum(F.greatest("v", F.lit(0))).alias("vertices"))
        lines = spark.read.text([r["sequence"] for r in kept]).where(F.get_json_object("value", "$.type").endswith(kinds.FEATURE_ENDING))
        texts = lines.groupBy(_plain(F.col("_metadata.file_path")).alias("sequence")).agg(F.avg(F.octet_length("value")).alias("mean_line_bytes"))
    else:
        stored, texts = (spark.createDataFrame([], c) for c in counts)
        listed = listed.withColumn("columns", F.lit(0))
    joined = listed.join(stored, "path", "left").join(texts, "sequence", "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("features", "objects", "vertices")]
    n = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "city", *numbers, "columns", "stored_bytes", "sequence_bytes", "mean_line_bytes",
        values.safe_ratio(F.col("sequence_bytes"), F.col("stored_bytes")).alias("compression"),
        values.safe_ratio(n("vertices"), n("objects")).alias("vertices_per_object"),
        values.safe_ratio(n("vertices"), n("features")).alias("vertices_per_feature"),
    )


def write_report(found: DataFrame, path: str, kind: str = "csv") -> None:
    """The report in one file of CSV (with a header) or JSON lines, by city."""
    out = found.repartition(1).sortWithinPartitions("city").write
    if kind == "csv":
        out.csv(path, header=True)
    elif kind == "json":
        out.json(path)
    else:
        raise BadInput(f"unknown kind: {kind}")
