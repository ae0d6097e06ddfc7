"""Headline queries at ``BENCH_SF_DIR`` on ``local[BENCH_CPUS]``; prints one JSON line.

Beside the registered queries, a city model made from the tables is stored twice,
along the Hilbert curve and in the order of its keys, in files of few features.
The same box, point, nearest and attribute selections run on both; ``skipping``
has their times, and the row groups and bytes that the footers' statistics leave of
all (worked out from the footers, not taken from Spark's scan).  ``dataset`` has the
same selections on features of wide and of small boxes through a stored dataset's
table of files: seconds with planning, and the files that the scan is given of all.
"""

import glob
import json
import os
import time

import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plinth.operators import spatial
from plinth.plans import registry
from plinth.sources import catalogue, dataset, folders

HEADLINE = ["feature_bbox", "hilbert_key", "bbox_select", "point_nearest", "attr_eq", "attr_gt", "attr_and_cross_object", "spatial_and_attr", "flatten_boundaries", "rebuild_boundaries", "tile_pyramid", "dataset_stats", "bench_stats"]
PARTS = 64


def timed(df) -> float:
    df.write.format("noop").mode("overwrite").save()
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - began, 3)


def groups(where: str, bounds: dict[str, tuple[float, float]]) -> list[int]:
    """Row groups and bytes that statistics leave of a stored table for closed ranges of columns, and of all."""
    kept, total, kept_bytes, all_bytes = 0, 0, 0, 0
    for path in glob.glob(f"{where.removeprefix('file:')}/part-*.parquet"):
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            stats = {group.column(c).path_in_schema: group.column(c).statistics for c in range(group.num_columns)}
            meets = all(stats[c] is None or not stats[c].has_min_max or (stats[c].max >= low and stats[c].min <= high) for c, (low, high) in bounds.items())
            total, all_bytes = total + 1, all_bytes + group.total_byte_size
            kept, kept_bytes = kept + meets, kept_bytes + meets * group.total_byte_size
    return [kept, total, kept_bytes, all_bytes]


def skipping(spark: SparkSession, sf_dir: str) -> dict:
    """Selections on features that are stored clustered and not."""
    placed = spatial.with_hilbert(registry.flat(registry.features(spark, sf_dir))).withColumn("q", F.col("key") % 1000)
    where = folders.scratch(spark, "bench")
    spatial.cluster(placed, "key", PARTS).write.mode("overwrite").parquet(f"{where}/clustered")
    placed.repartitionByRange(PARTS, "key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{where}/unclustered")
    placed.repartitionByRange(PARTS, "q").sortWithinPartitions("q").write.mode("overwrite").parquet(f"{where}/by_q")
    ends = spark.read.parquet(f"{where}/clustered").agg(F.percentile_approx("xmin", [0.02, 0.04]).alias("x"), F.percentile_approx("ymin", [0.02, 0.04]).alias("y")).first()
    (x0, x1), (y0, y1) = ends["x"], ends["y"]
    inf = float("inf")
    box = {"xmax": (x0, inf), "xmin": (-inf, x1), "ymax": (y0, inf), "ymin": (-inf, y1)}
    point = {"xmax": (x0, inf), "xmin": (-inf, x0), "ymax": (y0, inf), "ymin": (-inf, y0)}
    out = {}
    for name in ("clustered", "unclustered"):
        rows = spark.read.parquet(f"{where}/{name}")
        out[name] = {
            "bbox": [timed(spatial.select(rows, spatial.SpatialQuery("bbox", x0, y0, x1, y1))), *groups(f"{where}/{name}", box)],
            "point": [timed(spatial.select(rows, spatial.SpatialQuery("pointIntersects", x0, y0))), *groups(f"{where}/{name}", point)],
            "nearest": [timed(spatial.nearest(rows, x0, y0, "key"))],
            "attribute": [timed(rows.where("q = 77")), *groups(f"{where}/{name}", {"q": (77, 77)})],
        }
    out["by_q"] = {"attribute": [timed(spark.read.parquet(f"{where}/by_q").where("q = 77")), *groups(f"{where}/by_q", {"q": (77, 77)})]}
    return out


def through_datasets(spark: SparkSession, sf_dir: str) -> dict:
    """Selections through the table of files: box, point and nearest, with the files that are read of all."""
    wide = registry.flat(registry.features(spark, sf_dir))
    small = wide.select("key", "xmin", "ymin", (F.col("xmin") + 1).alias("xmax"), (F.col("ymin") + 1).alias("ymax"))
    out = {}
    for name, rows in (("wide", wide), ("small", small)):
        real = [F.col(c).cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]
        none = [F.lit(None).cast(t).alias(c) for c, t in (("objects", "map<string,string>"), ("vertices", "array<int>"), ("zmin", "double"), ("zmax", "double"))]
        placed = spatial.with_hilbert(rows.select(F.lit("f").alias("file"), F.col("key").alias("feature_seq"), *real, *none))
        where = folders.scratch(spark, f"bench-{name}")
        spatial.cluster(placed, "feature_seq", PARTS).write.parquet(f"{where}/features")
        features = spark.read.parquet(f"{where}/features")
        catalogue.feature_files(features).coalesce(1).write.parquet(f"{where}/statistics/files")
        data = dataset.Dataset(features, features, features, where)
        (x0, x1), (y0, y1) = features.agg(F.percentile_approx("xmin", [0.30, 0.32]), F.percentile_approx("ymin", [0.30, 0.32])).first()
        queries = {"bbox": spatial.SpatialQuery("bbox", x0, y0, x1, y1), "point": spatial.SpatialQuery("pointIntersects", x0, y0), "nearest": spatial.SpatialQuery("pointNearest", x0, y0)}
        found = {}
        for kind, query in queries.items():
            data.spatial(query).count()
            began = time.time()
            got = data.spatial(query)
            got.write.format("noop").mode("overwrite").save()
            found[kind] = [round(time.time() - began, 3), len(got.inputFiles()), len(features.inputFiles())]
        found["nearest, all files"] = [timed(spatial.nearest(features, x0, y0, "feature_seq")), len(features.inputFiles()), len(features.inputFiles())]
        out[name] = found
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {name: timed(registry.QUERIES[name](spark, sf_dir)) for name in HEADLINE}
    found, stored = skipping(spark, sf_dir), through_datasets(spark, sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "skipping": found, "dataset": stored, "dataset_columns": ["seconds", "files read", "of"], "skipping_columns": ["seconds", "row groups read", "of", "bytes read", "of"]}))
    spark.stop()


if __name__ == "__main__":
    main()
