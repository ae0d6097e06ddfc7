"""The trees of city objects over their children, of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.sources import folders

FEATURE = ["file", "feature_seq"]


def links(objects: DataFrame) -> DataFrame:
    """A row for each link from an object to a child, with ``there``: whether the child is among its feature's objects."""
    named = objects.select(*FEATURE, "object_id", F.explode(F.array_distinct("children")).alias("child_id"))
    known = objects.select(*FEATURE, F.col("object_id").alias("child_id"), F.lit(True).alias("there")).distinct()
    return named.join(known, [*FEATURE, "child_id"], "left").select(*FEATURE, "object_id", "child_id", F.coalesce("there", F.lit(False)).alias("there"))


def missing(objects: DataFrame) -> DataFrame:
    """The links to children that aren't there."""
    return links(objects).where("NOT there").drop("there")


def closure(objects: DataFrame) -> DataFrame:
    """file, feature_seq, ancestor_id, object_id and steps: each object below another one of its feature, with the fewest links between them.

    An object that is above itself is in a ring (``rings``).  Each round looks one link
    further from the pairs that the round before found, and ends when there are no
    new ones, so that rings end too; rounds are written.
    """
    pair = [*FEATURE, "ancestor_id", "object_id"]
    below = folders.saved(links(objects).where("there"), "links").select(*FEATURE, F.col("object_id").alias("middle"), F.col("child_id").alias("object_id"))
    new = below.select(*FEATURE, F.col("middle").alias("ancestor_id"), "object_id")
    found, steps = new.withColumn("steps", F.lit(1)), 1
    while True:
        further = new.withColumnRenamed("object_id", "middle").join(below, [*FEATURE, "middle"]).select(pair).distinct()
        new = folders.saved(further.join(found, pair, "left_anti"), "round")
        if new.isEmpty():
            return found
        steps += 1
        found = found.unionByName(new.withColumn("steps", F.lit(steps)))


def rings(pairs: DataFrame) -> DataFrame:
    """The objects that ``closure`` found above themselves."""
    return pairs.where("ancestor_id = object_id").select(*FEATURE, "object_id", F.col("steps").alias("ring"))


def placed(objects: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Each object with its root, its depth and how many objects are below it.

    A root is an object that is no other one's child; of several above an object the
    first by id counts, and the depth is the number of links to it.  An object that
    no root is above, as in a ring, has neither.
    """
    pairs = closure(objects) if pairs is None else pairs
    own = objects.select(*FEATURE, "object_id").distinct()
    children = pairs.select(*FEATURE, "object_id").distinct()
    roots = own.join(children, [*FEATURE, "object_id"], "left_anti").select(*FEATURE, F.col("object_id").alias("ancestor_id"))
    above = pairs.join(roots, [*FEATURE, "ancestor_id"]).groupBy(*FEATURE, "object_id").agg(F.min(F.struct("ancestor_id", "steps")).alias("top"))
    itself = roots.select(*FEATURE, F.col("ancestor_id").alias("object_id"), F.struct("ancestor_id", F.lit(0).alias("steps")).alias("top"))
    below = pairs.where("ancestor_id <> object_id").groupBy(*FEATURE, F.col("ancestor_id").alias("object_id")).agg(F.count("*").alias("below"))
    joined = own.join(above.unionByName(itself), [*FEATURE, "object_id"], "left").join(below, [*FEATURE, "object_id"], "left")
    return joined.select(*FEATURE, "object_id", F.col("top.ancestor_id").alias("root_id"), F.col("top.steps").alias("depth"), F.coalesce("below", F.lit(0)).cast("long").alias("below"))
