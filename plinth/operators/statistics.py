"""Inference over attributes, running sums over an order, runs and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import values
from plinth.operators import ordering
from plinth.sources import folders


def explode_attributes(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """A row for each attribute of a JSON object: keys, name and the value as text; nulls are left out."""
    pairs = F.explode(F.from_json(F.col(column), "map<string,string>"))
    return rows.select(*keys, pairs.alias("name", "value")).where(F.col("value").isNotNull())


def infer_types(rows: DataFrame, column: str, order: str, merge: bool = True) -> DataFrame:
    """Name and type of each attribute of a column of JSON objects."""
    entry = rows.select(order, F.explode(F.from_json(F.col(column), "map<string,variant>")).alias("name", "v"))
    typed = entry.select(order, "name", values.variant_type(F.col("v")).alias("type")).where(F.col("type").isNotNull())
    return merged_types(typed, order, merge)


def merged_types(typed: DataFrame, order: str, merge: bool = True) -> DataFrame:
    """name and type from a row for each value (name, type, ``order``).

    Types that disagree widen: whole numbers with fractions to Double, anything
    else to String.  Without ``merge``, the first value by ``order`` decides.
    """
    if not merge:
        return typed.groupBy("name").agg(F.min_by("type", order).alias("type"))
    kinds = typed.groupBy("name").agg(F.collect_set("type").alias("kinds"))
    numbers = F.array(*map(F.lit, ("Long", "ULong", "Double")))
    whole = F.size(F.array_except("kinds", numbers)) == 0
    merged = F.when(F.size("kinds") == 1, F.element_at("kinds", 1)).when(whole, F.when(F.array_contains("kinds", "Double"), "Double").otherwise("Long")).otherwise("String")
    return kinds.select("name", merged.alias("type"))


def running_offsets(rows: DataFrame, order: str, size: str, keep: bool = False, parts: int | None = None) -> DataFrame:
    """The sum of ``size`` over the rows before, by ``order``, which must be a number."""
    return ordering.with_running_sum(rows, order, size, parts=parts).select(order, *([size] if keep else []), "start")


def range_lengths(rows: DataFrame, order: str, size: str) -> DataFrame:
    """order, start and length of each range; the last one is open, its length null."""
    offsets = running_offsets(rows, order, size, keep=True)
    last = rows.agg(F.max(order).alias("_last"))
    return offsets.join(F.broadcast(last)).select(order, "start", F.when(F.col(order) < F.col("_last"), F.col(size)).alias("length"))


def every_nth(rows: DataFrame, order: str, n: int) -> DataFrame:
    """Each ``n``-th row by ``order``, a number."""
    return ordering.with_place(rows, order).where((F.col("place") + 1) % n == 0).drop("place")


def dataset_sizes(rows: DataFrame, key: str, text: str, chars: str) -> DataFrame:
    """By key: rows, bytes of their texts, mean bytes, and bytes for each character."""
    size = F.octet_length(text).cast("long")
    return rows.groupBy(key).agg(
        F.count("*").alias("features"), F.sum(size).alias("bytes"), F.round(F.avg(size), 6).alias("mean_bytes"),
        F.round(values.safe_ratio(F.sum(size), F.sum(chars)), 9).alias("ratio"),
    )


def best(rows: DataFrame, key: str, item: str, value: str) -> DataFrame:
    """By key, the item of the least value; of equal ones, the least item."""
    return rows.groupBy(key).agg(F.min_by(item, F.struct(value, item)).alias(item))


def unique_counts(rows: DataFrame, *names: str) -> DataFrame:
    """name and n: how many different values each column has."""
    return rows.agg(*(F.countDistinct(c).alias(c) for c in names)).unpivot([], list(names), "name", "n")


def payloads(rows: DataFrame, key: str, member: str) -> DataFrame:
    """By key, its distinct members: how many, and a digest of them in ascending order."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(member)), lambda k: k.cast("string")), ",")
    return rows.select(key, member).distinct().groupBy(key).agg(F.count("*").alias("n"), F.md5(listed).alias("payload"))


def merge_runs(rows: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """Runs of each key whose neighbours lie at most ``gap`` apart: first, last and number of rows."""
    w = Window.partitionBy(key).orderBy(at)
    before = F.lag(at).over(w)
    new = F.when(before.isNull() | (F.col(at) > before + F.expr(gap)), 1).otherwise(0)
    marked = rows.withColumn("new", new)
    run = F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")
    return marked.withColumn("run", run).groupBy(key, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """By key: mean, median, population deviation, least and most.

    The median is exact: a key's distinct values, with their counts, must fit a task;
    ``quantiles`` has no such bound.
    """
    return rows.groupBy(key).agg(
        F.round(F.avg(value), 6).alias("mean"),
        F.round(F.median(value), 6).alias("median"),
        F.round(F.stddev_pop(value), 6).alias("sd"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
    )


#: Ranges that values are cut into to find their quantiles.
RANGES = 256


def quantiles(rows: DataFrame, key: str, value: str, at: tuple[float, ...] = (0.5,)) -> DataFrame:
    """key, q and value: exact quantiles of each key's values, between two ranks by their distance; nulls don't count.

    Equal values are counted first.  Values are cut into ranges of similar row counts;
    a range's count for each key tells which one holds a rank, and only the values
    of that range are ranked.  So no buffer holds a key's values, and a value
    that a third of all rows have is one row.
    """
    counts = folders.saved(rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), F.col(value).alias("v")).agg(F.count("*").alias("n")), "values")
    counts = counts.withColumn("band", ordering.range_of(F.col("v"), ordering.split_points(counts, "v", RANGES)))
    bands = counts.groupBy("key", "band").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("key")
    bands = bands.select("key", "band", "n", F.sum("n").over(whole).alias("total"), (F.sum("n").over(whole.orderBy("band")) - F.col("n")).alias("before"))
    # Two ranks from 0 for each quantile.
    place = lambda q: (F.col("total") - 1) * q
    wanted = F.array(*(F.struct(F.lit(float(q)).alias("q"), F.lit(side).alias("side"), f(place(q)).cast("long").alias("rank")) for q in at for side, f in ((0, F.floor), (1, F.ceil))))
    ranks = bands.withColumn("w", F.explode(wanted)).where(F.col("w.rank").between(F.col("before"), F.col("before") + F.col("n") - 1))
    ranks = ranks.select(F.col("key").alias("k"), F.col("band").alias("b"), "before", "total", "w.*")
    own = counts.join(ranks.select("k", "b").distinct(), F.col("key").eqNullSafe(F.col("k")) & (F.col("band") == F.col("b")), "left_semi")
    upto = F.sum("n").over(Window.partitionBy("key", "band").orderBy("v"))
    own = own.select("key", "band", "v", "n", upto.alias("upto"))
    first = F.col("before") + F.col("upto") - F.col("n")
    found = own.join(ranks, F.col("key").eqNullSafe(F.col("k")) & (F.col("band") == F.col("b"))).where((F.col("rank") >= first) & (F.col("rank") < F.col("before") + F.col("upto")))
    pair = found.groupBy("key", "q").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("high"), F.max("total").alias("total"))
    share = place(F.col("q")) - F.floor(place(F.col("q")))
    return pair.select(F.col("key").alias(key), "q", (F.col("low") + (F.col("high") - F.col("low")) * share).alias(value))


def ratios(rows: DataFrame, key: str, kind: str, value: str, base) -> DataFrame:
    """Mean of each kind within a key, and how many times the mean of kind ``base`` it is: 0 where that isn't positive."""
    means = rows.groupBy(key, kind).agg(F.avg(value).alias("mean"))
    own = F.max(F.when(F.col(kind) == base, F.col("mean"))).over(Window.partitionBy(key))
    return means.select(key, kind, F.round("mean", 6).alias("mean"), F.round(values.safe_ratio(F.col("mean"), own), 6).alias("ratio"))


def kind_counts(rows: DataFrame, column: str, names: dict[str, str], rest: str = "others") -> DataFrame:
    """One row: how many rows there are of each kind (``names``: column name by kind), and of no such kind."""
    t = F.col(column)
    return rows.agg(*(F.count_if(t == kind).alias(name) for kind, name in names.items()), F.count_if(~t.isin(*names)).alias(rest))


def geometry_counts(objects: DataFrame, type_col: str = "geometry_type") -> DataFrame:
    """Numbers of solids, multi-surfaces and other geometries."""
    return kind_counts(objects, type_col, {"Solid": "solids", "MultiSurface": "multi_surfaces"})


def write_runs(rows: DataFrame, key: str, kind: str, value: str, base, path: str) -> None:
    """Measured values as three folders of CSV: ``raw`` (the rows), ``summary`` (of each key and kind) and ``comparison`` (means, and ratios to the kind ``base``)."""
    both = F.struct(F.col(key), F.col(kind)).alias("_both")
    summed = summary(rows.select(both, value), "_both", value).select("_both.*", "mean", "median", "sd", "least", "most")
    for name, table in (("raw", rows.select(key, kind, value)), ("summary", summed), ("comparison", ratios(rows, key, kind, value, base))):
        table.repartitionByRange(key, kind).sortWithinPartitions(key, kind).write.mode("overwrite").csv(f"{path}/{name}", header=True)
