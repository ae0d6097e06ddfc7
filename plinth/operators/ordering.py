"""Places and running sums over a total order, without sorting everything in one task.

Rows are cut into ranges of similar row counts and numbered or summed within their
range; what the ranges before hold, a row for each range, is added.  What is read
more than once is written to a scratch folder, so that the input is worked out once
(a range shuffle reads it once more, to find its bounds).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.sources import folders

#: Bits of a row's number within its partition, in the numbers that Spark gives rows.
_ROW_BITS = 33
#: Rows that a range should have; ranges at least and at most.
RANGE_ROWS, LEAST, MOST = 500_000, 8, 20_000


def split_points(rows: DataFrame, column: str, parts: int) -> list[int]:
    """Values that cut a numeric column into ranges of similar row counts: at most ``parts`` - 1 of them."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    got = rows.select(F.percentile_approx(column, at, F.lit(20 * parts))).first()[0]
    return sorted(set(got or []))


def range_of(column: Column, points: list) -> Column:
    """The number of the range that a value falls into: how many of the ascending ``points`` are at most the value.

    The points are two literals, blocks and the blocks' first points, so that a
    value is compared with about twice the square root of their number.
    """
    if not points:
        return F.lit(0)
    kind = "bigint" if all(isinstance(p, int) for p in points) else "double"
    step = max(1, round(len(points) ** 0.5))
    blocks = [points[i : i + step] for i in range(0, len(points), step)]
    at_most = lambda ps: F.size(F.filter(ps, lambda p: p <= column))
    k = at_most(F.from_json(F.lit(json.dumps([b[0] for b in blocks])), f"array<{kind}>"))
    inner = at_most(F.get(F.from_json(F.lit(json.dumps(blocks)), f"array<array<{kind}>>"), k - 1))
    return F.when(k == 0, F.lit(0)).otherwise((k - 1) * step + inner)


def parts_for(rows: DataFrame) -> int:
    """How many ranges the rows should be cut into."""
    return min(MOST, max(LEAST, -(-rows.count() // RANGE_ROWS)))


def _before(ranged: DataFrame, band: str, value: Column) -> DataFrame:
    """For each range, the sum of ``value`` over the ranges before it: as many rows as ranges."""
    sums = ranged.groupBy(band).agg(value.alias("_n"))
    return sums.select(band, F.coalesce(F.sum("_n").over(Window.orderBy(band).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("_before"))


def with_place(rows: DataFrame, order: str, *tie: Column | str, name: str = "place", parts: int | None = None) -> DataFrame:
    """Adds ``name``: the row's place from 0 by ``order``, ascending, then by ``tie``.

    Rows without a value in ``order`` come first.  The ranges are Spark's own, over the
    order and its ties, so that many rows of one value are split; a partition's rows
    have consecutive numbers.
    """
    by = [F.col(order), *(F.col(t) if isinstance(t, str) else t for t in tie)]
    ranged = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    numbered = folders.saved(ranged.sortWithinPartitions(*by).withColumn("_own", F.monotonically_increasing_id()), "placed")
    numbered = numbered.withColumn("_band", F.shiftright("_own", _ROW_BITS)).withColumn("_own", F.col("_own").bitwiseAND((1 << _ROW_BITS) - 1))
    placed = numbered.join(F.broadcast(_before(numbered, "_band", F.count("*"))), "_band")
    return placed.withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).select(*rows.columns, name)


def with_running_sum(rows: DataFrame, order: str, size: str, *tie: Column | str, name: str = "start", parts: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``size`` over the rows before, by ``order`` (a number, ascending), then by ``tie``."""
    rows = folders.saved(rows, "summed")
    slim = rows.select(order)
    points = split_points(slim, order, parts or parts_for(slim))
    ranged = rows.withColumn("_band", F.coalesce(range_of(F.col(order), points), F.lit(0)))
    inner = Window.partitionBy("_band").orderBy(F.col(order), *tie).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_own", F.coalesce(F.sum(size).over(inner), F.lit(0))).join(F.broadcast(_before(ranged, "_band", F.sum(size))), "_band")
    return summed.withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_band", "_own", "_before")
