"""Box predicates, distances and the Hilbert order, as Columns.

A box is four columns xmin, ymin, xmax, ymax.  Comparisons stay plain, so that
the scan can skip Parquet row groups by their statistics.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("xmin", "ymin", "xmax", "ymax")
LEVELS = 16
CELLS = (1 << LEVELS) - 1


def intersects(x0: float, y0: float, x1: float, y1: float) -> Column:
    """Whether the row's box and a closed box share a point."""
    return (F.col("xmax") >= x0) & (F.col("xmin") <= x1) & (F.col("ymax") >= y0) & (F.col("ymin") <= y1)


def contains_point(x: float, y: float) -> Column:
    """Whether the row's box contains a point; its border counts."""
    return (F.col("xmin") <= x) & (F.col("xmax") >= x) & (F.col("ymin") <= y) & (F.col("ymax") >= y)


def point_in_box(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    return x.between(x0, x1) & y.between(y0, y1)


def width() -> Column:
    return F.col("xmax") - F.col("xmin")


def height() -> Column:
    return F.col("ymax") - F.col("ymin")


def centroid_distance_squared(x, y) -> Column:
    dx = (F.col("xmin") + F.col("xmax")) / 2 - x
    dy = (F.col("ymin") + F.col("ymax")) / 2 - y
    return dx * dx + dy * dy


def min_distance_squared(x, y) -> Column:
    """Squared distance to the box; 0 inside."""
    zero = F.lit(0.0)
    dx = F.greatest(F.col("xmin") - x, zero, F.lit(x) - F.col("xmax"))
    dy = F.greatest(F.col("ymin") - y, zero, F.lit(y) - F.col("ymax"))
    return dx * dx + dy * dy


#: Levels of the curve that one look-up covers.
AT_ONCE = 4


def _curve() -> list[int]:
    """For each orientation and the next bits of x and y: the quadrants' numbers, and below them the orientation after these levels.

    An orientation says whether the axes are exchanged (1) and turned around (2).
    From the coarsest bit to the finest, a quadrant has its number, and is entered in
    an orientation of its own.
    """
    table = []
    for start in range(4):
        for x in range(1 << AT_ONCE):
            for y in range(1 << AT_ONCE):
                now, number = start, 0
                for level in reversed(range(AT_ONCE)):
                    across, up = (x >> level) & 1, (y >> level) & 1
                    if now & 1:
                        across, up = up, across
                    if now & 2:
                        across, up = 1 - across, 1 - up
                    number = number * 4 + (3 * across ^ up)
                    if not up:
                        now ^= 3 if across else 1
                table.append(number << 2 | now)
    return table


def hilbert(x: Column, y: Column) -> Column:
    """Place of a cell along a Hilbert curve through 65,536 by 65,536 cells: a look-up for each ``AT_ONCE`` levels."""
    table, mask = F.lit(_curve()), (1 << AT_ONCE) - 1
    found, place = None, F.lit(0).cast("long")
    for shift in range(LEVELS - AT_ONCE, -1, -AT_ONCE):
        bits = F.shiftright(x.cast("int"), shift).bitwiseAND(mask) * (1 << AT_ONCE) + F.shiftright(y.cast("int"), shift).bitwiseAND(mask)
        at = bits if found is None else found.bitwiseAND(3) * (1 << 2 * AT_ONCE) + bits
        found = F.get(table, at)
        place = place + F.shiftright(found, 2).cast("long") * F.lit(4**shift).cast("long")
    return place


def cell(low: Column, high: Column, least: Column, most: Column) -> Column:
    """The cell of a box's centre along one axis; 0 where the extent has no width."""
    return F.coalesce(F.floor(F.try_divide(CELLS * ((low + high) / 2 - least), most - least)), F.lit(0)).cast("int")


def hilbert_box(extent: dict[str, Column | float]) -> Column:
    """Hilbert place of the row's box within an extent (xmin, ymin, xmax, ymax)."""
    e = {k: F.lit(v) if not isinstance(v, Column) else v for k, v in extent.items()}
    return hilbert(
        cell(F.col("xmin"), F.col("xmax"), e["xmin"], e["xmax"]),
        cell(F.col("ymin"), F.col("ymax"), e["ymin"], e["ymax"]),
    )
