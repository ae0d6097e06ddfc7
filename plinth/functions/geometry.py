"""Nested geometry to flat arrays and back, as Columns.

Boundaries nest by geometry type: points, strings of points, surfaces of
strings, shells of surfaces, solids of shells.  Flat form: the vertex indices
end to end, and for each level above them the number of parts of each member.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.functions import arrays

#: Levels of nesting.  Fixed values of the exchange format.
DEPTH = {
    "MultiPoint": 1,
    "MultiLineString": 2,
    "MultiSurface": 3,
    "CompositeSurface": 3,
    "Solid": 4,
    "MultiSolid": 5,
    "CompositeSolid": 5,
}
#: Names of the counts, from the innermost level: points of a string, strings of a surface, ...
COUNTS = ("strings", "surfaces", "shells", "solids")


def flatten(boundaries: Column, depth: int) -> Column:
    """A struct of ``boundaries`` (indices) and the counts of the levels that there are; the others are empty."""
    empty = F.array().cast("array<bigint>")

    def at(level: Column, left: int, counts: list[Column]) -> Column:
        if left == 0:
            inner_first = counts[::-1]
            own = [(inner_first[i] if i < len(inner_first) else empty).alias(n) for i, n in enumerate(COUNTS)]
            return F.struct(*own, level.cast("array<bigint>").alias("boundaries"))
        # Each level is worked out once, from the one above it.
        both = F.struct(F.transform(level, lambda x: F.size(x).cast("long")).alias("n"), F.flatten(level).alias("level"))
        return arrays.once(both, lambda b: at(b["level"], left - 1, [*counts, b["n"]]))

    return arrays.once(boundaries, lambda whole: at(whole, depth - 1, []))


def rebuild(flat: Column, depth: int) -> Column:
    """The nested boundaries from a struct that ``flatten`` gives."""
    level = flat["boundaries"]
    for name in COUNTS[: depth - 1]:
        level = arrays.regroup(level, flat[name])
    return level


def encode_semantics(values: Column, depth: int) -> Column:
    """Surface ordinals end to end; null stays null."""
    for _ in range(max(0, depth - 3)):
        values = F.flatten(values)
    return values


def decode_semantics(values: Column, flat: Column, depth: int) -> Column:
    """Surface ordinals nested as the type's shells and solids are."""
    if depth >= 4:
        values = arrays.regroup(values, flat["shells"])
    if depth >= 5:
        values = arrays.regroup(values, flat["solids"])
    return values


def instance(template: Column, matrix: Column, boundaries: Column) -> Column:
    """A geometry instance; it needs sixteen matrix values and one vertex."""
    bad = F.size(matrix) != 16
    return F.struct(
        template.cast("long").alias("template"),
        F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("an instance needs a matrix of 16 values"))).otherwise(matrix).alias("matrix"),
        F.when(F.coalesce(F.size(boundaries) != 1, F.lit(True)), F.raise_error(F.lit("an instance needs one vertex"))).otherwise(boundaries).alias("boundaries"),
    )
