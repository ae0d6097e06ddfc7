"""Running sums over arrays, as Columns, without copying a growing list for each element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose running sum is carried on together.
CHUNK = 256


def once(value: Column, use) -> Column:
    """``use`` of a value that is found once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def starts(sizes: Column) -> Column:
    """For each element of an array of sizes, the sum of those before it (array<bigint>)."""

    def sums(values: Column, begin: Column) -> Column:
        zero = F.struct(begin.alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(values, zero, step, lambda acc: acc["out"])

    def walk(values: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))
        return once(chunks, lambda cs: F.flatten(F.zip_with(cs, sums(F.transform(cs, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0).cast("long")), sums)))

    none = F.array().cast("array<bigint>")
    short = lambda s: F.size(s).between(1, CHUNK)
    return once(sizes.cast("array<bigint>"), lambda s: F.when(short(s), sums(s, F.lit(0).cast("long"))).when(F.size(s) > 0, walk(s)).when(s.isNotNull(), none))


def regroup(flat: Column, sizes: Column) -> Column:
    """Cuts an array into parts of the given sizes."""
    both = F.struct(flat.alias("flat"), sizes.alias("sizes"))
    return once(both, lambda b: F.zip_with(starts(b["sizes"]), b["sizes"], lambda at, n: F.slice(b["flat"], at.cast("int") + 1, n.cast("int"))))
