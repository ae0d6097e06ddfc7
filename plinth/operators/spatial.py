"""Spatial selections: boxes, points, the nearest feature, extents and the storage order."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.errors import BadBox
from plinth.functions import boxes
from plinth.operators import ordering
from plinth.sources import folders

#: Grids of the box join, each four times as coarse as the one before.
GRIDS = 24


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """Four comma-separated numbers, minima before maxima."""
    try:
        x0, y0, x1, y1 = map(float, text.split(","))
    except ValueError:
        raise BadBox(f"four numbers are needed: {text!r}") from None
    if x0 > x1 or y0 > y1:
        raise BadBox(f"minimum over maximum: {text!r}")
    return x0, y0, x1, y1


@dataclass(frozen=True)
class SpatialQuery:
    """A box, a point to be contained, or a point to be near."""

    type: str
    x0: float
    y0: float
    x1: float | None = None
    y1: float | None = None

    @classmethod
    def from_dict(cls, d: dict) -> SpatialQuery:
        if d["type"] == "bbox":
            return cls("bbox", d["minX"], d["minY"], d["maxX"], d["maxY"])
        if d["type"] in ("pointIntersects", "pointNearest"):
            return cls(d["type"], d["x"], d["y"])
        raise BadBox(f"unknown type: {d['type']}")

    def to_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v is not None}


def select(features: DataFrame, query: SpatialQuery) -> DataFrame:
    if query.type == "bbox":
        return features.where(boxes.intersects(query.x0, query.y0, query.x1, query.y1))
    if query.type == "pointIntersects":
        return features.where(boxes.contains_point(query.x0, query.y0))
    return nearest(features, query.x0, query.y0)


def nearest(features: DataFrame, x: float, y: float, *tie: Column | str) -> DataFrame:
    """The feature whose box centre is nearest; a top-1 in each task, then among those.

    Without ``tie``, equally near ones are taken in storage order, by ``hilbert_seq``.
    """
    d2 = boxes.centroid_distance_squared(x, y)
    return features.withColumn("d2", d2).orderBy("d2", *(tie or ("hilbert_seq",))).limit(1)


#: Tiles of a pyramid of centres that one tile above them has.
FAN = 16
#: Tiles from which on a level of that pyramid is written rather than worked out again.
STORED_TILES = 100_000
_CENTRES = ("cxmin", "cymin", "cxmax", "cymax")


def _square(low: Column, high: Column, at: Column) -> tuple[Column, Column]:
    """The squares of the least and the greatest distance of a value to a range."""
    outside = F.greatest(low - at, at - high, F.lit(0.0))
    inside = F.greatest(F.abs(low - at), F.abs(high - at))
    return outside * outside, inside * inside


def nearest_many(features: DataFrame, points: DataFrame, *tie: Column | str) -> DataFrame:
    """For each point (point_id, x, y), the feature whose box centre is nearest, with d2, the square of the distance.

    Branch and bound down a pyramid of tiles over the features in Hilbert order: of a
    point's tiles only those are followed whose box of centres begins no farther away
    than some other one of them ends.  Each level is an equi-join of points with the
    tiles below theirs, so neither the points nor the features are limited.  Equally
    near features are taken by ``tie``, without it in storage order (``hilbert_seq``);
    of tiles whose centres are all one place only the first by ``tie`` is followed, so
    that many features at one place cost no more than one.  Points without
    coordinates, and all points if no feature has a box, have no row.
    """
    by = [F.col(t) if isinstance(t, str) else t for t in (tie or ("hilbert_seq",))]
    rows = features.where(F.col("xmin").isNotNull() & F.col("ymin").isNotNull())
    placed = ordering.with_place(rows if "hilbert" in rows.columns else with_hilbert(rows), "hilbert", "xmin", "ymin", name="_place")
    placed = placed.withColumn("_tile", F.floor(F.col("_place") / FAN))
    centre = {a: (F.col(f"{a}min") + F.col(f"{a}max")) / 2 for a in "xy"}
    first = F.struct(*(t.alias(f"t{i}") for i, t in enumerate(by)))
    levels = [folders.saved(_centred(placed.select(F.col("_tile").alias("tile"), first.alias("first"), *(centre[c[1]].alias(c) for c in _CENTRES))), "centres")]
    left = levels[0].count()
    while left > 1:
        above = _centred(levels[-1].withColumn("tile", F.floor(F.col("tile") / FAN)))
        left = -(-left // FAN)
        levels.append(folders.saved(above, "centres") if left > STORED_TILES else above)
    found = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(0).cast("long").alias("tile"))
    for level in reversed(levels):
        below = level.withColumn("above", F.lit(0).cast("long") if level is levels[-1] else F.floor(F.col("tile") / FAN))
        found = _followed(found.withColumnRenamed("tile", "above").join(below, "above"))
    d2 = boxes.centroid_distance_squared(F.col("_x"), F.col("_y"))
    near = placed.join(found.select("point_id", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("tile").alias("_tile")), "_tile")
    best = F.min_by(F.struct(*features.columns), F.struct(d2, *by)).alias("best")
    return near.groupBy("point_id").agg(best, F.min(d2).alias("d2")).select("point_id", "best.*", "d2")


def _centred(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tile").agg(F.min("first").alias("first"), *((F.min if c.endswith("min") else F.max)(c).alias(c) for c in _CENTRES))


def _followed(rows: DataFrame) -> DataFrame:
    """The tiles of each point that may have its nearest centre."""
    (lx, hx), (ly, hy) = (_square(F.col(f"c{a}min"), F.col(f"c{a}max"), F.col(a)) for a in "xy")
    point = Window.partitionBy("point_id")
    one = (F.col("cxmin") == F.col("cxmax")) & (F.col("cymin") == F.col("cymax"))
    bounded = rows.select("*", (lx + ly).alias("low"), one.alias("one"), F.min(hx + hy).over(point).alias("bound"))
    tied = F.col("one") & (F.col("low") == F.col("bound"))
    marked = bounded.where(F.col("low") <= F.col("bound")).withColumn("best", F.min(F.when(tied, F.col("first"))).over(point))
    return marked.where(~tied | (F.col("first") == F.col("best"))).select("point_id", "x", "y", "tile")


def nearest_file(files: DataFrame, x: float, y: float) -> str | None:
    """The file (name, and the box of its centres: cxmin to cymax) whose centres are all within the least distance; None without any."""
    dx = F.greatest(F.abs(F.col("cxmin") - x), F.abs(F.col("cxmax") - x))
    dy = F.greatest(F.abs(F.col("cymin") - y), F.abs(F.col("cymax") - y))
    found = files.where("n > 0").select("name", (dx * dx + dy * dy).alias("far")).orderBy("far", "name").first()
    return None if found is None else found["name"]


def reach(features: DataFrame, x: float, y: float) -> float:
    """The distance of the nearest box centre, and a little more, as distances are rounded."""
    d2 = features.agg(F.min(boxes.centroid_distance_squared(x, y))).first()[0]
    return d2**0.5 * (1 + 1e-9) + 1e-9 * (abs(x) + abs(y))


def within_reach(x: float, y: float, far: float) -> Column:
    """Whether a box meets the square around a point; a centre that is nearer than ``far`` is in such a box."""
    return boxes.intersects(x - far, y - far, x + far, y + far)


def vertex_in_bbox(vertices: Column, transform: dict[str, float], x0: float, y0: float, x1: float, y1: float) -> Column:
    """Whether some vertex (struct of x, y, z in quantised units) lies in the box."""
    return F.exists(
        vertices,
        lambda v: boxes.point_in_box(v["x"] * transform["sx"] + transform["tx"], v["y"] * transform["sy"] + transform["ty"], x0, y0, x1, y1),
    )


def extent(rows: DataFrame, zero_if_empty: bool = True) -> DataFrame:
    """Least and greatest of the boxes' corners; six zeros (or nulls) for no rows."""
    axes = [a for a in ("x", "y", "z") if f"{a}min" in rows.columns]
    made = [f(f"{a}{f.__name__}").alias(f"{a}{f.__name__}") for f in (F.min, F.max) for a in axes]
    out = rows.agg(*made)
    return out.select(*(F.coalesce(c, F.lit(0)).alias(c) for c in out.columns)) if zero_if_empty else out


def boxes_of(points: DataFrame, key: str) -> DataFrame:
    """The quantised box of each key's points (x, y, z)."""
    return points.groupBy(key).agg(*(f(a).alias(a + f.__name__) for f in (F.min, F.max) for a in "xyz"))


def real_boxes(features: DataFrame, scale: tuple[float, ...], translate: tuple[float, ...]) -> DataFrame:
    """The features with their boxes' corners in real-world coordinates."""
    at = {f"{a}{m}": F.col(f"{a}{m}") * s + t for m in ("min", "max") for a, s, t in zip("xyz", scale, translate) if f"{a}{m}" in features.columns}
    return features.withColumns(at)


def with_hilbert(features: DataFrame) -> DataFrame:
    """Adds ``hilbert``; the extent is one row, joined to all."""
    e = features.agg(F.min("xmin").alias("e0"), F.min("ymin").alias("e1"), F.max("xmax").alias("e2"), F.max("ymax").alias("e3"))
    whole = {"xmin": F.col("e0"), "ymin": F.col("e1"), "xmax": F.col("e2"), "ymax": F.col("e3")}
    return features.join(F.broadcast(e)).withColumn("hilbert", boxes.hilbert_box(whole)).drop("e0", "e1", "e2", "e3")


def with_sequence(features: DataFrame, key: str) -> DataFrame:
    """Adds ``hilbert_seq``, the place in storage order: by descending Hilbert value, then key."""
    placed = ordering.with_place(features.withColumn("_down", -F.col("hilbert")), "_down", key, name="hilbert_seq")
    return placed.withColumn("hilbert_seq", F.col("hilbert_seq") + 1).drop("_down")


def cluster(features: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Rows ranged and sorted by descending Hilbert value, ready to be written."""
    order = [F.desc("hilbert"), F.col(key)]
    ranged = features.repartitionByRange(parts, *order) if parts else features.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def tiles(features: DataFrame, node: int = 16) -> DataFrame:
    """Boxes of each run of ``node`` features in storage order: one level of a tile pyramid."""
    tile = F.floor((F.col("hilbert_seq") - 1) / node).cast("long")
    return _rolled(features, tile, F.count("*"))


def _rolled(rows: DataFrame, tile: Column, n: Column) -> DataFrame:
    return rows.groupBy(tile.alias("tile")).agg(*(f(c).alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))), n.alias("n"))


def pyramid(features: DataFrame, node: int = 16) -> DataFrame:
    """level, tile, box and n (features) of all levels: 0 over the features, each further one over ``node`` tiles, up to one tile."""
    level = folders.saved(tiles(features, node), "tiles")
    out = level.select(F.lit(0).alias("level"), "*")
    left, k = level.count(), 0
    while left > 1:
        k, left = k + 1, -(-left // node)
        level = _rolled(level, F.floor(F.col("tile") / node).cast("long"), F.sum("n"))
        out = out.unionByName(level.select(F.lit(k).alias("level"), "*"))
    return out


def _smallest_cell(*sides: DataFrame) -> float:
    """A cell so small that ``GRIDS`` grids reach from it to the whole extent."""
    boxed = None
    for df in sides:
        own = df.select(*boxes.BOX)
        boxed = own if boxed is None else boxed.unionByName(own)
    r = boxed.agg(F.max("xmax") - F.min("xmin"), F.max("ymax") - F.min("ymin")).first()
    return max(float(r[0] or 0), float(r[1] or 0), 1e-300) / 4.0 ** (GRIDS - 10)


def join_boxes(left: DataFrame, right: DataFrame, size: float | None = None) -> DataFrame:
    """Pairs of overlapping boxes: equi-joins on grid cells, each pair kept in one cell only.

    Both sides need xmin to ymax; the right side's columns get the prefix ``r_``.
    See ``box_candidates``; boxes with nulls meet none.
    """
    pairs = box_candidates(left, right, size)
    meet = (F.col("xmax") >= F.col("r_xmin")) & (F.col("xmin") <= F.col("r_xmax")) & (F.col("ymax") >= F.col("r_ymin")) & (F.col("ymin") <= F.col("r_ymax"))
    first = (F.col("cx") == F.floor(F.greatest("xmin", "r_xmin") / F.col("cell"))) & (F.col("cy") == F.floor(F.greatest("ymin", "r_ymin") / F.col("cell")))
    return pairs.where(meet & first).drop("cell", "cx", "cy")


def box_candidates(left: DataFrame, right: DataFrame, size: float | None = None) -> DataFrame:
    """Pairs of boxes that have a grid cell in common, with ``cell`` (its size), ``cx`` and ``cy``.

    A box has the finest grid, of cells of ``size`` times a power of four, whose
    cells are as large as the box; it covers four cells at most there.  A pair
    meets in the coarser grid of the two, so wide boxes cost no more cells.

    Without ``size`` the finest cells are those of a 2^28-th of the extent.  Then
    boxes that share a cell are about as large as it or lie in a box that is, so
    that a dense place has about as many candidates as it has pairs, however dense it is;
    a cell with many rows of one side is split by Spark's skew join.
    """
    size = float(size) if size else _smallest_cell(left, right)
    grids = F.sequence(F.lit(0), F.lit(GRIDS - 1))
    cell = F.lit(size) * F.pow(F.lit(4.0), F.col("grid"))

    def graded(df: DataFrame) -> DataFrame:
        width = F.greatest(boxes.width(), boxes.height())
        fits = F.filter(grids, lambda g: width <= F.lit(size) * F.pow(F.lit(4.0), g))
        return df.withColumn("own", F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(GRIDS - 1)))

    def celled(df: DataFrame) -> DataFrame:
        across = F.sequence(F.floor(F.col("xmin") / cell), F.floor(F.col("xmax") / cell))
        down = F.sequence(F.floor(F.col("ymin") / cell), F.floor(F.col("ymax") / cell))
        return df.withColumn("cx", F.explode(across)).withColumn("cy", F.explode(down))

    def used(df: DataFrame) -> list[int]:
        return [r["own"] for r in df.select("own").where(F.col("own").isNotNull()).distinct().collect()]

    def coarser(df: DataFrame, others: list[int], equal: bool) -> DataFrame:
        """The cells of each box in the grids of the other side that are coarser than its own, or ``equal``."""
        there = F.array(*map(F.lit, sorted(others))).cast("array<int>")
        return celled(df.withColumn("grid", F.explode(F.filter(there, lambda g: (g >= F.col("own")) if equal else (g > F.col("own"))))))

    def prefixed(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), "grid", "cx", "cy")

    a, b = graded(left), graded(right)
    own_a, own_b = celled(a.withColumn("grid", F.col("own"))), celled(b.withColumn("grid", F.col("own")))
    on = ["grid", "cx", "cy"]
    kept = [*left.columns, *(f"r_{c}" for c in right.columns), cell.alias("cell"), "cx", "cy"]
    return own_a.join(prefixed(coarser(b, used(a), True)), on).select(kept).unionByName(coarser(a, used(b), False).join(prefixed(own_b), on).select(kept))


#: Parts that ``join_totals`` cuts a run of ranks into, level by level.
RANK_FAN = 64


def join_totals(left: DataFrame, right: DataFrame, **sums: Column) -> DataFrame:
    """The columns of each right box (with the prefix ``r_``) that meets left boxes, ``n``, how many, and the ``sums`` of whole numbers over them.

    The same as an aggregation of ``join_boxes`` by the right rows, without the pairs.
    Along an axis, a box meets another if it begins no later than that ends, and doesn't
    end before that begins; as the second rules out the first, what meets along both
    axes is a difference of four sums over all boxes whose one corner lies below a
    point.  For these, boxes and points are ranked along x; ranks are cut into
    ``RANK_FAN`` runs, those again and so on, and the ranks below a point's are at
    most ``RANK_FAN`` - 1 whole runs of each level, in each of which the corners below
    it are a running sum along y.  The largest group that is sorted is one of ``RANK_FAN`` parts.
    Boxes with nulls, or that end before they begin, meet none.
    """
    sound = (F.col("xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("ymax"))
    total = {"n": F.lit(1), **sums}
    boxed = left.where(sound).select(*boxes.BOX, *(c.cast("long").alias(f"_{i}") for i, c in enumerate(total.values())))
    points = folders.saved(boxed, "boxes")
    asked = folders.saved(right.where(sound).withColumn("_id", F.monotonically_increasing_id()), "asked")
    none = [F.lit(None).cast("long").alias(f"_{i}") for i in range(len(total))]
    places = points.count() + asked.count()
    found = None
    # At equal coordinates a box that begins counts (it comes first), one that ends doesn't.
    for corner, other, first, sign in (("xmin", "xmax", 0, 1), ("xmax", "xmin", 2, -1)):
        boxes_ = points.select(F.col(corner).alias("u"), F.lit(first).alias("turn"), F.lit(None).cast("long").alias("_id"), "ymin", "ymax", *(f"_{i}" for i in range(len(total))))
        asks = asked.select(F.col(other).alias("u"), F.lit(1).alias("turn"), "_id", F.col("ymax").alias("ymin"), F.col("ymin").alias("ymax"), *none)
        part = _below(ordering.with_place(boxes_.unionByName(asks), "u", "turn", "ymin", "ymax", name="_rank"), places, len(total))
        part = part.select("_id", *((sign * F.col(f"_{i}")).alias(f"_{i}") for i in range(len(total))))
        found = part if found is None else found.unionByName(part)
    by = found.groupBy("_id").agg(*(F.sum(f"_{i}").alias(n) for i, n in enumerate(total)))
    kept = [F.col(c).alias(f"r_{c}") for c in right.columns]
    return asked.join(by.where("n > 0"), "_id").select(*kept, *total)


def _below(ranked: DataFrame, places: int, n: int) -> DataFrame:
    """For each ranked point (_id) sums over the boxes of lower ranks: those that begin below it along y, less those that end there."""
    sizes = []
    while not sizes or sizes[-1] > 1:
        sizes.append(-(-(sizes[-1] if sizes else max(places, 2)) // RANK_FAN))
    runs, path, rest = [], F.lit(0).cast("long"), F.col("_rank")
    for level, size in enumerate(sizes):
        digit = F.floor(rest / size)
        own = F.struct(F.lit(level).alias("level"), (path * RANK_FAN + digit).alias("run"))
        lower = F.transform(F.filter(F.sequence(F.lit(0), F.lit(RANK_FAN - 1)), lambda d: d < digit), lambda d: F.struct(F.lit(level).alias("level"), (path * RANK_FAN + d).alias("run")))
        runs.append(F.when(F.col("_id").isNull(), F.array(own)).otherwise(lower))
        path, rest = path * RANK_FAN + digit, rest % size
    sums = [f"_{i}" for i in range(n)]
    rows = ranked.select("_id", "ymin", "ymax", *sums, F.explode(F.flatten(F.array(*runs))).alias("at"))
    box = F.col("_id").isNull()
    ends = [F.struct(F.lit(sign).alias("sign"), F.col(c).alias("v"), F.when(box, turn).otherwise(1).alias("turn")) for c, turn, sign in (("ymin", 0, 1), ("ymax", 2, -1))]
    rows = rows.select("_id", *sums, "at.*", F.explode(F.array(*ends)).alias("y")).select("_id", *sums, "level", "run", "y.*")
    upto = Window.partitionBy("level", "run", "sign").orderBy("v", "turn").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.select("_id", "sign", *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in sums))
    return summed.where(F.col("_id").isNotNull()).select("_id", *((F.col("sign") * F.col(c)).alias(c) for c in sums))
