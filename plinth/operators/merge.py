"""Merging features into documents, Wavefront OBJ and appearance, with Columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.errors import BadInput
from plinth.functions import arrays, geometry
from plinth.operators import ordering
from plinth.sources import folders, sequences


def _by_depth(kind: Column, make) -> Column:
    """``make`` for the nesting depth of the geometry type ``kind``; null for other types."""
    out = None
    for depth in sorted(set(geometry.DEPTH.values())):
        here = kind.isin(*(k for k, d in geometry.DEPTH.items() if d == depth))
        out = F.when(here, make(depth)) if out is None else out.when(here, make(depth))
    return out


def _nested(depth: int, kind: str = "int") -> str:
    return "array<" * depth + kind + ">" * depth


def reindex(g: Column, moved: Column) -> Column:
    """The geometry (variant) with each vertex index i replaced by ``moved[i]``; instances too."""

    def shift(level: Column, depth: int) -> Column:
        return F.transform(level, (lambda i: moved[i]) if depth == 1 else (lambda x: shift(x, depth - 1)))

    kind = F.try_variant_get(g, "$.type", "string")
    place = lambda d: F.to_variant_object(shift(F.try_variant_get(g, "$.boundaries", _nested(d)), d))
    found = F.when(kind == "GeometryInstance", place(1)).otherwise(_by_depth(kind, place))
    return arrays.once(found, lambda new: _put(g, "boundaries", new))


def _put(whole: Column, member: str, new: Column) -> Column:
    """An object (variant) with another value (variant) of a member, or as it is where that is null."""
    fields = F.try_variant_get(whole, "$", "map<string,variant>")
    put = F.map_concat(F.map_filter(fields, lambda k, _: k != member), F.create_map(F.lit(member), new))
    return F.when(new.isNotNull(), F.to_variant_object(put)).otherwise(whole)


def shared_vertices(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct vertices of each file with their index (by x, y, z), and the features with ``moved``: own index to the file's.

    Vertices are numbered over all files, in ranges of similar size, and a file's first
    place is taken off again, so that no task numbers a whole file.
    """
    points = features.select("file", "feature_seq", F.posexplode("vertices").alias("i", "v"))
    distinct = points.select("file", "v").distinct()
    placed = ordering.with_place(distinct, "file", "v.x", "v.y", "v.z")
    first = placed.groupBy("file").agg(F.min("place").alias("first"))
    indexed = placed.join(sequences.headers(first, "first"), "file").select("file", "v", (F.col("place") - F.col("first")).cast("int").alias("at"))
    found = points.join(indexed, ["file", "v"]).groupBy("file", "feature_seq").agg(F.array_sort(F.collect_list(F.struct("i", "at"))).alias("m"))
    found = found.select("file", "feature_seq", F.transform("m", lambda x: x["at"]).alias("moved"))
    return indexed, features.join(found, ["file", "feature_seq"], "left").withColumn("moved", F.coalesce("moved", F.array().cast("array<int>")))


#: The order of a document's pieces: its part, an object's id, a vertex's number.
PIECE = ["part", "object_id", "at"]


def document_pieces(features: DataFrame, header: DataFrame) -> DataFrame:
    """file, part, object_id, at and value: the features of each file as pieces of one document, a row for each object and each vertex.

    The values of a file, one after another in the order of ``PIECE``, are its document's
    text, so that no row holds a document.  Equal vertices become one.  Of objects that
    features share by id the one of the feature that comes last is kept.  A file
    without features gives a document without objects.
    """
    features = folders.saved(features.select("file", "feature_seq", "vertices", "objects"), "merged")
    distinct, moved = shared_vertices(features)
    head = F.to_json(F.struct("type", "version", "transform", "metadata", "extensions", "appearance", "geometry-templates"))
    opened = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.when(F.length(head) > 2, ",").otherwise(""), F.lit('"CityObjects":{'))
    ends = F.array(*(F.struct(F.lit(part).alias("part"), value.alias("value")) for part, value in ((0, opened), (2, F.lit('},"vertices":[')), (4, F.lit("]}")))))
    frame = header.select("file", F.explode(ends).alias("e")).select("file", "e.part", F.lit("").alias("object_id"), F.lit(0).alias("at"), "e.value")
    rows = moved.select("file", "feature_seq", "moved", F.explode("objects").alias("object_id", "o"))
    shapes = F.transform(F.try_variant_get("o", "$.geometry", "array<variant>"), lambda g: reindex(g, F.col("moved")))
    whole = arrays.once(F.to_variant_object(shapes), lambda new: _put(F.col("o"), "geometry", new))
    named = F.to_json(F.create_map("object_id", whole))
    objects = rows.select("file", "object_id", "feature_seq", F.substring(named, F.lit(2), F.length(named) - 2).alias("text"))
    objects = objects.groupBy("file", "object_id").agg(F.max_by("text", "feature_seq").alias("text"))
    first = objects.groupBy("file").agg(F.min("object_id").alias("first"))
    comma = F.when(F.col("object_id") == F.col("first"), "").otherwise(",")
    objects = objects.join(first, "file").select("file", F.lit(1).alias("part"), "object_id", F.lit(0).alias("at"), F.concat(comma, "text").alias("value"))
    vertex = F.concat(F.when(F.col("at") > 0, ",").otherwise(""), F.to_json(F.array("v.x", "v.y", "v.z")))
    vertices = distinct.select("file", F.lit(3).alias("part"), F.lit("").alias("object_id"), "at", vertex.alias("value"))
    return frame.unionByName(objects).unionByName(vertices)


def merge_documents(features: DataFrame, header: DataFrame) -> DataFrame:
    """file and value: the features of each file as one document (JSON text), which must fit a task; see ``document_pieces``."""
    pieces = document_pieces(features, header).groupBy("file").agg(F.array_sort(F.collect_list(F.struct(*PIECE, "value"))).alias("s"))
    return pieces.select("file", F.array_join(F.transform("s", lambda x: x["value"]), "").alias("value"))


def write_document(features: DataFrame, header: DataFrame, path: str, parts: int | None = None, compression: str | None = None) -> None:
    """One file's features as a document of any size, in part files that make it up in the order of their names."""
    one_file(header)
    pieces = document_pieces(features, header)
    ranged = pieces.repartitionByRange(parts, *PIECE) if parts else pieces.repartitionByRange(*PIECE)
    ranged.sortWithinPartitions(*PIECE).select("value").write.mode("overwrite").text(path, compression=compression)


def one_file(header: DataFrame) -> None:
    """An error if there are headers of several files."""
    if header.limit(2).count() > 1:
        raise BadInput("the models of several files can't be one text: take them one by one")


def surfaces(g: Column) -> Column:
    """The surfaces of a geometry (variant) of any type that has them, end to end: arrays of rings."""

    def level(depth: int) -> Column:
        if depth < 3:
            return F.lit(None).cast(_nested(3))
        found = F.try_variant_get(g, "$.boundaries", _nested(depth))
        for _ in range(depth - 3):
            found = F.flatten(found)
        return found

    return _by_depth(F.try_variant_get(g, "$.type", "string"), level)


def obj_lines(features: DataFrame, header: DataFrame, parts: int | None = None) -> DataFrame:
    """Lines of a Wavefront OBJ text for one file's features, in the order of at (feature), part, object_id and line.

    A feature's vertices come first, in real coordinates, then for each object its
    name and a face for each surface's outer ring; OBJ has no holes.
    """
    features = folders.saved(features.select("file", "feature_seq", "vertices", "objects"), "obj")
    sized = features.select("feature_seq", F.size("vertices").cast("long").alias("n_vertices"))
    before = ordering.with_running_sum(sized, "feature_seq", "n_vertices", name="before", parts=parts).drop("n_vertices")
    real = [F.col(f"v.{a}") * F.col("transform.scale")[i] + F.col("transform.translate")[i] for i, a in enumerate("xyz")]
    points = sequences.with_transform(features, header).select(F.col("feature_seq").alias("at"), F.lit(0).alias("part"), "transform", F.posexplode("vertices").alias("line", "v"))
    points = points.select("at", "part", F.lit("").alias("object_id"), F.col("line").cast("long").alias("line"), F.concat_ws(" ", F.lit("v"), *real).alias("value"))
    objects = features.select("feature_seq", F.explode("objects").alias("object_id", "o"))
    names = objects.select(F.col("feature_seq").alias("at"), F.lit(1).alias("part"), "object_id", F.lit(-1).cast("long").alias("line"), F.concat(F.lit("o "), "object_id").alias("value"))
    shapes = F.try_variant_get("o", "$.geometry", "array<variant>")
    rings = F.transform(F.flatten(F.transform(shapes, lambda g: arrays.once(surfaces(g), lambda s: F.coalesce(s, F.array().cast(_nested(3)))))), lambda s: s[0])
    # Only the rings meet the features' first numbers.
    faces = objects.select("feature_seq", "object_id", rings.alias("rings")).join(before, "feature_seq")
    faces = faces.select("feature_seq", "before", "object_id", F.posexplode("rings").alias("line", "ring")).where(F.size("ring") > 2)
    index = F.transform("ring", lambda i: (i + 1 + F.col("before")).cast("string"))
    faces = faces.select(F.col("feature_seq").alias("at"), F.lit(1).alias("part"), "object_id", F.col("line").cast("long").alias("line"), F.concat(F.lit("f "), F.array_join(index, " ")).alias("value"))
    return points.unionByName(names).unionByName(faces)


def write_obj(features: DataFrame, header: DataFrame, path: str) -> None:
    """An OBJ text of one file's features in part files, in the order of their names; headers of several files are an error."""
    one_file(header)
    order = ("at", "part", "object_id", "line")
    obj_lines(features, header).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def surface_materials(objects: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """A row for each surface that has a material: object, geometry number, theme, surface number and the material (variant).

    A theme gives one material for all surfaces or a value for each; null values have none.
    Without ``features``, the objects have their feature's ``appearance`` themselves, and no join is needed.
    """
    materials = F.try_variant_get("appearance", "$.materials", "array<variant>").alias("materials")
    own = [] if features is not None else [materials]
    shapes = objects.select("file", "feature_seq", "object_id", *own, F.posexplode("geometry").alias("geometry_no", "g"))
    themes = shapes.select("*", F.explode(F.try_variant_get("g", "$.material", "map<string,variant>")).alias("theme", "m"))
    one = F.try_variant_get("m", "$.value", "int")
    n = F.size(surfaces(F.col("g")))
    each = F.array_repeat(one, n)
    flat1 = F.try_variant_get("m", "$.values", "array<int>")
    flat2 = F.flatten(F.try_variant_get("m", "$.values", "array<array<int>>"))
    flat3 = F.flatten(F.flatten(F.try_variant_get("m", "$.values", "array<array<array<int>>>")))
    kept = ["file", "feature_seq", "object_id", *(["materials"] if own else []), "geometry_no", "theme"]
    rows = themes.select(*kept, F.posexplode(F.when(one.isNotNull(), each).otherwise(F.coalesce(flat1, flat2, flat3))).alias("surface", "material_no"))
    joined = rows.where(F.col("material_no").isNotNull())
    if features is not None:
        joined = joined.join(features.select("file", "feature_seq", materials), ["file", "feature_seq"])
    return joined.withColumn("material", F.get("materials", F.col("material_no"))).drop("materials")


def surface_textures(objects: DataFrame, features: DataFrame) -> DataFrame:
    """A row for each textured ring: object, geometry number, theme, ring number, the texture (variant) and its texture vertices."""
    shapes = objects.select("file", "feature_seq", "object_id", F.posexplode("geometry").alias("geometry_no", "g"))
    themes = shapes.select("*", F.explode(F.try_variant_get("g", "$.texture", "map<string,variant>")).alias("theme", "m"))
    surface = F.flatten(F.try_variant_get("m", "$.values", _nested(3)))
    solid = F.flatten(F.flatten(F.try_variant_get("m", "$.values", _nested(4))))
    solids = F.flatten(F.flatten(F.flatten(F.try_variant_get("m", "$.values", _nested(5)))))
    rows = themes.select("file", "feature_seq", "object_id", "geometry_no", "theme", F.posexplode(F.coalesce(surface, solid, solids)).alias("ring_no", "ring"))
    table = features.select("file", "feature_seq", *(F.try_variant_get("appearance", f"$['{a}']", b).alias(c) for a, b, c in (("textures", "array<variant>", "textures"), ("vertices-texture", "array<array<double>>", "uv"))))
    joined = rows.where(F.get("ring", F.lit(0)).isNotNull()).join(table, ["file", "feature_seq"])
    at = F.transform(F.slice("ring", 2, F.size("ring") - 1), lambda i: F.get("uv", i))
    return joined.select("file", "feature_seq", "object_id", "geometry_no", "theme", "ring_no", F.get("textures", F.col("ring")[0]).alias("texture"), at.alias("texture_vertices"))
