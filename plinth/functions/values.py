"""Types, names and other scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.functions import geometry

#: Attribute types and the Spark types that hold them.
SPARK_TYPES = {
    "Byte": "tinyint", "UByte": "smallint", "Bool": "boolean", "Short": "smallint", "UShort": "int", "Int": "int", "UInt": "bigint",
    "Long": "bigint", "ULong": "decimal(20,0)", "Float": "float", "Double": "double", "String": "string", "Json": "string",
    "DateTime": "timestamp", "Binary": "binary",
}

#: The types of city objects.
OBJECT_TYPES = (
    "Bridge", "BridgePart", "BridgeInstallation", "BridgeConstructiveElement", "BridgeRoom", "BridgeFurniture", "Building", "BuildingPart",
    "BuildingInstallation", "BuildingConstructiveElement", "BuildingFurniture", "BuildingStorey", "BuildingRoom", "BuildingUnit",
    "CityFurniture", "CityObjectGroup", "GenericCityObject", "LandUse", "OtherConstruction", "PlantCover", "SolitaryVegetationObject",
    "TINRelief", "Road", "Railway", "Waterway", "TransportSquare", "Tunnel", "TunnelPart", "TunnelInstallation",
    "TunnelConstructiveElement", "TunnelHollowSpace", "TunnelFurniture", "WaterBody",
)

#: The types of semantic surfaces.
SURFACE_TYPES = (
    "RoofSurface", "GroundSurface", "WallSurface", "ClosureSurface", "OuterCeilingSurface", "OuterFloorSurface", "Window", "Door",
    "InteriorWallSurface", "CeilingSurface", "FloorSurface", "WaterSurface", "WaterGroundSurface", "WaterClosureSurface",
    "TrafficArea", "AuxiliaryTrafficArea", "TransportationMarking", "TransportationHole",
)

#: Bytes of a stored attribute of each type of fixed size.
SIZES = {"Byte": 1, "UByte": 1, "Bool": 1, "Short": 2, "UShort": 2, "Int": 4, "UInt": 4, "Long": 8, "ULong": 8, "Float": 4, "Double": 8}

def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"


def is_datetime(text: Column) -> Column:
    return text.rlike(RFC3339) & F.try_to_timestamp(text).isNotNull()


def to_instant(text: Column) -> Column:
    """The instant of an RFC 3339 text; null for any other."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(text))


def guess_type(json: Column) -> Column:
    """The attribute type of a JSON value (as text); null for JSON null.

    Numbers with a fraction or exponent are Double, others ULong or, below zero,
    Long; texts are DateTime if they are RFC 3339, else String; arrays and
    objects are Json.
    """
    t = F.trim(json)
    inner = F.regexp_extract(t, r'^"(.*)"$', 1)
    return (
        F.when(t.isin("true", "false"), "Bool")
        .when(t.isNull() | (t == "null"), F.lit(None).cast("string"))
        .when(t.rlike(r"^-?[0-9]+$"), F.when(t.startswith("-"), "Long").otherwise("ULong"))
        .when(t.rlike(r"^-?[0-9]"), "Double")
        .when(t.rlike(r"^[\[{]"), "Json")
        .when(is_datetime(inner), "DateTime")
        .otherwise("String")
    )


def variant_type(value: Column) -> Column:
    """``guess_type`` of a variant, which still knows whether a whole number was written with a fraction."""
    kind, json = F.schema_of_variant(value), F.to_json(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.when(kind == "BIGINT", F.when(json.startswith("-"), "Long").otherwise("ULong")).when(json.rlike("^[0-9]{19,}$"), "ULong").otherwise("Double")
    return (
        F.when(value.isNull() | (kind == "VOID"), F.lit(None).cast("string"))
        .when(kind == "BOOLEAN", "Bool")
        .when(kind.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"), number)
        .when(kind.rlike("^(?:OBJECT|ARRAY)"), "Json")
        .when(is_datetime(text), "DateTime")
        .otherwise("String")
    )


def normalise_type(name: Column) -> Column:
    """Known and extension types as they are, others as GenericCityObject."""
    return F.when(name.isin(*OBJECT_TYPES) | name.startswith("+"), name).otherwise("GenericCityObject")


def surface_type(name: Column) -> Column:
    """type and extension: known surface types as they are, others as ExtraSemanticSurface; names with a plus are extensions."""
    known = F.when(name.isin(*SURFACE_TYPES), name).otherwise("ExtraSemanticSurface")
    return F.struct(known.alias("type"), F.when(name.startswith("+"), name).alias("extension"))


def point_of_contact(metadata: Column) -> Column:
    """The contact in a header's metadata (variant); null without one.

    Fails without a name or an e-mail address.  The address is there only with
    all five of its parts, of which the number must be a whole one.
    """
    at = lambda path, kind="string": F.try_variant_get(metadata, f"$.pointOfContact{path}", kind)
    needed = lambda path: F.coalesce(at(path), F.raise_error(F.lit(f"missing field: {path[1:]}")).cast("string"))
    parts = {
        "thoroughfare_number": at(".address.thoroughfareNumber", "bigint"), "thoroughfare_name": at(".address.thoroughfareName"), "locality": at(".address.locality"),
        "postcode": F.coalesce(at(".address.postcode"), at(".address.postalCode")), "country": at(".address.country"),
    }
    whole = F.lit(True)
    for c in parts.values():
        whole = whole & c.isNotNull()
    address = F.when(whole, F.struct(*(c.alias(n) for n, c in parts.items())))
    contact = F.struct(
        needed(".contactName").alias("name"), at(".contactType").alias("type"), at(".role").alias("role"), at(".phone").alias("phone"),
        needed(".emailAddress").alias("email"), at(".website").alias("website"), address.alias("address"),
    )
    return F.when(at("", "variant").isNotNull(), contact)


def attribute_size(kind: Column, json: Column) -> Column:
    """Bytes that an attribute of a type takes when it is stored; texts and JSON have their length before them."""
    fixed = F.element_at(F.create_map(*(F.lit(x) for pair in SIZES.items() for x in pair)), kind)
    text = F.coalesce(F.try_variant_get(F.try_parse_json(json), "$", "string"), F.lit(""))
    return F.when(kind == "Json", F.octet_length(json) + 4).when(kind.isin("String", "DateTime", "Binary"), F.octet_length(text) + 4).otherwise(fixed)


def reference_system(url: Column) -> Column:
    """Authority, version and code of a CRS URL; numbers that don't parse are 0."""
    part = lambda n: F.regexp_extract(url, r"/def/crs/([^/]+)/([^/]+)/([^/]+)$", n)
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("authority"), number(part(2)).alias("version"), number(part(3)).alias("code"))


def prefix_key(text: Column, n: int = 50) -> Column:
    """The first ``n`` bytes of a text."""
    return F.substring(text.cast("binary"), 1, n)


def lossy_text(data: Column) -> Column:
    """The text of bytes up to the first zero byte; what isn't UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(F.split_part(data.cast("string"), F.lit("\0"), F.lit(1)))


def geometry_type(name: Column) -> Column:
    """Known types of geometries as they are, others as Solid."""
    return F.when(name.isin(*geometry.DEPTH, "GeometryInstance"), name).otherwise("Solid")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b isn't positive."""
    return F.when(b > 0, a / b).otherwise(0.0)


def format_size(n: Column) -> Column:
    """Bytes for people, in steps of 1024."""
    out = F.format_string("%d B", n.cast("long"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.2f {unit}", n / float(1024**k))).otherwise(out)
    return out


def format_duration(seconds: Column) -> Column:
    """Seconds for people; less than one as milliseconds."""
    return F.when(seconds >= 1, F.format_string("%.2fs", seconds)).otherwise(F.format_string("%.2fms", seconds * 1000.0))
