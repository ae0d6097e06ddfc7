import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.errors import BadBox, EmptyQuery, UnknownColumn, UnknownOperator
from plinth.functions import boxes, geometry, values
from plinth.functions import format as kinds
from plinth.operators import attributes, spatial
from plinth.plans import registry
from plinth.sources import sequences

SF = "/root/testdata/sf0.001"
BOXES = "key long, xmin double, ymin double, xmax double, ymax double"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    a = sorted(tuple(str(r[c]) for c in names) for r in got.collect())
    b = sorted(tuple(str(r[want.columns.index(c)]) for c in names) for r in want.fetchall())
    assert a == b


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0


def test_point_and_nearest(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 2.0, 2.0, 3.0, 3.0), (3, 5.0, 5.0, 10.0, 10.0), (4, -10.0, -10.0, 10.0, 10.0)], BOXES)
    for x, y, n in ((0.5, 0.5, 2), (1, 1, 2), (7.5, 7.5, 2), (20, 20, 0)):
        assert df.where(boxes.contains_point(x, y)).count() == n
    df = df.where("key < 4").withColumn("hilbert_seq", F.col("key"))
    assert spatial.nearest(df, 0, 0).first()["key"] == 1
    assert spatial.nearest(df, 4, 4).first()["key"] == 2


def test_hilbert_degenerate_extent(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0), (2, 1.0, 1.0, 1.0, 1.0)], BOXES)
    assert [r["hilbert"] for r in spatial.with_hilbert(df).collect()] == [0, 0]
    two = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 2.0, 2.0, 3.0, 3.0)], BOXES)
    assert [r["key"] for r in spatial.with_sequence(spatial.with_hilbert(two), "key").orderBy("hilbert_seq").collect()] == [2, 1]


def test_feature_semantics(spark):
    rows = spark.createDataFrame([(1, 5), (1, 7), (2, 5), (3, 9), (4, None)], "f long, v long")
    got = lambda op, k: sorted(r["f"] for r in attributes.select_ids(rows, [("v", op, k)], "f").collect())
    assert got("=", 5) == [1, 2]
    assert got("!=", 5) == [3]
    assert got(">", 5) == [3]
    assert got(">=", 5) == [1, 2, 3]
    assert got("<", 7) == [2]
    assert got("<=", 7) == [1, 2]
    with pytest.raises(EmptyQuery):
        attributes.AttrQuery([])
    with pytest.raises(UnknownColumn):
        attributes.select_ids(rows, [("w", "=", 1)], "f")
    with pytest.raises(UnknownOperator):
        attributes.Condition("v", "~", 1)


def test_range_keeps_both_bounds(spark):
    rows = spark.createDataFrame([(k,) for k in range(19)], "v long")
    assert attributes.select_range(rows, "v", 0, 18).count() == 19
    assert attributes.select_range(rows, "v", 17, 18).count() == 2
    assert attributes.select_range(rows, "v", 10, 5).count() == 0


@pytest.mark.parametrize(
    "kind, nested",
    [
        ("MultiPoint", [1, 2]),
        ("MultiLineString", [[1, 2], [3]]),
        ("MultiSurface", [[[0, 1, 2], [3, 4, 5]], [[6, 7, 8]]]),
        ("Solid", [[[[0, 1, 2]], [[3, 4, 5], [6, 7, 8]]], [[[9, 1, 2]]]]),
        ("MultiSolid", [[[[[0, 1, 2]]]]]),
        ("CompositeSolid", [[[[[0, 1, 2]]], [[[3, 4, 5]]]], [[[[6, 7, 8]]]]]),
    ],
)
def test_boundaries_round_trip(spark, kind, nested):
    depth = geometry.DEPTH[kind]
    df = spark.createDataFrame([(nested,)], "b " + "array<" * depth + "bigint" + ">" * depth)
    flat = df.select(geometry.flatten(F.col("b"), depth).alias("f"))
    assert json.loads(flat.select(F.to_json(geometry.rebuild(F.col("f"), depth))).first()[0]) == nested


def test_guess_type(spark):
    cases = {"-10": "Long", "5": "ULong", "true": "Bool", "1.0": "Double", '"x"': "String", "[1]": "Json", '{"a":1}': "Json", "null": None, '"2010-10-13T12:43:04Z"': "DateTime", '"1994-04-17"': "String"}
    rows = spark.createDataFrame([(k,) for k in cases], "j string").select("j", values.guess_type(F.col("j")).alias("t"))
    assert {r["j"]: r["t"] for r in rows.collect()} == cases


def test_parse_bbox():
    assert spatial.parse_bbox("1,2,3,4") == (1, 2, 3, 4)
    for bad in ("1,2,3", "3,0,1,1", "a,b,c,d"):
        with pytest.raises(BadBox):
            spatial.parse_bbox(bad)


def test_sequence(spark, tmp_path):
    head = {"type": kinds.DOCUMENT, "version": "2.0", "transform": {"scale": [0.5, 0.5, 1], "translate": [10, 20, 0]}, "CityObjects": {}, "vertices": []}
    one = {"type": kinds.FEATURE, "id": "a", "vertices": [[0, 0, 0], [2, 4, 6]], "CityObjects": {"a": {"type": "Building", "attributes": {"h": 3.5, "n": 2, "when": "2010-10-13T12:43:04Z"}}}}
    two = {"type": kinds.FEATURE, "id": "b", "vertices": [], "CityObjects": {"b": {"type": "Road", "attributes": {"n": None}}}}
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(map(json.dumps, (head, one, two))))
    header, features = sequences.read_models(spark, str(path))
    assert header.count() == 1 and features.count() == 2
    found = {r["feature_id"]: r for r in sequences.with_box(features, header).collect()}
    assert (found["a"]["xmin"], found["a"]["ymax"], found["b"]["xmin"]) == (10.0, 22.0, None)
    objects = sequences.city_objects(features)
    assert {r["name"]: r["type"] for r in sequences.infer_schema(objects).collect()} == {"h": "Double", "n": "ULong", "when": "DateTime"}
    typed = sequences.project(objects)
    assert attributes.select_ids(typed, [("h", ">", 2.0), ("n", "=", 2)], "feature_id").count() == 1
    sequences.write_sequence(features, header, str(tmp_path / "out"))
    _, again = sequences.read_models(spark, str(tmp_path / "out"))
    assert sorted(r["feature_id"] for r in again.collect()) == ["a", "b"]


def test_surface_types(spark):
    rows = spark.createDataFrame([("Door",), ("+Solar",), ("Hedge",), (None,)], "n string").select(values.surface_type(F.col("n")).alias("s")).select("s.*")
    assert [tuple(r) for r in rows.collect()] == [("Door", None), ("ExtraSemanticSurface", "+Solar"), ("ExtraSemanticSurface", None), ("ExtraSemanticSurface", None)]


def test_point_of_contact(spark):
    address = {"thoroughfareNumber": 7, "thoroughfareName": "Lane", "locality": "Town", "postcode": "1A", "country": "Land"}
    got = lambda m: spark.createDataFrame([(json.dumps(m),)], "j string").select(values.point_of_contact(F.parse_json("j")).alias("c")).first()["c"]
    contact = {"contactName": "Ann", "emailAddress": "a@b.c", "role": "owner", "address": address}
    whole = got({"pointOfContact": contact})
    assert (whole["name"], whole["email"], whole["role"], whole["phone"]) == ("Ann", "a@b.c", "owner", None)
    assert tuple(whole["address"]) == (7, "Lane", "Town", "1A", "Land")
    assert got({"pointOfContact": contact | {"address": address | {"thoroughfareNumber": "7b"}}})["address"] is None
    assert got({"pointOfContact": contact | {"address": {"country": "Land"}}})["address"] is None
    assert got({"title": "x"}) is None
    with pytest.raises(Exception, match="emailAddress"):
        got({"pointOfContact": {"contactName": "Ann"}})


def test_sizes_and_durations(spark):
    rows = [("Bool", "true", 1), ("Double", "1.5", 8), ("String", '"é"', 6), ("DateTime", '"2020-01-01T00:00:00Z"', 24), ("Json", "[1,2]", 9), ("Int", "3", 4)]
    got = spark.createDataFrame(rows, "k string, j string, n int").select("n", values.attribute_size(F.col("k"), F.col("j")).alias("m"))
    assert all(r["n"] == r["m"] for r in got.collect())
    took = spark.createDataFrame([(0.25,), (2.5,)], "s double").select(values.format_duration(F.col("s")).alias("t"))
    assert [r["t"] for r in took.collect()] == ["250.00ms", "2.50s"]


def test_join_boxes_of_any_width(spark):
    rng = np.random.default_rng(6)

    def some(n):
        low = rng.integers(-1000, 1000, (n, 2))
        return [(i, *map(float, (x, y, x + w, y + h))) for i, ((x, y), w, h) in enumerate(zip(low.tolist(), *(10.0 ** rng.uniform(0, 4, (2, n))).round()))] + [(n, -1e9, 0.0, 1e9, 1.0)]

    a, b = some(150), some(150)
    schema = "id long, xmin double, ymin double, xmax double, ymax double"
    got = spatial.join_boxes(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 50.0).select("id", "r_id").collect()
    want = [(p[0], q[0]) for p in a for q in b if p[3] >= q[1] and p[1] <= q[3] and p[4] >= q[2] and p[2] <= q[4]]
    assert sorted(map(tuple, got)) == sorted(want)
