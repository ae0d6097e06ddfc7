"""Bad lines, attributes of any name, NaN, typed geometries and what a stored dataset knows of its files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from plinth import __main__ as cli
from plinth.errors import BadInput, UnknownColumn
from plinth.functions import format as kinds
from plinth.functions import nested
from plinth.functions import values as column_values
from plinth.operators import attributes, shapes, spatial, statistics
from plinth.sources import catalogue, dataset, sequences

HEAD = {"type": kinds.DOCUMENT, "version": "2.0", "transform": {"scale": [1.0, 1.0, 1.0], "translate": [0.0, 0.0, 0.0]}, "CityObjects": {}, "vertices": []}


def feature(name, vertices=((0, 0, 0),), attributes=None, geometry=(), **more):
    made = {"type": kinds.FEATURE, "id": name, "vertices": list(map(list, vertices)), "CityObjects": {name or "x": {"type": "Building", "attributes": attributes or {}, "geometry": list(geometry)}}}
    return {k: v for k, v in {**made, **more}.items() if v is not None}


def sequence(path, *lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(path)


BAD = [
    (feature("over", [[3_000_000_000, 1, 2], [1, 1, 1]]), "a vertex that doesn't fit 32 bits"),
    (feature("part", [[1.5, 1, 2], [1, 1, 1]]), "a vertex that isn't whole"),
    (feature("flat", [[1, 2]]), "without vertices, or with one that isn't three numbers"),
    (feature("text", [["a", 2, 3]]), "without vertices, or with one that isn't three numbers"),
    ({k: v for k, v in feature("none").items() if k != "vertices"}, "without vertices, or with one that isn't three numbers"),
    (feature(None), "a feature without an id"),
    (feature("bare", **{"CityObjects": None}), "without objects"),
    ({"type": "Else", "a": 1}, "a line of another type: Else"),
    ({"a": 1}, "a line of another type:"),
    ("[1, 2]", "not an object"),
    ('{"type": ', "not JSON, or a key comes twice"),
    ({**HEAD, "transform": {"scale": [1, 2], "translate": [0, 0, 0]}}, "a header whose transform isn't three scales and three translations"),
    (HEAD, "a second header"),
]


def test_bad_lines_are_named_and_dropped(spark, tmp_path):
    good = feature("good", [[2147483647, -2147483648, 1.0]])
    path = sequence(tmp_path / "x.jsonl", HEAD, good, *(line for line, _ in BAD), "", good | {"id": "last"})
    got = sequences.bad_lines(sequences.read_lines(spark, path)).orderBy("line_no").collect()
    assert [(r["line_no"], r["reason"]) for r in got] == [(i + 2, reason) for i, (_, reason) in enumerate(BAD)]
    header, features = sequences.read_sequence(spark, path, mode="drop")
    assert header.count() == 1 and sorted(r["feature_id"] for r in features.collect()) == ["good", "last"]
    assert features.where("feature_id = 'good'").select("vertices.x", "vertices.y", "vertices.z").first()[:] == ([2147483647], [-2147483648], [1])
    with pytest.raises(BadInput):
        sequences.read_sequence(spark, path, mode="some")


@pytest.mark.parametrize("line, reason", BAD, ids=[r for _, r in BAD])
def test_a_bad_line_fails(spark, tmp_path, line, reason):
    header, features = sequences.read_sequence(spark, sequence(tmp_path / "x.jsonl", HEAD, feature("good"), line))
    with pytest.raises(Exception, match="line 2: " + reason.split(":")[0]):
        (header if "header" in reason else features).collect()


def test_features_without_a_header(spark, tmp_path):
    path = sequence(tmp_path / "x.jsonl", feature("alone"))
    assert [r["reason"] for r in sequences.bad_lines(sequences.read_lines(spark, path)).collect()] == ["a feature of a file without a header"]
    header, features = sequences.read_sequence(spark, path)
    with pytest.raises(Exception, match="no header for"):
        sequences.with_box(features, header).collect()
    assert sequences.read_sequence(spark, path, mode="drop")[1].count() == 0
    with pytest.raises(Exception, match="a vertex that isn't whole"):
        sequences.parse_documents(spark.createDataFrame([("d", json.dumps({**HEAD, "vertices": [[0.5, 1, 2]]}))], "file string, value string"))[1].collect()


def test_ingest_in_drop_mode(spark, tmp_path, capsys):
    path = sequence(tmp_path / "x.jsonl", HEAD, feature("good"), "what?")
    cli.main(["ingest", path, str(tmp_path / "d"), "--bad", "drop"], spark)
    assert dataset.Dataset.open(spark, str(tmp_path / "d")).features.count() == 1
    cli.main(["bad", path], spark)
    assert "what?" in capsys.readouterr().out


NAMES = {"type": "t", "file": "f", "geometry": 1, "d": 1, "D": 2, "e.f": 3, "a b`c": 4, "it's": 5, "attributes": 6, "_key": 7, "feature_key": 8, "d_2": 9, "": 10}


def test_attributes_of_any_name(spark, tmp_path):
    path = sequence(tmp_path / "x.jsonl", HEAD, feature("one", attributes=NAMES), feature("two", attributes={"d": 2, "D": 1}), feature("three"))
    header, features = sequences.read_sequence(spark, path)
    dataset.write_dataset(features, header, str(tmp_path / "d"), indices=("e.f", "D", "it's"))
    data = dataset.Dataset.open(spark, str(tmp_path / "d"))
    assert dict(data.schema()) == {n: "string" if isinstance(v, str) else "bigint" for n, v in NAMES.items()}
    assert data.indices() == ["D", "e.f", "it's"]
    ids = lambda df: sorted(r["feature_id"] for r in df.collect())
    for name, value in NAMES.items():
        assert ids(data.attr([(name, "=", value)])) == ["one"], name
        assert data.objects.where(data.column(name) == value).count() == 1
    assert ids(data.attr([("d", ">=", 1)])) == ["one", "two"] and ids(data.attr([("D", ">", 1)])) == ["one"]
    assert ids(data.attr([("d", "=", 2), ("D", "=", 1)], "object")) == ["two"]
    with pytest.raises(UnknownColumn):
        data.attr([("d_3", "=", 1)])
    with pytest.raises(UnknownColumn):
        dataset.write_dataset(features, header, str(tmp_path / "e"), indices=("zz",))
    assert sequences.column_names(["D", "d", "d_2", "file"], ["file"]) == {"D": "D", "d": "d_3", "d_2": "d_2", "file": "file_2"}


def test_nan_is_in_no_range(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(1, nan), (2, 5.0), (2, nan), (3, 1.0), (4, None)], "k int, v double")
    found = lambda *c, s="feature": sorted(r["k"] for r in attributes.select_ids(rows, list(c), "k", s).collect())
    for value in (2, 2.0):
        assert found(("v", ">", value)) == [2] and found(("v", ">=", value)) == [2] and found(("v", "<", value)) == [3] and found(("v", "<=", value)) == [3]
        assert found(("v", ">", value), s="object") == [2] and found(("v", "<=", value), s="object") == [3]
        assert sorted(r["k"] for r in attributes.select_range(rows, "v", low=value).collect()) == [2]
        assert sorted(r["k"] for r in attributes.select_range(rows, "v", high=value).collect()) == [3]
    assert found(("v", "=", nan)) == [1, 2]


SHAPES = [
    {"type": "MultiPoint", "lod": "0", "boundaries": [0, 1]},
    {"type": "MultiLineString", "lod": "0", "boundaries": [[0, 1], [1, 2, 0]]},
    {"type": "MultiSurface", "lod": "2", "boundaries": [[[0, 1, 2], [2, 1, 0]], [[1, 2, 0]]], "semantics": {"surfaces": [{"type": "RoofSurface", "slope": 2.5, "children": [1]}, {"type": "+Odd", "parent": 0}], "values": [1, None]},
     "material": {"day": {"values": [0, None]}, "night": {"value": 1}}, "texture": {"day": {"values": [[[0, 1, 2, 3], [None]], [[None]]]}}},
    {"type": "CompositeSurface", "lod": "2", "boundaries": [[[0, 1, 2]]], "odd": {"a": [1]}},
    {"type": "Solid", "lod": "2.1", "boundaries": [[[[0, 1, 2]], [[1, 2, 0]]], [[[2, 1, 0]]]], "semantics": {"surfaces": [{"type": "WallSurface"}], "values": [[0, None], [0]]},
     "material": {"day": {"values": [[1, None], None]}}, "texture": {"day": {"values": [[[[0, 1, 2, 0]], [[None]]], None]}}},
    {"type": "MultiSolid", "lod": "1", "boundaries": [[[[[0, 1, 2]]]]], "semantics": {"surfaces": [{"type": "RoofSurface"}], "values": [[[0]]]}, "material": {"day": {"values": [[[3]]]}}},
    {"type": "CompositeSolid", "lod": "1", "boundaries": [[[[[0, 1, 2]], [[0, 2, 1]]]], [[[[1, 2, 0]]], [[[2, 0, 1]]]]], "semantics": {"surfaces": [{"type": "RoofSurface"}], "values": [[[0, None]], [[0], [None]]]},
     "material": {"day": {"values": [[[0, 1]], None]}}, "texture": {"day": {"values": [[[[[0, 1, 2, 0]], [[None]]]], [[[[1, 0, 1, 2]]], None]]}}},
    {"type": "GeometryInstance", "template": 1, "boundaries": [2], "transformationMatrix": [float(i) for i in range(16)]},
    {"type": "Unheard", "boundaries": {"of": 1}},
]


def test_typed_geometries_of_all_types_through_a_stored_dataset(spark, tmp_path):
    path = sequence(tmp_path / "x.jsonl", HEAD, feature("a", [[0, 0, 0], [1, 0, 0], [0, 1, 0]], geometry=SHAPES), feature("b", geometry=SHAPES[:1]))
    header, features = sequences.read_sequence(spark, path)
    dataset.write_dataset(features, header, str(tmp_path / "d"))
    data = dataset.Dataset.open(spark, str(tmp_path / "d"))
    rows = data.geometries()
    back = {r["object_id"]: [json.loads(x) for x in r["g"]] for r in shapes.gathered(rows).select("object_id", F.transform("geometry", lambda g: F.to_json(g)).alias("g")).collect()}
    assert back == {"a": SHAPES, "b": SHAPES[:1]}
    solid = rows.where("lod = '2.1'").first()
    assert (solid["solids"], solid["shells"], solid["surfaces"], solid["strings"], solid["boundaries"]) == ([], [2, 1], [1, 1, 1], [3, 3, 3], [0, 1, 2, 1, 2, 0, 2, 1, 0])
    assert solid["ordinals"] == [0, None, 0] and solid["material"]["day"]["packed"]["inner"] == [2, None]
    plan = rows.where("lod = '1'").select("object_id", F.size("shells"))._jdf.queryExecution().toString()
    assert "boundaries" not in plan.split("ReadSchema")[-1]
    own = dataset.Dataset(features, data.objects, header)
    assert own.geometries().count() == len(SHAPES) + 1
    bad = feature("z", geometry=[{"type": "GeometryInstance", "template": 0, "boundaries": [0], "transformationMatrix": [1.0]}])
    _, features = sequences.read_sequence(spark, sequence(tmp_path / "y.jsonl", HEAD, bad))
    with pytest.raises(Exception, match="a matrix of 16 values"):
        shapes.typed(sequences.city_objects(features)).collect()


@pytest.mark.parametrize("depth, value", [(1, [1, None]), (1, []), (2, [[1, None], None, [], [2]]), (3, [[[1], None], None, [[None], []]]), (4, [[[[1, 2]], None], None]), (5, [[[[[1], None]]], None, []]), (3, None)])
def test_pack_and_unpack(spark, depth, value):
    rows = spark.createDataFrame([(value,)], f"v {nested.kind(depth)}")
    assert rows.select(nested.unpack(nested.pack(F.col("v"), depth), depth).alias("v")).first()["v"] == value


def grid(spark, tmp_path, n=40):
    lines = [feature(f"{i:02}{j:02}", [[10 * i, 10 * j, 0], [10 * i + 1, 10 * j + 1, 5]], {"h": i * n + j}) for i in range(n) for j in range(n)]
    header, features = sequences.read_sequence(spark, sequence(tmp_path / "g.jsonl", HEAD, *lines))
    dataset.write_dataset(features, header, str(tmp_path / "g"), parts=16, indices=("h",))
    return dataset.Dataset.open(spark, str(tmp_path / "g"))


def read_of(df):
    return len(df.inputFiles())


def test_selections_read_fewer_files(spark, tmp_path):
    data = grid(spark, tmp_path)
    ids = lambda df: sorted(r["feature_id"] for r in df.collect())
    some = data.spatial(spatial.SpatialQuery("bbox", 95, 95, 111, 111))
    assert ids(some) == ["1010", "1011", "1110", "1111"] and read_of(some) < 8 < read_of(data.features)
    point = data.spatial(spatial.SpatialQuery("pointIntersects", 100.5, 100.5))
    assert ids(point) == ["1010"] and read_of(point) < 4
    near = data.nearest(213, 187)
    assert ids(near) == ["2119"] and read_of(near) < 8
    assert ids(data.nearest(-1e6, -1e6)) == ["0000"] and ids(data.nearest(55.5, 50.5)) == ["0505"]
    assert ids(data.spatial(spatial.SpatialQuery("bbox", 1e6, 1e6, 2e6, 2e6))) == []
    high = catalogue.Files(spark, f"{data.path}/by/0", f"{data.path}/statistics/by_0")
    assert ids(data.attr([("h", "=", 77)])) == ["0137"] and len(high.chosen(catalogue.value_may("=", 77))) < len(catalogue.data_files(spark, high.folder))
    assert ids(data.attr([("h", ">", 1598)])) == ["3939"] == ids(data.attr([("h", ">=", 1599)]))
    assert data.extent().first()[:] == (0.0, 0.0, 0.0, 391.0, 391.0, 5.0)
    assert data.info().select("features", "objects", "xmax").first()[:] == (1600, 1600, 391.0)
    assert "features" not in " ".join(data.extent().inputFiles()).replace("/statistics/", "")


def test_files_that_the_table_does_not_know(spark, tmp_path):
    """Features that were appended later are found, and a file that is gone is not missed."""
    data = grid(spark, tmp_path, 12)
    again = data.features.where("feature_id = '0000'").withColumns({"feature_id": F.lit("new"), "xmin": F.lit(500.0), "xmax": F.lit(501.0)})
    again.coalesce(1).write.mode("append").parquet(f"{data.path}/features")
    data = dataset.Dataset.open(spark, data.path)
    ids = lambda df: sorted(r["feature_id"] for r in df.collect())
    assert len(data.files().stale()) == 1
    assert ids(data.spatial(spatial.SpatialQuery("bbox", 499, 0, 502, 2))) == ["new"] == ids(data.nearest(505, 0))
    assert data.info().select("features", "xmax").first()[:] == (145, 501.0)
    first = data.features.where("feature_id = '0000'").select("_metadata.file_name").first()[0]
    os.remove(f"{data.path}/features/{first}")
    data = dataset.Dataset.open(spark, data.path)
    left = data.features.count()
    assert left < 145 and data.info().first()["features"] == left and "0000" not in ids(data.nearest(0, 0))


def test_nearest_of_many_points(spark):
    """Equal to brute force, with ties, many features at one place, features without a box, points without coordinates."""
    import random

    rng = random.Random(1)
    rows = []
    for k in range(800):
        x, y = rng.randint(0, 60), rng.randint(0, 60)
        rows.append((k, float(x), float(y), float(x + rng.randint(0, 3)), float(y + rng.randint(0, 3))))
    rows += [(k, 50.0, 50.0, 51.0, 51.0) for k in range(800, 1600)] + [(1999, None, None, None, None)]
    points = [(i, rng.uniform(-20, 80), rng.uniform(-20, 80)) for i in range(150)] + [(150, 50.5, 50.5), (151, None, 1.0), (152, 30.0, 30.0)]
    features = spark.createDataFrame(rows, "key long, xmin double, ymin double, xmax double, ymax double")
    at = spark.createDataFrame(points, "point_id long, x double, y double")
    got = {r["point_id"]: (r["d2"], r["key"]) for r in spatial.nearest_many(features, at, "key").collect()}
    square = lambda v: v * v
    want = {i: min((square((a + c) / 2 - x) + square((b + d) / 2 - y), k) for k, a, b, c, d in rows if a is not None) for i, x, y in points if x is not None}
    assert got == want
    assert spatial.nearest_many(features.where("key = 1999"), at, "key").count() == 0


def test_several_files_are_not_one_text(spark, tmp_path):
    for name in ("a", "b"):
        sequence(tmp_path / f"{name}.jsonl", HEAD, feature(name))
    header, features = sequences.read_sequence(spark, str(tmp_path / "*.jsonl"))
    dataset.write_dataset(features, header, str(tmp_path / "d"))
    data = dataset.Dataset.open(spark, str(tmp_path / "d"))
    with pytest.raises(BadInput):
        data.export(str(tmp_path / "out"))
    file = next(r["file"] for r in header.collect() if r["file"].endswith("b.jsonl"))
    data.of_file(file).export(str(tmp_path / "out"))
    assert [r["feature_id"] for r in sequences.read_sequence(spark, str(tmp_path / "out"), joined=True)[1].collect()] == ["b"]


def test_options_of_the_stored_form(spark, tmp_path):
    """Texts by their first bytes, nulls as defaults, boxes of features without vertices, a line's length, texts with odd bytes."""
    rows = spark.createDataFrame([(1, "a" * 49 + "xy"), (2, "a" * 49 + "xz"), (3, "a"), (4, None)], "k int, v string")
    long = ("v", "=", "a" * 49 + "x!")
    assert attributes.select_ids(rows, [long], "k").count() == 0
    for semantics in ("feature", "object"):
        assert sorted(r["k"] for r in attributes.select_ids(rows, [long], "k", semantics, 50).collect()) == [1, 2]
    assert sorted(r["k"] for r in attributes.select_ids(rows, [("v", "<", "a" * 49 + "x!")], "k", key_bytes=50).collect()) == [3]
    lines = [feature("a", attributes={"n": None, "t": None, "b": None, "w": None}), feature("b", attributes={"n": 1, "t": "x", "b": True, "w": "2020-01-01T00:00:00Z"}), feature("c", [])]
    header, features = sequences.read_sequence(spark, sequence(tmp_path / "x.jsonl", {**HEAD, "transform": {"scale": [1, 1, 1], "translate": [5, 6, 7]}}, *lines))
    objects = sequences.city_objects(features)
    schema = sequences.infer_schema(objects)
    got = {r["object_id"]: (r["b"], r["n"], r["t"], r["w"] and r["w"].year) for r in sequences.project(objects, schema, True).collect()}
    assert got == {"a": (False, 0, "", 1970), "b": (True, 1, "x", 2020), "c": (None, None, None, None)}
    assert sequences.project(objects, schema).where("object_id = 'a' AND n IS NULL AND t IS NULL").count() == 1
    at = {r["feature_id"]: r["xmin"] for r in sequences.with_box(features, header, empty_at_origin=True).collect()}
    assert at == {"a": 5.0, "b": 5.0, "c": 5.0} and sequences.with_box(features, header).where("feature_id = 'c' AND xmin IS NULL").count() == 1
    assert sequences.feature_bytes(features).where("n_bytes > 50").count() == 3
    odd = spark.createDataFrame([(b"ab\0cd",), (b"a\xffb",), (b"",)], "d binary")
    assert [r[0] for r in odd.select(column_values.lossy_text(F.col("d"))).collect()] == ["ab", "a\ufffdb", ""]
    kinds_ = spark.createDataFrame([("Solid",), ("MultiPoint",), ("Cube",), ("GeometryInstance",)], "t string")
    assert [r[0] for r in kinds_.select(column_values.geometry_type(F.col("t"))).collect()] == ["Solid", "MultiPoint", "Solid", "GeometryInstance"]


def test_runs_as_csv(spark, tmp_path):
    rows = spark.createDataFrame([("q", "x", 2.0), ("q", "x", 4.0), ("q", "y", 6.0)], "name string, kind string, t double")
    statistics.write_runs(rows, "name", "kind", "t", "x", str(tmp_path / "csv"))
    read = lambda n: sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "csv" / n), header=True, inferSchema=True).collect())
    assert len(read("raw")) == 3 and read("summary") == [("q", "x", 3.0, 3.0, 1.0, 2.0, 4.0), ("q", "y", 6.0, 6.0, 0.0, 6.0, 6.0)]
    assert read("comparison") == [("q", "x", 3.0, 1.0), ("q", "y", 6.0, 2.0)]
