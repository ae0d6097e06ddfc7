import glob
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plinth import __main__ as cli
from plinth.errors import BadInput
from plinth.functions import encodings
from plinth.functions import format as kinds
from plinth.operators import merge, spatial
from plinth.sources import collection, dataset, encoded, sequences
from plinth.streaming import sequence

HEAD = {"type": kinds.DOCUMENT, "version": "2.0", "transform": {"scale": [0.5, 0.5, 1.0], "translate": [10.0, 20.0, 0.0]}, "CityObjects": {}, "vertices": []}
ONE = {
    "type": kinds.FEATURE, "id": "a", "vertices": [[0, 0, 0], [2, 0, 0], [2, 4, 6]],
    "appearance": {"materials": [{"name": "roof"}, {"name": "wall"}], "textures": [{"image": "x.png"}], "vertices-texture": [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]},
    "CityObjects": {"a": {"type": "Building", "attributes": {"h": 3.5, "n": 2}, "geometry": [{
        "type": "MultiSurface", "lod": "2", "boundaries": [[[0, 1, 2]], [[2, 1, 0]]],
        "material": {"day": {"values": [1, None]}}, "texture": {"day": {"values": [[[0, 0, 1, 2]], [[None]]]}}}]}},
}
TWO = {
    "type": kinds.FEATURE, "id": "b", "vertices": [[20, 20, 0], [2, 4, 6], [22, 20, 0], [20, 22, 0]],
    "CityObjects": {"b": {"type": "Road", "attributes": {"n": 7}, "geometry": [{"type": "Solid", "lod": "1", "boundaries": [[[[0, 1, 2]], [[3, 2, 1]]]]}]}},
}
THREE = {"type": kinds.FEATURE, "id": "c", "vertices": [], "CityObjects": {"c": {"type": "LandUse"}}}


@pytest.fixture(scope="module")
def city(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("city")
    (where / "x.jsonl").write_text("\n".join(map(json.dumps, (HEAD, ONE, TWO, THREE))))
    return str(where / "x.jsonl")


values = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False) | st.text(),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text().filter(lambda k: "\0" not in k), inner, max_size=4),
    max_leaves=20,
)


@given(values)
def test_encodings_round_trip(value):
    assert encodings.from_cbor(encodings.to_cbor(value)) == value
    assert encodings.from_bson(encodings.to_bson({"v": value})) == {"v": value}


def test_encodings_known_bytes():
    assert encodings.to_cbor({"a": 1, "b": [2, 3]}).hex() == "a26161016162820203"
    assert encodings.from_cbor(bytes.fromhex("9f018202039f0405ffff")) == [1, [2, 3], [4, 5]]
    assert encodings.from_cbor(bytes.fromhex("f93c00")) == 1.0
    assert encodings.to_bson({"hello": "world"}).hex() == "160000000268656c6c6f0006000000776f726c640000"
    for bad in (b"\x82\x01", b"\x01\x01"):
        with pytest.raises(BadInput):
            encodings.from_cbor(bad)
    with pytest.raises(BadInput):
        encodings.from_bson(b"\x10\0\0\0")


@pytest.mark.parametrize("kind", ["cbor", "bson"])
def test_encoded_files(spark, tmp_path, kind):
    whole = {**HEAD, "CityObjects": ONE["CityObjects"], "vertices": ONE["vertices"]}
    (tmp_path / "in.json").write_text(json.dumps(whole))
    cli.main([kind, str(tmp_path / "in.json"), str(tmp_path / f"out.{kind}")])
    got = encoded.read_encoded(spark, str(tmp_path / f"out.{kind}"), kind)
    assert json.loads(got.first()["value"]) == whole
    assert encoded.object_counts(got).select("objects", "geometries").first()[:] == (1, 1)
    made = encoded.encode(spark.createDataFrame([(json.dumps(whole),), (None,)], "value string"), kind).collect()
    assert encodings.DECODE[kind](bytes(made[0]["content"])) == whole and made[1]["content"] is None


def test_dataset(spark, city, tmp_path, capsys):
    at = str(tmp_path / "d")
    cli.main(["ingest", city, at], spark)
    data = dataset.Dataset.open(spark, at)
    ids = lambda df: sorted(r["feature_id"] for r in df.collect())
    assert ids(data.all()) == ["a", "b", "c"]
    assert ids(data.spatial(spatial.SpatialQuery("bbox", 10, 20, 10.5, 20.5))) == ["a"]
    assert ids(data.spatial(spatial.SpatialQuery("pointNearest", 100, 100))) == ["b"]
    assert ids(data.attr([("n", ">=", 2)])) == ["a", "b"] and ids(data.attr([("n", ">", 2)])) == ["b"]
    assert dict(data.schema()) == {"h": "double", "n": "bigint"}
    assert data.info().first()["features"] == 3
    cli.main(["info", at], spark)
    assert "bigint" in capsys.readouterr().out
    cli.main(["export", at, str(tmp_path / "out")], spark)
    _, again = sequences.read_models(spark, str(tmp_path / "out"))
    assert ids(again) == ["a", "b", "c"]
    cli.main(["ingest", city, str(tmp_path / "e"), "--bbox", "10,20,10.5,20.5"], spark)
    assert ids(dataset.Dataset.open(spark, str(tmp_path / "e")).all()) == ["a"]


def test_collection(spark, city, tmp_path, capsys):
    where = tmp_path / "all of it"
    where.mkdir()
    text = open(city).read()
    for name, suffix in (("ax", ".jsonl"), ("ax", ".city.jsonl"), ("b+y", ".jsonl"), ("lone", ".jsonl")):
        (where / f"{name}{suffix}").write_text(text if suffix != ".jsonl" or name != "ax" else text + "\n")
    for name in ("ax", "b+y"):
        cli.main(["ingest", city, str(where / name)], spark)
    rows = {r["city"]: r for r in collection.report(spark, str(where)).collect()}
    assert sorted(rows) == ["ax", "b+y"]
    for r in rows.values():
        assert (r["features"], r["objects"], r["vertices"], r["columns"], r["sequence_bytes"]) == (3, 3, 7, 2, len(text))
        assert r["mean_line_bytes"] == sum(map(len, text.splitlines()[1:])) / 3
        assert r["compression"] == len(text) / r["stored_bytes"] and r["vertices_per_feature"] == 7 / 3
    assert [r["city"] for r in collection.pairs(spark, str(where), ("b",)).collect()] == ["b+y"]
    assert collection.report(spark, str(where), ("none",)).count() == 0
    cli.main(["stats", str(where)], spark)
    assert "b+y" in capsys.readouterr().out
    for kind in ("csv", "json"):
        cli.main(["stats", str(where), str(tmp_path / kind), "--format", kind, "--prefix", "a"], spark)
        (made,) = glob.glob(str(tmp_path / kind / "part-*"))
        assert len(open(made).read().splitlines()) == (2 if kind == "csv" else 1)
    with pytest.raises(BadInput):
        collection.write_report(collection.report(spark, str(where)), str(tmp_path / "z"), "xml")


def corners(document, boundaries):
    return [corners(document, b) for b in boundaries] if isinstance(boundaries, list) else document["vertices"][boundaries]


def test_merge(spark, city):
    header, features = sequences.read_models(spark, city)
    got = json.loads(merge.merge_documents(features, header).first()["value"])
    assert sorted(got["CityObjects"]) == ["a", "b", "c"] and got["type"] == kinds.DOCUMENT
    assert len(got["vertices"]) == 6 == len({tuple(v) for v in got["vertices"]})
    for f in (ONE, TWO):
        old, new = f["CityObjects"][f["id"]], got["CityObjects"][f["id"]]
        assert corners(got, new["geometry"][0]["boundaries"]) == corners(f, old["geometry"][0]["boundaries"])
        assert new["attributes"] == old["attributes"] and new["geometry"][0]["lod"] == old["geometry"][0]["lod"]
    empty = json.loads(merge.merge_documents(features.limit(0), header).first()["value"])
    assert empty["CityObjects"] == {} and empty["vertices"] == []


def test_obj(spark, city, tmp_path):
    header, features = sequences.read_models(spark, city)
    merge.write_obj(features, header, str(tmp_path / "obj"))
    lines = open(glob.glob(str(tmp_path / "obj/part*"))[0]).read().splitlines()
    assert [x for x in lines if x[0] == "o"] == ["o a", "o b", "o c"]
    assert lines[:3] == ["v 10.0 20.0 0.0", "v 11.0 20.0 0.0", "v 11.0 22.0 6.0"]
    assert [x for x in lines if x[0] == "f"] == ["f 1 2 3", "f 3 2 1", "f 4 5 6", "f 7 6 5"]


def test_appearance(spark, city):
    _, features = sequences.read_models(spark, city)
    objects = sequences.city_objects(features)
    found = merge.surface_materials(objects, features).select("object_id", "surface", F.try_variant_get("material", "$.name", "string").alias("m")).collect()
    assert [tuple(r) for r in found] == [("a", 0, "wall")]
    rings = merge.surface_textures(objects, features).select("ring_no", F.to_json("texture").alias("t"), "texture_vertices").collect()
    assert [(r[0], json.loads(r[1]), r[2]) for r in rings] == [(0, {"image": "x.png"}, [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]])]


def test_stream(spark, city, tmp_path):
    folder = city.rsplit("/", 1)[0]
    features = sequences.with_box(sequence.stream_features(spark, folder), sequence.stream_headers(spark, folder))
    running = features.select("feature_id", "xmin").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert running.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("seen").collect() if r["xmin"] is not None) == [("a", 10.0), ("b", 11.0)]
    events = spark.createDataFrame([("2020-01-01 00:01:00", "x"), ("2020-01-01 00:11:00", "x")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sequence.windowed_counts(events, "t", "k").count() == 2
