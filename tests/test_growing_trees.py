"""Box joins in dense places, object trees, exact quantiles, large documents, folders of binary files, growing datasets, workers without the package."""

import json
import os
import random
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from plinth import __main__ as cli
from plinth.errors import BadInput
from plinth.functions import encodings
from plinth.functions import format as kinds
from plinth.operators import merge, spatial, statistics, trees
from plinth.sources import dataset, encoded, folders, sequences
from plinth.streaming import growing, sequence

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HEAD = {"type": kinds.DOCUMENT, "version": "2.0", "transform": {"scale": [1.0, 1.0, 1.0], "translate": [0.0, 0.0, 0.0]}, "CityObjects": {}, "vertices": []}
BOXES = "key long, xmin double, ymin double, xmax double, ymax double"


def boxes_of(rng, n, at, wide):
    out = []
    for k in range(n):
        x, y = rng.gauss(*at), rng.gauss(*at)
        out.append((k, x, y, x + rng.choice(wide), y + rng.choice(wide)))
    return out


def test_box_join_of_dense_places(spark):
    """Equal to brute force on a cluster of small boxes and points beside wide ones, with candidates in proportion to pairs."""
    rng = random.Random(7)
    left = boxes_of(rng, 1500, (446000, 0.5), [0, 0.001, 0.004]) + [(9000, 445990.0, 445990.0, 446010.0, 446010.0), (9001, None, None, None, None)]
    right = boxes_of(rng, 1500, (446000, 0.5), [0, 0.002, 0.01]) + boxes_of(rng, 20, (446000, 200), [50, 400])
    a, b = spark.createDataFrame(left, BOXES), spark.createDataFrame(right, BOXES)
    want = sorted((p[0], q[0]) for p in left if p[1] is not None for q in right if p[3] >= q[1] and p[1] <= q[3] and p[4] >= q[2] and p[2] <= q[4])
    got = sorted(tuple(r) for r in spatial.join_boxes(a, b).select("key", "r_key").collect())
    assert got == want and len(want) > 1000
    assert spatial.box_candidates(a, b).count() < 20 * len(want) < 1500 * 1500 / 2


def objects_of(spark, rows):
    return spark.createDataFrame([("f", 1, i, c) for i, c in rows], "file string, feature_seq long, object_id string, children array<string>")


def test_object_trees_with_rings_and_missing_children(spark):
    chain = [(f"c{i}", [f"c{i + 1}"]) for i in range(12)] + [("c12", None)]
    objects = objects_of(spark, chain + [("a", ["b", "b", "gone"]), ("b", ["d"]), ("d", []), ("e", ["d"]), ("r1", ["r2"]), ("r2", ["r3"]), ("r3", ["r1"])])
    pairs = trees.closure(objects)
    assert pairs.where("ancestor_id LIKE 'c%'").count() == 12 * 13 // 2 and pairs.where("ancestor_id = 'c0' AND object_id = 'c12'").first()["steps"] == 12
    assert sorted(tuple(r)[2:] for r in trees.rings(pairs).collect()) == [("r1", 3), ("r2", 3), ("r3", 3)]
    assert [tuple(r)[2:] for r in trees.missing(objects).collect()] == [("a", "gone")]
    got = {r["object_id"]: tuple(r)[3:] for r in trees.placed(objects, pairs).collect()}
    assert got["c7"] == ("c0", 7, 5) and got["a"] == ("a", 0, 2) and got["d"] == ("a", 2, 0) and got["e"] == ("e", 0, 1) and got["r1"] == (None, None, 2)
    assert trees.placed(objects.limit(0)).count() == 0


def test_exact_quantiles_are_medians(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([1.0, rng.uniform(-5, 5)])) for _ in range(5000)] + [("one", 3.5), ("null", None), (None, 2.0), (None, 4.0), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"], r["q"]): r["v"] for r in statistics.quantiles(df, "k", "v", (0.0, 0.5, 0.99, 1.0)).collect()}
    want = {(r["k"], q): r[f"p{i}"] for r in df.where("v IS NOT NULL").groupBy("k").agg(*(F.percentile("v", q).alias(f"p{i}") for i, q in enumerate((0.0, 0.5, 0.99, 1.0)))).collect() for i, q in enumerate((0.0, 0.5, 0.99, 1.0))}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def city(spark, tmp_path, n=300):
    lines = [HEAD] + [{"type": kinds.FEATURE, "id": f"f{i}", "vertices": [[i, 0, 0], [i + 1, 0, 0], [i, 1, 0]], "CityObjects": {f'o"{i}': {"type": "Road", "geometry": [{"type": "MultiSurface", "lod": "1", "boundaries": [[[0, 1, 2]]]}]}}} for i in range(n)]
    lines[-1]["CityObjects"] = {'o"0': {"type": "Bridge"}}
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)))
    return sequences.read_sequence(spark, str(tmp_path / "c.jsonl")), lines


def test_a_document_in_parts(spark, tmp_path):
    """Part files make up one document; no row holds more than an object or a vertex."""
    (header, features), lines = city(spark, tmp_path)
    dataset.write_dataset(features, header, str(tmp_path / "d"))
    cli.main(["document", str(tmp_path / "d"), str(tmp_path / "out")], spark)
    merge.write_document(features, header, str(tmp_path / "out8"), 8)
    whole = json.loads(merge.merge_documents(features, header).first()["value"])
    for folder in ("out", "out8"):
        parts = sorted(p for p in (tmp_path / folder).iterdir() if p.name.startswith("part-"))
        assert folder == "out" or len(parts) > 4
        assert json.loads("".join(p.read_text() for p in parts)) == whole
    assert whole["type"] == kinds.DOCUMENT and len(whole["vertices"]) == 2 * 300 + 1 and whole["CityObjects"]['o"0'] == {"type": "Bridge"}
    place = lambda i: [whole["vertices"][k] for k in whole["CityObjects"][f'o"{i}']["geometry"][0]["boundaries"][0][0]]
    assert all(place(i) == [[i, 0, 0], [i + 1, 0, 0], [i, 1, 0]] for i in range(1, 299))
    assert merge.document_pieces(features, header).agg(F.max(F.length("value"))).first()[0] < 400
    none = merge.document_pieces(features.limit(0), header).orderBy(*merge.PIECE).collect()
    assert json.loads("".join(r["value"] for r in none))["CityObjects"] == {}


def test_folders_of_binary_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    docs = {f"d{i}": {"n": i, "CityObjects": {}} for i in range(20)}
    for name, doc in docs.items():
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(doc))
    for kind in ("cbor", "bson"):
        out = tmp_path / kind
        cli.main([kind, str(tmp_path / "in"), str(out)], spark)
        assert sorted(os.listdir(out)) == sorted(f"{n}.{kind}" for n in docs)
        assert {os.path.basename(r["file"]).split(".")[0]: json.loads(r["value"]) for r in encoded.read_encoded(spark, str(out), kind).collect()} == docs
        with pytest.raises(Exception, match="there already"):
            encoded.convert_folder(spark, str(tmp_path / "in"), str(out), kind)
    (tmp_path / "in" / "bad.json").write_text("{")
    with pytest.raises(Exception):  # noqa: B017
        encoded.convert_folder(spark, str(tmp_path / "in"), str(tmp_path / "none"), "cbor")
    assert not (tmp_path / "none").exists() or os.listdir(tmp_path / "none") == []
    twice = spark.createDataFrame([("x", b"1"), ("x", b"2")], "name string, content binary").repartition(2)
    with pytest.raises(Exception, match="comes twice"):
        encoded.write_files(twice, str(tmp_path / "twice"))


def test_encodings_beyond_json():
    """Byte strings in pieces are one base64 text; what isn't UTF-8, a lone end and numbers that BSON lacks are errors."""
    assert encodings.from_cbor(bytes.fromhex("5f41014202034104ff")) == "AQIDBA=="
    for bad in ("61ff", "ff", "82ff01", "7f61ffff", "5f6161ff"):
        with pytest.raises(BadInput):
            encodings.from_cbor(bytes.fromhex(bad))
    with pytest.raises(BadInput):
        encodings.to_bson({"n": 1 << 63})
    assert encodings.from_bson(encodings.to_bson({"n": -(1 << 63)})) == {"n": -(1 << 63)}


def test_a_growing_dataset(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda i, x: json.dumps({"type": kinds.FEATURE, "id": f"f{i}", "vertices": [[x, 0, 0]], "CityObjects": {"o": {"type": "Road"}}})
    text = lambda *lines: "\n".join([json.dumps(HEAD), *lines])
    store, marks = str(tmp_path / "store"), str(tmp_path / "marks")
    (tmp_path / "in" / "a.jsonl").write_text(text(line(1, 1), line(2, 2), line(2, 3)))
    run = lambda: growing.grow(sequence.stream_features(spark, str(tmp_path / "in")), store, marks, once=True).awaitTermination()
    run()
    assert growing.earlier(spark, store).count() == 2
    (tmp_path / "in" / "b.jsonl").write_text(text(line(1, 9), line(3, 3)))
    run()
    assert growing.earlier(spark, store).groupBy("feature_id").count().count() == 3
    header = sequence.stream_headers(spark, str(tmp_path / "in"))
    # The second batch again, and again after a third: nothing is added.
    second = sequences.read_sequence(spark, str(tmp_path / "in" / "b.jsonl"))[1]
    growing.append_batch(second, 1, store)
    growing.append_batch(second, 2, store)
    assert growing.earlier(spark, store).count() == 4
    made = growing.compact(spark, store, header, str(tmp_path / "whole"))
    assert made.features.count() == 4 and made.info().first()["features"] == 4
    with pytest.raises(BadInput):
        growing.compact(spark, str(tmp_path / "nowhere"), header, str(tmp_path / "n"))


def test_workers_do_not_need_the_package(tmp_path):
    """A job of an application that has the package on its driver alone."""
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        from plinth.sources import encoded
        rows = spark.createDataFrame([("[1]",)], "value string")
        assert encoded.decode(encoded.encode(rows, "cbor").drop("value"), "cbor").first()["value"] == "[1]"
        encoded.write_files(encoded.encode(rows, "cbor").selectExpr("'x' AS name", "content"), {str(tmp_path / "out")!r})
        print("fine")
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in done.stdout, done.stderr[-3000:]


def test_scratch_is_read_as_it_was(spark):
    rows = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    assert folders.saved(rows, "t").schema == rows.schema and folders.saved(rows, "t").count() == 2
