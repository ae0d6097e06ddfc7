"""The command line: ingest, bad, export, info, obj, document, stats, cbor and bson.

    python -m plinth ingest IN OUT [--kind sequence|folder|document] [--bbox x0,y0,x1,y1] [--index NAME ...] [--bad fail|drop]
    python -m plinth bad IN
    python -m plinth export|obj|document DATASET OUT
    python -m plinth info DATASET
    python -m plinth stats FOLDER [OUT] [--format csv|json] [--prefix NAME ...]
    python -m plinth cbor|bson IN OUT

``cbor`` and ``bson`` read one JSON file and write one file, or a folder of them and
write a folder.  There, as the source
of ``ingest`` and as the target of ``export``, ``-`` is a standard stream.  The box
keeps features of which a vertex lies in it.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from plinth.functions import encodings
from plinth.operators import merge, spatial
from plinth.sources import collection, dataset, encoded, sequences


def _convert(kind: str, source: str, target: str) -> None:
    text = sys.stdin.read() if source == "-" else open(source, encoding="utf-8").read()
    made = encodings.ENCODE[kind](json.loads(text))
    if target == "-":
        sys.stdout.buffer.write(made)
    else:
        with open(target, "wb") as out:
            out.write(made)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="plinth", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["ingest", "bad", "export", "info", "obj", "document", "stats", "cbor", "bson"])
    parser.add_argument("source")
    parser.add_argument("target", nargs="?")
    parser.add_argument("--kind", default="sequence", choices=["sequence", "folder", "document"])
    parser.add_argument("--bbox")
    parser.add_argument("--bad", default="fail", choices=sequences.MODES)
    parser.add_argument("--index", action="append", default=[])
    parser.add_argument("--format", default="csv", choices=["csv", "json"])
    parser.add_argument("--prefix", action="append", default=[])
    given = parser.parse_args(args)
    if given.target is None and given.command not in ("info", "stats", "bad"):
        parser.error("a target is needed")
    if given.command in encodings.ENCODE and not os.path.isdir(given.source):
        return _convert(given.command, given.source, given.target)
    spark = spark or SparkSession.builder.appName("plinth").getOrCreate()
    if given.command == "ingest":
        if given.source != "-":
            header, features = sequences.read_models(spark, given.source, given.kind, given.bad)
        elif given.kind == "document":
            header, features = sequences.parse_documents(spark.createDataFrame([("-", sys.stdin.read())], "file string, value string"))
        else:
            header, features = sequences.parse_lines(sequences.from_lines(spark, sys.stdin), given.bad)
        box = spatial.parse_bbox(given.bbox) if given.bbox else None
        dataset.write_dataset(features, header, given.target, box, vertices=True, indices=tuple(given.index))
        return None
    if given.command in encodings.ENCODE:
        return encoded.convert_folder(spark, given.source, given.target, given.command)
    if given.command == "bad":
        for row in sequences.bad_lines(sequences.read_lines(spark, given.source, given.kind == "folder")).orderBy("file", "line_no").toLocalIterator():
            print(f"{row['file']}, line {row['line_no']}: {row['reason']}: {row['value']}")
        return None
    if given.command == "stats":
        found = collection.report(spark, given.source, tuple(given.prefix))
        if given.target:
            collection.write_report(found, given.target, given.format)
        else:
            print(found.orderBy("city").toPandas().to_string(index=False))
        return None
    data = dataset.Dataset.open(spark, given.source)
    if given.command == "info":
        data.info().show(truncate=False, vertical=True)
        for name, kind in data.schema():
            print(f"{name}: {kind}")
    elif given.command == "export" and given.target == "-":
        for row in sequences.sequence_lines(data.features, data.header).orderBy("seq").toLocalIterator():
            print(row["value"])
    elif given.command == "export":
        data.export(given.target)
    elif given.command == "obj":
        merge.write_obj(data.features, data.header, given.target)
    else:
        data.write_document(given.target)
    return None


if __name__ == "__main__":
    main()
