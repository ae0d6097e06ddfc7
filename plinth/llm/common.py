"""Shared pieces of the training-data operators.

Functions that run on executors take Arrow record batches and work on the UTF-8
bytes of a text: ``bytes.lower`` and ``bytes.split`` treat ASCII only, which is
what the operators' word definitions ask for.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.operators.ordering import range_of, split_points  # noqa: F401
from plinth.sources.folders import scratch, shared_dir  # noqa: F401

#: Rows and bytes of a batch that are worked on at once, whatever the session's own batches hold.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

#: Bytes that separate words, for words of ASCII letters, digits and all non-ASCII characters.
#: Upper-case ASCII letters become lower-case ones, everything else in ASCII a space.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to a scratch folder."""
    where = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded size; a slice of one row may be larger."""
    for batch in batches:
        rows = max(1, min(BATCH_ROWS, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of letters and digits: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(WORD_TABLE).split()


def kept() -> dict:
    """What this Python process keeps from task to task; it lasts while the tasks of one operator follow each other."""
    return sys.modules.setdefault("_plinth_kept", types.ModuleType("_plinth_kept")).__dict__.setdefault("kept", {})


def start_anew() -> None:
    """Gives up what this Python process kept from another operator's tasks, and the memory that its allocators hold."""
    kept().clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # Only glibc has it.


def small_batches(spark: SparkSession) -> None:
    """Has Spark hand batches of ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes at most to Python, unless the session asks for fewer rows.

    An executor holds a batch of each of its tasks twice, in the JVM and in the worker.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def built(sent, build: Callable):
    """What ``build`` makes of a broadcast of plain values: made once in a worker and kept with the broadcast.

    Objects of the package's own classes can't be broadcast themselves, as workers needn't have the package.
    """
    made = getattr(sent, "_plinth_built", None)
    if made is None:
        made = sent._plinth_built = build(sent.value)
    return made


def map_arrow(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], pa.RecordBatch | dict],
    schema: T.StructType,
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """Apply ``function`` to each batch; ``setup`` runs once a task and its result is the second argument.

    What a worker kept from another operator's tasks is given up, so that a worker
    that goes from stage to stage doesn't hold the tables of all of them.
    """
    arrow = to_arrow(schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_anew()
        state = setup() if setup else None
        for batch in pieces(batches):
            made = function(batch, state) if setup else function(batch)
            if isinstance(made, dict):
                made = pa.RecordBatch.from_arrays(
                    [x.cast(f.type) if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=f.type)
                     for x, f in ((made[f.name], f) for f in arrow)],
                    schema=arrow,
                )
            yield made

    return df.mapInArrow(run, schema)


def whole_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of rows that are sorted by ``keys``, cut anew so that rows of equal keys are in one batch.

    It holds a batch and one run of equal keys, whose size the caller must have bounded.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns, begin = [batch.column(k) for k in keys], batch.num_rows
        key = lambda i: [c[i].as_py() for c in columns]  # noqa: B023, E731
        if held and key(0) != last:
            yield _joined(held)
            held = []
        last = key(begin - 1)
        while begin and key(begin - 1) == last:
            begin -= 1
        if begin:
            yield _joined([*held, batch.slice(0, begin)])
            held = []
        held.append(batch.slice(begin))
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def map_runs(df: DataFrame, keys: list[str], function: Callable[[pa.RecordBatch], dict], schema: T.StructType, order: tuple[str, ...] = ()) -> DataFrame:
    """Shuffle by ``keys``, sort by them and ``order``, and apply ``function`` to batches in which no run of equal keys is cut."""
    arrow = to_arrow(schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_anew()
        for batch in whole_runs(batches, keys):
            made = function(batch)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, whatever else the table has; null texts are empty."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def id_field(docs: DataFrame, id_col: str = "doc_id") -> T.StructField:
    return T.StructField("doc_id", docs.schema[id_col].dataType)


def parts_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
