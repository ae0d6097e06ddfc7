"""Substring dedup with difference-cover anchors.

Words at positions whose remainder modulo ``PERIOD`` is in ``COVER`` start an
anchor of ``ANCHOR`` words.  Every difference modulo the period is a difference
of two cover elements, so for two equal windows of ``WINDOW`` words, wherever
they start, some offset below the period puts both on cover positions, and the
anchor there lies within both.  A window that starts a repeat thus always has an
anchor whose hash occurs twice; only such windows are looked at further.  There,
anchors are extended to all windows around them, whose own 96-bit hashes are
grouped, and every window that isn't the first of its group is removed.

Exact copies of whole documents are found first by their texts' hashes and need
neither anchors nor windows.

Anchors and windows are sorted by their hashes on disk and streamed; a hash that
occurs in any number of places needs no more memory than another.  Nor does it
make one task read all its places: a task first looks through some ``LOCAL`` rows
at a time, where every place of an anchor that occurs again, and every place of a
window but the first, is decided already.  Those go on under a key of their
document, and one row for each hash goes on under the hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm import common

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
HIGH = np.uint64(0xFFFFFFFF00000000)
#: Rows that a task looks through before they are shuffled, and the mark of a row that this decides.
LOCAL, DECIDED = 1 << 20, 1 << 31
#: Stands for a null id, which comes before all others.
NULL_ID = -(1 << 63)

_ANCHORS = T.StructType([T.StructField("h", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("pos", T.LongType())])
_PLACES = T.StructType([T.StructField("doc", T.LongType()), T.StructField("pos", T.IntegerType())])
_WINDOWS = T.StructType([T.StructField("h", T.LongType()), T.StructField("g", T.LongType()), T.StructField("doc", T.LongType())])


def multipliers(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of several texts, end to end, as hashes."""

    def __init__(self, texts: list[bytes]):
        lists = [t.split() for t in texts]
        digest = xxhash.xxh64_intdigest
        self.hashes = np.array([digest(w) for words in lists for w in words], dtype=np.uint64)
        self.sizes = np.array([len(words) for words in lists], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])) if len(lists) else np.empty(0, np.int64)
        self.text = np.repeat(np.arange(len(lists)), self.sizes)
        self.pos = np.arange(len(self.hashes)) - self.starts[self.text]

    def runs(self, at: np.ndarray, n: int, seed: int) -> np.ndarray:
        """Hashes of the ``n`` words from each of ``at`` on."""
        h = np.zeros(len(at), dtype=np.uint64)
        for k, c in enumerate(multipliers(seed, n)):
            h += self.hashes[at + k] * c
        return mixed(h)


def copies(docs: DataFrame) -> DataFrame:
    """The ids (column doc) of documents whose whole text is that of a smaller id: all their windows start earlier."""
    hashed = docs.select("doc", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    first = hashed.groupBy("h", "g").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    # An id with several texts is left to the windows.
    single = hashed.groupBy("doc").agg(F.min("h").alias("h"), F.min("g").alias("g"), F.max("h").alias("h2"), F.max("g").alias("g2")).where("h = h2 AND g = g2")
    # Written out, it is joined by a shuffle of either side, and Spark splits the rows of a hot text.
    return single.join(common.saved(first, "copies"), ["h", "g"]).where(F.col("doc") > F.col("first")).select("doc")


def _locally(docs: DataFrame, made, decide, schema: T.StructType) -> DataFrame:
    """The columns that ``made`` makes of each batch, through ``decide`` in lots of about ``LOCAL`` rows."""
    arrow = common.to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot: list[list[np.ndarray]] = []

        def out() -> pa.RecordBatch:
            columns = decide(*(np.concatenate(c) for c in zip(*lot)))
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in common.pieces(batches):
            lot.append(made(batch))
            if sum(len(x[0]) for x in lot) >= LOCAL:
                yield out()
                lot = []
        if lot:
            yield out()

    return docs.mapInArrow(run, schema)


def _own_key(doc: np.ndarray) -> np.ndarray:
    return mixed(mixed(doc.view(np.uint64))).view(np.int64)


def anchors(docs: DataFrame) -> DataFrame:
    """Anchors' hashes and places; the place of one that is known to occur again has the mark ``DECIDED``."""
    cover = np.isin(np.arange(PERIOD), COVER)

    def made(batch: pa.RecordBatch) -> list[np.ndarray]:
        w = Words(common.utf8(batch.column("text")))
        size = w.sizes[w.text]
        at = np.flatnonzero(cover[w.pos % PERIOD] & (w.pos <= size - ANCHOR) & (size >= WINDOW))
        return [w.runs(at, ANCHOR, 1).view(np.int64), batch.column("doc").to_numpy()[w.text[at]], w.pos[at]]

    def decide(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        again, several = np.zeros((2, len(h)), dtype=bool)
        again[order[1:]] = same
        several[order[:-1]] = same
        return np.where(again, _own_key(doc), h), doc, pos | np.where(several | again, DECIDED, 0)

    return _locally(docs, made, decide, _ANCHORS)


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def repeated(rows: DataFrame) -> DataFrame:
    """Places of the anchors whose hash occurs more than once."""
    arrow = common.to_arrow(_PLACES)

    def places(doc: np.ndarray, pos: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array((pos[keep] & ~DECIDED).astype(np.int32))], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, and whether its hash was there before it
        for batch in batches:
            h, doc, pos = _columns(batch, ("h", "doc", "pos"))
            before = False
            if held:
                h, doc, pos = (np.concatenate((x, y)) for x, y in zip(held[0], (h, doc, pos)))
                before = held[1]
            if not len(h):
                continue
            same = h[1:] == h[:-1]
            several = np.append(before, same)
            held = ((h[-1:], doc[-1:], pos[-1:]), bool(several[-1]))
            several[:-1] |= same
            keep = several | (pos >= DECIDED)
            keep[-1] = False
            yield places(doc, pos, keep)
        if held:
            (_, doc, pos), before = held
            yield places(doc, pos, before | (pos >= DECIDED))

    parts = common.parts_for(rows.sparkSession)
    return rows.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(run, _PLACES)


def windows(places: DataFrame) -> DataFrame:
    """Hashes and places of all windows that hold an anchor of ``places`` (doc, text, at: anchor positions).

    ``g`` has 32 more bits of hash, then the window's position, with the mark
    ``DECIDED`` if it is known to start earlier elsewhere.
    """

    def made(batch: pa.RecordBatch) -> list[np.ndarray]:
        w = Words(common.utf8(batch.column("text")))
        lists = batch.column("at")
        at = lists.flatten().to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        flat = w.starts[of] + at if len(at) else np.empty(0, np.int64)
        marks = np.zeros(len(w.hashes) + 1, dtype=np.int32)
        np.add.at(marks, np.maximum(flat - (WINDOW - ANCHOR), w.starts[of]), 1)
        np.add.at(marks, flat + 1, -1)
        here = np.flatnonzero((np.cumsum(marks)[:-1] > 0) & (w.pos <= w.sizes[w.text] - WINDOW))
        g = (w.runs(here, WINDOW, 3) & HIGH | w.pos[here].astype(np.uint64)).view(np.int64)
        return [w.runs(here, WINDOW, 2).view(np.int64), g, batch.column("doc").to_numpy()[w.text[here]]]

    def decide(h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((g & 0xFFFFFFFF, doc, h))
        _, lead = _leads(h[order], g[order] >> 32)
        first, place = np.empty((2, len(h)), dtype=np.int64)
        first[order], place[order] = order[lead], np.arange(len(h)) - lead
        other = (doc != doc[first]) | (g != g[first])
        once = other | (place == 0)  # rows of the same id may say the same place twice
        h, g = np.where(other, _own_key(doc), h), np.where(other, g & 0xFFFFFFFF | DECIDED, g)
        return h[once], g[once], doc[once]

    return _locally(places, made, decide, _WINDOWS)


def _leads(h: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row begins a group of equal hashes, and the first row of its group."""
    new = np.append(True, (h[1:] != h[:-1]) | (high[1:] != high[:-1]))[: len(h)]
    return new, np.flatnonzero(new)[np.cumsum(new) - 1]


def later(rows: DataFrame) -> DataFrame:
    """Places of the windows whose words start earlier too."""
    arrow = common.to_arrow(_PLACES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None  # the first row of the group that the rows so far end in
        for batch in batches:
            h, g, doc = _columns(batch, ("h", "g", "doc"))
            if not len(h):
                continue
            if first:
                h, g, doc = (np.concatenate(([x], y)) for x, y in zip(first, (h, g, doc)))
            pos = g & 0xFFFFFFFF
            _, lead = _leads(h, g >> 32)
            drop = (doc != doc[lead]) | (pos != pos[lead]) | (pos >= DECIDED)
            if first:
                drop[0] = False
            k = lead[-1]
            first = (h[k], g[k], doc[k])
            yield pa.RecordBatch.from_arrays([pa.array(doc[drop], type=pa.int64()), pa.array((pos[drop] & ~DECIDED).astype(np.int32))], schema=arrow)

    parts = common.parts_for(rows.sparkSession)
    return rows.repartition(parts, "h").sortWithinPartitions("h", F.shiftright("g", 32), "doc", "g").mapInArrow(run, _PLACES)


_KEPT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType()),
])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed and the kept words joined by a space (or their SHA-256).

    Ids are integers; a null id comes before all others.  Null and empty texts,
    and texts of fewer than ``WINDOW`` words, lose nothing.  Rows that share an
    id count as the same document at the same place: neither is earlier, and
    what is removed is removed from all of them.  Other columns are not read.
    """
    spark = docs.sparkSession
    parts = common.parts_for(spark)
    read = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    dealt = read.repartition(parts, "doc")
    copied = copies(read)
    # Not an anti join, which would be moved below the shuffle and make it a second one.
    own = dealt.join(copied.withColumn("copy", F.lit(True)).hint("shuffle_hash"), "doc", "left").where(F.col("copy").isNull()).drop("copy")
    at = repeated(anchors(own)).groupBy("doc").agg(F.collect_list("pos").alias("at"))
    found = later(windows(dealt.join(at.hint("shuffle_hash"), "doc"))).groupBy("doc").agg(F.collect_list("pos").alias("at"))
    marked = found.select("doc", "at", F.lit(False).alias("copy")).unionByName(copied.select("doc", F.lit(None).cast("array<int>").alias("at"), F.lit(True).alias("copy")))

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}
        lists, copy = batch.column("at"), batch.column("copy").to_pylist()
        for i, (doc, text) in enumerate(zip(batch.column("doc").to_pylist(), common.utf8(batch.column("text")))):
            words, gone = text.split(), 0
            if copy[i]:
                if len(words) >= WINDOW:
                    words, gone = [], len(words)
            elif lists[i].is_valid:
                starts = lists[i].values.to_numpy(zero_copy_only=False)
                starts = starts[starts <= len(words) - WINDOW]
                marks = np.zeros(len(words) + 1, dtype=np.int32)
                np.add.at(marks, starts, 1)
                np.add.at(marks, starts + WINDOW, -1)
                kept = np.cumsum(marks)[:-1] == 0
                gone = len(words) - int(kept.sum())
                words = [w for w, k in zip(words, kept.tolist()) if k]
            text = b" ".join(words)
            out["doc_id"].append(None if doc == NULL_ID else doc)
            out["n_words"].append(len(words) + gone)
            out["n_removed"].append(gone)
            out["kept"].append(hashlib.sha256(text).hexdigest().encode() if digest else text)
        return out

    return common.map_arrow(dealt.join(marked.hint("shuffle_hash"), "doc", "left"), cut, _KEPT)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS t(i) WHERE len(w) >= 20),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM hit),
kept AS (SELECT w.doc_id, string_agg(w.x, ' ' ORDER BY w.p) AS s, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) AS w
         ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.p = gone.p GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
