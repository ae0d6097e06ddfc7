"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs.

A paragraph (a line with words) has a digest; with the number of equal paragraphs
before it, that goes into three cells of the sketch (count, digests, checks; the
last two are exclusive-or sums).  One sketch less another has only what differs;
peeling it recovers the digests of the paragraphs on either side that the other
lacks, and where that gets stuck both sides are sketched anew in a larger size.
After ``RETRIES`` sizes the sorted digests are compared instead, so that a
collision can't keep it going.

Only the changed paragraphs are looked into further: they are cut into cells of a
few words, at words that their own hash marks, and the cells that both sides have
count as alike.  As equal paragraphs have equal cells, that is what all cells of the
two texts have in common; a fingerprint's second part, the list of its cells, gives
the same likeness (``likeness_of``).  Sketches of a batch of texts are built,
subtracted and peeled together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm import common

#: Sketch cells of a fingerprint; growth and number of retries; words of a changed paragraph's cell on average.
BASE_CELLS, GROWTH, RETRIES, CELL_WORDS = 24, 4, 5, 8
HASHES = 3
#: Rounds of peeling; each takes all digests that stand alone in a cell.
ROUNDS = 64
#: Texts, and characters of texts, that are worked on together.
TOGETHER, TOGETHER_CHARS = 256, 1 << 20
_MIX = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)))
_NONE = np.empty(0, dtype=np.uint64)


@dataclass
class Parts:
    """Of a text: digests of its paragraphs (different for equal ones), digests of its cells, and the paragraph of each cell."""

    paragraphs: np.ndarray
    cells: np.ndarray
    owner: np.ndarray


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[0]
    return h ^ (h >> np.uint64(30))


def _runs(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Digests of the runs of words that begin at ``starts``."""
    place = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    return _mixed(np.add.reduceat(_mixed(h + place.astype(np.uint64) * _MIX[1]), starts))


def numbered(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Equal keys of a text (number ``of``) made different by how many equal ones come before."""
    order = np.lexsort((keys, of))
    new = np.append(True, (np.diff(keys[order]) != 0) | (np.diff(of[order]) != 0))
    number = np.empty(len(keys), dtype=np.int64)
    number[order] = np.arange(len(keys)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return _mixed(keys + number.astype(np.uint64) * _MIX[2])


def parts_of(texts: list[bytes]) -> list[Parts]:
    """The parts of each text."""
    words: list[bytes] = []
    begins, counts = [], []
    for text in texts:
        before = len(begins)
        for paragraph in text.split(b"\n"):
            if own := paragraph.split():
                begins.append(len(words))
                words += own
        counts.append(len(begins) - before)
    if not words:
        return [Parts(_NONE, _NONE, np.empty(0, np.int64)) for _ in texts]
    h, begins = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype=">u8").astype(np.uint64), np.array(begins)
    fresh = np.zeros(len(h), dtype=bool)
    fresh[begins] = True
    starts = np.flatnonzero(fresh | np.append(True, h[:-1] % np.uint64(CELL_WORDS) == 0))
    paragraphs = numbered(_runs(h, begins), np.repeat(np.arange(len(texts)), counts))
    cells, owner = _runs(h, starts), np.cumsum(fresh[starts]) - 1
    ends = np.append(0, np.cumsum(counts))
    cuts = np.searchsorted(owner, ends).tolist()
    ends = ends.tolist()
    return [Parts(paragraphs[a:b], cells[c:d], owner[c:d] - a) for a, b, c, d in zip(ends, ends[1:], cuts, cuts[1:])]


class Sketches:
    """Sketches of ``n`` texts, of ``cells`` cells each."""

    def __init__(self, n: int, cells: int = BASE_CELLS):
        self.n, self.cells = n, cells
        self.count, self.key, self.check = np.zeros(n * cells, np.int64), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)

    def put(self, of: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        """Add (or with a sign of -1 take away) the digests ``keys`` of the texts numbered ``of``."""
        check, part = (keys * _MIX[3]) >> np.uint64(32), np.uint64(self.cells // HASHES)
        for j in range(HASHES):
            at = of * self.cells + (((keys * _MIX[j]) >> np.uint64(20)) % part).astype(np.int64) + j * (self.cells // HASHES)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, digest and sign of what is recovered, and for each text whether that is all there was."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(ROUNDS):
            at = np.flatnonzero((np.abs(self.count) == 1) & ((self.key * _MIX[3]) >> np.uint64(32) == self.check))
            if not len(at):
                break
            of, keys, sign = at // self.cells, self.key[at], self.count[at]
            order = np.lexsort((keys, of))
            once = order[np.append(True, (np.diff(of[order]) != 0) | (np.diff(keys[order]) != 0))]
            of, keys, sign = of[once], keys[once], sign[once]
            self.put(of, keys, -sign)
            found.append((of, keys, sign))
        whole = ~((self.count != 0) | (self.key != 0)).reshape(self.n, self.cells).any(axis=1)
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64), _NONE, np.empty(0, np.int64)]
        return (*columns, whole)

    def texts(self) -> list[str]:
        columns = [c.reshape(self.n, self.cells).astype(kind) for c, kind in ((self.count, "<i4"), (self.key, "<u8"), (self.check, "<u4"))]
        return [base64.b64encode(b"".join(c[i].tobytes() for c in columns)).decode() for i in range(self.n)]


def sketched(keys: list[np.ndarray], cells: int = BASE_CELLS) -> Sketches:
    made = Sketches(len(keys), cells)
    if keys:
        made.put(np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.concatenate(keys), 1)
    return made


def differences(a: list[np.ndarray], b: list[np.ndarray], cells: int = BASE_CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair, the digests that only the first and that only the second has, both sorted."""
    out: list[tuple[np.ndarray, np.ndarray]] = [(_NONE, _NONE)] * len(a)
    todo = np.arange(len(a))
    for _ in range(RETRIES):
        if not len(todo):
            return out
        made = Sketches(len(todo), cells)
        for side, sign in ((a, 1), (b, -1)):
            made.put(np.repeat(np.arange(len(todo)), [len(side[i]) for i in todo]), np.concatenate([side[i] for i in todo]), sign)
        of, keys, sign, whole = made.peel()
        order = np.lexsort((keys, sign, of))
        of, keys, sign = of[order], keys[order], sign[order]
        ends = np.searchsorted(of, np.arange(len(todo) + 1))
        for k in np.flatnonzero(whole).tolist():
            own, s = keys[ends[k] : ends[k + 1]], sign[ends[k] : ends[k + 1]]
            out[todo[k]] = (own[s == 1], own[s == -1])
        todo = todo[~whole]
        cells *= GROWTH
    for i in todo.tolist():
        out[i] = (np.setdiff1d(a[i], b[i]), np.setdiff1d(b[i], a[i]))
    return out


def _changed(parts: Parts, digests: np.ndarray) -> np.ndarray:
    """Cells of the paragraphs with these (sorted) digests."""
    if not len(digests):
        return _NONE
    at = np.minimum(np.searchsorted(digests, parts.paragraphs), len(digests) - 1)
    return parts.cells[(digests[at] == parts.paragraphs)[parts.owner]]


def likeness(a: list[Parts], b: list[Parts]) -> list[float]:
    """For each pair, the share of cells that the other has too; 1 for two texts without words."""
    sides: tuple[list, list] = ([], [])
    for p, q, (mine, theirs) in zip(a, b, differences([p.paragraphs for p in a], [q.paragraphs for q in b])):
        sides[0].append(_changed(p, mine))
        sides[1].append(_changed(q, theirs))
    n = len(a)
    lengths = [np.array([len(x) for x in side], dtype=np.int64) for side in sides]
    of = np.concatenate([np.repeat(np.arange(n), k) for k in lengths])
    keys, own = np.concatenate(sides[0] + sides[1]) if n else _NONE, np.arange(len(of)) < lengths[0].sum()
    order = np.lexsort((keys, of))
    of, keys, own = of[order], keys[order], own[order]
    starts = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(keys) != 0))) if len(of) else np.empty(0, np.int64)
    mine = np.add.reduceat(own.astype(np.int64), starts) if len(of) else starts
    theirs = np.diff(np.append(starts, len(of))) - mine
    both = np.bincount(of[starts], np.minimum(mine, theirs), minlength=n)
    out = []
    for i in range(n):
        total = len(a[i].cells) + len(b[i].cells)
        out.append(1.0 - (lengths[0][i] + lengths[1][i] - 2 * both[i]) / total if total else 1.0)
    return out


def cell_lists(parts: list[Parts]) -> list[str]:
    """The digests of each text's cells, sorted: the part of its fingerprint that its likeness is taken from."""
    return [base64.b64encode(np.sort(p.cells).astype("<u8").tobytes()).decode() for p in parts]


def likeness_of(a: str, b: str) -> float:
    """The likeness of two texts from the lists of their cells (``cell_lists``) alone."""
    x, y = (np.frombuffer(base64.b64decode(t), dtype="<u8") for t in (a, b))
    if not len(x) + len(y):
        return 1.0
    keys, place = np.unique(np.concatenate((x, y)), return_inverse=True)
    both = np.minimum(np.bincount(place[: len(x)], minlength=len(keys)), np.bincount(place[len(x) :], minlength=len(keys))).sum()
    return 2 * float(both) / (len(x) + len(y))


def edited(text: str, after: str) -> str:
    """The text with its last third replaced by as much of the beginning of ``after``."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def together(texts: list[str]) -> Iterator[slice]:
    """Slices of neighbouring texts, each of a bounded size or one text."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and (i - begin == TOGETHER or size + len(text) > TOGETHER_CHARS):
            yield slice(begin, i)
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield slice(begin, len(texts))


_OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("cells", T.StringType()), T.StructField("edited_cells", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of range, ghost, doc and text, each range sorted by descending id and ended by the row that follows it (a ghost).

    Ranges are cut at quantiles of the ids; the first row of each range is also
    sent to the range above it, and the first of all to the last range.
    """
    spark = docs.sparkSession
    parts = common.parts_for(spark)
    low = F.lit(-(1 << 63)).cast("long")
    df = docs.select(F.coalesce(docs[id_col].cast("long"), low).alias("doc"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    ids = df.select("doc")
    points = common.split_points(ids, "doc", parts)
    df = df.withColumn("range", common.range_of(F.col("doc"), points))
    # As many rows as ranges.
    tops = ids.groupBy(common.range_of(F.col("doc"), points).alias("range")).agg(F.max("doc").alias("top")).orderBy("range").collect()
    sends = [(r["top"], tops[(i + 1) % len(tops)]["range"]) for i, r in enumerate(tops)]
    sent = spark.createDataFrame(sends, "top long, target int")
    df = df.join(F.broadcast(sent), F.col("doc") == F.col("top"), "left")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("ghost"))
    other = F.struct(F.col("target").alias("range"), F.lit(True).alias("ghost"))
    df = df.withColumn("to", F.explode(F.when(F.col("top").isNull(), F.array(own)).otherwise(F.array(own, other))))
    return df.select("to.range", "to.ghost", "doc", "text").repartition(parts, "range").sortWithinPartitions("range", "ghost", F.desc("doc"), "text")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: fingerprints of its text and of its edited text, the lists of their cells, and their likeness.

    The next document is the following row by descending id, after the last the
    first; rows that share an id follow each other by their texts, and rows
    without an id come last.  A document alone is its own next.  Null and empty
    texts have the fingerprint of nothing and are wholly like each other.  Other
    columns are not read.
    """
    arrow = common.to_arrow(_OUT)

    def rows(own: list[tuple[int, str, Parts]], after: list[tuple[int, str, Parts]]) -> pa.RecordBatch:
        raw = [edited(t, u).encode() for (_, t, _), (_, u, _) in zip(own, after)]
        mine, theirs = [p for _, _, p in own], parts_of(raw)
        columns = (
            [None if doc == -(1 << 63) else doc for doc, _, _ in own], [len(t) for _, t, _ in own], [hashlib.sha256(r).hexdigest() for r in raw],
            sketched([p.paragraphs for p in mine]).texts(), sketched([p.paragraphs for p in theirs]).texts(),
            cell_lists(mine), cell_lists(theirs),
            likeness(mine, theirs), likeness(mine, [p for _, _, p in after]),
        )
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # range, ghost, document, text and parts of the row before
        for batch in common.pieces(batches):
            columns = [batch.column(c).to_pylist() for c in ("range", "ghost", "doc", "text")]
            for some in together(columns[3]):
                own, after = [], []
                for place, ghost, doc, text, parts in zip(*(c[some] for c in columns), parts_of([t.encode() for t in columns[3][some]])):
                    if held and held[0] == place and not held[1]:
                        own.append(held[2:])
                        after.append((doc, text, parts))
                    held = (place, ghost, doc, text, parts)
                if own:
                    yield rows(own, after)

    return with_next(docs, id_col, text_col).mapInArrow(run, _OUT)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"))
