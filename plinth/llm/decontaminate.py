"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are the windows of ``window`` consecutive words of each benchmark
item (an item of fewer words, but not none, is one window).  Windows of one
length make one searcher.  It looks at the last word of the current alignment
and at the block of words that ends there: a word that no pattern has lets it
skip the whole pattern length, a block that no pattern has or that lies further
left in every pattern lets it skip by the shift table, and only a block that
ends a pattern leads to that block's bucket, where whole windows are compared.

The benchmark is a stated query set.  Its words are counted first; it is searched
for in blocks of about ``block_words`` words, one after another.  A block is sent
to the executors, what it finds is written to the shared folder, and the block is
given up before the next one is sent; then the blocks' finds are joined.  A
benchmark of one block needs neither the folder nor the join.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm import common
from plinth.operators import ordering

WINDOW = 10
#: Words of a block.  The tables of a worker that searches for it take about 0.6 KB a word.
BLOCK_WORDS = 250_000


class WuManber:
    """Searches word lists for patterns of one length, with blocks of up to three words."""

    def __init__(self, patterns: dict[tuple, set], length: int, block: int = 3):
        self.length, self.block = length, min(block, length)
        self.words = {w for p in patterns for w in p}
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[tuple, set]] = defaultdict(dict)
        for p, items in patterns.items():
            for end in range(self.block, length + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, length), length - end)
            self.bucket[p[length - self.block :]][p] = items

    def search(self, words: list[bytes]):
        """Starts of occurring windows, ascending, with the items that have the window."""
        m, k, known, shift, bucket = self.length, self.block, self.words, self.shift, self.bucket
        far, at, n = m - k + 1, m - 1, len(words)
        while at < n:
            if words[at] not in known:
                at += m
                continue
            b = tuple(words[at - k + 1 : at + 1])
            step = shift.get(b, far)
            if step:
                at += step
                continue
            items = bucket[b].get(tuple(words[at - m + 1 : at + 1]))
            if items:
                yield at - m + 1, items
            at += 1


def patterns_of(rows: list[tuple[str | None, bytes]], window: int) -> dict[int, dict[tuple, set]]:
    """Windows by length, each with the ids of the items that have it."""
    found: dict[int, dict[tuple, set]] = defaultdict(dict)
    alone: dict[str | None, frozenset] = {}
    for item, text in rows:
        words, own = common.words_of(text), alone.setdefault(item, frozenset((item,)))
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            p = tuple(words[i : i + m])
            before = found[m].get(p, own)
            found[m][p] = before if item in before else before | own
    return found


def searchers_of(block: tuple[list[tuple[str | None, bytes]], int]) -> list[WuManber]:
    """The searchers of a block: some of the benchmark's texts, and the window."""
    return [WuManber(p, m) for m, p in patterns_of(*block).items()]


def scan(searchers: list[WuManber], words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """Merged hit ranges (start, end) of words, and the items with an occurring window."""
    spans, items = [], set()
    for s in searchers:
        for start, found in s.search(words):
            spans.append((start, start + s.length))
            items |= found
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> tuple[int, Iterator[Broadcast]]:
    """How many blocks the benchmark has, and the blocks, each given up when the next one is asked for.

    A text of more than a tenth of a block's words is cut; its pieces share
    ``window`` - 1 words, so that each window is in one of them.  Equal pieces of an
    item count once.  Pieces are dealt in their order by running size, so that a block
    has ``block_words`` words at most and one piece more.
    """
    spark = benchmark.sparkSession
    most = max(2 * window, block_words // 10)
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("text", T.BinaryType()), T.StructField("n", T.LongType())])

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict = {"item": [], "text": [], "n": []}
        for item, text in zip(batch.column("item").to_pylist(), common.utf8(batch.column("text"))):
            words = common.words_of(text)
            for i in range(0, max(1, len(words) - window + 1), most - window + 1) if words else ():
                own = words[i : i + most]
                for name, x in zip(out, (item, b" ".join(own), len(own))):
                    out[name].append(x)
        return out

    b = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[text_col].cast("string").alias("text"))
    pieces = common.saved(common.map_arrow(b.where(F.col("text").isNotNull()), cut, schema).dropDuplicates(["item", "text"]), "benchmark")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    n = -(-total // block_words) or 1
    numbered = pieces.withColumn("block", F.lit(0))
    if n > 1:
        placed = ordering.with_running_sum(pieces.withColumn("place", F.xxhash64("item", "text")), "place", "n", "item", "text", name="before")
        numbered = common.saved(placed.select("item", "text", F.floor(F.col("before") / block_words).alias("block")), "blocks")

    def blocks() -> Iterator[Broadcast]:
        for k in range(n):
            rows = [(r[0], bytes(r[1])) for r in numbered.where(F.col("block") == k).select("item", "text").collect()]
            sent = spark.sparkContext.broadcast((rows, window))
            del rows
            yield sent
            if k < n - 1:
                sent.destroy()

    return n, blocks()


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row for each row of ``docs``: its id, ``n_words``, ``spans`` (hit word ranges) and ``items`` (ids as strings, sorted).

    Null and empty texts have no words and no hits.  Repeated rows are each
    judged.  Items with a null id make words hit but are not listed; items with
    null or empty texts have no windows.  An empty table on either side gives
    rows without hits, or no rows.  Other columns of ``docs`` are not read.
    """
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    found = [T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("items", T.ArrayType(T.StringType()))]
    own = [common.id_field(docs, id_col)]
    df = common.id_text(docs, id_col, text_col)
    n, blocks = benchmark_blocks(benchmark, item_col, item_text_col, window, block_words)
    if n == 1:
        return common.map_arrow(df, _scanner(next(blocks)), T.StructType(own + found))
    # Rows of the same id and text have the same finds.
    key = [F.col("doc_id"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")]
    marks = [T.StructField("h", T.LongType()), T.StructField("g", T.LongType())]
    keyed, parts = df.select(*key, "text"), []
    for sent in blocks:
        hits = common.map_arrow(keyed, _scanner(sent), T.StructType(own + marks + found)).where(F.size("spans") > 0)
        parts.append(common.saved(hits.select("doc_id", "h", "g", "spans", "items"), "hits"))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    names = [common.fresh(df, x) for x in ("_id", "_h", "_g")]
    joined = hits.groupBy(*(F.col(c).alias(x) for c, x in zip(("doc_id", "h", "g"), names))).agg(F.collect_set(F.struct("spans", "items")).alias("hits"))
    on = F.lit(True)
    for k, x in zip(key, names):
        on = on & k.eqNullSafe(F.col(x))
    none = F.array().cast("array<struct<spans:array<struct<start:bigint,end:bigint>>,items:array<string>>>")
    rows = df.join(joined, on, "left").select("doc_id", "text", F.coalesce("hits", none).alias("hits"))

    def union(batch: pa.RecordBatch) -> dict:
        hits = batch.column("hits").to_pylist()
        return {
            "doc_id": batch.column("doc_id"), "n_words": [len(common.words_of(t)) for t in common.utf8(batch.column("text"))],
            "spans": [[{"start": a, "end": b} for a, b in merged([(s["start"], s["end"]) for x in h for s in x["spans"]])] for h in hits],
            "items": [sorted({i for x in h for i in x["items"]}) for h in hits],
        }

    return common.map_arrow(rows, union, T.StructType(own + found))


def _scanner(sent: Broadcast):
    def run(batch: pa.RecordBatch) -> dict:
        searchers = common.built(sent, searchers_of)
        out: dict = {c: batch.column(c) for c in batch.schema.names if c != "text"} | {"n_words": [], "spans": [], "items": []}
        for text in common.utf8(batch.column("text")):
            words = common.words_of(text)
            spans, items = scan(searchers, words)
            out["n_words"].append(len(words))
            out["spans"].append([{"start": a, "end": b} for a, b in spans])
            out["items"].append(sorted(x for x in items if x is not None))
        return out

    return run


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query, from what ``find`` gives."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all their columns.

    Rows with null or empty texts stay.
    """
    n, blocks = benchmark_blocks(benchmark, "item_id", "text", WINDOW, block_words)
    for k, sent in enumerate(blocks):
        docs = common.map_arrow(docs, _filter(sent, text_col), docs.schema)
        if k < n - 1:
            docs = common.saved(docs, "clean")
    return docs


def _filter(sent: Broadcast, text_col: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, searchers = [], common.built(sent, searchers_of)
        for text in common.utf8(batch.column(text_col)):
            words = common.words_of(text)
            keep.append(not any(next(s.search(words), None) for s in searchers))
        return batch.filter(pa.array(keep, type=pa.bool_()))

    return run


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

ORACLE = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
      FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS p
        FROM d, (SELECT DISTINCT m FROM p) AS ms, unnest(range(1, len(w) - m + 2)) AS t(i) WHERE len(w) >= m),
occ AS (SELECT doc_id, i, m, item_id FROM win JOIN p USING (m, p)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
       FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, sha256(coalesce(it.s, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
