"""Spelling variants: words that differ by one inserted, deleted or replaced character.

One edit leaves a half of the shorter word intact, at its beginning or at its end.
So near words meet in a block of a forward dictionary (a shared prefix of half the
length) or of a reversed one (a shared suffix).  Blocks of words of one length hold
the pairs with a replaced character, blocks of two neighbouring lengths those with
an inserted one.  A block of more than ``BLOCK_ROWS`` words is subdivided: what
its words don't share yet has one edit too, so half of that is intact again, and
the words go to blocks that share more of the beginning or more of the end.  The
last subdivision leaves one character open, so every block becomes as small as the
alphabet, and no block is ever searched by all its pairs.  Spark shuffles the rows
by block and sorts them; a task scans the sorted blocks and verifies their words.

A pair is found once: in a block that shares more of the end, only if it can't be
in the one that shares more of the beginning (``less``).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm import common

#: Letters of a word, and the least length of words that are looked at.
LETTERS, LEAST_LENGTH = "[A-Za-zÀ-ÿ]", 7
#: Occurrences that a word must have, and how many times as frequent as a word its form must be.
LEAST_COUNT, TIMES = 2, 10
#: A block of more words is subdivided.
BLOCK_ROWS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_BOUND = 1 << 30


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", garbled: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n: the words of all texts with their numbers of occurrences.

    A word is a maximal run of letters, of which only A-Z are lower-cased.  With
    ``garbled``, the runs whose hash with the document's id it divides lose a
    character first.  Null and empty texts have no words; a null id counts as an
    empty one; repeated rows count each.  Other columns are not read.
    """
    run = F.explode(F.regexp_extract_all(docs[text_col].cast("string"), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), run.alias("run"))
    rows = rows.select("id", F.translate("run", _UPPER, _LOWER).alias("word"))
    if garbled:
        h, size = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")), F.length("word")
        at = (h % size).cast("int")
        rows = rows.select(F.when(h % garbled == 0, F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, size))).otherwise(F.col("word")).alias("word"))
        rows = rows.where(F.length("word") >= least_length)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


_STATE = ("kind", "m", "a", "b", "less")


def _part(kind: Column, rest: Column) -> Column:
    """How much of ``rest`` open characters one edit leaves intact on one side: half, rounded up for an inserted one."""
    return F.floor((rest + kind) / 2).cast("int")


def _halves(rows: DataFrame) -> DataFrame:
    """The two blocks of each row that share more: of the beginning, and of the end.

    A block's words have the first ``a`` and the last ``b`` characters in common;
    ``m`` is the length of the shorter ones.  ``kind`` is 0 for a replaced
    character, where all words have that length, and 1 for an inserted one.
    """
    half = _part(F.col("kind"), F.col("m") - F.col("a") - F.col("b"))
    to = lambda a, b, less: F.struct(a.alias("a"), b.alias("b"), less.alias("less"))
    a, b, less = F.col("a"), F.col("b"), F.col("less")
    both = F.array(to(a + half, b, less), to(a, b + half, F.least(less, a + half)))
    rows = rows.select("word", "n", "kind", "m", F.explode(both).alias("s")).select("word", "n", "kind", "m", "s.a", "s.b", "s.less")
    ends = F.concat(F.substring(F.col("word"), F.lit(1), F.col("a")), F.lit("/"), F.substring(F.col("word"), F.length("word") - F.col("b") + 1, F.col("b")))
    # A block's name only brings words together; what it names is compared again.
    return rows.withColumn("block", F.concat_ws("/", *_STATE, F.when(F.length(ends) > 40, F.md5(ends.cast("binary"))).otherwise(ends)))


def _begin(words: DataFrame) -> DataFrame:
    size = F.length("word")
    state = lambda kind, m: F.struct(F.lit(kind).alias("kind"), m.cast("int").alias("m"))
    roles = F.array(state(0, size), state(1, size), state(1, size - 1))
    rows = words.select("word", "n", F.explode(roles).alias("s")).select("word", "n", "s.kind", "s.m", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(_NO_BOUND).alias("less"))
    return _halves(rows)


def common_prefix(u: str, v: str) -> int:
    k = 0
    for x, y in zip(u, v):
        if x != y:
            break
        k += 1
    return k


def near_in_block(words: list[str], kind: int, m: int, a: int, b: int, less: int) -> Iterator[tuple[int, int]]:
    """Places of the near pairs of a block's words, each once."""
    if kind == 0:
        open_at: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i in range(a, min(m - b, less)):
            open_at.clear()
            for k, w in enumerate(words):
                open_at[w[:i], w[i + 1 :]].append(k)
            for same in open_at.values():
                for x, u in enumerate(same):
                    for v in same[x + 1 :]:
                        yield u, v
        return
    short = {w: k for k, w in enumerate(words) if len(w) == m}
    for k, w in enumerate(words):
        if len(w) == m + 1 and short:
            for s in {w[:i] + w[i + 1 :] for i in range(a, m + 1 - b)}:
                if s in short and common_prefix(s, w) < less:
                    yield short[s], k


_LINK = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("near", T.StringType()), T.StructField("near_n", T.LongType())])


def _scan(batch: pa.RecordBatch) -> dict:
    """Links of the whole blocks of a batch that is sorted by block, both ways."""
    blocks, words, counts = (batch.column(c).to_pylist() for c in ("block", "word", "n"))
    out: dict = {"word": [], "n": [], "near": [], "near_n": []}
    at, size = 0, len(blocks)
    while at < size:
        end = at + 1
        while end < size and blocks[end] == blocks[at]:
            end += 1
        if end - at > 1:
            state = map(int, blocks[at].split("/")[:5])
            for u, v in near_in_block(words[at:end], *state):
                for x, y in ((at + u, at + v), (at + v, at + u)):
                    out["word"].append(words[x])
                    out["n"].append(counts[x])
                    out["near"].append(words[y])
                    out["near_n"].append(counts[y])
        at = end
    return out


def links(words: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """word, n, near, near_n: each pair of near words, both ways, of a table of distinct words with their counts.

    Each round counts the blocks, scans those that are small or can't be subdivided
    and subdivides the others; there are about as many rounds as the longest
    crowded word's length has binary digits, and a crowded word comes to at most
    about as many blocks as it has characters.
    """
    rows, found = _begin(words), None
    while True:
        done = F.col("m") - F.col("a") - F.col("b") <= 1 - F.col("kind")
        large = common.saved(rows.where(~done).groupBy("block").agg(F.count("*").alias("size")).where(F.col("size") > block_rows), "blocks")
        none = large.isEmpty()
        small = rows if none else rows.join(large, "block", "left").where(F.col("size").isNull()).drop("size")
        here = common.map_runs(small.select("block", "word", "n"), ["block"], _scan, _LINK)
        found = here if found is None else found.unionByName(here)
        if none:
            return found
        rows = common.saved(_halves(rows.join(large, "block", "left_semi")), "halves")


def variants(words: DataFrame, times: int = TIMES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """word, form, root, n, n_near and form_n of each of the distinct words (word, n).

    The form is the near word of largest n (of equal ones the first by code points)
    if that is at least ``times`` n; the root follows forms to the last.  As n grows
    with each step, there are no rings.
    """
    words = common.saved(words.select("word", F.col("n").cast("long").alias("n")), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("down"), "near", "near_n")).alias("best")
    near = common.saved(links(words, block_rows).groupBy("word").agg(F.first("n").alias("own"), F.count("*").alias("n_near"), best), "near")
    fits = F.col("best.near_n") >= times * F.col("own")
    near = near.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, F.col("best.near_n")).alias("form_n"))
    roots = common.saved(near.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not roots.where("moved").isEmpty():
        # Each round doubles the steps that a root is away.
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = common.saved(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    all_ = words.join(near, "word", "left").join(roots.drop("moved"), "word", "left")
    return all_.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(common.table(spark, sf_dir, "documents"), garbled=31))
