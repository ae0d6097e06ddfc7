"""The prefix trie of conversations, by distributed most-significant-digit radix partitioning.

Turns (role and text) become numbers by a dictionary in the order of role and text.
A conversation is then a sequence of numbers; equal ones are taken together, with
their number, their smallest id and the digest of their ids.  The sequences of a
node are dealt into buckets by their next number.  A bucket that is small enough is
finished in one task by multikey quicksort, whose recursion emits the nodes.  A
larger one becomes a node itself, past all turns that its sequences share, and is
dealt again by the number after that; so a first turn that a third of all
conversations have is split by the second one.  What lies below the large nodes is
added up at the end.

A node is named by its smallest member and its depth.  Rounds are written to the
shared folder.  One conversation, as numbers (12 bytes a turn), must fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm import common

#: Sequences and turns up to which a bucket is finished in one task.
LOCAL_ROWS, LOCAL_TURNS = 500, 200_000
#: Ids that go into one piece of a list of members.
CHUNK = 4096
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def encoded(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), id and words: each turn's place in its conversation, its number and its text's words.

    Turns are in the order of ``turn``, null first; those of one ``turn`` in the order
    of role and text.  Null roles and texts are empty; rows without a conv_id are not
    used; repeated rows are turns each; other columns are not read.
    """
    c = conversations
    said = [F.coalesce(c[x].cast("string"), F.lit("")).alias(x) for x in ("role", "text")]
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].alias("turn"), *said).where(F.col("conv_id").isNotNull())
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))).alias("digest")
    known = rows.select("role", "text").distinct().repartitionByRange("role", "text").sortWithinPartitions("role", "text")
    words = F.regexp_count("text", F.lit(WORD)).cast("int").alias("words")
    dictionary = common.saved(known.select(digest, F.monotonically_increasing_id().alias("id"), words), "turns")
    placed = rows.select("conv_id", "turn", digest).join(dictionary, "digest").select("conv_id", "turn", "id", "words")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "id")) - 1
    return placed.select("conv_id", at.alias("pos"), "id", "words")


def rebuilt(turns: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """The turns of each conversation c after its first h are kept, and its first h are those of c - c % ``family``.

    h is the hash of c modulo ``heads``.  Returns a row for each conv_id with its
    sequence: ids and words.  c % family has the sign of c.
    """
    turns = common.saved(turns, "placed")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    all_ = turns.select("conv_id").distinct()
    base = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv_id", "base")
    # At most as many ids share a base as the family has on its two sides.
    first = all_.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(base, "base").where(F.col("pos") < h).select("conv_id", "pos", "id", "words")
    own = turns.where(F.col("pos") >= h)
    none = all_.select("conv_id", *(F.lit(None).cast(t).alias(n) for n, t in (("pos", "int"), ("id", "long"), ("words", "int"))))
    return sequences(first.unionByName(own).unionByName(none))


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, ids and words of each conversation; a row without a pos only names a conversation."""
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", "id", "words"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return listed.select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))


_DISTINCT = T.StructType([
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("n", T.LongType()), T.StructField("least", T.LongType()), T.StructField("ends", T.StringType()),
])


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """Each distinct sequence once: how many conversations have it, the smallest id, and the digest of all their ids.

    Ids are first listed in pieces of ``CHUNK`` neighbouring ids, so that no list grows
    with the number of copies; a digest is then taken over the pieces in order.
    """
    piece = F.floor(F.col("conv_id") / CHUNK).alias("piece")
    listed = convs.groupBy("ids", "words", piece).agg(F.sort_array(F.collect_list("conv_id")).alias("members"))
    pieces = listed.select("ids", "words", "piece", F.size("members").alias("k"), F.array_min("members").alias("least"), F.array_join(F.col("members").cast("array<string>"), ",").alias("text"))
    arrow = common.to_arrow(_DISTINCT)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.start_anew()
        before: list | None = None
        for batch in batches:
            out: list[list] = []
            for ids, words, k, least, text in zip(*(batch.column(c).to_pylist() for c in ("ids", "words", "k", "least", "text"))):
                if before is not None and before[0] == ids:
                    before[2] += k
                    before[4].update(b"," + text.encode())
                    continue
                if before is not None:
                    out.append([*before[:4], before[4].hexdigest()])
                before = [ids, words, k, least, hashlib.sha256(text.encode())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        if before is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip([*before[:4], before[4].hexdigest()], arrow)], schema=arrow)

    return pieces.repartition("ids").sortWithinPartitions("ids", "piece").mapInArrow(digests, _DISTINCT)


def local_trie(rows: list[tuple[list[int], list[int], int, int, str]], top: int) -> list[list]:
    """Nodes of the distinct sequences (ids, words, n, least, ends) that share their first ``top`` numbers, from that depth on.

    A node is conv_id, depth, parent's place in the list (-1 for the first), n_convs,
    n_children, n_leaves, saved_tokens and ends.  Parents come before their children.
    """
    nodes: list[list] = []

    def emit(members: list[int], depth: int, parent: int) -> None:
        n = sum(rows[m][2] for m in members)
        ends = next((rows[m][4] for m in members if len(rows[m][0]) == depth), NO_ENDS)
        saved = (n - 1) * rows[members[0]][1][depth - 1] if depth else 0
        nodes.append([min(rows[m][3] for m in members), depth, parent, n, 0, 0, saved, ends])
        if parent >= 0:
            nodes[parent][4] += 1

    emit(list(range(len(rows))), top, -1)
    todo = [([m for m in range(len(rows)) if len(rows[m][0]) > top], top, 0)]
    while todo:
        members, depth, node = todo.pop()
        if not members:
            continue
        pivot = rows[members[len(members) // 2]][0][depth]
        less, equal, more = [], [], []
        for m in members:
            at = rows[m][0][depth]
            (equal if at == pivot else less if at < pivot else more).append(m)
        todo += [(less, depth, node), (more, depth, node)]
        emit(equal, depth + 1, node)
        todo.append(([m for m in equal if len(rows[m][0]) > depth + 1], depth + 1, len(nodes) - 1))
    for node in reversed(nodes):
        node[5] = node[5] or 1
        if node[2] >= 0:
            nodes[node[2]][5] += node[5]
            nodes[node[2]][6] += node[6]
    return nodes


_PATH = "array<struct<conv:bigint,depth:int>>"
_NUMBERS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
_STEP = T.StructType([T.StructField("conv", T.LongType()), T.StructField("depth", T.IntegerType())])
_LOCAL = T.StructType([*(T.StructField(c, T.LongType()) for c in _NUMBERS), T.StructField("ends_sha256", T.StringType()), T.StructField("path", T.ArrayType(_STEP))])


def _finish(batch: pa.RecordBatch) -> dict:
    """Nodes of the buckets of a batch; the first of each has the path of large nodes above it."""
    conv, depth, digit, tops = (batch.column(c).to_pylist() for c in ("conv", "depth", "digit", "top"))
    columns = [batch.column(c).to_pylist() for c in ("ids", "words", "n", "least", "ends")]
    paths = batch.column("path")
    out: dict = {f.name: [] for f in _LOCAL}
    keys, at = list(zip(conv, depth, digit)), 0
    while at < len(keys):
        end = at + 1
        while end < len(keys) and keys[end] == keys[at]:
            end += 1
        nodes = local_trie(list(zip(*(c[at:end] for c in columns))), tops[at])
        for node in nodes:
            above = nodes[node[2]][0] if node[2] >= 0 else conv[at]
            for name, x in zip(out, (*node[:2], above, *node[3:], paths[at].as_py() if node[2] < 0 else None)):
                out[name].append(x)
        at = end
    return out


def _shared(a: Column, b: Column) -> Column:
    """How many first numbers two sequences share."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differ > 0, differ - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def trie(convs: DataFrame, local_rows: int = LOCAL_ROWS, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The nodes of the conversations' trie, from conv_id (each once, not null), ids and words.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.  A conversation without turns is a member of the
    root alone.  No conversations give no nodes.
    """
    spark = convs.sparkSession
    rows = common.saved(distinct_sequences(convs), "sequences")
    whole = rows.agg(F.count("*").alias("rows"), F.sum(F.size("ids")).alias("turns"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max(F.when(F.size("ids") == 0, F.col("ends"))).alias("ends")).first()
    none = F.array().cast(_PATH)
    if whole["rows"] <= local_rows and (whole["turns"] or 0) <= local_turns:
        start = rows.select("*", F.lit(None).cast("long").alias("conv"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("digit"), F.lit(0).alias("top"), none.alias("path"))
        return common.map_runs(start, ["conv", "depth", "digit"], _finish, _LOCAL).drop("path")
    root = F.struct(F.lit(whole["least"]).alias("conv"), F.lit(0).alias("depth"))
    active = rows.select("*", F.lit(whole["least"]).alias("conv"), F.lit(0).alias("depth"), F.array(root).cast(_PATH).alias("path"))
    branch = "conv bigint, depth int, above bigint, above_depth int, n bigint, words array<int>, ends string, path " + _PATH
    branches = spark.createDataFrame([(whole["least"], 0, None, None, whole["n"], [], whole["ends"], [])], branch)
    bucket, local = ["conv", "depth", "digit"], None
    while True:
        dealt = active.withColumn("digit", F.get("ids", F.col("depth"))).where(F.col("digit").isNotNull())
        sized = dealt.groupBy(*bucket).agg(F.count("*").alias("s"), F.sum(F.size("ids") - F.col("depth")).alias("t"), F.sum("n").alias("own"), F.min("least").alias("low"), F.min("ids").alias("first"), F.max("ids").alias("last"))
        large = sized.where((F.col("s") > 1) & ((F.col("s") > local_rows) | (F.col("t") > local_turns))).withColumn("shared", _shared(F.col("first"), F.col("last")))
        large = common.saved(large.drop("first", "last", "s", "t"), "buckets")
        marked = common.saved(dealt.join(large, bucket, "left"), "dealt")
        small = marked.where(F.col("low").isNull()).select(*bucket, (F.col("depth") + 1).alias("top"), "ids", "words", "n", "least", "ends", "path")
        local = small if local is None else local.unionByName(small)
        big = marked.where(F.col("low").isNotNull())
        here = F.struct(F.col("low").alias("conv"), F.col("shared").alias("depth"))
        # A node a bucket: the words of the turns that all its sequences share, and the digest of the one that ends there.
        between = F.slice("words", F.col("depth") + 1, F.col("shared") - F.col("depth"))
        made = big.groupBy(*bucket, "low", "shared", "own").agg(F.first(between).alias("words"), F.max(F.when(F.size("ids") == F.col("shared"), F.col("ends"))).alias("ends"), F.first("path").alias("path"))
        made = common.saved(made.select(F.col("low").alias("conv"), F.col("shared").alias("depth"), F.col("conv").alias("above"), F.col("depth").alias("above_depth"), F.col("own").alias("n"), "words", "ends", "path"), "branches")
        if made.isEmpty():
            break
        branches = branches.unionByName(made)
        active = big.select("ids", "words", "n", "least", "ends", F.col("low").alias("conv"), F.col("shared").alias("depth"), F.concat("path", F.array(here)).alias("path"))
    nodes = common.saved(common.map_runs(local, bucket, _finish, _LOCAL), "nodes")
    # What each large node has below it: the totals of buckets finished in a task, and the large nodes' own savings.
    own = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w.cast("long")) * (F.col("n") - 1)
    parts = nodes.where(F.size("path") > 0).select("path", "n_leaves", "saved_tokens").unionByName(branches.where(F.size("path") > 0).select("path", F.lit(0).cast("long").alias("n_leaves"), own.alias("saved_tokens")))
    each = parts.select("n_leaves", "saved_tokens", F.size("path").alias("steps"), F.posexplode("path").alias("i", "p"))
    totals = each.groupBy(F.col("p.conv").alias("conv"), F.col("p.depth").alias("depth")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"), F.count_if(F.col("i") == F.col("steps") - 1).alias("n_children"))
    joined = branches.join(totals, ["conv", "depth"])
    # The turns that a large node's sequences share are a chain of nodes above it.
    chain = joined.where("depth > 0").select("*", F.posexplode("words").alias("k", "w"))
    last = F.col("k") == F.size("words") - 1
    saved = F.col("below") + (F.col("n") - 1) * F.aggregate(F.slice("words", F.col("k") + 1, F.size("words")), F.lit(0).cast("long"), lambda a, w: a + w.cast("long"))
    chain = chain.select(
        F.col("conv").alias("conv_id"), (F.col("above_depth") + F.col("k") + 1).cast("long").alias("depth"), F.when(F.col("k") == 0, F.col("above")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.when(last, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
    )
    head = joined.where("depth = 0").select(
        F.col("conv").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("below").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return nodes.drop("path").unionByName(chain).unionByName(head)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(encoded(common.table(spark, sf_dir, "conversations"))))
