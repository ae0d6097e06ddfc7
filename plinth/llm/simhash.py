"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit over the hashes of a text's
shingles.  For radius r, every bit position gets a non-zero vector of r + 1 bits;
the mask of table v keeps the positions whose vector has an odd product with v.
The vectors of r differing positions span at most r dimensions, so some non-zero
v is orthogonal to all of them, and in its table both fingerprints have the same
masked value: every pair within the radius meets in one of the 2^(r+1) - 1
tables.

Rows with the same fingerprint are one node from the start.  Within a table's
bucket, nodes are searched outwards from one another and linked as a forest, so
that a bucket gives fewer links than it has nodes while its connected nodes stay
connected.  Buckets of over ``HEAVY`` nodes are dealt out as pairs of chunks,
which bounds a task's memory and loses no link.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm import common, graph

SHINGLE, RADIUS, SEED, BITS = 3, 2, 42, 64
HEAVY = 50_000
#: Near copies share this part of their shingles of so many words.
WORDS, SIMILAR = 5, 0.8
#: Members of all sets of a component that one task compares (which takes time as their square, at worst); the tasks that a large component is dealt over.
HEAVY_MARKS, SALTS = 1_000_000, 32
CHUNK = 1 << 16
#: MinHash bands and the minima of a band.  A pair whose sets have a similarity of 0.8
#: shares no band with a probability of (1 - 0.8^5)^40 = 1.3e-7, a more similar pair with less.
BANDS, ROWS = 40, 5


def shingles(words: list[bytes], size: int) -> Iterator[bytes]:
    """Runs of ``size`` words joined by a space; of fewer words, all of them."""
    if len(words) <= size:
        if words:
            yield b" ".join(words)
        return
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    for a, b in zip(starts, (ends[size - 1 :] - 1).tolist()):
        yield text[a:b]


def fingerprint(words: list[bytes], size: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned; 0 without words."""
    digest, counts, n, held = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64), 0, []

    def add() -> int:
        bits = np.unpackbits(np.array(held, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[:] += bits.sum(axis=0, dtype=np.int64)
        return len(held)

    for s in shingles(words, size):
        held.append(digest(s, seed))
        if len(held) == CHUNK:
            n += add()
            held = []
    if held:
        n += add()
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int | None = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for each row of ``docs``; null texts have no words.

    Without a ``size``, the features are the distinct words.
    """
    schema = T.StructType([common.id_field(docs, id_col), T.StructField("fp", T.LongType())])

    def run(batch: pa.RecordBatch) -> dict:
        words = (t.lower().split() for t in common.utf8(batch.column("text")))
        made = np.array([fingerprint(w, size) if size else fingerprint(sorted(set(w)), 1) for w in words], dtype=np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(made.view(np.int64))}

    return common.map_arrow(common.id_text(docs, id_col, text_col), run, schema)


_FACTORS = np.random.default_rng(11).integers(0, 1 << 64, (3, BANDS * ROWS), dtype=np.uint64)


def bands(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """A hash of each band of the minima over the text's ``size``-word shingles; none without words."""
    held = {xxhash.xxh64_intdigest(s, SEED) for s in shingles(words, size)}
    if not held:
        return np.empty(0, dtype=np.int64)
    marks = np.fromiter(held, dtype=np.uint64, count=len(held))
    factor, added, mixed = _FACTORS[0] | np.uint64(1), _FACTORS[1], _FACTORS[2] | np.uint64(1)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for i in range(0, len(marks), 1 << 10):
        part = marks[i : i + (1 << 10), None] * factor
        part += added
        np.minimum(least, part.min(axis=0), out=least)
    least ^= least >> np.uint64(32)
    return (least * mixed).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def banded(docs: DataFrame, id_col: str, text_col: str, size: int | None, words: int) -> DataFrame:
    """``fingerprints``, with the hashes of the text's bands."""
    schema = T.StructType([common.id_field(docs, id_col), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batch: pa.RecordBatch) -> dict:
        made, held = [], []
        for text in common.utf8(batch.column("text")):
            w = text.lower().split()
            made.append(fingerprint(w, size) if size else fingerprint(sorted(set(w)), 1))
            held.append(bands(w, words))
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(np.array(made, dtype=np.uint64).view(np.int64)), "bands": pa.array(held, type=pa.list_(pa.int64()))}

    return common.map_arrow(common.id_text(docs, id_col, text_col), run, schema)


def band_links(rows: DataFrame) -> DataFrame:
    """Edges a, b from the least fingerprint of each band's hash to the others (``rows``: fp, bands).

    A hash's rows are read in order and not held, however many they are.
    """
    parts = common.parts_for(rows.sparkSession)
    keyed = rows.select(F.posexplode("bands").alias("t", "h"), "fp").select(F.xxhash64("t", "h").alias("bucket"), "fp")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    arrow = common.to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, 0
        for batch in batches:
            k, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "fp"))
            if not len(k):
                continue
            new = np.concatenate(([last is None or k[0] != last], k[1:] != k[:-1]))
            starts = np.concatenate(([first], f[new]))[np.cumsum(new)]
            last, first = k[-1], starts[-1]
            other = starts != f
            if other.any():
                yield pa.RecordBatch.from_arrays([pa.array(starts[other]), pa.array(f[other])], schema=arrow)

    return keyed.repartition(parts, "bucket").sortWithinPartitions("bucket", "fp").mapInArrow(run, schema).distinct()


def masks(radius: int, bits: int = BITS) -> list[int]:
    """One mask for each non-zero vector of ``radius`` + 1 bits, as signed longs."""
    vectors = list(range(1, 1 << (radius + 1)))
    random.Random(7).shuffle(vectors)
    own = [vectors[i % len(vectors)] for i in range(bits)]
    found = [sum(1 << i for i in range(bits) if bin(own[i] & v).count("1") % 2) for v in range(1, 1 << (radius + 1))]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in found]


def forest(nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what links within ``radius`` connect, fewer than there are nodes."""
    edges: list[tuple[int, int]] = []
    rest = nodes
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = np.bitwise_count((rest ^ at).view(np.uint64)) <= radius  # of a signed number it counts the absolute value's bits
            if near.any():
                found = rest[near]
                edges += [(int(at), int(x)) for x in found]
                reached += list(found)
                rest = rest[~near]
    return edges


_LINKS = T.StructType([T.StructField("heavy", T.BooleanType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _link(dealt: DataFrame, radius: int, heavy: int | None) -> DataFrame:
    """Links within the buckets of ``dealt`` (bucket, fp; sorted by bucket in each partition).

    Buckets of over ``heavy`` rows come out as rows of bucket and fp instead.
    """
    arrow = common.to_arrow(_LINKS)

    def batch_of(kind: bool, a: list | np.ndarray, b: list | np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind)), pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], schema=arrow)

    def whole(bucket: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(bucket)]))
        several = ends - starts > 1
        edges: list[tuple[int, int]] = []
        for a, b in zip(starts[several].tolist(), ends[several].tolist()):
            edges += forest(np.unique(fp[a:b]), radius)
        if edges:
            yield batch_of(False, [e[0] for e in edges], [e[1] for e in edges])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, fp, over = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            k, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "fp"))
            if over is not None:
                n = int(np.searchsorted(k, over, side="right"))
                if n:
                    yield batch_of(True, k[:n], f[:n])
                    k, f = k[n:], f[n:]
                if not len(k):
                    continue
                over = None
            bucket, fp = np.concatenate((bucket, k)), np.concatenate((fp, f))
            if not len(bucket):
                continue
            cut = int(np.searchsorted(bucket, bucket[-1]))
            if cut:
                yield from whole(bucket[:cut], fp[:cut])
                bucket, fp = bucket[cut:], fp[cut:]
            if heavy is not None and len(bucket) > heavy:
                over = int(bucket[0])
                yield batch_of(True, bucket, fp)
                bucket, fp = bucket[:0], fp[:0]
        if len(bucket):
            yield from whole(bucket, fp)

    return dealt.mapInArrow(run, _LINKS)


def links(nodes: DataFrame, radius: int = RADIUS, heavy: int = HEAVY) -> DataFrame:
    """Edges a, b of a forest that connects the fingerprints (column fp, distinct) that lie within ``radius`` bits."""
    spark = nodes.sparkSession
    common.shared_dir(spark)
    parts = common.parts_for(spark)
    tables = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.lit(m).alias("mask")) for i, m in enumerate(masks(radius)))))
    keyed = nodes.select("fp", tables.alias("x")).select(F.xxhash64("x.t", F.col("fp").bitwiseAND(F.col("x.mask"))).alias("bucket"), "fp")
    out = _link(keyed.repartition(parts, "bucket").sortWithinPartitions("bucket"), radius, heavy).checkpoint()
    found = out.where(~F.col("heavy")).select("a", "b")
    rest = out.where("heavy").select(F.col("a").alias("bucket"), F.col("b").alias("fp"))
    if rest.isEmpty():
        return found.distinct()
    chunks = rest.groupBy("bucket").agg(F.ceil(2 * F.count("*") / heavy).cast("long").alias("n"))
    dealt = rest.join(chunks, "bucket").withColumn("own", F.pmod(F.xxhash64("fp"), "n"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    dealt = dealt.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fp")
    more = _link(dealt.repartition(parts, "bucket").sortWithinPartitions("bucket"), radius, None).select("a", "b")
    return found.unionByName(more).distinct()


def components(prints: DataFrame, radius: int = RADIUS, heavy: int = HEAVY, more: DataFrame | None = None) -> DataFrame:
    """``prints``: doc_id, fp.  Returns each row with component_id, the smallest doc_id that links reach.

    ``more`` has edges a, b between fingerprints besides those within the radius.

    Null ids never are a component's id unless it has no other.
    """
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = links(nodes.select("fp"), radius, heavy)
    linked = graph.components(edges if more is None else edges.unionByName(more)).withColumnRenamed("node", "fp")
    roots = nodes.join(linked, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    moved = linked.join(roots, "root").select("fp", "component_id")
    of = nodes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # Written out, both sides of the join are shuffled for it alone, and Spark splits the rows of a hot fingerprint.
    return prints.join(common.saved(of, "components"), "fp")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS, heavy: int = HEAVY) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id.

    Texts without words (null, empty, white space) have fingerprint zero and are
    linked like any other.  Repeated rows and exact copies share a fingerprint.
    An empty table gives no rows.  Other columns are not read.
    """
    prints = fingerprints(docs, id_col, text_col, size)
    common.shared_dir(docs.sparkSession)
    found = components(prints.checkpoint(), radius, heavy)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame, size: int, bucket: str = "bucket", node: str = "node", text_col: str = "text") -> DataFrame:
    """bucket, node and the sorted distinct 64-bit hashes of a text's ``size``-word shingles, for each row; null texts have none."""
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("node", docs.schema[node].dataType), T.StructField("marks", T.ArrayType(T.LongType()))])

    def run(batch: pa.RecordBatch) -> dict:
        made = []
        for text in common.utf8(batch.column("text")):
            held = {xxhash.xxh64_intdigest(s, SEED) for s in shingles(text.lower().split(), size)}
            made.append(np.sort(np.fromiter(held, dtype=np.uint64, count=len(held)).view(np.int64)))
        return {"bucket": batch.column("bucket"), "node": batch.column("node"), "marks": pa.array(made, type=pa.list_(pa.int64()))}

    df = docs.select(docs[bucket].alias("bucket"), docs[node].alias("node"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return common.map_arrow(df, run, schema)


def similar_forest(nodes: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges that connect what pairs of a Jaccard similarity of ``least`` or more connect, fewer than there are sets.

    A set is compared with all sets that nothing has reached yet, by the sets that have
    its marks or, where those sets are fewer, by looking all their marks up.  Two
    empty sets are alike.
    """
    edges: list[tuple[int, int]] = []
    n = len(nodes)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    ends = np.append(0, np.cumsum(sizes))
    flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
    # Postings: for each mark of each set, where the sets that have it begin and end in ``owner``.
    order = np.argsort(flat, kind="stable")
    owner, ranked = np.repeat(np.arange(n), sizes)[order], flat[order]
    low, high = np.searchsorted(ranked, flat, side="left"), np.searchsorted(ranked, flat, side="right")
    waiting, left, first = np.ones(n, dtype=bool), n, 0
    reached: list[int] = []
    while left:
        if reached:
            at = reached.pop()
        else:
            while not waiting[first]:
                first += 1
            at, left = first, left - 1
            waiting[at] = False
        a, b = low[ends[at] : ends[at + 1]], high[ends[at] : ends[at + 1]]
        rest, total = np.flatnonzero(waiting), int((b - a).sum())
        if total <= sizes[rest].sum():
            places = np.arange(total) + np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a)
            both = np.bincount(owner[places], minlength=n)
        else:
            other = np.concatenate([sets[i] for i in rest]) if len(rest) else flat[:0]
            same = sets[at][np.minimum(np.searchsorted(sets[at], other), sizes[at] - 1)] == other
            both = np.bincount(np.repeat(rest, sizes[rest])[same], minlength=n)
        both = both[rest]
        found = rest[both >= least * (sizes[at] + sizes[rest] - both) - 1e-9]
        if len(found):
            edges += [(nodes[at], nodes[x]) for x in found.tolist()]
            reached += found.tolist()
            waiting[found] = False
            left -= len(found)
    return edges


def _verify(dealt: DataFrame, least: float, heavy: int | None) -> DataFrame:
    """Links within the buckets of ``dealt`` (bucket, node, marks; sorted by bucket in each partition).

    A bucket whose sets have over ``heavy`` members in all is named, with their number, in a row without a link instead.
    """
    kind = dealt.schema["node"].dataType
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType()), T.StructField("a", kind), T.StructField("b", kind)])
    arrow = common.to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple] = []
        current, nodes, sets, total = None, [], [], 0

        def end() -> None:
            if heavy is not None and total > heavy:
                edges.append((current, total, None, None))
            elif len(nodes) > 1:
                edges.extend((None, None, a, b) for a, b in similar_forest(nodes, sets, least))

        for batch in common.pieces(batches):
            marks = batch.column("marks")
            ends = np.cumsum(marks.value_lengths().to_numpy(zero_copy_only=False))
            flat = marks.flatten().to_numpy(zero_copy_only=False)
            begin = 0
            for bucket, node, stop in zip(batch.column("bucket").to_pylist(), batch.column("node").to_pylist(), ends.tolist()):
                if bucket != current:
                    if current is not None:
                        end()
                    current, nodes, sets, total = bucket, [], [], 0
                total += stop - begin + 1
                if heavy is not None and total > heavy:
                    nodes, sets = [], []
                else:
                    nodes.append(node)
                    sets.append(flat[begin:stop].copy())
                begin = stop
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*edges), arrow)], schema=arrow)
                edges.clear()
        if current is not None:
            end()
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*edges), arrow)], schema=arrow)

    return dealt.mapInArrow(run, schema)


def similar_links(sets: DataFrame, least: float = SIMILAR, heavy: int = HEAVY_MARKS) -> DataFrame:
    """Edges a, b between nodes of a bucket (bucket, node, marks) that connect all pairs whose sets are ``least`` alike.

    Buckets over ``heavy`` are dealt out as pairs of chunks: a task holds two chunks and no link is lost.
    """
    spark = sets.sparkSession
    parts = common.parts_for(spark)
    sets = sets.checkpoint()
    out = _verify(sets.repartition(parts, "bucket").sortWithinPartitions("bucket"), least, heavy).checkpoint()
    found = out.where("bucket IS NULL").select("a", "b")
    over = out.where("bucket IS NOT NULL").select("bucket", F.ceil(2 * F.col("n") / heavy).cast("long").alias("n"))
    if over.isEmpty():
        return found.distinct()
    dealt = sets.join(over, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), "n"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    dealt = dealt.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "node", "marks")
    more = _verify(dealt.repartition(parts, "bucket").sortWithinPartitions("bucket"), least, None).select("a", "b")
    return found.unionByName(more).distinct()


def keep_one(docs: DataFrame, size: int | None, radius: int, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = SIMILAR) -> DataFrame:
    """One row of each group of near copies, with all its columns: one of the smallest id.

    Candidates are the components that fingerprints within the radius and equal
    MinHash bands of the ``words``-word shingles connect.  Within a component, texts are
    linked where their sets of ``words``-word shingles have a Jaccard similarity of
    ``least`` or more, and a group is what such links connect.  A group whose rows
    all lack an id keeps one of them.  A text is known by 128 bits of hash.  Null texts
    are one group and empty ones another, like any other equal texts; columns may have
    any names.
    """
    common.shared_dir(docs.sparkSession)
    id_, key_, bucket_, n_ = (common.fresh(docs, n) for n in ("_id", "_key", "_bucket", "_n"))
    key = F.coalesce(F.unhex(F.md5(docs[text_col].cast("binary"))), F.lit(b""))
    row = F.struct(docs[id_col].isNull().alias("no_id"), docs[id_col].alias("id"), key.alias("key"))
    made = banded(docs.select(row.alias("row"), docs[text_col].alias("text")), "row", "text", size, words).checkpoint()
    prints = made.select("doc_id", "fp")
    # Equal texts are one node, before anything is joined by fingerprint.
    one = made.groupBy(F.col("doc_id.key").alias("node"), "fp").agg(F.min("doc_id").alias("doc_id"), F.min("bands").alias("bands")).checkpoint()
    found = components(one.select("doc_id", "fp"), radius, more=band_links(one.select("fp", "bands")))
    texts = found.select(F.xxhash64("component_id").alias("bucket"), F.col("doc_id.key").alias("node"), F.col("doc_id").alias("row")).checkpoint()
    # A large component's texts are dealt over ``SALTS`` tasks.
    several = texts.groupBy("bucket").count().where("count > 1").select("bucket", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    chosen = texts.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(several, ["bucket", "salt"])
    chosen = chosen.select(F.col("row.id").alias(id_), F.col("node").alias(key_), F.col("bucket").alias(bucket_))
    on = docs[id_col].eqNullSafe(F.col(id_)) & key.eqNullSafe(F.col(key_))
    read = docs.join(chosen, on).select(F.col(bucket_).alias("bucket"), F.col(key_).alias("node"), docs[text_col].alias("text"))
    linked = graph.components(similar_links(shingle_sets(read, words), least))
    group = texts.join(linked, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("row").alias("row"))
    # Rows that agree in id and text are one row here.
    kept = prints.join(group.select(F.col("row").alias("doc_id")), "doc_id", "left_semi")
    repeated = kept.select(F.col("doc_id.id").alias(id_), F.col("doc_id.key").alias(key_)).groupBy(id_, key_).agg(F.count("*").alias(n_)).checkpoint()
    once = docs.join(repeated.where(F.col(n_) == 1), on, "left_semi")
    more = repeated.where(F.col(n_) > 1)
    if more.isEmpty():
        return once
    return once.unionByName(docs.join(more, on, "left_semi").dropDuplicates([id_col, text_col]))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"))
