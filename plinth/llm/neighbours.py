"""Nearest neighbours of a stated set of vectors by a block matrix join.

Queries and rows are dealt into blocks; a cell of the join has one block of each.
In a cell, products of int8 tiles give the distances of the quantised vectors, and
the quantisation errors bound how far the true ones can be off: a pair survives if
its lower bound is within the k-th smallest upper bound.  Survivors are computed
again from the original vectors in double precision and merged by a heap for each
query; the cells' heaps are merged by Spark, which ranks a task's rows before it
shuffles them.  So the result is exact, ties included.

Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest, so a
vector that a third of all rows share is searched once.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm import common

#: Bytes of the original vectors of a block, in double precision; rows of a block and of a tile.
BLOCK_BYTES, BLOCK_ROWS, TILE = 32 << 20, 65_536, 1024
#: Rows that a block should have at least, if the rows are too few for all cores.
LEAST_ROWS = 2048
#: Up to this dimension sums of int8 products are exact in single precision.
EXACT = (1 << 24) // 127**2


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the exact lengths of what the rounding lost."""
    top = np.abs(x).max(axis=1)
    scale = np.maximum(top / 127, np.finfo(np.float64).tiny)
    q = np.rint(x / scale[:, None]).clip(-127, 127)
    return q.astype(np.int8), scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed from the first component to the last in double precision."""
    return np.sqrt(np.add.reduce(np.ascontiguousarray(((a - b) ** 2).T), axis=0))


class Heaps:
    """For each query, the k nearest so far as a heap, the farthest on top; of equally near ones the largest id."""

    def __init__(self, own: list, k: int):
        self.own, self.k, self.heaps = own, k, [[] for _ in own]
        self.worst = np.full(len(own), np.inf)

    def add(self, i: int, distance: float, ids: list) -> None:
        heap = self.heaps[i]
        for c in ids:
            if c == self.own[i]:
                continue
            if len(heap) < self.k:
                heapq.heappush(heap, (-distance, -c))
            elif (-distance, -c) > heap[0]:
                heapq.heapreplace(heap, (-distance, -c))
            else:
                break
        if len(heap) == self.k:
            self.worst[i] = -heap[0][0]


def search(queries: np.ndarray, own: list, rows: np.ndarray, ids: list[list], k: int, tile: int = TILE) -> list[tuple[int, int, float]]:
    """The k nearest of a block's rows for each query: query's place, id and distance.

    ``ids``: for each row the ids that have this vector, ascending.
    """
    found = []
    for at in range(0, len(queries), tile):
        a = queries[at : at + tile]
        heaps = Heaps(own[at : at + tile], k)
        for start in range(0, len(rows), tile):
            _merge_tile(a, rows[start : start + tile], ids[start : start + tile], heaps)
        found += [(at + i, -c, -d) for i, heap in enumerate(heaps.heaps) for d, c in heap]
    return found


def _merge_tile(a: np.ndarray, b: np.ndarray, ids: list[list], heaps: Heaps) -> None:
    (qa, sa, ea), (qb, sb, eb) = quantised(a), quantised(b)
    kind = np.float32 if a.shape[1] <= EXACT else np.float64
    with np.errstate(over="ignore", invalid="ignore"):
        dots = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64)
        na, nb = (s * np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)) for q, s in ((qa, sa), (qb, sb)))
        about = np.sqrt(np.maximum((na**2)[:, None] + (nb**2)[None, :] - 2 * (sa[:, None] * sb[None, :]) * dots, 0))
        # The last term covers the rounding of this line itself.
        slack = ea[:, None] + eb[None, :] + 1e-7 * (na[:, None] + nb[None, :])
        low, high = np.nan_to_num(about - slack, nan=-np.inf, posinf=-np.inf), np.nan_to_num(about + slack, nan=np.inf, posinf=np.inf)
    limit = heaps.worst
    if b.shape[0] > heaps.k:
        # One of the k + 1 smallest may be the query's own.
        limit = np.minimum(limit, np.partition(high, heaps.k, axis=1)[:, heaps.k])
    i, j = np.nonzero(low <= limit[:, None])
    for part in range(0, len(i), 1 << 16):
        pi, pj = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
        exact = distances(a[pi], b[pj])
        for q, c, d in zip(pi.tolist(), pj.tolist(), exact.tolist()):
            if d <= heaps.worst[q]:
                heaps.add(q, d, ids[c])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest rows of each row for which ``query`` holds.

    ``query`` is a condition on ``vec_id``.  Nearness is the Euclidean distance in
    double precision; of equally near rows the smaller ids come first; a query with
    fewer other rows gets all of them.  A row without an id takes no part, nor does
    a vector that isn't ``usable`` (null, empty, zero, with a null or non-finite
    component).  Vectors are only near to those of their own dimension.  A repeated
    row counts once; rows of one id with different vectors are searched each, and
    never find their own id.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v"))).dropDuplicates()
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    held = rows.withColumn("n", first).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    held = common.saved(held.withColumn("d", F.size("v")), "vectors")
    asked = common.saved(rows.where(query).withColumn("d", F.size("v")), "queries")
    n, longest = held.agg(F.count("*"), F.max("d")).first()
    most = block_rows or max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * (longest or 1))))
    down = max(-(-n // most), min(common.parts_for(spark), -(-n // LEAST_ROWS)), 1)
    across = max(-(-asked.count() // most), 1)
    # A block is dealt by hash, so that a cell holds about as many rows as a block should have.
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("d", deal(across, "vec_id", "v").alias("s"), every(down).alias("r"), "vec_id", "v")
    right = held.select("d", deal(down, "v").alias("r"), every(across).alias("s"), "ids", "v")
    kind = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("mark", T.LongType()), T.StructField("vec_id", kind), T.StructField("score", T.DoubleType())])
    arrow = common.to_arrow(schema)

    def cell(queries: pa.Table, block: pa.Table) -> pa.Table:
        common.start_anew()
        own, marks = queries.column("vec_id").to_pylist(), queries.column("mark").to_pylist()
        found = search(_matrix(queries.column("v")), own, _matrix(block.column("v")), block.column("ids").to_pylist(), k) if len(own) and len(block) else []
        columns = [own[q] for q, _, _ in found], [marks[q] for q, _, _ in found], [c for _, c, _ in found], [s for _, _, s in found]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    cells = ["d", "r", "s"]
    pairs = left.withColumn("mark", F.xxhash64("v")).groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(cell, schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""
