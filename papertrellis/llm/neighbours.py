"""Nearest neighbours by a block matrix join on int8 tiles, with exact results.

Vectors are scaled to length one and rounded to int8; what the rounding loses is a vector of known length, so a tile product gives
every cosine up to a known error. A pair whose upper bound is below the k best lower bounds of its query can't be among the k nearest;
the few others are computed anew in double precision from the original vectors and merged into the heap of the query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from papertrellis.llm.tables import written

#: Rows in a block of queries and of candidates; a tile has the product of them.
QUERY_ROWS = 512
BLOCK_ROWS = 2048
#: Bytes of query blocks, about, that are broadcast at a time.
PART_BYTES = 16 << 20
#: Slack for rounding in the bounds themselves.
EPSILON = 1e-6


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v array<float or double>, dim) of the vectors that take part: not null, not zero, all components finite.

    Rows of equal id and vector are one; an id with several vectors has a row for each. Rows without an id take no part.
    """
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    chosen = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null and size(v) > 0")
    chosen = chosen.where(finite & F.exists(v, lambda x: x != 0))
    return chosen.distinct().withColumn("dim", F.size("v"))


def quantised(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scales, lengths of the rounded vectors, lengths of what rounding lost) for rows of doubles."""
    top = np.abs(rows).max(1, keepdims=True)
    unit = rows / top
    unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / 127
    whole = np.rint(unit / scale[:, None])
    back = whole * scale[:, None]
    return whole.astype(np.int8), scale, np.sqrt((back * back).sum(1)), np.sqrt(((unit - back) ** 2).sum(1))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row pair in double precision; a row pair gives the same value wherever it stands.

    Rows are scaled by powers of two, which changes no digit, so that squares neither overflow nor vanish.
    """
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) for x in (a, b))
    dot = (a * b).sum(1)
    return dot / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def tile(queries: tuple, block: tuple, own: tuple[np.ndarray, np.ndarray], k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query row, block row) of the pairs that may be among the k nearest of a query, given its k-th best score so far.

    ``own`` has the pairs, in the same form, of a query and its own row.
    """
    (qa, sa, na, ea), (qb, sb, nb, eb) = queries, block
    # products of int8 summed in float32 are whole numbers below 2^24 up to 1,040 components; longer vectors take double
    kind = np.float32 if qa.shape[1] <= 1040 else np.float64
    near = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) * (sa[:, None] * sb[None, :])
    error = na[:, None] * eb[None, :] + ea[:, None] * (nb + eb)[None, :] + EPSILON
    near[own] = -np.inf
    if near.shape[1] > k:
        low = near - error
        floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
    return np.nonzero((near + error >= floor[:, None]) & np.isfinite(near))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS,
            part_bytes: int = PART_BYTES) -> DataFrame:
    """(query_id, rank, id, score): the k nearest of every query among ``vectors`` but its own row, all if there are fewer.

    Both tables are as usable() makes them; its own row has the query's id and vector, and a query id with several vectors has ranks for
    each. Ties go to the smaller id; vectors of other dimensions than the query's are no candidates.
    Blocks of queries are broadcast in parts of about ``part_bytes``, one part after the other, and meet the blocks of candidates where
    these lie, so neither side is ever whole in one place; a task keeps k rows per query of a part.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["id"].dataType.simpleString()

    def pack(df: DataFrame, rows: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            number = 0

            def row(dim: int) -> pa.RecordBatch:
                nonlocal number
                number += 1
                ids, values = zip(*held.pop(dim))
                v = np.array(values, np.float64)
                whole, scale, length, lost = quantised(v)
                blobs = [whole.tobytes(), np.stack([scale, length, lost]).tobytes(), v.tobytes()]
                return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([number], pa.int32()), pa.array([list(ids)]).cast(pa.list_(id_kind)), *[pa.array([b], pa.binary()) for b in blobs]], names=["dim", "number", "ids", "q", "bounds", "v"])

            for batch in batches:
                id_kind = batch.schema.field("id").type
                for i, v, dim in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), batch.column("dim").to_pylist()):
                    held.setdefault(dim, []).append((i, v))
                    if len(held[dim]) == rows:
                        yield row(dim)
            for dim in list(held):
                yield row(dim)

        return df.select("id", "v", "dim").mapInArrow(run, f"dim int, number int, ids array<{kind}>, q binary, bounds binary, v binary")

    asked = written(pack(queries, query_rows), "query-blocks").withColumn("qblock", F.monotonically_increasing_id())
    asked = written(asked, "query-blocks")
    blocks = written(pack(vectors, block_rows), "vector-blocks")
    # candidate blocks are dealt once to so many tasks; query blocks go to all of them, a bounded part at a time
    many = max(1, min(blocks.count(), 4 * spark.sparkContext.defaultParallelism))
    size = F.octet_length("q") + F.octet_length("bounds") + F.octet_length("v")
    parts = max(1, -(-(asked.agg(F.sum(size.cast("long"))).first()[0] or 0) // part_bytes))
    right = blocks.select("dim", F.col("ids").alias("ids_b"), F.col("q").alias("q_b"), F.col("bounds").alias("bounds_b"), F.col("v").alias("v_b"))
    right = right.repartition(many, F.xxhash64("ids_b"))

    def met(part: int) -> DataFrame:
        left = asked.where(F.pmod(F.xxhash64("qblock"), F.lit(parts)) == part) if parts > 1 else asked
        return right.join(F.broadcast(left), "dim").select("dim", "qblock", "ids", "q", "bounds", "v", "ids_b", "q_b", "bounds_b", "v_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict = {}  # (query block, row in it): its id and k best as (score, -order of id, ...), the worst first

        def side(batch, n, ids, q, bounds, v, dim):
            b = np.frombuffer(batch.column(bounds)[n].as_py()).reshape(3, -1)
            return batch.column(ids)[n].as_py(), (np.frombuffer(batch.column(q)[n].as_py(), np.int8).reshape(-1, dim), *b), np.frombuffer(batch.column(v)[n].as_py()).reshape(-1, dim)

        class Later:
            """Orders ids so that of equal scores the larger id is the worse one."""

            __slots__ = ("id",)

            def __init__(self, i):
                self.id = i

            def __lt__(self, other):
                return self.id > other.id

        for batch in batches:
            for n in range(batch.num_rows):
                dim = batch.column("dim")[n].as_py()
                ids_a, qa, va = side(batch, n, "ids", "q", "bounds", "v", dim)
                ids_b, qb, vb = side(batch, n, "ids_b", "q_b", "bounds_b", "v_b", dim)
                at = batch.column("qblock")[n].as_py()
                floor = np.array([h[0][0] if len(h := heaps.get((at, a), (None, ()))[1]) == k else -np.inf for a in range(len(ids_a))])
                x, y = np.nonzero(np.array(ids_a)[:, None] == np.array(ids_b)[None, :])
                equal = (va[x] == vb[y]).all(1)
                x, y = tile(qa, qb, (x[equal], y[equal]), k, floor)
                for lo in range(0, len(x), 65536):
                    some_x, some_y = x[lo:lo + 65536], y[lo:lo + 65536]
                    for a, b, s in zip(some_x.tolist(), some_y.tolist(), cosines(va[some_x], vb[some_y]).tolist()):
                        heap, entry = heaps.setdefault((at, a), (ids_a[a], []))[1], (s, Later(ids_b[b]))
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif heap[0] < entry:
                            heapq.heapreplace(heap, entry)
        for (at, a), (q, heap) in heaps.items():
            many = len(heap)
            yield pa.RecordBatch.from_arrays([
                pa.array([at] * many, pa.int64()), pa.array([a] * many, pa.int32()), pa.array([q] * many), pa.array([e.id for _, e in heap]), pa.array([s for s, _ in heap]),
            ], names=["qblock", "qrow", "query_id", "id", "score"])

    best = Window.partitionBy("qblock", "qrow").orderBy(F.desc("score"), "id")

    def ranked(part: int) -> DataFrame:
        found = met(part).mapInArrow(run, f"qblock long, qrow int, query_id {kind}, id {kind}, score double")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    if parts == 1:
        return ranked(0)
    return reduce(DataFrame.unionByName, [written(ranked(part), "nearest") for part in range(parts)])
