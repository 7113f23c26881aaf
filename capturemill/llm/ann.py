"""Exact nearest neighbours by a block matrix join over int8 tiles.

Vectors are packed into blocks of int8 components with one scale each.  A tile multiplies a
block of queries with a block of candidates; the norms of what rounding took away bound the
error of every product.  Pairs whose upper bound reaches the query's current k-th score are
recomputed on the original vectors in double precision and kept in a heap per query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturemill.llm.common import releasing, saved

BLOCK_ROWS = 1024
# Blocks of queries a tile holds in memory, and blocks of candidates it streams.
TILE_QUERIES, TILE_CANDIDATES = 8, 16
# Beyond this many tiles a task works through several, one after the other.
MOST_TASKS = 20_000

BLOCKS = "block bigint, role int, dim int, ids binary, vectors binary"


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 components (as float32 for the matrix product), scales, norms of the rounded vectors, norms of the errors."""
    scale = np.abs(vectors).max(axis=1) / 127.0
    with np.errstate(all="ignore"):
        whole = np.rint(vectors / scale[:, None])
    whole[~np.isfinite(whole)] = 0
    whole = np.clip(whole, -127, 127).astype(np.int8)
    back = whole * scale[:, None]
    return whole.astype(np.float32), scale, np.linalg.norm(back, axis=1), np.linalg.norm(vectors - back, axis=1)


def packed_blocks(vectors: DataFrame, id_column: str, vector_column: str, is_query, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of ids and doubles: role 0 holds the queries again, role 1 every vector.

    Vectors that are null, empty, zero or hold a null or non-finite component are left out, and
    so are rows without an id.  A block holds vectors of one dimension.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        made = task << 32
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(key: tuple[int, int], least: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids = np.concatenate([p[0] for p in held[key]])
            rows = np.concatenate([p[1] for p in held[key]])
            while len(ids) >= max(least, 1):
                made += 1
                yield pa.RecordBatch.from_pylist([{
                    "block": made, "role": key[0], "dim": key[1],
                    "ids": ids[:block_rows].astype("<i8").tobytes(), "vectors": rows[:block_rows].astype("<f8").tobytes(),
                }], schema=pa.schema([("block", pa.int64()), ("role", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]))
                ids, rows = ids[block_rows:], rows[block_rows:]
            held[key] = [(ids, rows)]

        for batch in batches:
            lists = batch["vector"]
            offsets = lists.offsets.to_numpy()
            values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            # a null component reads as NaN
            sizes = np.diff(offsets)
            known = ~np.asarray(lists.is_null()) & (sizes > 0) & ~np.asarray(batch["id"].is_null())
            ids = batch["id"].fill_null(0).to_numpy(zero_copy_only=False)
            asks = np.asarray(batch["asks"].fill_null(False))
            for dim in np.unique(sizes[known]).tolist():
                rows = np.flatnonzero(known & (sizes == dim))
                part = values[offsets[rows][:, None] + np.arange(dim)]
                good = np.isfinite(part).all(axis=1) & (part != 0).any(axis=1)
                rows, part = rows[good], part[good]
                for role, chosen in ((0, asks[rows]), (1, np.ones(len(rows), bool))):
                    if chosen.any():
                        held.setdefault((role, dim), []).append((ids[rows[chosen]], part[chosen]))
            for key in list(held):
                yield from block(key, block_rows)
        for key in list(held):
            yield from block(key, 1)

    return vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"), is_query.alias("asks"),
    ).mapInArrow(releasing(pack), BLOCKS)


class QueryBlock:
    """Queries of a block with their heaps."""

    def __init__(self, block: int, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.block, self.ids, self.vectors, self.k = block, ids, vectors, k
        self.whole, self.scale, self.norm, self.error = quantised(vectors)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)

    def meet(self, ids: np.ndarray, vectors: np.ndarray, q: tuple) -> None:
        whole, scale, norm, error = q
        # products of int8 below 2**24 in magnitude are exact in float32 up to a dimension of 1,040
        kind = np.float32 if whole.shape[1] <= 1040 else np.float64
        near = (self.whole.astype(kind) @ whole.T.astype(kind)).astype(np.float64) * self.scale[:, None] * scale
        full = norm + error
        slack = self.error[:, None] * full + self.norm[:, None] * error + 1e-12 * (self.norm + self.error)[:, None] * full
        near[self.ids[:, None] == ids] = -np.inf
        floor = self.least
        if near.shape[1] >= self.k:
            # the k-th largest lower bound of this block is a floor too
            low = np.partition(near - slack, near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k]
            floor = np.maximum(floor, low)
        at, other = np.nonzero((near + slack >= floor[:, None]) & np.isfinite(near))
        exact = (self.vectors[at] * vectors[other]).sum(axis=1)
        touched = set()
        for i, score, name in zip(at.tolist(), exact.tolist(), ids[other].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -name))
                touched.add(i)
            elif (score, -name) > heap[0]:
                heapq.heapreplace(heap, (score, -name))
                touched.add(i)
        for i in touched:
            if len(self.heaps[i]) == self.k:
                self.least[i] = self.heaps[i][0][0]

    def rows(self) -> dict:
        sizes = [len(h) for h in self.heaps]
        found = [x for h in self.heaps for x in h]
        return {
            "block": np.full(sum(sizes), self.block), "row": np.repeat(np.arange(len(self.ids)), sizes), "query_id": np.repeat(self.ids, sizes),
            "vec_id": np.array([-n for _, n in found], np.int64), "score": np.array([s for s, _ in found], np.float64),
        }


def search(
    vectors: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k candidates of largest inner product of every query: (query_id, rank, vec_id, score).

    ``is_query`` is a column that marks the queries; a query meets every vector of its dimension but those
    that bear its own id.  Ties go to the smaller id.  Query blocks go to every group of candidate blocks and
    the other way round, so a tile is one task and no task holds more than a few blocks.  Repeated
    rows are candidates, and queries, of their own; other columns are not looked at.
    """
    blocks = saved(packed_blocks(vectors, id_column, vector_column, is_query, block_rows), "vector-blocks")
    counts = {r["role"]: r["n"] for r in blocks.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
    across = max(1, -(-counts.get(0, 0) // TILE_QUERIES))
    down = max(1, -(-counts.get(1, 0) // TILE_CANDIDATES))
    deal = F.xxhash64("block")
    row = F.when(F.col("role") == 0, F.array(F.pmod(deal, F.lit(across)))).otherwise(F.sequence(F.lit(0), F.lit(across - 1)).cast("array<bigint>"))
    tiles = blocks.withColumn("across", F.explode(row))
    column = F.when(F.col("role") == 1, F.array(F.pmod(deal, F.lit(down)))).otherwise(F.sequence(F.lit(0), F.lit(down - 1)).cast("array<bigint>"))
    tiles = tiles.withColumn("down", F.explode(column)).repartition(min(across * down, MOST_TASKS), "across", "down").sortWithinPartitions(
        "across", "down", "role", "block")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked = None, []

        def ended() -> Iterator[pa.RecordBatch]:
            for q in asked:
                out = q.rows()
                if len(out["vec_id"]):
                    yield pa.RecordBatch.from_pydict(out)

        for batch in batches:
            for r in range(batch.num_rows):
                one = {name: batch[name][r].as_py() for name in ("across", "down", "role", "block", "dim", "ids", "vectors")}
                if (one["across"], one["down"]) != at:
                    yield from ended()
                    at, asked = (one["across"], one["down"]), []
                ids = np.frombuffer(one["ids"], "<i8")
                rows = np.frombuffer(one["vectors"], "<f8").reshape(-1, one["dim"])
                if one["role"] == 0:
                    asked.append(QueryBlock(one["block"], ids, rows, k))
                elif asked:
                    q = quantised(rows)
                    for query in asked:
                        if query.vectors.shape[1] == one["dim"]:
                            query.meet(ids, rows, q)
        yield from ended()

    found = tiles.mapInArrow(releasing(multiply), "block bigint, row bigint, query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("block", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
