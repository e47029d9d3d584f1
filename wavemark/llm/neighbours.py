"""Nearest vectors by collision counting: an index of shards, blocks of queries against every shard, tops merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType

from .collisions import Shard
from .common import Table

#: Vectors of a shard at most (their places take 16 bits), and bytes of them.
SHARD_ROWS, SHARD_BYTES = 32_768, 32 << 20
#: Bytes of the queries that are sent to every task at a time.
BLOCK_BYTES = 16 << 20
_INDEX = "shard string, dims int, vectors binary, ids binary, starts binary, orders binary"


def matrices(column: pa.ListArray, kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the batch's vectors of each length; none is null or holds a null."""
    sizes = column.value_lengths().to_numpy()
    values, starts = column.flatten().to_numpy().astype(kind), np.concatenate(([0], np.cumsum(sizes)))
    for dims in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dims)
        yield rows, values[(starts[rows][:, None] + np.arange(dims)).ravel()].reshape(-1, dims)


def _build(kind: np.dtype, shard_rows: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        rows_held: dict[int, int] = {}

        def close(dims: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            v, ids = (np.concatenate(x) for x in zip(*held.pop(dims), strict=True))
            rows_held.pop(dims)
            row = {"shard": f"{part}-{number}", "dims": dims, **Shard.build(v, ids, most).dumps()}
            return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.string()), ("dims", pa.int32()), *((n, pa.binary()) for n in ("vectors", "ids", "starts", "orders"))]))

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            for rows, v in matrices(batch.column(1), kind):
                dims, at = v.shape[1], 0
                most_rows = max(1, min(shard_rows, SHARD_BYTES // (dims * kind.itemsize)))
                while at < len(rows):
                    room = most_rows - rows_held.get(dims, 0)
                    held.setdefault(dims, []).append((v[at : at + room], ids[rows[at : at + room]]))
                    rows_held[dims] = rows_held.get(dims, 0) + len(rows[at : at + room])
                    at += room
                    if rows_held[dims] >= most_rows:
                        yield close(dims)
        for dims in list(held):
            yield close(dims)

    return run


def _search(block, kind: np.dtype, k: int):
    names, types = ["query_id", "number", "vec_id", "score"], [pa.int64(), pa.int64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row is a shard. The block's queries of its length run against it, from the best that the shards before left."""
        asked = block.value
        best = {dims: [(np.empty(0), np.empty(0, np.int64))] * len(ids) for dims, (ids, _, _) in asked.items()}
        for batch in batches:
            for row in batch.to_pylist():
                if row["dims"] in asked:
                    ids, _, v = asked[row["dims"]]
                    Shard.loads(row, kind, row["dims"]).search(v, ids, best[row["dims"]], k)
        for dims, (ids, numbers, _) in asked.items():
            sizes = [len(x) for x, _ in best[dims]]
            columns = np.repeat(ids, sizes), np.repeat(numbers, sizes), np.concatenate([x for _, x in best[dims]]), np.concatenate([x for x, _ in best[dims]])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _block(queries: DataFrame, part: int, kind: np.dtype) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """dims -> (ids, numbers, vectors) of the queries of a block; BLOCK_BYTES bounds it."""
    found = queries.where(F.col("part") == part).select("vec_id", "number", "embedding").toArrow().combine_chunks()
    if not found.num_rows:
        return {}
    ids, numbers = (found.column(x).to_numpy() for x in ("vec_id", "number"))
    return {v.shape[1]: (ids[rows], numbers[rows], v) for rows, v in matrices(found.column("embedding").combine_chunks(), kind)}


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors of smallest Euclidean distance found for each query, ties to the smaller id.

    Candidates are all rows but those of the query's own id. Null, empty and zero vectors, such with null or non-finite
    components and rows without an id take no part; vectors of another length than the query's aren't its candidates. A
    query with fewer than k candidates gets them all. Equal rows are one candidate and one query; rows that share an id
    and differ are candidates of their own (the id may come twice in a list), and as queries each gets a list. Ids of any
    number may share a vector: a shard keeps the k + 1 smallest of each, which is all that ties can ask for. An empty
    table finds nothing; other columns, whatever their names, are ignored.

    Recall: a vector no farther than the last one returned is missed with a chance of MISSED at most (see `collisions`).
    Every vector is in the index, which needs no fitting; the work grows with queries times vectors.
    """
    spark = vectors.sparkSession
    type_ = vectors.schema[vector_col].dataType
    narrow = isinstance(type_, ArrayType) and isinstance(type_.elementType, FloatType)  # then nothing is lost in single precision
    kind, element = np.dtype("<f4" if narrow else "<f8"), "float" if narrow else "double"

    def sound(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{element}>").alias("embedding"))
        bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0))

    rows, tasks = sound(vectors), spark.sparkContext.defaultParallelism
    count = rows.count()
    per_shard = max(1, min(shard_rows, -(-count // tasks)))  # a shard a core at least
    built = Table(rows.coalesce(max(tasks, -(-count // shard_rows))).mapInArrow(_build(kind, per_shard, k + 1), _INDEX), "vector-shards", batch=4096, codec="none")
    asked = Table(sound(queries).distinct().withColumn("number", F.monotonically_increasing_id()), "vector-queries", batch=4096)
    size = asked.read().agg(F.sum(F.size("embedding") * kind.itemsize + 16).alias("bytes")).first().bytes or 0
    blocks = max(1, -(-size // (BLOCK_BYTES // 2)))  # blocks are filled by a hash: half of what may be sent leaves room
    placed = asked.read().withColumn("part", F.pmod(F.xxhash64("number"), F.lit(blocks).cast("long")))
    tops = []
    for part in range(blocks):  # a job a block of queries; the index stays where it is, and a core walks through its shards
        block = spark.sparkContext.broadcast(_block(placed, part, kind))
        found = built.read().coalesce(tasks).mapInArrow(_search(block, kind, k), "query_id long, number long, vec_id long, score double")
        tops.append(Table(found, "vector-tops", batch=1))
        block.unpersist()
    built.drop()
    asked.drop()
    found = spark.read.schema(tops[0].schema).parquet(*(t.path for t in tops))
    rank = F.row_number().over(Window.partitionBy("query_id", "number").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
