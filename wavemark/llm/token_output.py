"""Token-id output with fixed-width bit packing.

File format: a Parquet folder with a row per block. A block holds whole documents one after another, as
`n_ids` ids of `width` bits each in `payload`. `shard` and `block` number the blocks in ascending document order,
`first` is the block's first id within its shard, and `doc_ids`, `doc_first` (within the block) and `doc_len` are the
block's offsets. A reader takes one row and unpacks any document of it by numpy, without the blocks before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Table
from .tokens import crc, encoder, pack_bits, unpack_bits, width_of

BLOCK_SCHEMA = "shard int, block int, first long, n_ids long, width int, payload binary, doc_ids array<long>, doc_first array<long>, doc_len array<long>"
#: A block is closed once it holds so many ids.
BLOCK_IDS = 1 << 15


def _blocks(tokenizer_path: str, end_id: int | None, by_word: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, shard = encoder(tokenizer_path, by_word), TaskContext.get().partitionId()
        width = width_of(worker.vocabulary)
        if end_id is not None and end_id >> width:
            raise ValueError(f"end id {end_id} does not fit in {width} bits")
        tail = np.array([] if end_id is None else [end_id], worker.dtype)
        block, first, held, ids, lengths = 0, 0, 0, [], []
        parts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
            payload = pack_bits(np.concatenate(parts), width)
            row = [[shard], [block], [first], [held], [width], [payload], [ids], [starts.tolist()], [lengths]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _TYPES, strict=True)], names=_NAMES)

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), worker.many(batch.column(1).to_pylist()), strict=True):
                found = np.concatenate((found, tail))
                parts.append(found)
                ids.append(doc_id)
                lengths.append(len(found))
                held += len(found)
                if held >= BLOCK_IDS:
                    yield close()
                    block, first, held, ids, lengths, parts = block + 1, first + held, 0, [], [], []
        if ids:
            yield close()

    return run


_NAMES = ["shard", "block", "first", "n_ids", "width", "payload", "doc_ids", "doc_first", "doc_len"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]


def write_tokens(docs: DataFrame, tokenizer_path: str, *, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", by_word: bool = True) -> Table:
    """Encodes every whole text and writes the ids in ascending `id_col` order.

    Null and empty texts give the end id alone; rows with a null id come first; rows that share an id follow each other
    in the order of their texts' hashes, so that every run gives them the same places; repeated rows are written as often
    as they occur, dealt to several tasks where there are many. Other columns are ignored, whatever their names. An empty
    table gives an empty folder. Very long texts are looked up in pieces.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    told_apart = rows.withColumn("print", F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    ordered = told_apart.repartitionByRange("doc_id", "print", "part").sortWithinPartitions("doc_id", "print", "part").select("doc_id", "text")
    return Table(ordered.mapInArrow(_blocks(tokenizer_path, end_id, by_word), BLOCK_SCHEMA), "tokens", batch=128, codec="none")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack_bits(row["payload"], row["width"], 0, row["n_ids"]).astype("<u4")
            a, n = np.array(row["doc_first"], np.int64), np.array(row["doc_len"], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(np.full(len(a), row["shard"], np.int32)),
                    pa.array(np.full(len(a), row["block"], np.int32)),
                    pa.array(a + row["first"]),
                    pa.array(n),
                    pa.array([crc(ids[i : i + k]) for i, k in zip(a, n, strict=True)], pa.int64()),
                ],
                names=["doc_id", "shard", "block", "in_shard", "n_tokens", "ids_crc32"],
            )


def read_tokens(files: Table) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, shard, block; one task reads each block alone."""
    blocks = files.read()
    totals = sorted(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())  # a row for each written partition
    before, starts = 0, []
    for shard, n in totals:
        starts.append((shard, before))
        before += n
    bases = blocks.sparkSession.createDataFrame(starts, "shard int, base long")
    found = Table(blocks.mapInArrow(_documents, "doc_id long, shard int, block int, in_shard long, n_tokens long, ids_crc32 long"), "token-index", batch=16).read()
    return found.join(bases, "shard").select("doc_id", (F.col("base") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")


def lookup(files: Table, doc_id: int) -> list[np.ndarray]:
    """Random access: the ids of one document, from the one block that holds it."""
    rows = files.read().where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).collect()
    return [unpack_bits(r.payload, r.width, r.doc_first[k], r.doc_len[k]).astype("<u4") for r in rows for k, d in enumerate(r.doc_ids) if d == doc_id]
