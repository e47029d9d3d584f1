"""Samples moved by blocks: rows become arrays where they are read, and only arrays are shuffled.

A piece holds what a task read of one (channel, block), its halo included, as arrays in binary columns. The pieces of a
block meet in one group, are put in order and handed to a function of arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.shared import fresh_path

#: Rows that a task holds before it passes its pieces on.
HELD = 1 << 19
PIECE_SCHEMA = "channel int, block long, at binary, time_us binary, value binary"
_NAMES = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

#: Of one block: channel, block, indices, times and values in order, the halo included.
Run = Callable[[int, int, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]


def _cut(block: int, halo: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, ...]]] = {}
        rows = 0

        def flush() -> pa.RecordBatch:
            parts = [(c, b, *(np.concatenate(x).tobytes() for x in zip(*found, strict=True))) for (c, b), found in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts, strict=True), _TYPES, strict=True)], names=_NAMES)

        for batch in batches:
            if not batch.num_rows:
                continue
            channel, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            time, value = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (2, 3))  # nulls are NaN
            first, last = np.maximum((at - halo) // block, 0), (at + halo) // block
            for c in np.unique(channel).tolist():
                mine = channel == c
                for b in range(int(first[mine].min()), int(last[mine].max()) + 1):
                    here = np.flatnonzero(mine & (first <= b) & (b <= last))
                    if len(here):
                        held.setdefault((c, b), []).append((at[here], time[here], value[here]))
                        rows += len(here)
            if rows >= HELD:
                yield flush()
                rows = 0
        if held:
            yield flush()

    return run


def _typed(df: DataFrame) -> DataFrame:
    return df.select(F.col("channel").cast("int").alias("channel"), F.col("sample_index").cast("long").alias("sample_index"), F.col("time_us").cast("double").alias("time_us"), F.col("value").cast("double").alias("value"))


def nearest_outside(df: DataFrame, block: int, halo: int) -> DataFrame:
    """channel, block, sample_index, value: of each block with rows, the nearest finite samples before and after what it holds.

    What ends before block b begins (its halo included) has (index + halo) // size < b, and what starts after it has
    (index - halo) // size > b: of each such number the last (first) finite sample is kept, and only those, a few a
    block, meet in a window of the channel.
    """
    rows = _typed(df)
    i, v = F.col("sample_index"), F.col("value")
    point = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), F.struct("sample_index", "value"))
    number = lambda shift: F.floor((i + shift) / block)
    found = rows.groupBy("channel", number(halo).alias("upto"), number(-halo).alias("since"), number(0).alias("block")).agg(F.max(point).alias("last"), F.min(point).alias("first"))
    path = fresh_path(df.sparkSession, "finite-samples")
    found.write.parquet(path)  # a few rows a block, from one scan
    cells = df.sparkSession.read.schema(found.schema).parquet(path)
    parts = []
    for name, best, order in (("upto", F.max("last"), F.asc("block")), ("since", F.min("first"), F.desc("block"))):
        ends = cells.groupBy("channel", F.col(name).alias("block")).agg(best.alias("p"))
        both = cells.select("channel", "block").distinct().join(ends, ["channel", "block"], "full")
        w = Window.partitionBy("channel").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        parts.append(both.withColumn("q", F.last("p", True).over(w)))
    return parts[0].unionByName(parts[1]).where("q is not null and block >= 0").select("channel", F.col("block").cast("long").alias("block"), "q.sample_index", "q.value")


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of one sample each; they have no time."""
    for batch in batches:
        at, value = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.float64)
        missing = np.full(1, np.nan).tobytes()
        columns = batch.column(0), batch.column(1), pa.array([x.tobytes() for x in at], pa.binary()), pa.array([missing] * len(at), pa.binary()), pa.array([x.tobytes() for x in value], pa.binary())
        yield pa.RecordBatch.from_arrays(list(columns), names=_NAMES)


def over_blocks(df: DataFrame, block: int, halo: int, run: Run, schema: str, *, filled: bool = False, outside: DataFrame | None = None) -> DataFrame:
    """The rows that `run` makes of each block of `df` (channel, sample_index, time_us, value) that has rows of its own.

    `run` gets a block's rows with those within `halo` before and after it, and returns columns of `schema`. With `filled`
    values that aren't finite are given as if the whole channel had been filled: linear in the index between the nearest
    finite samples, however far they lie beyond the block, the nearest one's value at an end, 0 in a channel without any.
    `outside` is `nearest_outside` of the whole table, where `df` is a part of it.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def join(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        channel, number = key[0].as_py(), key[1].as_py()
        at, time, value = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in rows.column(n)]) for n, kind in (("at", np.int64), ("time_us", np.float64), ("value", np.float64)))
        if (np.diff(at) < 0).any():
            order = np.argsort(at, kind="stable")
            at, time, value = at[order], time[order], value[order]
        if filled:
            good = np.isfinite(value)
            if not good.all():
                value = np.interp(at, at[good], value[good]) if good.any() else np.zeros(len(at))
            held = slice(*np.searchsorted(at, (number * block - halo, (number + 1) * block + halo)))
            at, time, value = at[held], time[held], value[held]
        found = run(channel, number, at, time, value) if ((at // block) == number).any() else {}
        return pa.table({n: found[n] for n in names}) if found else pa.table({n: [] for n in names}, schema=empty)

    empty = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]]) for x in schema.split(", ")])
    rows = _typed(df)
    pieces = rows.mapInArrow(_cut(block, halo), PIECE_SCHEMA)
    if filled:
        outside = nearest_outside(df, block, halo) if outside is None else outside
        pieces = pieces.unionByName(outside.mapInArrow(_points, PIECE_SCHEMA))
    return pieces.groupBy("channel", "block").applyInArrow(join, schema)
