"""Structured Streaming over sample streams: carried times, monotonic input, tumbling counts and partial publishing."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.blocks import ROWS

#: A block's running counts, and its first and last valid time.
GAP_SCHEMA = "channel int, block long, n long, duplicates long, discontinuities long, backwards long, first_us double, last_us double"
_STATE = "n long, duplicates long, discontinuities long, backwards long, first_us double, last_us double"


def block_gaps(stream: DataFrame, expected_us: float, block: int = ROWS) -> DataFrame:
    """Per channel, block and trigger, the block's running counts of valid times, of repeated ones, of other steps that
    aren't the expected one, and of those that go backwards.

    The state is a block's: its last valid time is carried, so a step over two micro-batches counts like any other, and a
    channel's rows of one trigger spread over as many tasks as they have blocks. Rows of one trigger and block are taken in
    the order of sample_index. Steps from block to block are for `gap_totals`.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, twice, jumps, back, first, last = state.get if state.exists else (0, 0, 0, 0, None, None)
        held = [(b["sample_index"].to_numpy(), b["time_us"].to_numpy(np.float64)) for b in batches]  # a block's rows at most
        index, times = (np.concatenate(x) for x in zip(*held, strict=True))
        times = times[np.argsort(index, kind="stable")]
        times = times[~np.isnan(times)]
        if len(times):
            steps = np.diff(times) if last is None else np.diff(times, prepend=last)
            n, twice, jumps, back = n + len(times), twice + int((steps == 0).sum()), jumps + int(((steps != 0) & (steps != expected_us)).sum()), back + int((steps < 0).sum())
            first, last = float(times[0]) if first is None else first, float(times[-1])
        state.update((n, twice, jumps, back, first, last))
        yield pd.DataFrame({"channel": [key[0]], "block": [key[1]], "n": [n], "duplicates": [twice], "discontinuities": [jumps], "backwards": [back], "first_us": [first], "last_us": [last]})

    rows = stream.select("channel", F.floor(F.col("sample_index") / block).alias("block"), "sample_index", "time_us")
    return rows.groupBy("channel", "block").applyInPandasWithState(run, GAP_SCHEMA, _STATE, "update", GroupStateTimeout.NoTimeout)


def gap_totals(blocks: DataFrame, expected_us: float) -> DataFrame:
    """channel, n, duplicates, discontinuities, backwards, last_us: the blocks' newest counts (by `batch`) put together in
    order, with the steps from one block's last valid time to the next one's first. A row a block is put in order."""
    newest = blocks.groupBy("channel", "block").agg(F.max_by(F.struct("n", "duplicates", "discontinuities", "backwards", "first_us", "last_us"), "batch").alias("s")).select("channel", "block", "s.*")
    before = F.last("last_us", True).over(Window.partitionBy("channel").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    rows = newest.withColumn("step", F.col("first_us") - before)
    step = F.col("step")
    counts = {"duplicates": step == 0, "discontinuities": (step != 0) & (step != expected_us), "backwards": step < 0}
    return rows.groupBy("channel").agg(F.sum("n").alias("n"), *((F.sum(c) + F.count_if(odd)).alias(c) for c, odd in counts.items()), F.max_by("last_us", F.when(F.col("last_us").isNotNull(), F.col("block"))).alias("last_us"))


def follow_gaps(stream: DataFrame, path: str, checkpoint: str, expected_us: float, *, strict: bool = False, block: int = ROWS):
    """Starts the stream of block counts, a folder a batch in `path`; see `read_gaps`.

    With `strict` a time that goes backwards, within a block or from one to the next, ends the query with an error, as
    late input is an error here and not late data. A batch that runs again replaces its folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if strict:
            bad = read_gaps(batch.sparkSession, path, expected_us).where("backwards > 0").first()
            if bad is not None:
                raise ValueError(f"times go backwards on channel {bad.channel}")

    counts = block_gaps(stream, expected_us, block)
    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_gaps(spark: SparkSession, path: str, expected_us: float) -> DataFrame:
    return gap_totals(spark.read.schema(GAP_SCHEMA + ", batch long").parquet(path), expected_us)


def tumbling(stream: DataFrame, width: str = "60 seconds", late: str = "0 seconds") -> DataFrame:
    """Rows and sum of values per channel and window of event time (column ts)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "channel").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


class Progress(StreamingQueryListener):
    """Fractions of a known number of rows that a query has read, as its triggers end; each is handed to `report`."""

    def __init__(self, total: int, report: Callable[[float], None]):
        self.total, self.done, self.report = max(1, total), 0, report

    def onQueryStarted(self, event) -> None:
        self.report(0.0)

    def onQueryProgress(self, event) -> None:
        self.done += event.progress.numInputRows
        self.report(min(1.0, self.done / self.total))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception is None:
            self.report(1.0)


def cancellable(spark: SparkSession, tag: str, job: Callable[[], None]) -> Callable[[], None]:
    """Runs `job` under a tag; `cancelJobsWithTag(tag)` of the Spark context, from another thread, ends it.

    Spark's commit protocol leaves nothing of a cancelled write that a reader could see.
    """

    def run() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            job()
        finally:
            spark.sparkContext.removeJobTag(tag)

    return run


def slowly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first column, half a second a batch; stands for work that is worth cancelling."""
    for batch in batches:
        for _ in range(20):
            time.sleep(0.5)
            yield batch.select([0])
