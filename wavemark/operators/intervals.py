"""Neighbourhoods of times united from left to right while the union stays short enough, without a fold over a run.

Which times begin an interval depends on all that lies before them in their run. Within a block of time, each time's next
beginning is a jump that the block can tell; a chain of jumps that comes into a block at one time leaves it at one time.
Only these pairs of times go from block to block, and they are joined with themselves until they have passed all blocks
that a run goes through: the number of joins grows with the logarithm of those blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.shared import fresh_path
from .samples import finite


class Block:
    """The times of a block and those near it, in order, with each one's jump."""

    def __init__(self, times: np.ndarray, radius: float, span: float):
        self.t, n = times, len(times)
        first = np.ones(n, bool)
        first[1:] = times[1:] - radius > times[:-1] + radius
        self.first = first  # begins an interval whatever comes before
        breaks = np.append(np.flatnonzero(first), n)
        apart = breaks[np.searchsorted(breaks, np.arange(n), "right")]
        i = np.arange(n)
        k = np.maximum(np.searchsorted(times, times + (span - 2 * radius), "right"), i + 1)
        long = lambda j: (times[np.minimum(j, n - 1)] + radius) - (times - radius) > span
        while (back := (k > i + 1) & long(k - 1)).any():  # sums of floating numbers decide, not their rearrangement
            k[back] -= 1
        while (ahead := (k < n) & ~long(k)).any():
            k[ahead] += 1
        self.jump = np.minimum(apart, k)

    def goes_on(self, i: int) -> bool:
        """Whether the interval after the one that begins at i begins there because of it."""
        j = self.jump[i]
        return j < len(self.t) and not self.first[j]

    def exits(self, a: int, b: int) -> dict[int, float]:
        """For each place in [a, b), where a chain through it first goes on from b; those that end before aren't listed."""
        out: dict[int, float] = {}
        for i in range(b - 1, a - 1, -1):
            if self.goes_on(i):
                j = int(self.jump[i])
                if j >= b:
                    out[i] = float(self.t[j])
                elif j in out:
                    out[i] = out[j]
        return out

    def chain(self, i: int, b: int) -> Iterator[tuple[int, int]]:
        """(first, last) places of the intervals from i on that begin before b."""
        while True:
            yield i, int(self.jump[i]) - 1
            if not self.goes_on(i) or self.jump[i] >= b:
                return
            i = int(self.jump[i])


def _in_blocks(times: DataFrame, width: float, reach: float) -> DataFrame:
    """Each time in its block, and again in blocks that it lies `reach` before or after."""
    t = F.col("time_sec")
    block = F.explode(F.sequence(F.floor((t - reach) / width), F.floor((t + reach) / width)))
    return times.withColumn("block", block).withColumn("own", F.floor(t / width) == F.col("block"))


def peak_intervals(df: DataFrame, context_sec: float = 1.0, longest_sec: float = 30.0, width: float = 21_600.0) -> DataFrame:
    """channel, left, right: neighbourhoods (context_sec around each of a channel's times) united in order of time: one
    that touches the union joins it if that doesn't become longer than longest_sec (twice the context at least), else it
    begins the next. Times that aren't finite are left out, equal ones count once.
    """
    spark = df.sparkSession
    radius = max(float(context_sec), 0.0)
    span = max(float(longest_sec), 2 * radius)
    reach = span + 2 * radius
    width = max(width, 2 * reach)
    schema_of = f"channel {df.schema['channel'].dataType.simpleString()}"
    times = df.where(finite(F.col("time_sec"))).select("channel", F.col("time_sec").cast("double").alias("time_sec")).distinct()

    def written(rows: DataFrame, name: str) -> DataFrame:
        at = fresh_path(spark, name)
        rows.write.parquet(at)
        return spark.read.schema(rows.schema).parquet(at)

    blocks = written(_in_blocks(times, width, reach), "interval-times")

    def of(pdf: pd.DataFrame) -> tuple[pd.DataFrame, Block, int, int]:
        pdf = pdf.sort_values("time_sec", ignore_index=True)
        own = np.flatnonzero(pdf["own"].to_numpy())
        return pdf, Block(pdf["time_sec"].to_numpy(), radius, span), *((int(own[0]), int(own[-1]) + 1) if len(own) else (0, 0))

    def jumps(pdf: pd.DataFrame) -> pd.DataFrame:
        """Where chains leave the block: without `entry` those from the runs that begin in it, else those that come in there."""
        pdf, block, a, b = of(pdf)
        out = block.exits(a, b)
        early = (int(pdf["block"].iloc[0]) * width) + reach  # a chain comes in soon after the block's start
        rows = [(float(block.t[i]) if not block.first[i] else None, x) for i, x in out.items() if block.first[i] or block.t[i] <= early]
        return pd.DataFrame({"channel": pdf["channel"].iloc[0], "entry": np.array([e for e, _ in rows], float), "exit": np.array([x for _, x in rows], float)}, columns=["channel", "entry", "exit"])

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, block, a, b = of(pdf.groupby(["time_sec", "own"], as_index=False).agg({"channel": "first", "entry": "max"}))
        begins = [i for i in range(a, b) if block.first[i] or pdf["entry"].iat[i]]
        found = [pair for i in begins for pair in block.chain(i, b)]
        left, right = (block.t[[p[k] for p in found]] for k in (0, 1))
        return pd.DataFrame({"channel": pdf["channel"].iloc[0], "left": left - radius, "right": right + radius}, columns=["channel", "left", "right"])

    left = written(blocks.groupBy("channel", "block").applyInPandas(jumps, f"{schema_of}, entry double, exit double"), "interval-jumps")
    nan = F.isnan("entry") | F.col("entry").isNull()
    entries = left.where(nan).select("channel", F.col("exit").alias("time_sec")).distinct()
    steps = left.where(~nan)
    while not steps.isEmpty():
        onward = entries.join(steps, entries.channel.eqNullSafe(steps.channel) & (entries.time_sec == steps.entry)).select(entries.channel, F.col("exit").alias("time_sec"))
        entries = written(entries.unionByName(onward).distinct(), "interval-entries")
        then = steps.select(F.col("channel").alias("c"), F.col("entry").alias("e"), F.col("exit").alias("x"))
        steps = written(steps.join(then, steps.channel.eqNullSafe(then.c) & (F.col("exit") == then.e)).select("channel", "entry", F.col("x").alias("exit")), "interval-steps")
    marked = blocks.withColumn("entry", F.lit(False)).unionByName(entries.withColumn("block", F.floor(F.col("time_sec") / width)).withColumn("own", F.lit(True)).withColumn("entry", F.lit(True)))
    return marked.groupBy("channel", "block").applyInPandas(unite, f"{schema_of}, left double, right double")
