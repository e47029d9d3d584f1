"""Greedy selection along a line: the best candidates in turn, each keeping off all that it touches, without one task for a run.

A candidate's fate hangs on better ones that it touches, theirs on better ones again. A block decides all its candidates
whose chain ends within what it sees (its rows and those near its edges); what hangs on an undecided neighbour waits for
the next round, to which only undecided and newly kept candidates go. The best of all undecided is decided in every round,
and a chain of candidates, each better than the last, takes a round a block that it runs through.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.shared import fresh_path
from .blocks import with_edges

UNDECIDED, KEPT, GONE = 0, 1, 2


def decide(start: np.ndarray, end: np.ndarray, rank: np.ndarray, own: np.ndarray, state: np.ndarray, gap: int) -> np.ndarray:
    """The states of intervals that lie in order of `start`, as far as they can be told; lower ranks are better.

    Intervals touch with at most `gap` between them. Those that aren't `own` may touch others that aren't here: they are
    gone if they touch one that is kept, and undecided else.
    """
    state = state.copy()
    longest = int((end - start).max(initial=0))
    lows, highs = np.searchsorted(start, start - gap - longest), np.searchsorted(start, end + gap, "right")
    kept = np.flatnonzero(state == KEPT)
    starts, ends = start[kept].tolist(), end[kept].tolist()  # kept ones don't touch each other
    waiting = 0
    held = np.zeros(len(start), bool)
    for k in np.argsort(rank, kind="stable"):
        if state[k] != UNDECIDED:
            continue
        at = bisect_left(starts, start[k])
        if at and ends[at - 1] + gap >= start[k] or at < len(starts) and starts[at] - gap <= end[k]:
            state[k] = GONE
        elif not own[k] or waiting and (held[lows[k] : highs[k]] & (end[lows[k] : highs[k]] >= start[k] - gap)).any():
            held[k], waiting = True, waiting + 1
        else:
            state[k] = KEPT
            starts.insert(at, int(start[k]))
            ends.insert(at, int(end[k]))
    return state


def select(rows: DataFrame, keys: list[str], start: str, end: str, order: list[tuple[str, bool]], *, gap: int, longest: int, block: int) -> DataFrame:
    """The rows that are left when the best in turn keep off those that they touch.

    `start` and `end` are whole numbers from 0, at most `longest` apart; rows touch if at most `gap` lies between them.
    `order` lists columns and whether they rise, the best first; equal rows go in any order. Each round is written to the
    shared folder and read again.
    """
    spark, names, reach = rows.sparkSession, rows.columns, gap + longest

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([start, end], kind="stable")
        best = np.lexsort([pdf[c].to_numpy() if up else -pdf[c].to_numpy() for c, up in reversed(order)])
        rank = np.empty(len(pdf), np.int64)
        rank[best] = np.arange(len(pdf))
        own, before = pdf["_own"].to_numpy(bool), pdf["_state"].to_numpy()
        after = decide(pdf[start].to_numpy(np.int64), pdf[end].to_numpy(np.int64), rank, own, before, gap)
        left = own & (before == UNDECIDED) & (after != GONE)
        return pdf.loc[left, names].assign(_state=after[left])

    active = rows.withColumn("_state", F.lit(UNDECIDED).cast("byte"))
    schema, paths = active.schema, []
    while True:
        paths.append(fresh_path(spark, "kept-off"))
        with_edges(active, reach, reach, start, block).groupBy(*keys, "_block").applyInPandas(run, schema).write.parquet(paths[-1])
        active = spark.read.schema(schema).parquet(paths[-1])
        if active.where(F.col("_state") == UNDECIDED).isEmpty():
            return spark.read.schema(schema).parquet(*paths).where(F.col("_state") == KEPT).select(*names)
