"""Interval unions by jumps equal the walk from left to right, also where one run goes through many blocks."""

import math
import time

import numpy as np
import pytest

from wavemark.operators.intervals import Block, peak_intervals

SCHEMA = "channel long, time_sec double"


def walk(times, radius, longest):
    radius = max(radius, 0.0)
    span, out = max(longest, 2 * radius), []
    for t in sorted(set(times)):
        if out and t - radius <= out[-1][1] and max(out[-1][1], t + radius) - out[-1][0] <= span:
            out[-1][1] = max(out[-1][1], t + radius)
        else:
            out.append([t - radius, t + radius])
    return [tuple(x) for x in out]


def cases():
    r = np.random.default_rng(1)
    yield "touching", np.cumsum(r.choice([0.5, 1.0, 2.0], 3000)), 1.0, 30.0
    yield "gaps", np.cumsum(r.exponential(2.0, 3000)), 1.0, 9.0
    yield "long gaps", np.cumsum(r.choice([0.1, 5.0, 700.0], 3000, p=[0.7, 0.29, 0.01])), 1.0, 7.3
    yield "tenths", np.arange(4000) * 0.1, 0.3, 2.0
    yield "no radius", np.arange(100) * 1.0, 0.0, 5.0
    yield "negative", np.arange(-300, 300) * 0.7, 0.5, 4.0
    yield "no longest", np.arange(500) * 0.9, 1.0, 0.0


@pytest.mark.parametrize(("name", "times", "radius", "longest"), list(cases()), ids=lambda x: x if isinstance(x, str) else "")
def test_equal_to_the_walk(spark, name, times, radius, longest):
    rows = [(c, float(t)) for c in (1, None) for t in times[:: 1 if c else 2]] + [(2, math.nan), (2, math.inf), (2, None), (3, 5.0), (3, 5.0)]
    got = peak_intervals(spark.createDataFrame(rows, SCHEMA), radius, longest, width=40.0).collect()
    for c, some in ((1, times), (None, times[::2]), (2, []), (3, [5.0])):
        assert sorted((r.left, r.right) for r in got if r.channel == c) == walk(map(float, some), radius, longest)


def test_no_times(spark):
    for rows in ([], [(1, None), (1, math.nan)]):
        assert peak_intervals(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_a_run_of_very_many_times(spark):
    times = np.arange(100_000) * 0.01  # one run through 25 blocks
    started = time.time()
    got = peak_intervals(spark.createDataFrame([(1, float(t)) for t in times], SCHEMA), 0.5, 3.0, width=40.0).collect()
    assert sorted((r.left, r.right) for r in got) == walk(times.tolist(), 0.5, 3.0) and time.time() - started < 60


def test_jumps_of_a_block_are_linear():
    t = np.arange(1_000_000) * 0.001
    started = time.time()
    block = Block(t, 1.0, 30.0)
    assert len(list(block.chain(0, len(t)))) == len(walk(t.tolist(), 1.0, 30.0)) and time.time() - started < 20
