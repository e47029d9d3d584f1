"""Prominence in long contexts and very many ranges to leave out, against plain versions."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemark.operators import dsp, led, signal_blocks as B, windows as W


@pytest.mark.parametrize("reach", [1, 7, 64, 1000, 10**6])
def test_prominences_of_many_equal_those_of_one(reach):
    r = np.random.default_rng(3)
    for x in (r.normal(size=800), np.round(r.normal(size=800)), np.sin(np.arange(800) / 9) + np.arange(800) / 100, np.zeros(5), np.arange(1.0), np.arange(3.0)):
        at = np.arange(len(x))
        assert np.array_equal(dsp.prominences(x, at, reach), [dsp.prominence(x, k, reach) for k in at])


def test_a_long_context(spark):
    n, context = 200_000, 50_000
    r = np.random.default_rng(1)
    x = np.cumsum(r.normal(size=n))
    df = spark.range(n).select(F.lit(1).alias("channel"), F.col("id").alias("sample_index"), (F.col("id") * 1000.0).alias("time_us")).join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "sample_index long, value double"), "sample_index")
    rows = df.withColumn("is_high", F.col("sample_index") % 101 == 0)
    got = {r.sample_index: r.prominence for r in B.prominences(rows, context, 30_000).collect()}
    assert got == {k: dsp.prominence(x, k, context) for k in range(0, n, 101)}


def test_missing_values_are_passed_over(spark):
    x = [1.0, None, 5.0, None, 0.5, None, 4.0, None, 6.0]
    df = spark.createDataFrame([(1, i, 0.0, v, v is not None) for i, v in enumerate(x)], "channel int, sample_index long, time_us double, value double, is_high boolean")
    got = {r.sample_index: r.prominence for r in B.prominences(df, 8).collect()}
    whole = np.array([v for v in x if v is not None])
    assert got == {k: dsp.prominence(whole, sum(v is not None for v in x[:k]), 8) for k, v in enumerate(x) if v is not None}


def test_very_many_ranges(spark):
    r = np.random.default_rng(7)
    left = r.integers(0, 10**7, 100_000)
    right = left + r.integers(-5, 60, 100_000)  # some hold nothing
    start = r.integers(0, 10**7, 20_000)
    end = start + r.integers(0, 40, 20_000)
    rows = [(k, int(a), int(b), "x") for k, (a, b) in enumerate(zip(start, end, strict=True))] + [(-1, None, 5, "x"), (-2, 5, None, "x")]
    df = spark.createDataFrame(rows, "id long, left long, right long, _at string")
    ranges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(left, right, strict=True)], "left long, right long")
    begun = time.time()
    got = led.outside_ranges(df, ranges, F.col("left"), F.col("right"))
    found = sorted(x.id for x in got.collect())
    whole = (left <= right)
    a, b = left[whole], right[whole]
    order = np.argsort(a)
    a, b = a[order], b[order]
    want = [k for k, (s, e) in enumerate(zip(start, end, strict=True)) if not (b[: np.searchsorted(a, e, "right")] >= s).any()]
    assert got.columns == df.columns and found == want and 0 < len(want) < 20_000 and time.time() - begun < 60


@pytest.mark.parametrize("few", [0, 64])
def test_ranges_that_touch_and_odd_rows(spark, few):
    ranges = [(10, 20), (20, 30), (40, 40), (60, 50)]
    rows = [(0, 9), (0, 10), (30, 31), (31, 39), (31, 40), (41, 50), (50, 60), (15, 15), (None, 3), (3, None)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = led.outside_ranges(df, ranges, F.col("a"), F.col("b"), few, 7)
    assert sorted(map(tuple, got.collect())) == [(0, 9), (31, 39), (41, 50), (50, 60)]
    assert led.outside_ranges(df, [], F.col("a"), F.col("b"), few).count() == 8 and led.outside_ranges(df.limit(0), ranges, F.col("a"), F.col("b"), few).count() == 0


def test_repeated_ranges_are_united_once(spark):
    """Equal ranges and equal left ends, in any order of rows."""
    r = np.random.default_rng(11)
    ranges = [(c, float(a), float(a + n)) for c in (1, 2) for a, n in zip(r.integers(0, 3000, 900), r.integers(0, 6, 900), strict=True)] * 3
    want = set()
    for c in (1, 2):
        united = []
        for _, a, b in sorted(x for x in ranges if x[0] == c):
            if united and a <= united[-1][1]:
                united[-1][1] = max(united[-1][1], b)
            else:
                united.append([a, b])
        want |= {(c, a, b) for a, b in united}
    df = spark.createDataFrame(ranges, "channel int, left double, right double")
    for parts in (1, 5, 13):
        got = W.merge_ranges(df.repartition(parts), width=100.0).select("channel", "left", "right").collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want
