"""Samples shown around peaks, compared with a brute-force NumPy version."""

import os

import numpy as np
import pytest

from wavemark.catalog import QUERIES
from wavemark.operators import windows as W
from wavemark.sources import adapters as A

SF = os.environ.get("WHOLE_SF_DIR", "/root/testdata/sf0.01")


def even(n, most):
    """Places of at most `most` of n rows."""
    return range(n) if n <= most else [0] if most == 1 else [k * (n - 1) // (most - 1) for k in range(most)]


def shown(times, values, context, longest, budget, height):
    tops = np.flatnonzero(values > height)
    markers = [tops[k] for k in even(len(tops), min(len(tops), budget // 4))]
    spans = []
    for t in np.unique(times[tops]):
        if spans and t - context <= spans[-1][1] and t + context - spans[-1][0] <= longest:
            spans[-1][1] = t + context
        else:
            spans.append([t - context, t + context])
    exact = np.array([b - a for a, b in spans])
    exact = exact * ((budget - len(markers)) / exact.sum())
    points = np.floor(exact).astype(int)
    for k in np.argsort(-(exact - points), kind="stable")[: budget - len(markers) - points.sum()]:
        points[k] += 1
    found = list(markers)
    for (a, b), most in zip(spans, points, strict=True):
        inside = np.flatnonzero((times >= a) & (times <= b))
        found += [inside[k] for k in even(len(inside), most)] if most else []
    return sorted(map(int, found))


def check(got, rows):
    assert {r.channel for r in got} == {c for c, *_ in rows}
    for c in {c for c, *_ in rows}:
        mine = sorted((t, i, v) for k, i, t, v in rows if k == c)
        times, values = np.array([t for t, _, _ in mine]) / 1e6, np.array([v for _, _, v in mine])
        found = sorted(r.sample_index for r in got if r.channel == c)
        assert len(found) <= 2000 and found == shown(times, values, 300.0, 3000.0, 2000, 100.0)
        assert all(r.value == values[r.sample_index] for r in got if r.channel == c)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_given_tables(spark):
    rows = [(r.channel, r.sample_index, r.time_us, r.value) for r in A.samples(spark, SF).collect()]
    check(QUERIES["sp_peak_display"](spark, SF).collect(), rows)


def test_dense_intervals_are_thinned_evenly(spark, monkeypatch):
    """More samples around peaks, and more peaks, than there are points for."""
    r = np.random.default_rng(4)
    rows = [(1, i, i * 0.5e6, 120.0 if i == 11_000 else float(r.random() * 100 + 50 * (5_000 < i < 5_900))) for i in range(12_000)]
    rows += [(2, i, i * 2e6, 101.0 if i == 70 else 1.0) for i in range(200)]
    monkeypatch.setattr(A, "samples", lambda *_: spark.createDataFrame(rows, "channel int, sample_index long, time_us double, value double"))
    got = QUERIES["sp_peak_display"](spark, "").collect()
    check(got, rows)
    assert max(r.sample_index for r in got if r.channel == 1) > 11_500 and any(r.sample_index == 11_000 for r in got)


def test_each_group_has_its_own_number(spark):
    sizes = {"a": (10, 0), "b": (10, 1), "c": (11, 4), "d": (3, 7), "e": (1, 1), "f": (1, 0)}
    rows = spark.createDataFrame([(g, i, m) for g, (n, m) in sizes.items() for i in range(n)], "g string, sample_index long, most long")
    got = sorted((r.g, r.sample_index) for r in W.even_sample(rows, rows["most"], ("g",)).collect())
    assert got == [(g, i) for g, (n, m) in sizes.items() if m for i in even(n, m)]
