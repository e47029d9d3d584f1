"""Greedy selection in blocks equals the plain fold: best first, each keeping off all that it touches."""

import numpy as np
import pytest

from wavemark.operators import dominance, led, signal_blocks as B

PEAKS = "channel int, sample_index long, value double, prominence double, negative boolean"


def fold(items, touch):
    kept = []
    for x in items:
        if not any(touch(x, y) for y in kept):
            kept.append(x)
    return kept


def peaks(kind):
    r = np.random.default_rng(2)
    at = np.sort(r.choice(1000, 700, replace=False))  # one run over ten blocks of 100
    height = {"random": r.normal(size=700), "rising": at / 1000.0, "falling": -at / 1000.0, "equal": np.zeros(700), "few": np.round(r.normal(size=700))}[kind]
    return [(c, int(i), float(h) * (1 if n else -1), abs(float(h)) if kind != "falling" else 2 + float(h), bool(n)) for c in (1, 2) for i, h, n in zip(at, height, r.random(700) < 0.3, strict=True)]


@pytest.mark.parametrize("kind", ["random", "rising", "falling", "equal", "few"])
def test_one_run_over_ten_blocks(spark, kind):
    rows = peaks(kind) + [(3, 5, 1.0, 2.0, False), (3, 5, -1.0, 2.0, True), (3, 7, -1.0, 2.0, True)]
    df = spark.createDataFrame(rows, PEAKS)
    for distance in (1, 8, 30):
        want = [y for c in (1, 2, 3) for y in fold(sorted((x for x in rows if x[0] == c), key=lambda x: (-x[3], -abs(x[2]), x[1], x[4])), lambda x, y: abs(x[1] - y[1]) < distance)]
        assert sorted(map(tuple, B.nms(df, distance, 100).collect())) == sorted(want)
    tops = {x[:2]: x for x in rows if x[0] < 3}.values()
    want = [y[:3] for c in (1, 2) for y in fold(sorted((x for x in tops if x[0] == c), key=lambda x: (-x[2], -x[1])), lambda x, y: abs(x[1] - y[1]) < 8)]
    assert sorted(map(tuple, B.distant(spark.createDataFrame(list(tops), PEAKS), 8, 100).collect())) == sorted(want)


def test_no_group_is_larger_than_a_block_and_its_edges(spark, monkeypatch):
    rows, seen = peaks("rising"), spark.sparkContext.accumulator(0)
    whole = dominance.decide

    def watched(start, *more):
        assert start[-1] - start[0] < 100 + 2 * 7
        seen.add(1)
        return whole(start, *more)

    monkeypatch.setattr(dominance, "decide", watched)
    assert B.nms(spark.createDataFrame(rows, PEAKS), 8, 100).count() > 80
    assert seen.value >= 20


@pytest.mark.parametrize("gap", [0, 3, 15])
def test_pairs_that_overlap_over_blocks(spark, gap):
    r = np.random.default_rng(gap)
    pairs = sorted({(int(a), int(a + r.integers(1, 45)), float(np.round(r.normal(), 1))) for a in np.sort(r.choice(2000, 900))})
    pairs = list({p[:2]: p for p in pairs}.values())
    taken = fold(sorted(pairs, key=lambda p: (-p[2], p[0], p[1])), lambda p, q: p[0] <= q[1] + gap and p[1] >= max(q[0] - gap, 0))
    df = spark.createDataFrame(pairs, "on_frame long, off_frame long, score double")
    for most in (1, 5, 10_000):
        assert led.choose_pairs(df, most, gap, 100) == [p[:2] for p in taken[:most]]
    assert led.choose_pairs(df.limit(0), 3, gap) == []
