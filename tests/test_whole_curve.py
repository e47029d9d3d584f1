"""The queries of brightness curves without oracle SQL take every event; compared with brute force."""

import os

import numpy as np
import pytest

from wavemark.catalog import QUERIES
from wavemark.operators import led
from wavemark.sources import adapters as A

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def curve(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_id", "value").toPandas().sort_values(["ts", "event_id"])
    return rows["value"].to_numpy() / 500


def best_pulses(frames, values, least, most, gap, fps=30.0):
    delta = np.diff(values)
    found = []
    for i in np.flatnonzero(delta > least):
        for j in np.flatnonzero(delta < -least):
            d = frames[j + 1] / fps - frames[i + 1] / fps
            if j > i and 0.6 <= d <= 1.5:
                found.append((-(abs(delta[i]) + abs(delta[j]) - 0.1 * abs(d - 1.0)), int(frames[i + 1]), int(frames[j + 1])))
    taken = []
    for _, a, b in sorted(found):
        if len(taken) < most and all(not (a <= y + gap and b >= max(x - gap, 0)) for x, y in taken):
            taken.append((a, b))
    return taken


def test_curve_has_every_event(spark, curve):
    got = A.led_curve(spark, SF).orderBy("frame_index").collect()
    assert [r.frame_index for r in got] == list(range(len(curve)))
    assert np.array_equal([r.brightness for r in got], curve)


def test_best_pairs_of_all_events(spark, curve):
    want = best_pulses(np.arange(len(curve)), curve, 0.02, 3, 15)
    assert len(want) == 3 and [tuple(r) for r in QUERIES["topk_led_pairs"](spark, SF).collect()] == want


def test_detected_among_all_events(spark, curve):
    least = max(3 * np.abs(np.diff(curve)).mean(), 1e-6)
    want = {(kind, f) for a, b in best_pulses(np.arange(len(curve)), curve, least, 3, 15) for kind, f in (("led_on", a), ("led_off", b))}
    assert want and {(r.event_type, r.frame_index) for r in QUERIES["sp_led_detect"](spark, SF).collect()} == want


def test_refined_among_all_events(spark, curve):
    frames = np.arange(0, len(curve), 5)
    coarse = best_pulses(frames, curve[frames], 0.01, 3, 15)
    found = []
    for a, b in coarse:
        inside = np.array([f for f in range(len(curve)) if a / 30.0 - 1.0 <= f / 30.0 <= b / 30.0 + 1.0])
        least = max(3 * np.abs(np.diff(curve[inside])).mean(), 1e-6)
        found += best_pulses(inside, curve[inside], least, 1, 15)
    want, last = [], None
    for a, b in sorted(found):
        if last is None or a > last + 15:
            want.append((a, b))
        last = max(last or b, b)
    got = QUERIES["sp_led_refine"](spark, SF).collect()
    assert want and sorted((r.on_frame, r.off_frame) for r in got) == want


def test_deltas_over_buckets(spark):
    frames = [0, 5, led.FRAMES - 2, led.FRAMES + 3, led.FRAMES + 4, 3 * led.FRAMES]
    rows = spark.createDataFrame([(f, float(k * k)) for k, f in enumerate(frames)], "frame_index long, brightness double")
    got = led.deltas(rows).orderBy("frame_index").collect()
    assert [(r.frame_index, r.delta) for r in got] == [(f, 2.0 * k + 1) for k, f in enumerate(frames[1:])]
