"""Recordings hold every sample of every channel, and each query of them reads all."""

import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from wavemark.catalog import QUERIES
from wavemark.plans import signal_queries as S
from wavemark.sources import adapters as A, signal_csv as C

SF = os.environ.get("WHOLE_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def channels(spark):
    """Each channel's values in order of time, by its id in the recording."""
    rows = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    found = defaultdict(list)
    for kind, value in zip(rows["event_type"], rows["value"], strict=True):
        found[S.IDS[A.CHANNELS[kind] - 1]].append(value)
    return dict(found)


def test_every_sample_is_there(spark, channels):
    whole = max(map(len, channels.values()))
    assert len(channels) == len(S.IDS) and whole > 1500
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")  # more than one split
    try:
        path = S.recording(spark, SF)
        assert spark.read.text(path).rdd.getNumPartitions() > 1
        got = C.read(spark, path).toPandas().sort_values("row")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got["row"].tolist() == list(range(whole)) and got["time_us"].tolist() == [1000.0 * k for k in range(whole)]
    for c, values in channels.items():
        cells = got[f"channel_{c}"].to_numpy()
        assert np.array_equal(cells[: len(values)], np.array([f"{v:.8f}" for v in values], np.float32)) and np.isnan(cells[len(values) :]).all()


def test_queries_of_recordings_are_whole(spark, channels):
    whole, sizes = max(map(len, channels.values())), {c: len(v) for c, v in channels.items()}
    assert {r.channel: (r.n, r.with_value) for r in QUERIES["sink_signal_store"](spark, SF).collect()} == {c: (whole, n) for c, n in sizes.items()}
    assert Counter(r.channel for r in QUERIES["scan_signal_convert"](spark, SF).where("value is not null").collect()) == sizes
    assert QUERIES["scan_signal_frame"](spark, SF).count() == sum(r.n for r in QUERIES["scan_chunks_pyarrow"](spark, SF).collect()) == whole
    assert {r.channel: (r.n, r.valid) for r in QUERIES["filter_cache_valid"](spark, SF).collect()} == {**{c: (whole, True) for c in sizes}, 999: (0, False)}
    assert QUERIES["scan_data_header"](spark, SF).first() == (3, 1 + len(S.IDS))


def test_requests_of_all_events_are_looked_up(spark):
    """Every event but the views asks; each view is a curve that is there."""
    rows = spark.read.parquet(f"{SF}/events.parquet").toPandas()
    key = lambda i, u: (u % 50, None if i % 4 == 0 else i % 3, i % 4, i % 2)
    there = {key(i, u) for i, u, kind in zip(rows["event_id"], rows["user_id"], rows["event_type"], strict=True) if kind == "view"}
    want = [i for i, u, kind in zip(rows["event_id"], rows["user_id"], rows["event_type"], strict=True) if kind != "view" and key(i, u) in there]
    got = sorted(r.event_id for r in QUERIES["scan_led_cache"](spark, SF).collect())
    assert got == sorted(want) and len(got) > 5000
