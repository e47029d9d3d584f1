"""Carried state by blocks, and ranges published nearest first."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemark.operators import dsp, samples as O, signal_blocks as B
from wavemark.streaming import monitor, publishing

SAMPLES = "channel int, sample_index long, time_us double, value double"


def followed(spark, tmp_path, parts, expected, block, **more):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SAMPLES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    monitor.follow_gaps(stream, f"{tmp_path}/out", f"{tmp_path}/state", expected, block=block, **more).awaitTermination()
    return monitor.read_gaps(spark, f"{tmp_path}/out", expected)


@pytest.mark.parametrize("block", [2, 7, 1000])
def test_stream_counts_equal_batch_counts(spark, tmp_path, block):
    r = np.random.default_rng(4)
    times = np.cumsum(r.choice([0, 100_000, 100_000, 250_000], 60)).astype(float)
    rows = [(c, i, None if i % 13 == 5 else float(t), 1.0) for c in (1, 2) for i, t in enumerate(times)]
    got = {r.channel: r for r in followed(spark, tmp_path, [rows[k * 30 : k * 30 + 30] for k in range(4)], 100_000.0, block).collect()}
    for want in O.anomaly_counts(spark.createDataFrame(rows, SAMPLES), 10.0).collect():
        one = got[want.channel]
        assert (one.n, one.duplicates, one.discontinuities, one.backwards, one.last_us) == (want.n, want.duplicates, want.discontinuities, 0, times[59])


def test_a_trigger_of_one_channel_spreads_over_blocks(spark, tmp_path):
    rows = [(1, i, 1000.0 * i, 0.0) for i in range(500)]
    followed(spark, tmp_path, [rows], 1000.0, 50)
    blocks = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.block, r.n, r.first_us) for r in blocks) == [(k, 50, 50_000.0 * k) for k in range(10)]


@pytest.mark.parametrize("at", [3, 50])  # within a block, and from one to the next
def test_backwards_times_end_the_query(spark, tmp_path, at):
    rows = [(1, i, 1000.0 * i - (5000.0 if i >= at else 0), 0.0) for i in range(100)]
    with pytest.raises(Exception, match="backwards on channel 1"):
        followed(spark, tmp_path, [rows[:at], rows[at:]], 1000.0, 50, strict=True)


def test_published_nearest_first(spark, tmp_path):
    r = np.random.default_rng(8)
    n, size, step, path = 2350, 100, 3, f"{tmp_path}/ranges"
    values = {c: r.normal(size=n) for c in (1, 2)}
    rows = [(c, i, 1000.0 * i, None if 450 < i < 760 or i % 50 == 7 else float(v[i])) for c, v in values.items() for i in range(n)]
    df = spark.createDataFrame(rows, SAMPLES).repartition(4)
    band = dsp.Settings(True, bandpass=True, low_hz=30.0, high_hz=100.0)
    whole = {(x.channel, x.sample_index): x.value for x in B.filtered(df, band, 1000.0, size).where(F.col("sample_index") % step == 0).collect()}
    assert publishing.ready_ranges(spark, path).count() == publishing.read_ready(spark, path).count() == 0
    for _ in range(2):  # the second run replaces the first one's parts
        order = sorted(range(24), key=lambda k: (abs(100 * k + 50 - 1210), k))
        for ready, of in publishing.publish(df, band, 1000.0, step, path, wanted=1210, size=size, first=2):
            assert of == 24
            if _ == 1:
                continue
            near = set(order[:ready])
            got = {(x.channel, x.sample_index): x.value for x in publishing.read_ready(spark, path).collect()}
            assert got == {k: v for k, v in whole.items() if k[1] // size in near}
            spans = sorted(map(tuple, publishing.ready_ranges(spark, path).collect()))
            assert [(a, b) for a, b in spans] == [(min(near) * size, min((max(near) + 1) * size, n))]
    got = publishing.read_ready(spark, path).collect()
    assert len(got) == len(whole) and {(x.channel, x.sample_index): x.value for x in got} == whole


def test_nothing_to_publish(spark, tmp_path):
    assert list(publishing.publish(spark.createDataFrame([], SAMPLES), None, 1000.0, 5, f"{tmp_path}/none")) == []
    df = spark.createDataFrame([(1, i, 1.0 * i, float(i)) for i in range(10)], SAMPLES)
    assert list(publishing.publish(df, None, 1000.0, 4, f"{tmp_path}/one", size=100)) == [(1, 1)]
    assert sorted(r.sample_index for r in publishing.read_ready(spark, f"{tmp_path}/one").collect()) == [0, 4, 8]
