"""Coarse reads open the files of their level alone, and levels hold what a stride over all samples gives."""

import pytest

from wavemark.operators import dsp, samples as S, signal_blocks as B
from wavemark.sources import levels

SAMPLES = "channel int, sample_index long, time_us double, value double"


def test_levels(spark, tmp_path):
    df = spark.createDataFrame([(c, i, 10.0 * i, None if i % 50 == 1 else i * 0.5 + c) for c in (1, 2, 7) for i in range(1000)], SAMPLES).repartition(3)
    path = f"{tmp_path}/levels"
    for _ in range(2):
        levels.write_levels(df, path, (4, 16, 64, 16))
    assert levels.stored_steps(spark, path) == [4, 16, 64]
    for step, level in ((4, 4), (12, 4), (16, 16), (32, 16), (64, 64), (128, 64), (48, 16)):
        got = levels.read_level(spark, path, step)
        assert all(f"/step={level}/" in f for f in got.inputFiles()) and len(got.inputFiles()) == 3
        assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(map(tuple, S.stride(df, step).select("channel", "sample_index", "time_us", "value").collect()), key=lambda r: r[:2])
    assert all("/channel=2/" in f for f in levels.read_level(spark, path, 64).where("channel = 2")._jdf.queryExecution().executedPlan().toString().split() if f.startswith("file:") and f.endswith(".parquet"))
    for bad in (6, 1):
        with pytest.raises(ValueError):
            levels.read_level(spark, path, bad)
    with pytest.raises(ValueError):
        levels.write_levels(df, path, ())


def test_filtered_levels_are_filtered_first(spark, tmp_path):
    df = spark.range(3000).selectExpr("1 AS channel", "id AS sample_index", "id * 1000.0D AS time_us", "sin(id * 0.9) + cos(id * 0.01) AS value")
    band = dsp.Settings(True, bandpass=True, low_hz=100.0, high_hz=200.0)
    levels.write_levels(B.filtered(df, band, 1000.0, 500), f"{tmp_path}/f", (10,))
    want = {r.sample_index: r.value for r in B.filtered(df, band, 1000.0, 500).collect()}
    got = levels.read_level(spark, f"{tmp_path}/f", 10).collect()
    assert len(got) == 300 and all(r.value == want[r.sample_index] for r in got)
