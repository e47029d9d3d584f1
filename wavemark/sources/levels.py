"""Coarse levels of samples: each step's rows in files of their own, so that a coarse read opens no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_SCHEMA = "sample_index long, time_us double, value double, step int, channel int"


def write_levels(samples: DataFrame, path: str, steps: tuple[int, ...]) -> None:
    """A folder a step and channel with every step-th row counted from the first; the samples are read once for all steps.

    Filtered levels are those of filtered samples: the filter runs at the full rate, the order can't be changed.
    """
    if not steps or min(steps) < 1:
        raise ValueError("steps are at least 1")
    i = F.col("sample_index")
    mine = F.filter(F.array(*(F.lit(s) for s in sorted(set(steps)))), lambda s: i % s == 0)
    rows = samples.withColumn("step", F.explode(mine)).select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in _SCHEMA.split(", ")))
    rows.repartition("step", "channel", F.floor(i / F.col("step") / 1_000_000)).sortWithinPartitions("step", "channel", "sample_index").write.mode("overwrite").partitionBy("step", "channel").parquet(path)


def stored_steps(spark: SparkSession, path: str) -> list[int]:
    """The steps that are there, from the folders' names."""
    return sorted(r.step for r in spark.read.schema(_SCHEMA).parquet(path).select("step").distinct().collect())  # a row a step


def read_level(spark: SparkSession, path: str, step: int) -> DataFrame:
    """channel, sample_index, time_us, value of every step-th row: from the coarsest level whose rows hold all of them.

    An error if no level divides the step.
    """
    good = [s for s in stored_steps(spark, path) if step % s == 0]
    if not good:
        raise ValueError(f"no level for every {step}th row")
    level = spark.read.schema(_SCHEMA.replace("step int, ", "")).parquet(f"{path}/step={max(good)}")
    return level.where(F.col("sample_index") % step == 0).select("channel", "sample_index", "time_us", "value")
