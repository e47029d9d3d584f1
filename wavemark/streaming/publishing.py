"""Filtered ranges published as they are done, the ones nearest to a wanted sample first."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import dsp
from ..operators.pieces import nearest_outside
from ..operators.signal_blocks import BLOCK, filtered
from ..operators.windows import merge_ranges
from ..sources.shared import fresh_path

_DATA = "channel int, sample_index long, time_us double, value double, part int"
_READY = "left long, right long, part int"


def nearest_first(ranges: int, size: int, wanted: int) -> list[int]:
    """Numbers of ranges of `size` samples by the distance of their middles from the wanted sample; the earlier of equals first."""
    return sorted(range(ranges), key=lambda k: (abs((k + 0.5) * size - wanted), k))


def _together(numbers: list[int]) -> Iterator[tuple[int, int]]:
    """(first, last) of the numbers that follow each other."""
    found = sorted(numbers)
    first = 0
    for k in range(1, len(found) + 1):
        if k == len(found) or found[k] > found[k - 1] + 1:
            yield found[first], found[k - 1]
            first = k


def publish(samples: DataFrame, settings: dsp.Settings | None, rate_hz: float, step: int, path: str, *, wanted: int = 0, size: int = BLOCK, first: int = 1) -> Iterator[tuple[int, int]]:
    """Filters ranges of `size` samples at the full rate, keeps every `step`-th row counted from the start, and writes
    them to `path`; gives (ranges ready, ranges there are) after each part.

    The first part has the `first` ranges nearest to the sample `wanted`, each further part twice as many as the last, so
    that what is looked at is there soon and the number of jobs grows with the logarithm of the ranges. A part's rows are
    written before it is entered as ready, both in place of what an earlier run wrote: a reader sees whole ranges only,
    and a run that is started again replaces part by part. Ranges are filtered with context and gaps filled over the
    whole channel, so the parts don't change the values.
    """
    spark = samples.sparkSession
    last = samples.agg(F.max("sample_index")).first()[0]
    if last is None:
        return
    halo = dsp.padding(settings, rate_hz)
    outside = fresh_path(spark, "publish-gaps")
    nearest_outside(samples, size, halo).write.parquet(outside)
    order = nearest_first(last // size + 1, size, wanted)
    at, part, many = 0, 0, max(1, first)
    i = F.col("sample_index")
    while at < len(order):
        some = order[at : at + many]
        spans = list(_together(some))
        near = own = F.lit(False)
        for a, b in spans:
            near = near | i.between(a * size - halo, (b + 1) * size + halo - 1)
            own = own | i.between(a * size, (b + 1) * size - 1)
        rows = filtered(samples.where(near), settings, rate_hz, size, outside=spark.read.parquet(outside)).where(own & (i % step == 0))
        rows.write.mode("overwrite").parquet(f"{path}/data/part={part}")
        ready = spark.createDataFrame([(a * size, min((b + 1) * size, last + 1)) for a, b in spans], "left long, right long")
        ready.write.mode("overwrite").parquet(f"{path}/ready/part={part}")
        at, part, many = at + len(some), part + 1, many * 2
        yield at, len(order)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def ready_ranges(spark: SparkSession, path: str) -> DataFrame:
    """left, right (after the last): what may be read, as ranges that don't touch."""
    parts = _read(spark, f"{path}/ready", _READY).select(F.lit(0).alias("channel"), F.col("left").cast("double").alias("left"), F.col("right").cast("double").alias("right"))
    return merge_ranges(parts, 0.0, 1e9).select(F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"))


def read_ready(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the parts that are ready."""
    return _read(spark, f"{path}/data", _DATA).join(F.broadcast(_read(spark, f"{path}/ready", _READY).select("part").distinct()), "part", "left_semi").drop("part")
