"""Filters, spectra and peaks over sample tables: blocks with halos, segments and windows as keys of grouped maps.

No task is keyed by a channel alone: a key is (channel, block), (channel, segment) or (channel, window), whose rows are
bounded, so one long recording spreads over the cluster.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import dsp
from .dominance import select
from .pieces import over_blocks
from .samples import EPSILON, finite

BLOCK = 250_000


def filtered(df: DataFrame, settings: dsp.Settings | None, rate_hz: float, block: int = BLOCK, outside: DataFrame | None = None) -> DataFrame:
    """channel, sample_index, time_us, value after the filters; each block is filtered with context and cut back.

    Gaps are filled over the whole channel first, whatever the blocks (`outside`: see over_blocks). The regression of
    sinusoids refuses gaps.
    """
    halo = dsp.padding(settings, rate_hz)
    filled = settings is None or not settings.show_filtered or settings.method != "regression"

    def run(channel: int, number: int, at: np.ndarray, time: np.ndarray, value: np.ndarray) -> dict[str, np.ndarray]:
        a, b = np.searchsorted(at, (number * block, (number + 1) * block))
        found = dsp.prepare(value, rate_hz, settings, int(at[0]))[a:b]
        return {"channel": np.full(b - a, channel, np.int32), "sample_index": at[a:b], "time_us": time[a:b], "value": found}

    rows = over_blocks(df, block, halo, run, "channel int, sample_index long, time_us double, value double", filled=filled, outside=outside)
    return rows.withColumn("time_us", F.when(~F.isnan("time_us"), F.col("time_us")))


def coarse(df: DataFrame, settings: dsp.Settings | None, rate_hz: float, step: int, block: int = BLOCK) -> DataFrame:
    """Filtered at full resolution, then strided from the first sample; the order can't be changed."""
    return filtered(df, settings, rate_hz, block).where(F.col("sample_index") % step == 0).withColumn("value", F.col("value").cast("float"))


def overview_filtered(df: DataFrame, settings: dsp.Settings, rate_hz: float, step: int, block: int = BLOCK) -> DataFrame:
    """Strided first, then filtered at the lower rate: for navigation only."""
    thin = df.where(F.col("sample_index") % step == 0).withColumn("sample_index", (F.col("sample_index") / step).cast("long"))
    return filtered(thin, settings, rate_hz / step, block)


def regression(df: DataFrame, settings: dsp.Settings, rate_hz: float, block: int = BLOCK) -> DataFrame:
    """channel, sample_index, value without the sinusoids: windows of the absolute grid, overlap-added.

    Windows are the same whatever the blocks, and a block sees every window that its samples lie in, so the result doesn't
    depend on any partitioning. A channel's samples have no holes in their index; values that aren't finite are an error.
    """
    frequencies = dsp.regressed_frequencies(settings, rate_hz)
    size, hop = dsp.window_shape(settings, rate_hz)

    def run(channel: int, number: int, at: np.ndarray, time: np.ndarray, value: np.ndarray) -> dict[str, np.ndarray]:
        a, b = np.searchsorted(at, (number * block, (number + 1) * block))
        windows = range(max((int(at[a]) - size) // hop + 1, 0), int(at[b - 1]) // hop + 1)
        left = dsp.without_sinusoids(value, int(at[0]), rate_hz, frequencies, size, hop, windows)
        return {"channel": np.full(b - a, channel, np.int32), "sample_index": at[a:b], "value": left[a:b]}

    return over_blocks(df.withColumn("time_us", F.lit(0.0)), block, size, run, "channel int, sample_index long, value double")


def _segments(df: DataFrame, most: int, rate_hz: float, summed: bool) -> DataFrame:
    """channel, segment, bin, freq, power, centre_sec: half-overlapping segments of `most` samples (all, where a channel has
    fewer), a part at the end left out. With `summed` a block's segments are added up: `segment` is their number.

    A block has the segments that begin in it. Blocks are whole multiples of the step between segments.
    """
    known = df.groupBy("channel").agg(F.count("*").alias("n"), F.max("sample_index").alias("last")).collect()  # a row a channel
    sizes, counts = {r.channel: min(r.n, most) for r in known}, {r.channel: r.last + 1 for r in known}
    step = most - most // 2
    block = step * max(1, BLOCK // step)

    def run(channel: int, number: int, at: np.ndarray, time: np.ndarray, value: np.ndarray) -> dict[str, np.ndarray]:
        size = sizes[channel]
        starts = np.arange(number * block, min((number + 1) * block, counts[channel] - size + 1), step) if size == most else np.zeros(int(number == 0), np.int64)
        first, end = np.searchsorted(at, starts), np.searchsorted(at, starts + size)
        whole = end - first == size
        starts, first = starts[whole], first[whole]
        power = [dsp.segment_power(np.stack([dsp.fill_gaps(value[a : a + size]) for a in first[k : k + 64]]), rate_hz, hann=size >= 8) for k in range(0, len(first), 64)]
        if not power:
            return {}
        freq, n = np.fft.rfftfreq(size, 1 / rate_hz), len(starts)
        if summed:
            power, segment, centre, n = [sum(p.sum(0) for p in power)], np.array([n]), np.zeros(1), 1
        else:
            segment, centre = starts // step if size == most else np.zeros(1, np.int64), (starts + size / 2) / rate_hz
        bins = len(freq)
        return {"channel": np.full(n * bins, channel, np.int32), "segment": np.repeat(segment, bins), "bin": np.tile(np.arange(bins), n), "freq": np.tile(freq, n), "power": np.concatenate(power).ravel(), "centre_sec": np.repeat(centre, bins)}

    return over_blocks(df.withColumn("time_us", F.lit(0.0)), block, most, run, "channel int, segment long, bin long, freq double, power double, centre_sec double")


def psd(df: DataFrame, rate_hz: float, most: int = 4096) -> DataFrame:
    """channel, bin, freq, power: the mean over half-overlapping Hann segments; one plain periodogram under 8 samples."""
    return _segments(df, most, rate_hz, summed=True).groupBy("channel", "bin", "freq").agg((F.sum("power") / F.sum("segment")).alias("power"))


def spectrogram(df: DataFrame, rate_hz: float, most: int = 512) -> DataFrame:
    return _segments(df, most, rate_hz, summed=False).select("channel", "segment", "centre_sec", "bin", "freq", "power")


def find_peaks(df: DataFrame, rate_hz: float, *, settings: dsp.Settings | None = None, height_sigma: float = 8.0, prominence_sigma: float = 6.0, distance_sec: float = 1.0, context_sec: float = 2.0, block: int = BLOCK) -> DataFrame:
    """channel, sample_index, time_sec, value, negative, prominence of the peaks of both polarities.

    First pass: mean and deviation of a channel's finite values. Second: candidates of each block with context, kept by
    the block that owns them. Last: the strongest of near ones, over both polarities (see `dominance`).
    """
    rows = filtered(df, settings, rate_hz, block) if settings is not None else df.select("channel", "sample_index", "time_us", "value")
    distance = max(1, round(rate_hz * distance_sec))
    context = max(distance, round(rate_hz * context_sec))
    v = F.when(finite(F.col("value")), F.col("value"))
    s = F.stddev_pop(v)
    stats = rows.groupBy("channel").agg(F.avg(v).alias("mean"), F.when(s > 0, s).otherwise(EPSILON).alias("sigma"))

    limits = {r.channel: (r.mean, r.sigma) for r in stats.collect()}  # a row a channel

    def run(channel: int, number: int, at: np.ndarray, time: np.ndarray, value: np.ndarray) -> dict[str, np.ndarray]:
        mean, sigma = limits[channel]
        mean, sigma = (np.nan, np.nan) if mean is None else (mean, sigma)
        up, down = dsp.candidate_masks(value, mean + height_sigma * sigma, mean - height_sigma * sigma)
        parts = []
        for sign, mask in ((1, up), (-1, down)):
            tops, found = dsp.block_peaks(sign * value, mask, sign * mean + height_sigma * sigma, prominence_sigma * sigma, distance, context)
            own = at[tops] // block == number
            parts.append((tops[own], np.full(int(own.sum()), sign < 0), found[own]))
        tops, negative, found = (np.concatenate(x) for x in zip(*parts, strict=True))
        return {"channel": np.full(len(tops), channel, np.int32), "sample_index": at[tops], "time_sec": time[tops] / 1e6, "value": value[tops], "negative": negative, "prominence": found}

    schema = "channel int, sample_index long, time_sec double, value double, negative boolean, prominence double"
    return nms(over_blocks(rows, block, context, run, schema), distance, block)


def nms(candidates: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """The strongest of near candidates, over both polarities: by prominence, size and index."""
    order = [("prominence", False), ("_size", False), ("sample_index", True), ("negative", True)]
    rows = candidates.withColumn("_size", F.abs("value"))
    return select(rows, ["channel"], "sample_index", "sample_index", order, gap=distance - 1, longest=0, block=max(block, distance)).drop("_size")


def distant(df: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """Rows (channel, sample_index, value) left when higher ones, the later of equals first, take out all nearer than the distance."""
    rows = df.select("channel", "sample_index", "value")
    return select(rows, ["channel"], "sample_index", "sample_index", [("value", False), ("sample_index", False)], gap=distance - 1, longest=0, block=max(block, distance))


def prominences(df: DataFrame, context: int, block: int = BLOCK) -> DataFrame:
    """channel, sample_index, value, prominence of the rows marked is_high.

    On each side the base is the lowest value before higher ground, within `context` samples; the prominence is the
    height over the higher base. A block holds its samples and the context beside it, whatever the context's length.
    """

    def run(channel: int, number: int, at: np.ndarray, marked: np.ndarray, value: np.ndarray) -> dict[str, np.ndarray]:
        tops = np.flatnonzero((marked > 0) & (at // block == number))
        return {"channel": np.full(len(tops), channel, np.int32), "sample_index": at[tops], "value": value[tops], "prominence": dsp.prominences(value, tops, context)}

    marked = df.withColumn("time_us", F.col("is_high").cast("double"))
    return over_blocks(marked, block, context, run, "channel int, sample_index long, value double, prominence double")
