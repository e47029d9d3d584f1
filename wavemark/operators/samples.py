"""Filters, projections and aggregates of sample tables (channel, sample_index, time_us, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .blocks import ROWS, exact_median, ordered, with_edges, with_previous

EPSILON = 2.220446049250313e-16


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def channel(df: DataFrame, channel_id: int) -> DataFrame:
    """One channel's rows; on a table partitioned by channel the others aren't read."""
    return df.where(F.col("channel") == channel_id)


def time_range(df: DataFrame, start_us: float, end_us: float) -> DataFrame:
    """Rows in the range, both ends included, whichever bound comes first; on a stored table the bounds reach the scan."""
    return df.where(F.col("time_us").between(min(start_us, end_us), max(start_us, end_us)))


def segment_bounds(df: DataFrame, start_us: float, end_us: float) -> DataFrame:
    """Per channel: left (first row at or after the start) and right (first row after the end), by counting."""
    left, right = F.count_if(F.col("time_us") < start_us), F.count_if(F.col("time_us") <= end_us)
    return df.groupBy("channel").agg(left.alias("left_index"), right.alias("right_index"))


def segment_mask(df: DataFrame, start_s: float, end_s: float) -> DataFrame:
    """Rows between two different finite bounds in seconds; an error if the channel has fewer than two there."""
    a, b = min(start_s, end_s), max(start_s, end_s)
    if not (a < b and abs(a) < float("inf") and abs(b) < float("inf")):
        raise ValueError("a segment needs two different finite bounds")
    rows = df.withColumn("record_sec", F.col("time_us") / 1e6).where(F.col("record_sec").between(a, b))
    checked = F.when(F.col("_n") < 2, F.raise_error(F.lit("a segment needs two samples")).cast("double")).otherwise(F.col("record_sec"))
    return rows.join(F.broadcast(rows.groupBy("channel").agg(F.count("*").alias("_n"))), "channel").withColumn("record_sec", checked).drop("_n")  # a row a channel


def index_range(df: DataFrame, left: int, right: int) -> DataFrame:
    """Rows whose index is in [left, right), both clamped to the recording."""
    left = max(left, 0)
    return df.where((F.col("sample_index") >= left) & (F.col("sample_index") < max(right, left)))


def stride(df: DataFrame, step: int, left: int = 0) -> DataFrame:
    """Every step-th row counted from `left`."""
    if step < 1:
        raise ValueError("a stride is at least 1")
    return df.where((F.col("sample_index") >= left) & ((F.col("sample_index") - left) % step == 0))


def overview(df: DataFrame, most: int) -> DataFrame:
    """Every k-th row of each channel from the first, k = count // most; counts are a row a channel and are broadcast."""
    steps = df.groupBy("channel").agg(F.greatest(F.floor(F.count("*") / most), F.lit(1).cast("long")).alias("step"))
    return df.join(F.broadcast(steps), "channel").where(F.col("sample_index") % F.col("step") == 0)


def bounds(df: DataFrame) -> DataFrame:
    return df.groupBy("channel").agg(F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"))


def edge_values(df: DataFrame) -> DataFrame:
    """First and last value of each channel, without its times."""
    return df.groupBy("channel").agg(F.min_by("value", "sample_index").alias("first_value"), F.max_by("value", "sample_index").alias("last_value"))


def counts(df: DataFrame) -> DataFrame:
    return df.groupBy("channel").agg(F.count("*").alias("n"))


def chunk_stats(df: DataFrame, rows: int) -> DataFrame:
    """Count, mean and sum of squared deviations of the finite values of each chunk."""
    v = F.when(finite(F.col("value")), F.col("value"))
    return df.groupBy("channel", F.floor(F.col("sample_index") / rows).alias("chunk")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))


def merge_stats(chunks: DataFrame) -> DataFrame:
    """Chunk statistics merged: sum of m2 plus the spread of the chunk means around the whole mean."""
    whole = chunks.where("n > 0").groupBy("channel").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum("m2").alias("inner"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("squares"))
    return whole.select("channel", "n", "mean", (F.col("inner") + F.col("squares") - F.col("n") * F.col("mean") * F.col("mean")).alias("m2"))


def mean_std(df: DataFrame) -> DataFrame:
    """Mean and population deviation of the finite values; the machine's epsilon where there is no spread."""
    v = F.when(finite(F.col("value")), F.col("value"))
    std = F.stddev_pop(v)
    return df.groupBy("channel").agg(F.avg(v).alias("mean"), F.when(std > 0, std).otherwise(EPSILON).alias("std"))


def median_rate(df: DataFrame) -> DataFrame:
    """1e6 over the exact median of the positive time steps."""
    step = F.col("time_us") - F.lag("time_us").over(ordered(["channel"], "sample_index"))
    steps = with_edges(df.select("channel", "sample_index", "time_us"), 1, 0).withColumn("d", step).where("_own and d > 0")
    return exact_median(steps, "d", ["channel"]).select("channel", (1e6 / F.col("median")).alias("rate_hz"))


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing cells per column of each channel, and all of them."""
    lacks = lambda c: F.count_if(F.col(c).isNull() | F.isnan(F.col(c)))
    return df.groupBy("channel").agg(lacks("time_us").alias("missing_time"), lacks("value").alias("missing_value")).withColumn("missing", F.col("missing_time") + F.col("missing_value"))


def expected_step(rate_hz: float) -> int:
    """Microseconds between samples, half to even."""
    return round(1e6 / rate_hz)


def gaps(df: DataFrame, rate_hz: float, order: tuple[str, ...] = ("sample_index",)) -> DataFrame:
    """Each valid time's step from the valid time before it: duplicate (0), discontinuity (not the expected step), ok.

    The time before always advances, so the row after a duplicate is measured from the duplicate. Rows are put in order
    within blocks of the first column of `order`.
    """
    rows = with_previous(df.where("time_us is not null"), F.col("time_us"), "_last", ["channel"], order[0], ROWS, order[1:]).drop("_block")
    step = F.col("time_us") - F.col("_last")
    kind = F.when(F.col("gap_us").isNull(), "first").when(F.col("gap_us") == 0, "duplicate").when(F.col("gap_us") != expected_step(rate_hz), "discontinuity").otherwise("ok")
    return rows.withColumn("gap_us", step).withColumn("kind", kind).drop("_last")


def anomaly_counts(df: DataFrame, rate_hz: float) -> DataFrame:
    g = gaps(df, rate_hz)
    return g.groupBy("channel").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "duplicate").alias("duplicates"), F.count_if(F.col("kind") == "discontinuity").alias("discontinuities"))


def check_report(wide: DataFrame, rate_hz: float, header_row: int, channels: list[int], file: str, chunk_rows: int = ROWS) -> DataFrame:
    """ord, Type, File, Value: the rows of a check of a recording (row from 0, time_us, channel_<id>), in the order of `ord`.

    Seven rows of summary, then every missing cell and every valid time that isn't the expected step after the valid
    time before it, with its line in the file: by chunk of rows, missing cells by column first.
    """
    step, row = expected_step(rate_hz), F.col("row")
    line = F.concat(F.lit("line "), (row + header_row + 2).cast("string"))
    chunk = F.floor(row / chunk_rows)
    time = F.when(finite(F.col("time_us")), F.col("time_us").cast("long"))
    # The texts.
    shown = F.coalesce(F.concat(time.cast("string"), F.lit(" us")), F.lit("missing"))
    names = ["Time[us]", *map(str, channels)]
    cells = [F.struct(F.lit(k).alias("column"), F.lit(n).alias("name"), ~finite(F.col(c).cast("double")) | F.col(c).isNull()) for k, (n, c) in enumerate(zip(names, ["time_us", *(f"channel_{x}" for x in channels)], strict=True))]
    lost = wide.select("row", F.col("time_us"), F.explode(F.filter(F.array(*cells), lambda x: x["col3"])).alias("x"))
    missing = lost.select(F.array(chunk, F.lit(0), F.col("x.column"), row).alias("at"), F.lit("Missing value").alias("Type"), line.alias("File"), F.concat(F.lit("time="), shown, F.lit(", channel="), F.col("x.name")).alias("Value"))
    valid = with_previous(wide.select("row", time.alias("t")).where("t is not null"), F.col("t"), "last", [], "row", ROWS).drop("_block")
    gap = F.col("t") - F.col("last")
    value = F.format_string(f"%d -> %d us (actual: %d us, expected: {step} us)", F.col("last"), F.col("t"), gap)
    odd = valid.where(gap != step).select(F.array(chunk, F.lit(1), F.lit(0), row).alias("at"), F.when(gap == 0, "Duplicate timestamp").otherwise("Time discontinuity").alias("Type"), line.alias("File"), value.alias("Value"))
    details = missing.unionByName(odd)
    counted = details.agg(*(F.count_if(F.col("Type") == x).cast("string").alias(n) for n, x in (("m", "Missing value"), ("d", "Duplicate timestamp"), ("j", "Time discontinuity"))))
    one = counted.crossJoin(wide.agg(F.count("*").cast("string").alias("n")))
    items = [("Summary", F.lit(file), F.lit("")), ("Rows", F.lit(""), F.col("n")), ("Sample rate", F.lit(""), F.lit(f"{float(rate_hz)} Hz")), ("Expected interval", F.lit(""), F.lit(f"{step} us")), ("Missing values", F.lit(""), F.col("m")), ("Duplicate timestamps", F.lit(""), F.col("d")), ("Discontinuous timestamps", F.lit(""), F.col("j"))]
    summary = one.select(F.posexplode(F.array(*(F.struct(F.lit(a).alias("Type"), b.alias("File"), c.alias("Value")) for a, b, c in items))).alias("k", "x"))
    head = summary.select(F.lit(0).alias("part"), F.array(F.col("k").cast("long")).alias("at"), "x.Type", "x.File", "x.Value")
    return head.unionByName(details.select(F.lit(1).alias("part"), "at", "Type", "File", "Value")).select(F.struct("part", "at").alias("ord"), "Type", "File", "Value")


def waveform(df: DataFrame, step: int, origin_sec: float) -> DataFrame:
    """The series a plot shows: a stride (0: all; none if the channel has no more rows than the step), time from an origin."""
    rows = df
    if step >= 1:
        rows = df.join(F.broadcast(counts(df)), "channel").where((F.col("n") <= step) | (F.col("sample_index") % step == 0))  # a row a channel
    return rows.select("channel", "sample_index", (F.col("time_us") / 1e6 - origin_sec).alias("plot_sec"), "value")


def axis_limits(df: DataFrame, margin: float = 0.05) -> DataFrame:
    """Full time range, and the values' range with a margin."""
    v = F.when(finite(F.col("value")), F.col("value"))
    r = df.groupBy("channel").agg((F.min("time_us") / 1e6).alias("x_min"), (F.max("time_us") / 1e6).alias("x_max"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    pad = (F.col("hi") - F.col("lo")) * margin
    return r.select("channel", "x_min", "x_max", (F.col("lo") - pad).alias("y_min"), (F.col("hi") + pad).alias("y_max"))


def playback_windows(df: DataFrame, now_sec: float, width: float = 30.0) -> DataFrame:
    """Rows of the tumbling window that holds the playhead and of its two neighbours."""
    k = int(now_sec // width)
    return df.withColumn("bucket", F.floor(F.col("time_us") / (width * 1e6))).where(F.col("bucket").between(k - 1, k + 1))


def sample_rates(df: DataFrame, rates: list[float | None], channels: list[int]) -> DataFrame:
    """A rate per channel: by position among the positive rates, else the first of them, else from the times.

    Rates that aren't positive go before positions are counted, so later positions move up.
    """
    good = [float(r) for r in rates if r and r > 0]
    known = {c: good[k] if k < len(good) else good[0] if good else None for k, c in enumerate(channels)}
    inferred = median_rate(df)
    given = F.lit(None).cast("double")
    for c, r in known.items():
        given = F.when(F.col("channel") == c, F.lit(r).cast("double")).otherwise(given)
    return df.select("channel").distinct().join(inferred, "channel", "left").select("channel", F.coalesce(given, "rate_hz").alias("rate_hz"))
