"""Ordered operators: local maxima, plateaus, gap interpolation, islands, allocation and even sampling.

Rows are put in order within (channel, block), see `blocks`; sample_index counts a channel's rows without holes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .blocks import ROWS, ordered, with_edges, with_largest_before, with_nearest, with_number, with_previous, with_run
from .markers import number_rows
from .samples import finite


def before(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def local_extrema(df: DataFrame, high: Column | float, low: Column | float, block: int = ROWS) -> DataFrame:
    """positive/negative candidate masks: a finite triple, not under (over) either neighbour, threshold included."""
    w = ordered(["channel"], "sample_index")
    rows = with_edges(df, 1, 1, size=block).withColumn("_a", F.lag("value").over(w)).withColumn("_b", F.lead("value").over(w)).where("_own")
    a, v, b = F.col("_a"), F.col("value"), F.col("_b")
    whole = finite(a) & finite(v) & finite(b)
    high, low = (x if isinstance(x, Column) else F.lit(x) for x in (high, low))
    up, down = whole & (v >= a) & (v >= b) & (v >= high), whole & (v <= a) & (v <= b) & (v <= low)
    return rows.withColumn("is_high", F.coalesce(up, F.lit(False))).withColumn("is_low", F.coalesce(down, F.lit(False))).drop("_a", "_b", "_block", "_own")


def plateaus(df: DataFrame, block: int = ROWS) -> DataFrame:
    """Each flat maximum's middle (rounded down): runs of equal values strictly above both neighbours, edges excluded."""
    w = ordered(["channel"], "sample_index")
    rows = with_edges(df, 1, 1, size=block).withColumn("_a", F.lag("value").over(w)).withColumn("_b", F.lead("value").over(w)).where("_own").drop("_own")
    rows = with_run(rows, ~F.coalesce(F.col("_a") == F.col("value"), F.lit(False)), "left", ["channel"], "sample_index")
    at = F.col("sample_index")
    edges = rows.groupBy("channel", "left").agg(F.max(at).alias("right"), F.first("value").alias("value"), F.min_by("_a", at).alias("before"), F.max_by("_b", at).alias("after"))
    return edges.where("value > before and value > after").select("channel", F.floor((F.col("left") + F.col("right")) / 2).alias("sample_index"), "left", "right", "value")


def fill_gaps(df: DataFrame, block: int = ROWS) -> DataFrame:
    """Values that aren't finite become linear in the index; ends take the nearest value, channels without any take 0."""
    good = F.when(finite(F.col("value")), F.struct("sample_index", "value"))
    rows = with_nearest(df, good, "a", "b", ["channel"], "sample_index", block)
    i, a, b = F.col("sample_index"), F.col("a"), F.col("b")
    line = a["value"] + (b["value"] - a["value"]) * (i - a["sample_index"]) / (b["sample_index"] - a["sample_index"])
    filled = F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull(), b["value"]).when(b.isNull(), a["value"]).when(a["sample_index"] == b["sample_index"], a["value"]).otherwise(line)
    return rows.withColumn("filled", filled).drop("a", "b")


def regression_windows(df: DataFrame, window: int, hop: int, columns: int) -> DataFrame:
    """channel, window_start, left, right, n: windows on the grid of whole multiples of the hop that cover enough samples."""
    n = df.groupBy("channel").agg(F.min("sample_index").alias("first"), F.max("sample_index").alias("last"))
    start = F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.ceil((F.col("first") - window + 1) / hop)), F.floor(F.col("last") / hop)))
    w = n.select("channel", "first", "last", start.alias("k")).withColumn("window_start", F.col("k") * hop)
    w = w.select("channel", "window_start", F.greatest("window_start", "first").alias("left"), F.least(F.col("window_start") + window, F.col("last") + 1).alias("right"))
    return w.withColumn("n", F.col("right") - F.col("left")).where(F.col("n") >= columns)


def merge_ranges(df: DataFrame, touch: float = 1e-9, width: float = 3600.0) -> DataFrame:
    """Ranges (channel, left, right) that overlap or touch, united. Left ends are put in order within blocks of `width`."""
    rows = with_largest_before(df.groupBy("channel", "left").agg(F.max("right").alias("right")), "right", "_far", ["channel"], "left", width)  # a row a left end: no ties
    islands = with_run(rows, F.coalesce(F.col("left") > F.col("_far") + touch, F.lit(True)), "_island", ["channel"], "left")
    return islands.groupBy("channel", "_island").agg(F.min("left").alias("left"), F.max("right").alias("right")).drop("_island")


def allocate_points(df: DataFrame, budget: Column | int) -> DataFrame:
    """A point budget (a column: each channel's own) dealt to the ranges (channel, left, right) by duration: largest remainders get what is left over.

    Sums are a row a channel; ranges are put in order of their remainders in buckets of those.
    """
    rows = df.withColumn("length", F.greatest(F.col("right") - F.col("left"), F.lit(0.0))).withColumn("points", F.lit(budget).cast("double"))
    per = rows.groupBy("channel").agg(F.sum("length").alias("whole"), F.count("*").alias("k"))
    rows = rows.join(F.broadcast(per), "channel")
    share = F.when(F.col("whole") > 0, F.col("length") * (F.col("points") / F.col("whole"))).otherwise(F.col("points") / F.col("k"))
    rows = rows.withColumn("share", share).withColumn("base", F.floor("share")).withColumn("rest", F.col("share") - F.col("base"))
    given = rows.groupBy("channel").agg(F.sum("base").alias("given"))
    ranked = number_rows(rows, F.floor((1 - F.col("rest")) * 1024), [F.desc("rest"), "left"], "place", ("channel",))
    more = F.when(F.col("place") <= F.col("points") - F.col("given"), 1).otherwise(0)
    return ranked.join(F.broadcast(given), "channel").select("channel", "left", "right", (F.col("base") + more).alias("points"))


def even_sample(df: DataFrame, most: Column | int, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """At most `most` rows (a column: each group's own number) of each channel, or of each group of `keys`, evenly spread
    over the row numbers, ends included."""
    rows = with_number(df, "r", "n", list(keys), "sample_index", ROWS)
    most, last = F.lit(most).cast("long"), F.greatest(F.col("n") - 1, F.lit(1))
    # row r is taken if some k has floor(k (n-1) / (most-1)) = r: the least such k is the one to test
    k = F.ceil(F.col("r") * (most - 1) / last)
    taken = (F.col("n") <= most) | (most == 1) & (F.col("r") == 0) | (most > 1) & (F.floor(k * last / F.greatest(most - 1, F.lit(1))) == F.col("r"))
    return rows.where(taken).drop("r", "n")


def carry_concat(df: DataFrame) -> DataFrame:
    """Partial chunks (channel, left, right) in order, with a separator row where one doesn't start at the last one's end."""
    rows = with_previous(df, F.col("right"), "end", ["channel"], "left", ROWS)
    breaks = rows.where("end < left").select("channel", F.col("end").alias("left"), F.col("left").alias("right"), F.lit(True).alias("is_gap"))
    return rows.select("channel", "left", "right", F.lit(False).alias("is_gap")).unionByName(breaks)


def bridge_notches(df: DataFrame, notches: list[float], quality: float) -> DataFrame:
    """Spectrum rows (channel, bin, freq, db): runs of bins near a notch become a line between the bins beside them.

    A bin is near if it is within max(notch / (2 quality), 2 bins) of it; runs at an edge of the spectrum stay.
    """
    w = before(["channel"], ["bin"])
    rows = df.withColumn("step", F.col("freq") - F.lag("freq").over(w))
    width = rows.where("step > 0").groupBy("channel").agg(F.median("step").alias("bin_hz"))
    rows = rows.join(F.broadcast(width), "channel")
    near = F.lit(False)
    for f in notches:
        near = near | (F.abs(F.col("freq") - f) <= F.greatest(F.lit(f / (2 * quality)), 2 * F.col("bin_hz")))
    good = F.when(~near, F.struct("freq", "db"))
    a = F.last(good, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = F.last(good, True).over(before(["channel"], [F.desc("bin")]).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("near", near).withColumn("a", a).withColumn("b", b)
    line = F.col("a.db") + (F.col("b.db") - F.col("a.db")) * (F.col("freq") - F.col("a.freq")) / (F.col("b.freq") - F.col("a.freq"))
    sound = F.col("near") & F.col("a").isNotNull() & F.col("b").isNotNull() & finite(F.col("a.db")) & finite(F.col("b.db"))
    return rows.select("channel", "bin", "freq", F.when(sound, line).otherwise(F.col("db")).alias("db"))


def overlap_add(df: DataFrame) -> DataFrame:
    """Weighted mean of window contributions per sample (channel, sample_index, part, weight); 0 where nothing covers."""
    w = F.sum("weight")
    return df.groupBy("channel", "sample_index").agg(F.when(w > 2.220446049250313e-16, F.sum(F.col("part") * F.col("weight")) / w).otherwise(0.0).alias("value"))
