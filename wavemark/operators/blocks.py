"""Ordered operators over blocks: what a row needs of rows before or after it, without a task for a whole channel.

A block is a range of the ordering column, so blocks of a channel follow each other. Rows are ordered within
(keys, block); what goes over a block's edge is a value a block, and only those values meet in a window of their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import fresh_path

#: Rows of a block where the ordering column counts rows.
ROWS = 250_000


def _ends(rows: DataFrame, keys: list[str], found: dict[str, Column], ahead: bool = False) -> DataFrame:
    """keys, _block and for each name the nearest value that isn't null of the blocks before (or after, with `ahead`)."""
    per = rows.groupBy(*keys, "_block").agg(*(c.alias(n) for n, c in found.items()))
    w = Window.partitionBy(*keys).orderBy(F.desc("_block") if ahead else F.asc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, "_block", *(F.last(n, True).over(w).alias(n) for n in found))


def in_blocks(df: DataFrame, at: str, size: float) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(at) / size))


def with_edges(df: DataFrame, before: int, after: int, at: str = "sample_index", size: int = ROWS) -> DataFrame:
    """Each row in its block, and again in blocks that it lies `before` or `after` rows from; `_own` marks the first.

    For tables without holes in the ordering column: a block then has all that a frame of its rows needs.
    """
    i = F.col(at)
    first, last = F.greatest(F.floor((i - after) / size), F.lit(0).cast("long")), F.floor((i + before) / size)
    return df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_own", F.floor(i / size) == F.col("_block"))


def ordered(keys: list[str], *order):
    """The window of a block's rows."""
    return Window.partitionBy(*keys, "_block").orderBy(*order)


def with_previous(df: DataFrame, value: Column, name: str, keys: list[str], at: str, size: float, ties: tuple[str, ...] = ()) -> DataFrame:
    """`name`: the value in the row before, in the order of `at` and `ties`; null in a key's first row. Keeps `_block`."""
    order = [at, *ties]
    rows = in_blocks(df, at, size).withColumn("_v", F.struct(value.alias("v"))).repartition(*keys, "_block")  # once for both
    carried = _ends(rows, keys, {"_carried": F.max_by("_v", F.struct(*order))})
    before = F.coalesce(F.lag("_v").over(ordered(keys, *order)), F.col("_carried"))
    return rows.join(carried, [*keys, "_block"]).withColumn(name, before["v"]).drop("_v", "_carried")


def with_nearest(df: DataFrame, value: Column, before: str, after: str, keys: list[str], at: str, size: float) -> DataFrame:
    """The nearest values that aren't null at or before each row, and at or after it; rows with equal `at` see each other's."""
    rows = in_blocks(df, at, size).withColumn("_v", value).repartition(*keys, "_block")
    there = F.when(F.col("_v").isNotNull(), F.col(at))
    back, ahead = _ends(rows, keys, {"_back": F.max_by("_v", there)}), _ends(rows, keys, {"_ahead": F.min_by("_v", there)}, ahead=True)
    up = F.last("_v", True).over(ordered(keys, F.asc(at)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    down = F.last("_v", True).over(ordered(keys, F.desc(at)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.join(back.join(ahead, [*keys, "_block"]), [*keys, "_block"])
    return rows.withColumn(before, F.coalesce(up, "_back")).withColumn(after, F.coalesce(down, "_ahead")).drop("_v", "_back", "_ahead", "_block")


def with_latest(df: DataFrame, value: Column, name: str, keys: list[str], at: str, size: float) -> DataFrame:
    """`name`: the value of the last row at or before each row where it isn't null; of rows with equal `at`, any one's. Drops `_block`."""
    rows = in_blocks(df, at, size).withColumn("_v", value).repartition(*keys, "_block")
    back = _ends(rows, keys, {"_back": F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(at)))})
    inside = F.last("_v", True).over(ordered(keys, at).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.join(back, [*keys, "_block"]).withColumn(name, F.coalesce(inside, "_back")).drop("_v", "_back", "_block")


def with_sum_before(df: DataFrame, value: str, name: str, keys: list[str], at: str, size: float, ties: tuple[str, ...] = ()) -> DataFrame:
    """`name`: the sum of the value over all rows before, in the order of `at` and `ties`; 0 in a key's first row. Drops `_block`."""
    rows = in_blocks(df, at, size).repartition(*keys, "_block")
    per = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_carried"))
    inside = F.coalesce(F.sum(value).over(ordered(keys, at, *ties).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(per, [*keys, "_block"]).withColumn(name, F.col("_carried") + inside).drop("_carried", "_block")


def with_largest_before(df: DataFrame, value: str, name: str, keys: list[str], at: str, size: float, ties: tuple[str, ...] = ()) -> DataFrame:
    """`name`: the largest value of all rows before, in the order of `at` and `ties`. Keeps `_block`."""
    rows = in_blocks(df, at, size).repartition(*keys, "_block")
    per = rows.groupBy(*keys, "_block").agg(F.max(value).alias("_most"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_block", F.max("_most").over(earlier).alias("_most"))
    inside = F.max(value).over(ordered(keys, at, *ties).rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(per, [*keys, "_block"]).withColumn(name, F.greatest(inside, "_most")).drop("_most")


def with_run(rows: DataFrame, starts: Column, name: str, keys: list[str], at: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """`name`: where the row's run began, the last `at` up to it in a row that starts one. Needs and drops `_block`."""
    rows = rows.withColumn("_start", F.when(starts, F.col(at)))
    carried = _ends(rows, keys, {"_carried": F.max("_start")})
    inside = F.max("_start").over(ordered(keys, at, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.join(carried, [*keys, "_block"]).withColumn(name, F.coalesce(inside, "_carried")).drop("_start", "_carried", "_block")


def with_number(df: DataFrame, number: str, count: str, keys: list[str], at: str, size: float, ties: tuple[str, ...] = ()) -> DataFrame:
    """`number`: the row's place in its key from 0; `count`: the key's rows."""
    rows = in_blocks(df, at, size).repartition(*keys, "_block")
    per = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(*keys, "_block", before.alias("_before"), F.sum("_n").over(w).alias(count))
    inside = F.row_number().over(ordered(keys, at, *ties)) - 1
    return rows.join(per, [*keys, "_block"]).withColumn(number, F.col("_before") + inside).drop("_before", "_block")


def exact_median(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys and `median` of positive values: equal values are counted first and written, and of those only the ones in the
    bins of the middle ranks, a 256th of an octave wide, are put in order."""
    path = fresh_path(df.sparkSession, "value-counts")
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n")).withColumn("_bin", F.floor(F.log2(value) * 256))
    counts.write.parquet(path)
    counts = df.sparkSession.read.schema(counts.schema).parquet(path)
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_n").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bins = bins.select(*keys, "_bin", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), F.sum("_n").over(w).alias("_all"))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1  # the middle ranks, from 1
    middle = bins.where((F.col("_before") < high) & (F.col("_upto") >= low)).select(*keys, "_bin", "_before", "_all")
    inside = counts.join(middle, [*keys, "_bin"])
    rank = F.sum("_n").over(Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_before")
    ranked = inside.withColumn("_rank", rank)
    pick = lambda r: F.min(F.when(F.col("_rank") >= r, F.col(value)))
    return ranked.groupBy(*keys).agg(((pick(low) + pick(high)) / 2).alias("median"))
