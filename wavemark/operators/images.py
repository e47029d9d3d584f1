"""Pictures of series: what a pixel column shows as an aggregate, and an SVG file a channel written by tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.files import file_system
from .samples import finite

#: Share of the values' range that is left free above and below.
MARGIN = 0.05


def pixel_columns(df: DataFrame, left_us: float, right_us: float, width: int) -> DataFrame:
    """channel, px, first, last, low, high: of the finite values between two times, both included, what each of `width`
    columns of a picture shows. A line through them is the picture of all samples."""
    t = F.col("time_us")
    px = F.least(F.floor((t - left_us) / F.lit(float(right_us - left_us)) * width), F.lit(width - 1)).cast("int")
    rows = df.where(t.between(left_us, right_us) & finite(F.col("value"))).withColumn("px", px)
    return rows.groupBy("channel", "px").agg(F.min_by("value", "sample_index").alias("first"), F.max_by("value", "sample_index").alias("last"), F.min("value").alias("low"), F.max("value").alias("high"))


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(text, "[\\x00-\\x1f]+", " ")


def as_svg(columns: DataFrame, width: int, height: int, title: Column) -> DataFrame:
    """channel, svg: a line through first, lowest, highest and last value of each column; `width` columns a channel at most.

    A channel's values fill the picture's height but for a margin; a channel with one value only has it in the middle.
    """
    bounds = F.struct(F.min("low").alias("lo"), F.max("high").alias("hi")).alias("b")
    one = F.array_sort(F.collect_list(F.struct("px", "first", "low", "high", "last"))).alias("columns")
    rows = columns.groupBy("channel").agg(one, bounds)
    pad = (F.col("b.hi") - F.col("b.lo")) * MARGIN
    top, span = F.col("b.hi") + pad, F.col("b.hi") - F.col("b.lo") + 2 * pad

    def point(c: Column, value: str) -> Column:
        y = F.when(span > 0, (top - c[value]) / span * height).otherwise(F.lit(height / 2))
        return F.format_string("%d,%.2f", c["px"], y)

    points = F.array_join(F.flatten(F.transform("columns", lambda c: F.array(*(point(c, v) for v in ("first", "low", "high", "last"))))), " ")
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}"><title>'
    return rows.select("channel", F.concat(F.lit(head), _escaped(title), F.lit('</title><rect width="100%" height="100%" fill="white"/><polyline fill="none" stroke="black" stroke-width="1" points="'), points, F.lit('"/></svg>')).alias("svg"))


def write_svg(pictures: DataFrame, path: str, suffix: str = "raw") -> None:
    """A file a channel in the folder, `channel<id>_<suffix>.svg`; a task writes it and it takes its name in the end."""
    spark = pictures.sparkSession
    parts, fs = file_system(spark, path + ".parts")
    pictures.select("channel", F.col("svg").alias("value")).repartition("channel").write.mode("overwrite").partitionBy("channel").text(path + ".parts")
    target, _ = file_system(spark, path)
    fs.delete(target, True)
    fs.mkdirs(target)
    for folder in fs.listStatus(parts):  # a folder a channel
        name = folder.getPath().getName()
        if name.startswith("channel="):
            found = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            fs.rename(found[0], file_system(spark, f"{path}/channel{name.removeprefix('channel=')}_{suffix}.svg")[0])
    fs.delete(parts, True)


def read_svg(df: DataFrame) -> DataFrame:
    """file, title, points (array of x and y) of texts (file, svg)."""
    points = F.transform(F.filter(F.split(F.xpath_string("svg", F.lit("/svg/polyline/@points")), " "), lambda x: x != ""), lambda p: F.transform(F.split(p, ","), lambda v: v.cast("double")))
    return df.select("file", F.xpath_string("svg", F.lit("/svg/title")).alias("title"), points.alias("points"))
