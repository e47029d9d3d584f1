"""TTL event files: absolute and record times in microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.time_math import record_time_parts
from . import files

#: Spellings of the record time's column, in lower case.
RECORD_NAMES = ("record_time(us)", "recording_time(us)", "record time(us)")


def columns_of(names: list[str]) -> tuple[str, str]:
    """(absolute, record): the first name that ends with `_time(us)` as written, else the first; a known record name in
    any case, else the second. A column named `record_time(us)` that comes first serves both.
    """
    if len(names) < 2:
        raise ValueError("a TTL file needs two columns")
    absolute = next((n for n in names if n.endswith("_time(us)")), names[0])
    return absolute, next((n for n in names if n.lower() in RECORD_NAMES), names[1])


def _whole(text: Column) -> Column:
    """The number's whole part, rounded towards zero; null where the text isn't a number."""
    x = F.trim(text).try_cast("decimal(28,9)")
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")


def local_text(us: Column, hours: int = 8) -> Column:
    """ISO text of an absolute time at a fixed offset from UTC, whatever the session's zone."""
    at = F.timestamp_micros(us + hours * 3_600_000_000)
    return F.date_format(F.to_utc_timestamp(F.from_utc_timestamp(at, F.current_timezone()), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def parse_rows(df: DataFrame) -> DataFrame:
    """Rows of a TTL table whose two times are numbers, with local_time_us, record_time and its parts."""
    absolute, record = columns_of([n for n in df.columns if n != "event_id"])
    rows = df.withColumn("local_time_us", _whole(F.col(f"`{absolute}`"))).withColumn("record_time", _whole(F.col(f"`{record}`")))
    rows = rows.where("local_time_us is not null and record_time is not null")
    names = ("record_hours", "record_minutes", "record_seconds", "record_microseconds")
    return rows.withColumns(dict(zip(names, record_time_parts(F.col("record_time")), strict=True)))


def record_text(us: Column) -> Column:
    """HH:MM:SS.ffffff; hours go on beyond a day."""
    return F.format_string("%02d:%02d:%02d.%06d", *record_time_parts(us))


def write(rows: DataFrame, path: str) -> None:
    """marker_index, local_us and us of TTL markers as one CSV file in the order of the index."""
    named = {"marker_index": F.col("marker_index"), "local_time(us)": F.col("local_us"), "local_time": local_text(F.col("local_us")), "record_time(us)": F.col("us"), "record_time": record_text(F.col("us"))}
    files.write_csv(rows.select(*(c.alias(n) for n, c in named.items())), path, list(named), ["marker_index"])


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse_rows(spark.read.csv(path, header=True))
