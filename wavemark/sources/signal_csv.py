"""Signal recordings as CSV with rows of metadata before the data, and as Parquet partitioned by channel.

Files that Python can open are read in windows of bytes (`recording_source`), others by Spark's own CSV reader.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.blocks import ordered, with_edges
from ..operators.markers import number_rows
from .files import qualified, write_lines
from .recording_source import AFTER_HEADER, CHANNELS, TIME, WINDOW, Parts, Recordings, can_open, describe, known_channels, top_of, top_rows

MICROVOLT = ("uv", "µv", "μv")
#: Rows that are looked at first for the header, where only Spark can read the file.
HEAD_ROWS = 64
#: Windows whose row numbers are sent to every task; more are joined by a shuffle.
FEW_WINDOWS = 1 << 20


def _in_order(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows of a reader with where they stand: file (numbers in order), the split's first byte, and the place in it."""
    name = F.col("_metadata.file_name")
    return rows.select("*", F.struct(F.length(name).alias("n"), name.alias("name"), F.col("_metadata.file_block_start").alias("start")).alias("_split"), F.monotonically_increasing_id().alias("_at"))


def head(spark: SparkSession, path: str, rows: int) -> list[list[str]]:
    """The first rows of the file, or of a folder's parts in order; a bounded read on the driver."""
    full = qualified(spark, path)
    if can_open(full):
        return top_rows(Parts(full), rows)[0]
    lines = _in_order(spark, spark.read.text(path)).orderBy("_split", "_at").limit(rows).collect()
    return list(csv.reader(io.StringIO("\n".join(r.value for r in lines).removeprefix("\ufeff"))))


def normalize_unit(unit: str) -> str:
    return "uV" if unit.lower().replace(" ", "") in MICROVOLT else " ".join(unit.split())


def _is_header(line: Column) -> Column:
    return F.trim(F.get(F.split(F.ltrim(line), ","), 0)).isin(TIME, f'"{TIME}"')


def _top_by_spark(spark: SparkSession, path: str) -> dict:
    """As `top_of`: first rows, ever more of them as long as there is a header further down."""
    rows, asked = head(spark, path, HEAD_ROWS), HEAD_ROWS
    while describe(rows)["header_row"] is None and len(rows) >= asked:
        if asked == HEAD_ROWS and spark.read.text(path).where(_is_header(F.col("value"))).isEmpty():
            break
        rows, asked = head(spark, path, 8 * asked), 8 * asked
    header = describe(rows)["header_row"]
    if header is not None and len(rows) <= header + AFTER_HEADER:
        rows = head(spark, path, header + 2 * AFTER_HEADER)
    return describe(rows)


def metadata(spark: SparkSession, path: str) -> dict:
    """channels, sample_rates, header_row (from 0), data_column_count, time_unit and value_unit; see `describe`."""
    full = qualified(spark, path)
    found = top_of(full)[0] if can_open(full) else _top_by_spark(spark, path)
    return found | {"value_unit": normalize_unit(found["value_unit"])}


def info(spark: SparkSession, path: str) -> dict:
    m = metadata(spark, path)
    return {"path": path, "filename": path.rstrip("/").rpartition("/")[2], "channel_count": len(m["channels"]), **m}


def data_header(spark: SparkSession, path: str) -> tuple[int, int]:
    """(row, columns) of the first row whose first cell is the time header; a ValueError if there is none."""
    m = metadata(spark, path)
    if m["header_row"] is None:
        raise ValueError(f"no {TIME} row")
    return m["header_row"], m["data_column_count"]


def preview(spark: SparkSession, path: str, rows: int = 8) -> list[list[str]]:
    return head(spark, path, rows)


def _source(spark: SparkSession, window_bytes: int) -> DataFrameReader:
    spark.dataSource.register(Recordings)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("recording").option("windowBytes", window_bytes).option("pushdown", pushes)


def read(spark: SparkSession, path: str, channels: list[int] | None = None, window_bytes: int = WINDOW) -> DataFrame:
    """row, time_us (double) and channel_<id> (float) of the asked channels, in the file's order.

    Only the asked channels are parsed. Cells that aren't numbers are null, blank lines aren't rows. Channel ids are ids,
    not positions; one that isn't there is an error. A window's first row is the sum of the lines before it, which are
    counted without parsing them.
    """
    m = metadata(spark, path)
    if m["header_row"] is None:
        raise ValueError(f"no {TIME} row")
    known = known_channels(m)
    if missing := set(channels or []) - set(known):
        raise ValueError(f"unknown channels {sorted(missing)}")
    wanted = channels or known
    full = qualified(spark, path)
    if not can_open(full):
        return _read_by_spark(spark, path, m["header_row"], known, wanted)
    rows = _source(spark, window_bytes).option("channels", ",".join(map(str, wanted))).load(full)
    sizes = _source(spark, window_bytes).option("what", "windows").load(full)
    earlier = Window.orderBy("window").rowsBetween(Window.unboundedPreceding, -1)  # a row a window
    first = sizes.select("window", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("first"))
    few = Parts(full).size <= FEW_WINDOWS * window_bytes
    return rows.join(F.broadcast(first) if few else first, "window").select((F.col("first") + F.col("line")).alias("row"), "time_us", *(f"channel_{c}" for c in wanted))


def _read_by_spark(spark: SparkSession, path: str, header_row: int, known: list[int], wanted: list[int]) -> DataFrame:
    """The same by Spark's CSV reader; rows are numbered in the order of files and splits."""
    schema = StructType([StructField(c, StringType()) for c in ["time_us", *(f"channel_{c}" for c in known)]])
    rows = _in_order(spark, spark.read.schema(schema).option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path))
    header = rows.where(F.trim("time_us") == TIME).agg(F.min(F.struct("_split", "_at")).alias("_header"))
    data = rows.crossJoin(F.broadcast(header)).where(F.struct("_split", "_at") > F.col("_header"))  # one row
    numbered = number_rows(data, F.col("_split"), ["_at"], "row")
    return numbered.select((F.col("row") - 1).alias("row"), F.col("time_us").try_cast("double").alias("time_us"), *(F.col(f"channel_{c}").try_cast("float").alias(f"channel_{c}") for c in wanted))


def chunks(spark: SparkSession, path: str, window_bytes: int = WINDOW) -> DataFrame:
    """window, n, first_us, last_us: the rows with a time that each window of bytes after the header has; only times are parsed."""
    full = qualified(spark, path)
    rows = _source(spark, window_bytes).option("channels", "").load(full)
    return rows.where("time_us is not null").groupBy("window").agg(F.count("*").alias("n"), F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"))


def to_long(wide: DataFrame) -> DataFrame:
    """channel, sample_index, time_us, value."""
    names = [c for c in wide.columns if c.startswith("channel_")]
    pairs = F.explode(F.array(*(F.struct(F.lit(int(c[8:])).alias("channel"), F.col(c).alias("value")) for c in names))).alias("s")
    return wide.select(F.col("row").alias("sample_index"), "time_us", pairs).select("s.channel", "sample_index", "time_us", "s.value")


def checked(long: DataFrame) -> DataFrame:
    """The samples; an error where a time isn't finite or goes backwards (repeats are allowed) or a channel has under two rows."""
    rows = with_edges(long, 1, 0).withColumn("_before", F.lag("time_us").over(ordered(["channel"], "sample_index"))).where("_own")
    rows = rows.join(F.broadcast(long.groupBy("channel").agg(F.count("*").alias("_n"))), "channel")  # a row a channel
    bad = F.when(F.col("time_us").isNull() | F.isnan("time_us") | (F.abs("time_us") == float("inf")), "a time isn't finite").when(F.col("time_us") < F.col("_before"), "times go backwards").when(F.col("_n") < 2, "under two samples")
    return rows.withColumn("time_us", F.when(bad.isNotNull(), F.raise_error(bad).cast("double")).otherwise(F.col("time_us"))).select(*long.columns)


def store(long: DataFrame, path: str) -> None:
    """Parquet partitioned by channel, sorted by index within files so that ranges of time skip row groups."""
    long.repartition("channel", F.floor(F.col("sample_index") / 1_000_000)).sortWithinPartitions("channel", "sample_index").write.partitionBy("channel").parquet(path)


def stored_valid(spark: SparkSession, path: str, channels: list[int], rows: int) -> DataFrame:
    """channel, n, valid: whether each expected channel is stored with the expected number of rows and rising times."""
    found = spark.read.parquet(path)
    back = F.col("time_us") < F.lag("time_us").over(ordered(["channel"], "sample_index"))
    per = with_edges(found, 1, 0).withColumn("back", back).where("_own").groupBy("channel").agg(F.count("*").alias("n"), F.count_if("back").alias("backwards"))
    wanted = spark.createDataFrame([(c,) for c in channels], "channel int")
    return wanted.join(per, "channel", "left").select("channel", F.coalesce("n", F.lit(0)).alias("n"), ((F.coalesce("n", F.lit(0)) == rows) & (F.coalesce("backwards", F.lit(1)) == 0)).alias("valid"))


def write_csv(wide: DataFrame, path: str, channels: list[int], rate_hz: float, unit: str = "uV", one_file: bool = False) -> None:
    """CSV with the metadata rows before the data, which many tasks put in order: a folder of parts, the metadata in the
    first; or, for other programs, one file, whose bytes then pass through the driver."""
    def line(name: str, values: list) -> str:
        return ",".join([name, *map(str, values)])

    top = [line(CHANNELS, channels), line("Sample Rate[Hz]", [f"{rate_hz:g}"] * len(channels)), line("Unit", [unit] * len(channels)), line(TIME, [f"Channel {c}" for c in channels])]
    cells = [F.format_string("%.0f", "time_us"), *(F.when(F.col(f"channel_{c}").isNull(), "").otherwise(F.format_string("%.8f", F.col(f"channel_{c}").cast("double"))) for c in channels)]
    lines = wide.orderBy("row").select(F.concat_ws(",", *cells).alias("value"))
    if one_file:
        write_lines(lines, path, "".join(f"{t}\n" for t in top).encode())
    else:
        wide.sparkSession.createDataFrame([(t,) for t in top], "value string").coalesce(1).union(lines).write.mode("overwrite").text(path)
