"""The library's canonical tables over the star schema's `events` and `embeddings`, in Spark and as oracle SQL.

samples(channel, sample_index, time_us, value, event_id), samples_dirty (gaps and repeated times), markers, peaks,
led_curve and vectors. Recordings that were imported by `signal_csv` carry sample_index already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.blocks import ordered, with_edges
from ..operators.markers import number_rows
from .shared import fresh_path

#: Events stand in for channels and for marker kinds.
CHANNELS = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
KINDS = {"signup": "ttl", "click": "led_on", "view": "led_off", "purchase": "action_start", "error": "action_end"}
SOURCES = {"signup": "ttl_csv", "click": "led_detection", "view": "led_detection", "purchase": "manual", "error": "manual"}
FPS, RATE_HZ = 30.0, 1000.0


def _case(values: dict) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(F.col("event_type") == k, v)
    return out


def _sql_case(values: dict) -> str:
    lit = lambda v: str(v) if isinstance(v, int) else f"'{v}'"
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in values.items()) + " END"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in microseconds from the first one; the one-row minimum is broadcast."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    first = rows.agg(F.min("us").alias("first_us"))
    return rows.crossJoin(F.broadcast(first)).withColumn("time_us", (F.col("us") - F.col("first_us")).cast("double"))


#: Where an application's stored tables are, by name, source and time of its last change.
_stored: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, schema: str, order: list[str], make: Callable[[], DataFrame], by: list[str] = ()) -> DataFrame:
    """A table over the events that is written once an application, at its first use: folders by `by`, rows in order within files."""
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    changed = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(source).getModificationTime()
    key = (spark.sparkContext.applicationId, name, sf_dir, changed)
    if key not in _stored:
        path = fresh_path(spark, name)
        make().repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(*by).parquet(path)
        _stored[key] = path
    return spark.read.schema(schema).parquet(_stored[key])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored sample table of the events: a folder a channel, rows in order, so filters of channel, index and time reach the scan.

    Rows are numbered within (channel, ten minutes), see number_rows.
    """

    def make() -> DataFrame:
        rows = events(spark, sf_dir).select(_case(CHANNELS).alias("channel"), "time_us", "value", F.col("event_id").cast("long").alias("event_id"))
        rows = number_rows(rows, F.floor(F.col("time_us") / 600e6), ["time_us", "event_id"], keys=("channel",))
        return rows.select("channel", (F.col("number") - 1).cast("long").alias("sample_index"), "time_us", "value", "event_id")

    schema = "sample_index long, time_us double, value double, event_id long, channel int"
    return stored(spark, sf_dir, "samples", schema, ["channel", "sample_index"], make, ["channel"]).select("channel", "sample_index", "time_us", "value", "event_id")


def samples_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 97th event lacks its value; every 53rd repeats the time of the row before it."""
    before = F.lag("time_us").over(ordered(["channel"], "sample_index"))
    rows = with_edges(samples(spark, sf_dir), 1, 0).withColumn("before", before).where("_own")
    repeated = F.when(F.col("event_id") % 53 == 0, F.coalesce("before", "time_us")).otherwise(F.col("time_us"))
    return rows.select("channel", "sample_index", repeated.alias("time_us"), F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("value"), "event_id")


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("kind", _case(KINDS)).withColumn("time_sec", F.col("time_us") / 1e6)
    video = F.col("kind") != "ttl"
    return rows.select(
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("marker_id"), F.col("event_id").alias("seq"), "kind", _case(SOURCES).alias("source"),
        F.when(video, "video").otherwise("record").alias("domain"), "time_sec", F.when(video, F.rint(F.col("time_sec") * FPS).cast("long")).alias("frame_index"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("note "), F.col("event_id").cast("string"))).otherwise("").alias("note"), "value", F.col("user_id"),
    )


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record-domain peak markers: events with a value over 40; an odd id turns the sign, every 7th lacks a channel."""
    value = F.when(F.col("event_id") % 2 == 1, -F.col("value")).otherwise(F.col("value"))
    rows = events(spark, sf_dir).where("value > 40")
    return rows.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 != 0, (F.col("user_id") % 3 + 1).cast("long")).alias("channel"), (F.col("time_us") / 1e6).alias("time_sec"),
        value.alias("value"), F.when(F.col("event_id") % 5 != 0, value < 0).alias("negative"), F.when(F.col("event_id") % 4 == 0, "manual").otherwise("auto").alias("source"),
    )


def led_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored curve of a frame an event, numbered in buckets of a day."""

    def make() -> DataFrame:
        rows = number_rows(events(spark, sf_dir), F.floor(F.col("time_us") / 86_400e6), ["time_us", "event_id"])
        return rows.select((F.col("number") - 1).cast("long").alias("frame_index"), (F.col("value") / 500).alias("brightness"), F.col("event_id").cast("long").alias("event_id"))

    curve = stored(spark, sf_dir, "led-curve", "frame_index long, brightness double, event_id long", ["frame_index"], make)
    return curve.withColumn("video_time_sec", F.col("frame_index") / FPS)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


SQL = {
    "ev": "SELECT *, epoch_us(ts) AS us, CAST(epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS DOUBLE) AS time_us FROM events",
    "samples": f"SELECT {_sql_case(CHANNELS)} AS channel, row_number() OVER (PARTITION BY event_type ORDER BY time_us, event_id) - 1 AS sample_index, time_us, value, event_id FROM ev",
    "samples_dirty": "SELECT channel, sample_index, CASE WHEN event_id % 53 = 0 THEN coalesce(lag(time_us) OVER (PARTITION BY channel ORDER BY sample_index), time_us) ELSE time_us END AS time_us, CASE WHEN event_id % 97 <> 0 THEN value END AS value, event_id FROM samples",
    "markers": f"SELECT 'm' || event_id AS marker_id, event_id AS seq, {_sql_case(KINDS)} AS kind, {_sql_case(SOURCES)} AS source, CASE WHEN event_type = 'signup' THEN 'record' ELSE 'video' END AS domain, time_us / 1e6 AS time_sec, CASE WHEN event_type <> 'signup' THEN CAST(round_even(time_us / 1e6 * {FPS}, 0) AS BIGINT) END AS frame_index, CASE WHEN event_id % 3 = 0 THEN 'note ' || event_id ELSE '' END AS note, value, user_id FROM ev",
    "peaks": "SELECT event_id AS seq, CASE WHEN event_id % 7 <> 0 THEN user_id % 3 + 1 END AS channel, time_us / 1e6 AS time_sec, CASE WHEN event_id % 2 = 1 THEN -value ELSE value END AS value, CASE WHEN event_id % 5 <> 0 THEN event_id % 2 = 1 END AS negative, CASE WHEN event_id % 4 = 0 THEN 'manual' ELSE 'auto' END AS source FROM ev WHERE value > 40",
    "led_curve": f"SELECT row_number() OVER (ORDER BY time_us, event_id) - 1 AS frame_index, value / 500 AS brightness, event_id, (row_number() OVER (ORDER BY time_us, event_id) - 1) / {FPS} AS video_time_sec FROM ev",
    "vectors": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
}
NEEDS = {"samples": ("ev",), "samples_dirty": ("ev", "samples"), "markers": ("ev",), "peaks": ("ev",), "led_curve": ("ev",), "vectors": (), "ev": ()}


def with_views(*names: str, then: str, more: str = "") -> str:
    """`then` with the named views (and what they need) before it as common table expressions; `more` adds own ones."""
    order = [v for v in SQL if v in {x for n in names for x in (n, *NEEDS[n])}]
    parts = [f"{v} AS ({SQL[v]})" for v in order] + ([more] if more else [])
    return "WITH " + ", ".join(parts) + " " + then
