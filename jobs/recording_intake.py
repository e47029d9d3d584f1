"""Takes recordings in as their files arrive: cleaned samples by day and channel, and a check report of each day.

A file stream with a checkpoint reads each file of the input once. A batch's rows are kept as they came in a folder of
their own (`arrived`). Once the stream has taken all there is, the days that its batches touch are put together anew from
all that ever arrived for them, once however many batches there were; so late rows, rows delivered twice and batches that
run again give the same tables. Other days are neither read nor written. The mark says up to which batch that is done: a
run that broke off before is made good by the next one. A changed config holds for the days touched from then on.

    arrived/state=.../day=.../batch=...   rows as they came; state `taken`, or `rejected` (no id, no time, unknown type)
    samples/day=.../channel=...           one row an event, with its step from the sample before it that day
    report/day=...                        a row a channel: counts, missing values, repeated times, long gaps, limits
    mark                                  one row: the last batch whose days are put together
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wavemark.operators.blocks import with_previous
from wavemark.operators.samples import finite

from .command import main

log = logging.getLogger(__name__)

_ARRIVED = "event_id long, channel int, time_us long, value double, state string, day date, batch long"
_SAMPLES = "event_id long, time_us long, value double, step_us long, kind string, day date, channel int"
_REPORT = "channel int, n long, missing long, repeated_times long, long_gaps long, longest_gap_us long, low double, high double, mean double, first_us long, last_us long, day date"


def _arrivals(rows: DataFrame, channels: dict[str, int], batch: int) -> DataFrame:
    """A batch's rows in the library's terms. Times are wall-clock times, in microseconds from 1970."""
    ts = F.col("ts").cast("timestamp_ntz")
    channel = F.lit(None).cast("int")
    for name, number in channels.items():
        channel = F.when(F.col("event_type") == name, F.lit(number)).otherwise(channel)
    sound = F.col("event_id").isNotNull() & ts.isNotNull() & channel.isNotNull()
    time = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)
    return rows.select(
        F.col("event_id").cast("long").alias("event_id"), channel.alias("channel"), time.alias("time_us"), F.col("value").cast("double").alias("value"),
        F.when(sound, "taken").otherwise("rejected").alias("state"), F.to_date(ts).alias("day"), F.lit(batch).cast("long").alias("batch"),
    )


def _replace(rows: DataFrame, path: str, *by: str) -> None:
    """Writes the rows' partitions in place of those that are there; other partitions stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def checked_samples(arrived: DataFrame, long_gap_us: int, block_us: int) -> DataFrame:
    """One row an event of a day, the first that came (ties: lowest channel, time, value), with its step and what that is.

    Steps are within a day and channel. Rows are put in order in blocks of time, so that a full day of one channel isn't
    one task's.
    """
    first = arrived.groupBy("day", "event_id").agg(F.min(F.struct("batch", "channel", "time_us", "value")).alias("r"))
    rows = first.select("day", "event_id", "r.channel", "r.time_us", "r.value")
    rows = with_previous(rows, F.col("time_us"), "_last", ["day", "channel"], "time_us", block_us, ("event_id",)).drop("_block")
    step = F.col("time_us") - F.col("_last")
    kind = F.when(step.isNull(), "first").when(step == 0, "repeated").when(step > long_gap_us, "gap").otherwise("ok")
    return rows.select("event_id", "time_us", "value", step.alias("step_us"), kind.alias("kind"), "day", "channel")


def day_report(samples: DataFrame) -> DataFrame:
    v = F.when(finite(F.col("value")), F.col("value"))

    def count(which: Column) -> Column:
        return F.count_if(which)

    return samples.groupBy("day", "channel").agg(
        F.count("*").alias("n"), (F.count("*") - F.count(v)).alias("missing"), count(F.col("kind") == "repeated").alias("repeated_times"), count(F.col("kind") == "gap").alias("long_gaps"),
        F.max("step_us").alias("longest_gap_us"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"),
    )


def _last_batch(spark: SparkSession, path: str) -> int:
    """The mark; -1 without one, which means that all days are to be put together."""
    try:
        found = spark.read.schema("batch long").parquet(path).agg(F.max("batch").alias("last")).first().last
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = None
    return -1 if found is None else found


def put_together(spark: SparkSession, paths: dict[str, str], config: dict) -> None:
    """Writes samples and report of every day with rows in a batch after the mark, then the mark."""
    last = _last_batch(spark, paths["mark"])
    taken = spark.read.schema(_ARRIVED).parquet(paths["arrived"]).where("state = 'taken'")
    new = taken.where(F.col("batch") > last)
    newest = new.agg(F.max("batch").alias("batch")).first().batch
    if newest is None:
        log.info("nothing new since batch %d", last)
        return
    days = F.broadcast(new.where(F.col("batch") <= newest).select("day").distinct())  # a row a day
    rows = checked_samples(taken.join(days, "day", "left_semi"), config["long_gap_us"], config["block_us"])
    _replace(rows.hint("rebalance", "day", "channel"), paths["samples"], "day", "channel")
    written = spark.read.schema(_SAMPLES).parquet(paths["samples"]).join(days, "day", "left_semi")
    _replace(day_report(written).hint("rebalance", "day"), paths["report"], "day")
    n = spark.read.schema(_REPORT).parquet(paths["report"]).join(days, "day", "left_semi").agg(F.count_distinct("day").alias("days"), F.sum("n").alias("n")).first()
    log.info("batches %d to %d: wrote %d samples of %d days to %s", last + 1, newest, n.n, n.days, paths["samples"])
    spark.createDataFrame([(newest,)], "batch long").write.mode("overwrite").parquet(paths["mark"])


def run(spark: SparkSession, *, events: str, output: str, checkpoint: str, config: dict) -> dict[str, str]:
    """Takes in what is new among the event files and returns the paths of the tables; with nothing new nothing is written."""
    paths = {name: f"{output.rstrip('/')}/{name}" for name in ("arrived", "samples", "report", "mark")}

    def take(batch: DataFrame, number: int) -> None:
        _replace(_arrivals(batch, config["channels"], number), paths["arrived"], "state", "day", "batch")
        mine = batch.sparkSession.read.schema(_ARRIVED).parquet(paths["arrived"]).where(F.col("batch") == number)
        found = {r["state"]: r["n"] for r in mine.groupBy("state").agg(F.count("*").alias("n")).collect()}
        log.info("batch %d: read %d rows, rejected %d", number, sum(found.values()), found.get("rejected", 0))

    names = ["event_id", "ts", "event_type", "value"]
    try:
        schema = spark.read.parquet(events).select(*names).schema
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        log.info("no files in %s yet", events)
        return paths
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_a_batch"])
    folder, _, name = events.rstrip("/").rpartition("/")
    some = spark.read.parquet(events).select("_metadata.file_name").first()
    if some and some.file_name == name:  # a file itself: streams read folders
        reader, events = reader.option("pathGlobFilter", name), folder
    stream = reader.parquet(events)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    put_together(spark, paths, config)
    return paths


def read(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The tables of samples and of reports."""
    return spark.read.schema(_SAMPLES).parquet(paths["samples"]), spark.read.schema(_REPORT).parquet(paths["report"])


if __name__ == "__main__":
    main(run, __file__, {"events": "folder of the event files (Parquet)", "output": "folder of the tables", "checkpoint": "folder of the stream's checkpoint"})
