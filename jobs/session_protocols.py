"""Turns session protocols, spoken turn by turn, into a marker table with paired intervals and warnings.

Each turn is a marker with its text as the note; its time is how long the notes before it take to dictate. Turns that
begin and end an action are paired as in a marker table, and the first wrong end of a session is told.

    protocol/part=...   a row a turn: marker, clock, note, broken rule, partner, duration, problem
    marks/part=...      what the part's input was when it was written
    pending             the marks of the parts that the last run took

Sessions are kept in parts by their numbers. A run takes only parts whose input differs from the mark, writes them whole
in place of the old ones, and their marks last: a run that broke off is made good by the next one.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from wavemark.functions.time_math import format_time
from wavemark.operators import markers as M
from wavemark.operators.blocks import ROWS, with_number, with_sum_before
from wavemark.sources.project import broken_rule

from .command import main

log = logging.getLogger(__name__)

_PROTOCOL = "session long, seq long, marker_id string, kind string, time_sec double, clock string, note string, broken string, partner_id string, duration_sec double, problem string, part long"
_MARKS = "n long, print decimal(38,0), part long"


def turns(conversations: DataFrame, sessions_a_part: int) -> DataFrame:
    """session, seq, role, note, part. White space in notes becomes one blank, a missing text an empty note; rows without a
    session or a turn are left out; of several rows of one turn the least by role and note counts."""
    note = F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x09-\x0D\x20]+", " "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("session"), F.col("turn").cast("long").alias("seq"), "role", note.alias("note")).where("session is not null and seq is not null")
    one = rows.groupBy("session", "seq").agg(F.min(F.struct("role", "note")).alias("r")).select("session", "seq", "r.role", "r.note")
    return one.withColumn("part", F.floor(F.col("session") / sessions_a_part))


def protocol(rows: DataFrame, kinds: dict[str, str], chars_per_sec: float, block: int = ROWS) -> DataFrame:
    """The rows of the protocol table, from turns."""
    kind = F.lit(None).cast("string")
    for role, name in kinds.items():
        kind = F.when(F.col("role") == role, name).otherwise(kind)
    dated = with_sum_before(rows.withColumn("_chars", F.length("note").cast("long")), "_chars", "_before", ["session"], "seq", block)
    seconds = F.col("_before") / F.lit(float(chars_per_sec))
    name = F.format_string("n%d.%d", F.col("session"), F.col("seq"))
    noted = dated.select("session", "seq", name.alias("marker_id"), kind.alias("kind"), F.lit("video").alias("domain"), seconds.alias("time_sec"), F.lit(None).cast("long").alias("frame_index"), "note", "part")
    noted = noted.withColumn("broken", broken_rule())
    sound = noted.where("broken is null")
    pairs = M.pair_intervals(sound, "action_start", "action_end", "session", block).withColumn("duration_sec", F.col("end_sec") - F.col("start_sec"))
    a, b = F.col("start_marker_id"), F.col("end_marker_id")
    partners = pairs.select("session", a.alias("marker_id"), b.alias("partner_id"), "duration_sec").unionByName(pairs.select("session", b.alias("marker_id"), a.alias("partner_id"), "duration_sec"))
    warnings = M.interval_warning(sound, "session", block)
    numbered = with_number(sound.select("session", "seq", "marker_id"), "number", "_count", ["session"], "seq", block)
    problems = numbered.withColumn("number", F.col("number") + 1).join(warnings, ["session", "number"]).select("session", "marker_id", "problem")
    whole = noted.join(partners, ["session", "marker_id"], "left").join(problems, ["session", "marker_id"], "left")
    return whole.select("session", "seq", "marker_id", "kind", "time_sec", format_time(F.col("time_sec")).alias("clock"), "note", "broken", "partner_id", "duration_sec", "problem", "part")


def _replace(rows: DataFrame, path: str) -> None:
    """Writes the rows' parts in place of those that are there; other parts stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def run(spark: SparkSession, *, conversations: str, output: str, config: dict) -> dict[str, str]:
    """Writes the parts whose sessions are new or changed and returns the paths of the tables.

    A part of which no session is left in the input stays as it was, and is logged.
    """
    paths = {name: f"{output.rstrip('/')}/{name}" for name in ("protocol", "marks", "pending")}
    rows = turns(spark.read.parquet(conversations), config["sessions_a_part"])
    settings = F.lit(f"{sorted(config['kinds'].items())} {config['chars_per_sec']} {config['sessions_a_part']}")
    prints = F.sum(F.xxhash64("session", "seq", "role", "note", settings).cast("decimal(38,0)")).alias("print")
    now = rows.groupBy("part").agg(F.count("*").alias("n"), prints)
    try:
        before = spark.read.schema(_MARKS).parquet(paths["marks"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        before = spark.createDataFrame([], _MARKS)
    # what is to be done is fixed before anything is written
    now.join(before, ["part", "n", "print"], "left_anti").select("n", "print", "part").write.mode("overwrite").parquet(paths["pending"])
    pending = spark.read.schema(_MARKS).parquet(paths["pending"])
    found = pending.agg(F.count("*").alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).alias("turns")).first()
    gone = before.join(now, "part", "left_anti").count()
    log.info("%s: %d parts are new or changed, with %d turns; %d parts have no session any more", conversations, found.parts, found.turns, gone)
    if not found.parts:
        return paths
    some = rows.join(pending.select("part"), "part", "left_semi")
    _replace(protocol(some, config["kinds"], config["chars_per_sec"]).hint("rebalance", "part"), paths["protocol"])
    _replace(pending, paths["marks"])
    log.info("wrote %d parts to %s", found.parts, paths["protocol"])
    return paths


def read(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    return spark.read.schema(_PROTOCOL).parquet(paths["protocol"])


if __name__ == "__main__":
    main(run, __file__, {"conversations": "the turns (Parquet): conv_id, turn, role, text", "output": "folder of the tables"})
