"""Tables of derived results (path, source, size, used): what is dropped by age and size, kept by use, or belongs to a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def sizes(entries: DataFrame, keys: list[str]) -> DataFrame:
    """How many entries each key has and how many bytes they take."""
    return entries.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def within_budget(entries: DataFrame, keys: list[str], most_bytes: int, oldest: float) -> DataFrame:
    """The entries left when expired ones (used up to `oldest`) are dropped and then the longest unused, until a key's are small enough.

    Protected entries count but stay. An entry goes if the bytes before its turn, which are all but those of the unprotected
    ones that went before it, are still too many.
    """
    live = entries.where("protected or used > " + repr(float(oldest)))
    whole = F.sum("size").over(Window.partitionBy(*keys))
    gone = F.sum(F.when(~F.col("protected"), F.col("size")).otherwise(0)).over(Window.partitionBy(*keys).orderBy("used", "size", "path").rowsBetween(Window.unboundedPreceding, -1))
    return live.withColumn("_left", whole - F.coalesce(gone, F.lit(0))).where((F.col("_left") <= most_bytes) | F.col("protected")).drop("_left")


def latest(entries: DataFrame, keys: list[str], most: int, by: str = "used") -> DataFrame:
    """The entries of each key that were used last, each path once."""
    last = entries.groupBy(*keys, "path").agg(F.max(by).alias(by))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by), "path"))
    return last.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def registered(opened: DataFrame, identity: list[str], by: str) -> DataFrame:
    """The sources known at the end: of each path the identity that was opened last, as a newer one takes the older's place."""
    return opened.groupBy("path").agg(F.max_by(F.struct(*identity), by).alias("i")).select("path", "i.*")


def without_source(entries: DataFrame, source: str) -> DataFrame:
    """The entries that don't belong to a source."""
    return entries.where(F.coalesce(F.col("source") != source, F.lit(True)))
