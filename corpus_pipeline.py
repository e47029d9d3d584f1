"""The corpus pipeline: five stages, each written as Parquet and read again.

quality -> language -> near_duplicates -> mixing -> packing. The first four return the columns of `documents`; the
last returns a row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wavemark.llm import jaccard, language, mixing, packing, quality
from wavemark.llm.common import Table, hold_wide_rows
from wavemark.llm.queries import domain_labels, vocabulary_file

#: Target shares of the tokens that the quality stage let through.
TARGETS = {"clean": 0.98, "toxic": 0.02}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose quality score is under one half, and rows without a word (null and empty texts among them).

    Each row is judged by its own whole text, so repeated rows and ids fare alike and null ids stay. An empty table stays
    empty; other columns, whatever their names, come through as they are.
    """
    hold_wide_rows(spark)
    return quality.keep_good(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose language can't be told.

    These are texts without a letter (null and empty ones among them; the quality stage mostly drops them before), texts
    of none of the languages learned, without an n-gram in common, and texts that no language fits with a score of one
    half (of a few letters, or evenly mixed). Rows, ids and columns as in quality_stage.
    """
    hold_wide_rows(spark)
    return language.keep_identified(docs)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group of near duplicates; one row where an id repeats with its text.

    Of rows with one id and one text the one whose other columns are least as JSON stays. Where an id has several texts,
    all but one of them are compared under ids of their own, which come after all others. Null and empty texts and texts
    without a word are near to nothing, so they go only where their id repeats; rows without an id all stay. Whole texts
    are compared, however long. An empty table stays empty; other columns, whatever their names, come through as they are.
    """
    names = docs.columns
    rows = docs.toDF(*(f"c{k}" for k in range(len(names))))  # inner names can't meet the table's own
    doc_id, text = (f"c{names.index(n)}" for n in ("doc_id", "text"))
    rows = rows.withColumn("own", F.col(doc_id).cast("long"))
    prints = rows.select("own", F.xxhash64(text).alias("print")).where("own is not null")
    repeated = Table(prints.groupBy("own").agg(F.min("print").alias("lo"), F.count("*").alias("n")).where("n > 1").select(F.col("own").alias("id"), "lo"), "repeated-ids")
    again = not repeated.read().isEmpty()
    if again:
        later = F.lit(1 << 62).bitwiseOR(F.xxhash64("own", text).bitwiseAND(F.lit((1 << 62) - 1)))
        rows = rows.join(repeated.read(), rows.own == F.col("id"), "left").withColumn("several", F.col("id").isNotNull())
        rows = rows.withColumn("own", F.when(F.col("several") & (F.xxhash64(text) != F.col("lo")), later).otherwise(F.col("own"))).drop("id", "lo")
    found = jaccard.jaccard_classes(rows, id_col="own", text_col=text)
    dropped = found.where("not is_first").select(F.col("doc_id").alias("own")).distinct()
    kept = rows.join(dropped, "own", "left_anti")
    plain = [f"c{k}" for k in range(len(names))]
    if again:
        others = F.to_json(F.struct(*(c for c in plain if c != text)))
        one = kept.where("several").groupBy("own").agg(F.min_by(F.struct(*plain), others).alias("r")).select("r.*")
        kept = kept.where("not several").select(*plain).unionByName(one)
    return kept.select(*plain).toDF(*names)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row by its fitted rate: floor(rate), and once more for a hash-drawn share of the rows.

    Null and empty texts have no tokens and the rate of their posterior; repeated rows and ids count as often as they
    come; an empty table stays empty. Other columns, whatever their names, come through as they are.
    """
    return mixing.repeat_by_rate(docs, domain_labels(spark, sf_dir), TARGETS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per packed piece; nulls, empty, very long and repeated texts are packed like any other, see pack_documents."""
    return packing.pack_documents(docs, vocabulary_file(), capacity=2048, end_id=0)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: None: SQL can't express the models and the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over `documents`; a stage's table is deleted when the next one's is written, the last one's is read by the result."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        table = Table(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            last.drop()
        docs, last = table.read(), table
    return STAGES[-1][1](spark, docs, sf_dir)
