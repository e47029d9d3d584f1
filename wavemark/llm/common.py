"""Shared folder, written intermediate tables and small helpers of the corpus operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_folder

#: Rows of an Arrow batch, and of a batch that the Parquet reader holds; their defaults suit narrow rows.
BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


#: Bytes of a row group: what a writing task holds of whole texts and blocks.
ROW_GROUP = 32 << 20


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Holds the rows of a batch down while an action over wide rows (whole texts, blocks of ids) runs."""
    before = {name: spark.conf.get(name) for name in BATCHES}
    for name in BATCHES:
        spark.conf.set(name, str(min(rows, int(before[name]))))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def hold_wide_rows(spark: SparkSession, rows: int = 512) -> None:
    """Keeps batches small for the session, for rows of whole texts that the caller writes."""
    for name in BATCHES:
        spark.conf.set(name, str(min(rows, int(spark.conf.get(name)))))


class Table:
    """A table written once to the shared folder; it cuts the lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str, batch: int = 256, codec: str = "zstd", partition_by: tuple[str, ...] = ()):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.schema = df.schema
        with batch_rows(self.spark, batch):
            writer = df.write.option("compression", codec).option("parquet.block.size", ROW_GROUP)
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; call it when nothing that is still to run reads them."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame) -> str:
    """A name that no column of the table has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    return next(n for k in range(len(taken) + 1) if (n := f"inner{k}") not in taken)


def cpu_env() -> None:
    """One thread a Python worker; executors already run a task per core."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
