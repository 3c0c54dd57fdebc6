"""What the operators of this subpackage share: settings, table access and checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.textkernel import BATCH_ROWS


#: Whether Spark removes a query's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, read with Arrow batches small enough for long texts."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder that the cluster names.

    The shuffle files that led to the checkpoint are not needed any more and are removed with it; the
    checkpoint itself goes when Spark is told so (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a new plan, made under this setting
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: An internal document key: doc_id, with the least long for null, so that joins keep such rows.
KEY = "__key"
NO_ID = -(2**63)


def key_column(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID)).alias(KEY)


def keyed(documents: DataFrame, *columns: str) -> DataFrame:
    """KEY and the columns named; every other column is left out, so none can clash."""
    return documents.select(key_column(), *columns)


def group_count(documents: DataFrame, rows: int, tasks: int | None = None) -> int:
    """How many hash ranges keep each one's share of the table in a task's memory: it follows the table, from `tasks` on."""
    return max(tasks or partitions(documents.sparkSession), documents.count() // rows + 1)


def shared_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; where it is unset, a folder of this machine if all of Spark runs here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared folder, by whatever file system it lies on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
