"""Cut lineages and tables numbered in order, by reliable checkpoints in the folder that the cluster names."""

from __future__ import annotations

import contextlib
import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Groups whose first places are broadcast, at most; beyond that a join by group.
FIRST_BROADCAST = 100_000


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings changed for a while, then as they were."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset, a folder of this machine if all of Spark runs here."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, place: str) -> None:
    """Delete a folder or file of the shared folder, by whatever file system it lies on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """The rows with their place, from 0, in a total order: places inside each sorted partition, and the sizes of those before.

    The sorted rows are kept first, so that places and sizes are of one and the same sorting.
    """
    return as_they_stand(rows.orderBy(*order), name)


def as_they_stand(rows: DataFrame, name: str) -> DataFrame:
    """The rows with their place, from 0, in the order of their partitions and inside them."""
    at = F.col(f"__{name}")
    placed = cut(rows.withColumn(f"__{name}", F.monotonically_increasing_id()))
    part = F.shiftright(at, 33).cast("int")
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    out = placed.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    return out.select(*rows.columns, (F.col("__before") + at.bitwiseAND((1 << 33) - 1)).alias(name))


def numbered_within(rows: DataFrame, name: str, within: str, *order: str | Column) -> DataFrame:
    """The rows with their place, from 0, in the order among those of equal `within`: places in the whole order less the group's first.

    The firsts of few groups are broadcast: a join by group would deal all rows of a group to one task.
    """
    placed = numbered(rows, "__at", F.col(within).asc_nulls_first(), *order)
    first = cut(placed.groupBy(F.col(within).alias("__within")).agg(F.min("__at").alias("__first")))
    few = first.count() <= FIRST_BROADCAST
    met = placed.join(F.broadcast(first) if few else first, F.col(within).eqNullSafe(F.col("__within")))
    return met.select(*rows.columns, (F.col("__at") - F.col("__first")).alias(name))
