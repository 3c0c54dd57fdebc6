"""Interval operators on 1-based closed ranges.

`interval_join` bins both sides and equi-joins on (contig, bin), so it shuffles like any hash join
and never compares all pairs of a contig; a pair that shares several bins is emitted in the first
one only. Bins are finer than most ranges' rows are long, so rows of a hot region spread over bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.schemas import MAX_COORDINATE
from strandflow.shared import numbered

#: Positions that one task of a running sum or maximum takes on; tiles are joined by their totals.
TILE = 1 << 20


def check_ranges(ranges: DataFrame) -> DataFrame:
    """The ranges; one that ends beyond the largest coordinate, or is no range, is an error when read."""
    bad = (F.col("end") > MAX_COORDINATE) | (F.col("start") > F.col("end") + 1) | (F.col("start") < 0)
    return ranges.withColumn("end", F.when(bad, F.raise_error(F.lit("a range is out of bounds")).cast("int")).otherwise(F.col("end")))


def check_contigs(ranges: DataFrame, contigs: DataFrame) -> DataFrame:
    """The ranges; one on a contig that the header (name, ...) does not have is an error when read."""
    known = contigs.select(F.col("name").alias("contig"), F.lit(True).alias("__known"))
    error = F.raise_error(F.concat(F.lit("the header has no contig "), F.col("contig"))).cast("string")
    return ranges.join(known, "contig", "left").withColumn("contig", F.when(F.col("__known"), F.col("contig")).otherwise(error)).select(*ranges.columns)


def unknown_contigs(ranges: DataFrame, contigs: DataFrame) -> DataFrame:
    """Contigs of the ranges that the header does not have; a scan of these is an error."""
    return ranges.select("contig").distinct().join(contigs.select(F.col("name").alias("contig")), "contig", "left_anti")


def interval_join(rows: DataFrame, ranges: DataFrame, contig: str, start: str, end: str, bin_width: int = 16384) -> DataFrame:
    """Rows with each range that they overlap: one output row per pair; `range_*` columns of the range."""
    names = {c: f"range_{c}" if c != "range_id" else c for c in ranges.columns}
    right = ranges.select(*[F.col(c).alias(n) for c, n in names.items()]).where("range_end >= range_start")
    bins = lambda a, b: F.explode(F.sequence((a / bin_width).cast("long"), (b / bin_width).cast("long")))
    left = rows.where(F.col(start).isNotNull() & (F.col(end) >= F.col(start))).withColumn("__bin", bins(F.col(start), F.col(end)))
    right = right.withColumn("__rbin", bins(F.col("range_start"), F.col("range_end")))
    first = F.greatest((F.col(start) / bin_width).cast("long"), (F.col("range_start") / bin_width).cast("long"))
    on = (F.col(contig) == F.col("range_contig")) & (F.col("__bin") == F.col("__rbin"))
    met = left.join(right, on & (F.col(start) <= F.col("range_end")) & (F.col(end) >= F.col("range_start")))
    return met.where(F.col("__bin") == first).drop("__bin", "__rbin")


def label(contig: Column, start: Column, end: Column) -> Column:
    return F.concat(contig, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def unique_labels(ranges: DataFrame) -> DataFrame:
    """Ranges with `label`; if any label occurs twice, each gets its ordinal in range_id order as a suffix.

    Whether one does is asked at once, so that only ranges that need ordinals are numbered.
    """
    named = ranges.withColumn("label", label(F.col("contig"), F.col("start"), F.col("end")))
    if named.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return named
    ordinal = (F.col("__ordinal") + 1).cast("string")
    return numbered(named, "__ordinal", "range_id").withColumn("label", F.concat_ws(".", "label", ordinal)).drop("__ordinal")


def _tiled(rows: DataFrame, contig: str, at: str, value: Column, gather, before: str) -> DataFrame:
    """Rows with `__tile` and, in `before`, `gather` of the value over all tiles of the contig before."""
    rows = rows.withColumn("__tile", (F.col(at) / TILE).cast("long"))
    w = Window.partitionBy(contig).orderBy("__tile").rowsBetween(Window.unboundedPreceding, -1)  # a row per tile
    tiles = rows.groupBy(contig, "__tile").agg(gather(value).alias("__v")).select(contig, "__tile", gather("__v").over(w).alias(before))
    return rows.join(tiles, [contig, "__tile"])


def normalize(ranges: DataFrame, contig: str = "contig", start: str = "start", end: str = "end") -> DataFrame:
    """Merge overlapping and adjacent ranges of a contig; empty ones are dropped. No task orders more than a tile's ranges.

    Equal ranges count once, so that their order, which two windows rely on, is one and the same.
    """
    rows = ranges.where(F.col(end) >= F.col(start)).select(contig, start, end).distinct()
    rows = _tiled(rows, contig, start, F.col(end), F.max, "__reach")
    w = Window.partitionBy(contig, "__tile").orderBy(start, end)
    reach = F.greatest("__reach", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.select(contig, start, end, F.when(F.coalesce(F.col(start) > reach + 1, F.lit(True)), F.col(start)).alias("__new"))
    rows = _tiled(rows, contig, start, F.col("__new"), F.max, "__island")
    island = F.coalesce(F.max("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__island")
    return rows.withColumn("__island", island).groupBy(contig, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def tile(contigs: DataFrame, width: int) -> DataFrame:
    """Fixed-width ranges over contigs (name, length)."""
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.col("length"), F.lit(1)), F.lit(width)))
    return contigs.where("length > 0").select(F.col("name").alias("contig"), starts.alias("start"), "length").select("contig", "start", F.least(F.col("start") + width - 1, "length").alias("end"))


def coverage(blocks: DataFrame, contig: str = "contig", start: str = "start", end: str = "end") -> DataFrame:
    """Runs of equal depth over (contig, start, end) blocks, from +1 and -1 steps: rows follow the blocks, not the bases."""
    steps = blocks.where(F.col(end) >= F.col(start)).select(contig, F.inline(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct((F.col(end) + 1).alias("at"), F.lit(-1).alias("d")))))
    steps = steps.withColumn("__tile", (F.col("at") / TILE).cast("long")).groupBy(contig, "__tile", "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(contig).orderBy("__tile")  # a row per tile
    tiles = steps.groupBy(contig, "__tile").agg(F.sum("d").alias("all"), F.min("at").alias("first"))
    tiles = tiles.select(contig, "__tile", (F.sum("all").over(w) - F.col("all")).alias("before"), F.lead("first").over(w).alias("after"))
    inside = Window.partitionBy(contig, "__tile").orderBy("at")
    runs = steps.withColumn("depth", F.sum("d").over(inside)).withColumn("next", F.lead("at").over(inside)).join(tiles, [contig, "__tile"])
    runs = runs.select(F.col(contig).alias("contig"), F.col("at").alias("start"), (F.coalesce("next", "after") - 1).alias("end"), (F.col("depth") + F.col("before")).alias("depth"))
    return runs.where("depth > 0")
