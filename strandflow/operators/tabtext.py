"""Indexed text: lines with a sequence, a start and an end column."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.operators.intervals import check_contigs, check_ranges, interval_join, unique_labels


@dataclass(frozen=True)
class Layout:
    """1-based columns; an end column of 0 means that a line ends where it starts."""

    seq: int
    start: int
    end: int
    comment: str = "#"
    skip: int = 0
    zero_based: bool = False


#: Column layouts of common formats.
PRESETS = {
    "gff": Layout(1, 4, 5),
    "bed": Layout(1, 2, 3, zero_based=True),
    "sam": Layout(3, 4, 0, comment="@"),
    "vcf": Layout(1, 2, 0),
    "vcf4": Layout(1, 2, 0),
    "psltbl": Layout(15, 17, 18, zero_based=True),
}


def keyed(lines: DataFrame, layout: Layout) -> DataFrame:
    """Lines (column `line`) that are no comment, with contig, start and end; starts count from 1.

    A layout that skips lines needs their number in `line_no`, from 0 in each file.
    """
    if layout.skip:
        lines = lines.where(F.col("line_no") >= layout.skip)
    parts = F.split("line", "\t")
    start = F.get(parts, F.lit(layout.start - 1)).cast("int") + (1 if layout.zero_based else 0)
    end = F.get(parts, F.lit(layout.end - 1)).cast("int") if layout.end else start
    return lines.where(~F.col("line").startswith(layout.comment) & (F.col("line") != "")).select("*", F.get(parts, F.lit(layout.seq - 1)).alias("contig"), start.alias("start"), end.alias("end"))


def parse_with(lines: DataFrame, fun, schema: str) -> DataFrame:
    """Lines parsed by a caller's function, from a pandas frame of them to one of `schema`, batch by batch in Spark's tasks."""
    return lines.mapInPandas(lambda frames: map(fun, frames), schema)


def parse_table(lines: DataFrame, parser: Callable[[str], Iterable[tuple]], schema: str) -> DataFrame:
    """Each line with the rows that a caller's parser makes of it, a table function that Spark joins laterally; a line without rows is left out.

    The parser takes a line and gives any number of rows of `schema`; it runs in Spark's tasks, an Arrow batch of lines at a time.
    """

    class Parse:
        def eval(self, line: str) -> Iterator[tuple]:
            yield from parser(line)

    return lines.lateralJoin(F.udtf(Parse, returnType=schema, useArrow=True)(F.col("line").outer()))


def header(lines: DataFrame, layout: Layout) -> DataFrame:
    """Comments, and the lines that the layout skips."""
    test = F.col("line").startswith(layout.comment)
    return lines.where(test | (F.col("line_no") < layout.skip) if layout.skip else test)


def names(rows: DataFrame) -> DataFrame:
    return rows.select("contig").distinct()


def in_ranges(rows: DataFrame, ranges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Lines per range hit, with range_id and label; with the known names (`contig`), a range on another one is an error."""
    if known is not None:
        ranges = check_contigs(ranges, known.select(F.col("contig").alias("name")))
    return interval_join(rows, unique_labels(check_ranges(ranges)), "contig", "start", "end")


def count(rows: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Lines per range (0 for a range without any), or in all."""
    if ranges is None:
        return rows.agg(F.count("*").alias("records"))
    hits = interval_join(rows, check_ranges(ranges), "contig", "start", "end").groupBy("range_id").agg(F.count("*").alias("records"))
    return ranges.join(hits, "range_id", "left").select(*ranges.columns, F.coalesce("records", F.lit(0)).cast("long").alias("records"))


def legacy_pileup(rows: DataFrame, variant: str = "SNP", line: str = "line_no", partition: str | None = None) -> DataFrame:
    """Rows of the old pileup text: SNP drops each '*' row and the row before it, all drops the '*' rows only,
    indel keeps the '*' rows with the base columns of the row before. `partition` names the file or contig
    inside which lines are in order.
    """
    by = partition or "space"
    star = F.col("referenceBase") == "*"
    if variant == "all":
        return rows.where(~star)
    if variant == "SNP":
        following = _beside(rows, by, line, F.col("referenceBase"), 1, "__next")
        return following.where(~star & ~(F.coalesce(F.col("__next") == "*", F.lit(False)))).drop("__next")
    if variant != "indel":
        raise ValueError(f"unknown variant {variant!r}")
    base = ["position", "referenceBase", "consensusBase", "consensusQuality", "snpQuality", "maxMappingQuality", "coverage"]
    rows = _beside(rows, by, line, F.struct(*base), -1, "__before").where(star)
    return rows.select(*[F.col(f"__before.{c}").alias(c) if c in base else F.col(c) for c in rows.columns if c != "__before"])


#: Numbers of lines that one task orders.
TILE = 1 << 20


def _beside(rows: DataFrame, by: str, line: str, value: Column, step: int, name: str) -> DataFrame:
    """The rows with the value of the line after (step 1) or before (-1) in `name`, inside each `by`.

    Lines are ordered in tiles of TILE numbers; a tile's edge meets the nearest line of the tiles beside it, of which there is a row each.
    """
    rows = rows.withColumn("__tile", F.floor(F.col(line) / TILE)).withColumn("__value", F.struct(value.alias("v")))
    inside, tiles = Window.partitionBy(by, "__tile").orderBy(line), Window.partitionBy(by).orderBy("__tile")
    edges = rows.groupBy(by, "__tile").agg((F.min_by if step > 0 else F.max_by)("__value", line).alias("__edge"))
    edges = edges.select(by, "__tile", (F.lead if step > 0 else F.lag)("__edge").over(tiles).alias("__edge"))
    own = (F.lead if step > 0 else F.lag)("__value").over(inside)
    met = rows.withColumn("__own", own).join(edges, [by, "__tile"])
    return met.withColumn(name, F.coalesce("__own", "__edge")["v"]).drop("__tile", "__value", "__own", "__edge")
