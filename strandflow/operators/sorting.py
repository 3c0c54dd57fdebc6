"""Orders, merging and rewriting of alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.shared import numbered_within


def order_columns(by: str = "coordinate", tag: str | None = None, then_name: bool = False, contig: tuple[str, ...] = ("rname",)) -> list[Column]:
    """Sort keys: coordinate (contig order in `contig`, say a column of header order; unplaced last), name, or a tag (rows without it first), then one of these.

    Ties are broken by all that tells records apart, so equal inputs give equal orders.
    """
    place = [*[F.col(c).asc_nulls_last() for c in contig], F.col("pos").asc_nulls_last(), F.col("flag").bitwiseAND(16).asc()]
    name = [F.col("qname").asc_nulls_first(), F.col("flag").bitwiseAND(192).asc()]
    rest = [F.col(c).asc_nulls_first() for c in ("qname", "flag", "mapq", "cigar", "seq", "qual")]
    if by == "name":
        return [*name, *place, *rest]
    if by == "tag":
        value = F.col("tags")[tag]
        return [value["s"].asc_nulls_first(), value["i"].asc_nulls_first(), value["d"].asc_nulls_first(), *([*name, *place] if then_name else place), *rest]
    if by != "coordinate":
        raise ValueError(f"unknown order {by!r}")
    return [*place, *rest]


def _keyed(alignments: DataFrame, by: str, tag: str | None, then_name: bool, contigs: DataFrame | None) -> tuple[DataFrame, list[Column]]:
    """The rows, with their contig's place in the header (name, tid) if given, and sort keys. What the header lacks comes last, by name."""
    if contigs is None:
        return alignments, order_columns(by, tag, then_name)
    ranks = contigs.select(F.col("name").alias("rname"), F.col("tid").alias("__rank"))
    return alignments.join(ranks, "rname", "left").select(*alignments.columns, "__rank"), order_columns(by, tag, then_name, ("__rank", "rname"))


def sort(alignments: DataFrame, by: str = "coordinate", tag: str | None = None, then_name: bool = False, contigs: DataFrame | None = None) -> DataFrame:
    """A total order by range partitions; each task sorts, and spills, its own range. Contigs go by name, or as the header (name, tid) has them."""
    rows, keys = _keyed(alignments, by, tag, then_name, contigs)
    return rows.orderBy(*keys).select(*alignments.columns)


def place(alignments: DataFrame, name: str, within: str, by: str = "coordinate", tag: str | None = None, then_name: bool = False, contigs: DataFrame | None = None) -> DataFrame:
    """The rows with their place in the order, from 1, among those of equal `within`."""
    rows, keys = _keyed(alignments, by, tag, then_name, contigs)
    placed = numbered_within(rows, name, within, *keys)
    return placed.select(*alignments.columns, (F.col(name) + 1).alias(name))


def merge(files: dict[str, DataFrame], add_read_group: bool = False, region: Column | None = None, by: str = "coordinate", contigs: DataFrame | None = None) -> DataFrame:
    """Union of two or more files in order (of the merged header's contigs, if given); with add_read_group the RG tag is the file's name."""
    if len(files) < 2:
        raise ValueError("merging needs two or more files")
    out = None
    for name, df in files.items():
        df = df.where(region) if region is not None else df
        if add_read_group:
            tag = F.struct(F.lit("Z").alias("type"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("double").alias("d"), F.lit(name).alias("s"), F.lit(None).cast("array<long>").alias("ai"), F.lit(None).cast("array<double>").alias("ad"))
            rest = F.map_filter(F.coalesce("tags", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{df.schema['tags'].dataType.valueType.simpleString()}>"))), lambda k, v: k != "RG")
            df = df.withColumn("tags", F.map_concat(rest, F.create_map(F.lit("RG"), tag)))
        out = df if out is None else out.unionByName(df)
    return sort(out, by, contigs=contigs)


def filter_to(alignments: DataFrame, path: str, test: Column, ranges: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """Write the passing rows, by contig and in order of position; ranges are merged first so no row is written twice."""
    from strandflow.operators.intervals import normalize
    from strandflow.operators.scan import overlap

    rows = alignments.where(test)
    if ranges is not None:
        merged = normalize(ranges).withColumn("range_id", F.xxhash64("contig", "start"))
        keyed = rows.withColumn("__row", F.monotonically_increasing_id())
        rows = overlap(keyed, merged).dropDuplicates(["__row"]).select(*alignments.columns)
    land(rows, path, mode)


def land(alignments: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The layout that stands in for an index: one folder per contig, sorted by position, flag tests stored as columns.

    A range query prunes folders by contig and row groups by position; bit tests cannot be pushed
    down, so the usual ones are materialised.
    """
    rows = alignments.withColumn("is_excluded", F.col("flag").bitwiseAND(1796) != 0).withColumn("contig", F.coalesce("rname", F.lit("*")))
    rows.repartitionByRange("contig", "pos").sortWithinPartitions("contig", "pos").write.mode(mode).partitionBy("contig").parquet(path)
