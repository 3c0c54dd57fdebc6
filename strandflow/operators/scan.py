"""Scans of alignments: projection with null rules, predicates, ranges."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandflow.functions import cigar, flags, sequence
from strandflow.operators.intervals import check_contigs, check_ranges, interval_join, unique_labels
from strandflow.shared import cut, folder, numbered, numbered_within, remove
from strandflow.specs import ScanSpec


def output_fields() -> dict[str, Column]:
    """Each output field with the rule by which it is null."""
    flag, c = F.col("flag"), F.col
    unmapped, mate_unmapped = flag.bitwiseAND(4) != 0, flag.bitwiseAND(8) != 0
    return {
        "qname": c("qname"),
        "flag": flag,
        "rname": c("rname"),
        "strand": F.when(~unmapped, F.when(flag.bitwiseAND(16) != 0, "-").otherwise("+")),
        "pos": F.when(~unmapped & c("rname").isNotNull(), c("pos")),
        "qwidth": F.when(~unmapped, cigar.query_width(c("cigar"))),
        "mapq": F.when(~unmapped, c("mapq")),
        "cigar": F.when(~unmapped & c("rname").isNotNull(), c("cigar")),
        "mrnm": c("mrnm"),
        "mpos": F.when(~mate_unmapped & c("mrnm").isNotNull(), c("mpos")),
        "isize": F.when(~unmapped & ~mate_unmapped, c("isize")),
        "seq": c("seq"),
        "qual": c("qual"),
    }


def tag_test(tag: str, values: list) -> Column:
    """Whether a tag holds one of the values; a tag of another or an unsupported type is an error."""
    value = F.col("tags")[tag]
    kind = value["type"]
    if isinstance(values[0], int):
        good, field = kind.isin("i", "I", "s", "S", "c", "C"), value["i"]
    else:
        good, field = kind.isin("A", "Z"), value["s"]
    error = F.raise_error(F.lit(f"tag filter: {tag} has another type")).cast("boolean")
    return F.when(value.isNull(), F.lit(False)).when(good, field.isin(*values)).otherwise(error)


def predicate(spec: ScanSpec) -> Column:
    """All of a scan's tests. Bit and quality tests reach the scan; tag tests come after them."""
    test = flags.passes(F.col("flag"), spec.flag)
    if spec.mapq:
        test = test & (F.col("mapq") >= spec.mapq)
    if spec.simple_cigar:
        test = test & cigar.is_simple(F.col("cigar"))
    for tag, values in spec.tag_filter.items():
        test = test & tag_test(tag, list(values))
    return test


def scan(alignments: DataFrame, spec: ScanSpec | None = None, ranges: DataFrame | None = None, contigs: DataFrame | None = None) -> DataFrame:
    """Selected fields and tags of the passing rows; with ranges, a row per range hit, with range_id and which_label.

    With contigs (the header's), a range on another one is an error.
    """
    spec = spec or ScanSpec()
    rows = alignments.where(predicate(spec))
    if spec.reverse_complement:
        rows = rows.withColumns({"seq": sequence.on_forward(F.col("seq"), F.col("flag")), "qual": sequence.quality_on_forward(F.col("qual"), F.col("flag"))})
    extra: list[Column] = []
    if ranges is not None:
        rows = overlap(rows, ranges, contigs)
        extra = [F.col("range_id"), F.col("range_label").alias("which_label")]
    fields = output_fields()
    tags = [F.coalesce(F.col("tags")[t]["i"].cast("string"), F.col("tags")[t]["d"].cast("string"), F.col("tags")[t]["s"]).alias(t) for t in spec.tags]
    return rows.select(*extra, *[fields[f].alias(f) if f in fields else F.col(f) for f in spec.what], *tags)


def overlap(rows: DataFrame, ranges: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """Placed rows with each range they overlap; with contigs, a range on any other is an error."""
    ranges = check_contigs(ranges, contigs) if contigs is not None else ranges
    placed = rows.where(F.col("rname").isNotNull() & F.col("pos").isNotNull()).withColumn("__end", cigar.reference_end(F.col("pos"), F.col("cigar")))
    return interval_join(placed, unique_labels(check_ranges(ranges)), "rname", "pos", "__end").drop("__end")


def first_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in the given order (a chunk of a scan)."""
    return rows.orderBy(*order).limit(n)


def first_n_names(rows: DataFrame, n: int) -> DataFrame:
    """All rows of the first n distinct names in order of name: a small top-n, then a semi-join."""
    names = rows.select("qname").where("qname is not null").distinct().orderBy("qname").limit(n)
    return rows.join(names, "qname", "left_semi")


def first_n_pairs(mated: DataFrame, n: int) -> DataFrame:
    """Both records of the first n pairs, in order of groupid, of rows with a mate status."""
    pairs = mated.where("mate_status = 'mated'").select("groupid").distinct().orderBy("groupid").limit(n)
    return mated.where("mate_status = 'mated'").join(pairs, "groupid", "left_semi")


def in_chunks(rows: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The rows with `chunk`: each next n of them in order have the next number, from 0."""
    return numbered(rows, "chunk", *order).withColumn("chunk", F.floor(F.col("chunk") / n))


def iterate(rows: DataFrame, n: int, *order: str | Column) -> Iterator[DataFrame]:
    """The chunks one after another, for callers that take n rows at a time.

    The rows are sorted and written once, a folder a chunk in the shared folder, and each chunk is read from its own; the folders go in the end.
    """
    spark = rows.sparkSession
    place = f"{folder(spark)}/chunks-{uuid.uuid4().hex}"
    try:
        chunked = in_chunks(rows, n, *order)
        chunked.repartitionByRange("chunk").write.partitionBy("chunk").parquet(place)
        last = chunked.agg(F.max("chunk")).first()[0]
        for i in range(0 if last is None else last + 1):
            yield spark.read.schema(rows.schema).parquet(f"{place}/chunk={i}")
    finally:
        remove(spark, place)


def apply_chunks(rows: DataFrame, n: int, fun, schema: str, *order: str | Column) -> DataFrame:
    """`fun`, from a pandas frame to one, of each chunk of n rows in order: a callback that Spark runs where the chunk is."""
    return in_chunks(rows, n, *order).groupBy("chunk").applyInPandas(lambda frame: fun(frame.drop(columns="chunk")), schema)


def apply_groups(rows: DataFrame, by: str, fun, schema: str, n: int = 100_000) -> DataFrame:
    """`fun` of the rows of each value of `by`, say of each range's hits, at most n at a time, in order of all columns.

    Groups stand one after another in sorted partitions, from which a task cuts frame after frame: a small group costs
    a call of `fun`, not an Arrow stream of its own.
    """
    simple = [f.name for f in rows.schema if f.dataType.typeName() != "map"]
    placed = numbered_within(rows, "__at", by, *[c for c in simple if c != by]).withColumn("__part", F.floor(F.col("__at") / n))
    dealt = placed.repartition(by, "__part").sortWithinPartitions(by, "__part", "__at")
    out = to_arrow_schema(StructType.fromDDL(schema))
    return dealt.mapInArrow(lambda batches: _frames(batches, fun, out), schema)


def _frames(batches: Iterator, fun, out) -> Iterator:
    """`fun` of each stretch of rows of one group and `__part`, as Arrow batches; a stretch may go on in the next batches."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    def results(table: pa.Table, edges: list[int]) -> Iterator[pa.RecordBatch]:
        # a column of whole numbers with nulls is one of floats in pandas: each group is converted by itself then
        whole = table.to_pandas(maps_as_pydicts="strict") if not any(c.null_count for c in table.columns) else None
        made = [fun(whole.iloc[a:b].reset_index(drop=True) if whole is not None else table.slice(a, b - a).to_pandas()) for a, b in zip(edges, edges[1:], strict=False)]
        if made:
            frame = pd.concat(made, ignore_index=True) if len(made) > 1 else made[0]
            yield from pa.Table.from_pandas(frame, schema=out, preserve_index=False).to_batches()

    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        part = table.column("__part").to_numpy()
        at = table.column("__at").to_numpy()
        # places go on by one inside a group's stretch; the next stretch begins at 0 or in another part
        same = (part[1:] == part[:-1]) & (at[1:] == at[:-1] + 1)
        edges = [0, *(np.flatnonzero(~same) + 1).tolist()]
        clean = table.drop_columns(["__part", "__at"])
        first = (part[0], at[0])
        if held and not (first[0] == last[0] and first[1] == last[1] + 1):
            whole = pa.concat_tables(held)
            yield from results(whole, [0, whole.num_rows])
            held = []
        last = (part[-1], at[-1])
        if len(edges) == 1:
            held.append(clean)
            continue
        if held:
            whole = pa.concat_tables([*held, clean.slice(0, edges[1])])
            yield from results(whole, [0, whole.num_rows])
            edges = edges[1:]
        yield from results(clean.slice(0, edges[-1]), edges)
        held = [clean.slice(edges[-1])]
    if held:
        whole = pa.concat_tables(held)
        yield from results(whole, [0, whole.num_rows])


def where_frame(rows: DataFrame, *rules) -> DataFrame:
    """Rows that pass every rule, a function from a pandas frame to booleans, or to one for the whole frame."""

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            for rule in rules:
                keep = rule(frame)
                frame = frame[keep] if hasattr(keep, "__len__") else frame if keep else frame[:0]
            yield frame

    return rows.mapInPandas(run, rows.schema)


def each_position(rows: DataFrame, n: int) -> DataFrame:
    """Rows of positions (seqnames, pos, ...) with `chunk`: each next n positions have the next number, whole positions in each."""
    rows = cut(rows)  # used twice
    places = numbered(rows.select("seqnames", "pos").distinct(), "chunk", "seqnames", "pos")
    return rows.join(places.withColumn("chunk", F.floor(F.col("chunk") / n)), ["seqnames", "pos"])


def whole_ranges_until(counts: DataFrame, n: int, total: str = "records") -> DataFrame:
    """Ranges in order until their counts reach n: those whose predecessors' sum is less than n."""
    w = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    return counts.withColumn("before", F.coalesce(F.sum(total).over(w), F.lit(0))).where(F.col("before") < n).drop("before")


def sample_n(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows, those with the least digests of the seed and their own columns: a top-n by task, then of these.

    The same rows come whatever their order and partitions; equal rows come or go together but for the last.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\\N"))
    simple = [f.name for f in rows.schema if f.dataType.typeName() not in ("map", "array", "struct", "binary")]
    digest = F.md5(F.concat_ws("\t", F.lit(str(seed)), *map(text, simple)))
    return rows.withColumn("__rank", digest).orderBy("__rank", *simple).limit(n).drop("__rank")


def demultiplex(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Each row once per destination whose rule it passes, with `dest`: write it partitioned by dest in one pass."""
    names = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.withColumn("dest", F.explode(names))
