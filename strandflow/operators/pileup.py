"""Pileup: counts of bases by position, strand, nucleotide and place in the read.

Tasks unfold their reads by Arrow batch (operators/places.py) and add up equal bases; one shuffle deals packed
tiles of positions, which are added up as they pass in order. The tests on positions and nucleotides look at
coarser sums of the same cells there, so the whole operator has a single shuffle.

Depth caps: reads are first counted by bins of positions. Where no bin has more reads than the cap, no
position has. In the other bins reads are swept in order, once by each task over its own and once by bin
over those that may still count, so what is sorted twice follows the cap there; a read is sent with the
stretches where it counts, not once for each position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions import cigar
from strandflow.operators import places
from strandflow.operators.intervals import check_ranges, interval_join, unique_labels
from strandflow.operators.scan import predicate
from strandflow.shared import cut, numbered
from strandflow.specs import MultiPileupSpec, PileupSpec, ScanSpec

#: Unmapped, secondary, failed and duplicate reads never count.
EXCLUDED = 4 + 256 + 512 + 1024
#: Positions of a bin by which reads are counted before any is ranked.
CAP_BIN = places.TILE
#: Deep bins that are broadcast, at most; of some 40 bytes each.
DEEP_BROADCAST = 1_000_000
#: Fixed nucleotide letters of a pileup.
NUCLEOTIDES = "ACGTN=-+"


def counting(scan_spec: ScanSpec | None, min_mapq: int) -> Column:
    """Whether a read counts at all."""
    test = predicate(scan_spec or ScanSpec()) & (F.col("flag").bitwiseAND(EXCLUDED) == 0) & F.col("cigar").isNotNull() & F.col("pos").isNotNull()
    return test & (F.col("mapq") >= min_mapq) if min_mapq else test


def _reads(alignments: DataFrame, scan_spec: ScanSpec | None, min_mapq: int) -> DataFrame:
    return alignments.where(counting(scan_spec, min_mapq))


def pileup(alignments: DataFrame, spec: PileupSpec | None = None, scan_spec: ScanSpec | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """seqnames, pos[, strand][, nucleotide][, left_bin or query_bin], count[, range_id, which_label].

    max_depth keeps, at each position, the first reads in order of start, name and flag (the least
    of equal ones), so the result does not depend on the order of the input.
    """
    spec = spec or PileupSpec()
    reads = _reads(alignments, scan_spec, spec.min_mapq)
    labelled = unique_labels(check_ranges(ranges)) if ranges is not None else None
    keys = ["range_id", "range_label", "seqnames"] if ranges is not None else ["seqnames"]
    tested = spec.min_nucleotide_depth > 1 or spec.min_minor_allele_depth > 0
    keep = spec.distinguish_strands, spec.distinguish_nucleotides or tested
    binned = [("left_bin" if spec.left_bins else "query_bin")] if spec.left_bins or spec.query_bins else []
    dims = [*(["strand"] if spec.distinguish_strands else []), *(["nucleotide"] if spec.distinguish_nucleotides else []), *binned]
    columns = ", ".join([*(f"{c} string" for c in dims), "count long"])

    def finish(spot: np.ndarray, letter: np.ndarray, strand: np.ndarray, bins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        at = _passing(spot, letter, n, spec) if tested else np.arange(len(spot))
        if keep[1] and not spec.distinguish_nucleotides and len(at):
            # letters are the lowest part of a cell, so those of one place, strand and bin stand together
            same = (spot[at] * 2 + strand[at]) * (1 + int(bins.max(initial=0))) + bins[at]
            new = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
            at, n = at[new], np.add.reduceat(n[at], new)
        else:
            n = n[at]
        out = {"strand": lambda: places.texts(strand[at], ["+", "-"]), "nucleotide": lambda: places.texts(letter[at])} | {b: lambda: places.texts(bins[at], places.bin_labels(spec)) for b in binned}
        return at, {c: out[c]() for c in dims} | {"count": pa.array(n, pa.int64())}

    def counted(rows: DataFrame, skip: DataFrame | None = None) -> DataFrame:
        return places.counted(rows, keys, spec, keep, finish, columns, skip, ["seqnames", "tile"])

    return _up_to(reads, labelled, spec.max_depth, [], counted).withColumnRenamed("range_label", "which_label")


def _up_to(reads: DataFrame, ranges: DataFrame | None, depth: int | None, by: list[str], counted) -> DataFrame:
    """`counted` of the reads, in the ranges if any, where no position has more than `depth` reads, for each value of `by`."""
    stop = cigar.reference_end(F.col("pos"), F.col("cigar"))
    whole = reads if ranges is None else interval_join(reads.withColumn("__end", stop), ranges, "rname", "pos", "__end").drop("__end")
    if depth is None:
        return counted(whole)
    bins = F.explode(F.sequence((F.col("pos") / CAP_BIN).cast("long"), (stop / CAP_BIN).cast("long"))).alias("__bin")
    deep = cut(reads.select(*by, "rname", bins).groupBy(*by, "rname", "__bin").agg(F.count("*").alias("n")).where(F.col("n") > depth).drop("n"))
    n_deep = deep.count()
    if not n_deep:
        return counted(whole)
    known = deep.select(*by, F.col("rname").alias("seqnames"), F.col("__bin").cast("int").alias("tile"))
    skip = F.broadcast(known) if n_deep <= DEEP_BROADCAST else known
    held = [*dict.fromkeys([*by, "rname", "pos", "qname", "flag", "cigar", "seq", "qual"])]
    low, high = F.greatest(F.col("pos"), F.col("__bin") * CAP_BIN), F.least(stop, F.col("__bin") * CAP_BIN + (CAP_BIN - 1))
    covering = reads.select(*held, bins).join(F.broadcast(deep) if n_deep <= DEEP_BROADCAST else deep, [*by, "rname", "__bin"]).withColumn("__kept", F.array(F.struct(low.cast("int").alias("a"), high.cast("int").alias("b"))))
    # first each task of the reads takes what may count of its own, then the bins' tasks of what these have left
    for dealt in (covering, None):
        rows = dealt if dealt is not None else swept.repartition(*by, "rname", "__bin")
        swept = _sweep(rows.sortWithinPartitions(*by, "rname", "__bin", "pos", "qname", "flag", "cigar", "seq", "qual"), by, depth)
    kept = swept.select(*held, F.inline("__kept")).withColumnsRenamed({"a": "__from", "b": "__to"})
    if ranges is not None:
        kept = interval_join(kept, ranges, "rname", "__from", "__to").withColumns({"range_start": F.greatest("range_start", "__from"), "range_end": F.least("range_end", "__to")})
    else:
        kept = kept.withColumns({"range_start": F.col("__from"), "range_end": F.col("__to")})
    return counted(whole, skip).unionByName(counted(kept.drop("__from", "__to")))


def _sweep(rows: DataFrame, by: list[str], depth: int) -> DataFrame:
    """Reads in order by bin, each with the stretches of `__kept` where fewer than `depth` reads of its bin stand before it; none are left out.

    A task counts the reads so far at each position of one bin, CAP_BIN numbers, and sends rows on as they come.
    """
    keys = [*by, "rname", "__bin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, np.zeros(CAP_BIN, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            spans = np.diff(batch.column("__kept").offsets.to_numpy()) * CAP_BIN  # at most
            for a, b in places.portions(spans, places.PORTION):
                part = batch.slice(a, b - a)
                columns = [part.column(k) for k in keys]
                code = places.codes_of(columns, len(part))
                new = np.append(True, code[1:] != code[:-1])
                edge = [tuple(c[i].as_py() for c in columns) for i in (0, len(part) - 1)]
                if edge[0] != last:
                    seen = np.zeros(CAP_BIN, np.int64)
                at, kept, seen = _free(part, np.cumsum(new) - 1, seen, depth)
                last = edge[1]
                place = part.schema.get_field_index("__kept")
                yield part.take(pa.array(at, pa.int32())).set_column(place, part.schema.field(place), kept.cast(part.schema.field(place).type))

    return rows.mapInArrow(run, rows.schema)


def _free(part: pa.RecordBatch, group: np.ndarray, seen: np.ndarray, depth: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Rows of ordered reads that count somewhere, the stretches where they do, and the counts of the last group.

    group numbers each row's bin; seen holds the counts of the first before these rows.
    """
    lists = part.column("__kept")
    row = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
    begin, end = (lists.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in "ab")
    n = np.maximum(end - begin + 1, 0)
    place = np.repeat(begin, n) + places.ramp(n)
    first = part.column("__bin").to_numpy()[row].astype(np.int64) * CAP_BIN
    spot = np.repeat(group[row], n) * CAP_BIN + place - np.repeat(first, n)
    order = np.argsort(spot, kind="stable")
    runs = np.diff(np.flatnonzero(np.append(np.append(True, spot[order][1:] != spot[order][:-1]), True))) if len(spot) else np.zeros(0, np.int64)
    before = np.empty(len(spot), np.int64)
    before[order] = places.ramp(runs)
    here = spot < CAP_BIN  # of the first group
    before[here] += seen[spot[here]]
    free = before < depth
    counts = np.bincount(spot[free & (spot >= group[-1] * CAP_BIN)] - group[-1] * CAP_BIN, minlength=CAP_BIN)
    seen = counts + seen if group[-1] == 0 else counts
    # stretches of free positions one after another within a stretch of the read
    of = np.repeat(np.arange(len(row)), n)
    joined = np.append(False, free[1:] & free[:-1] & (of[1:] == of[:-1])) if len(of) else np.zeros(0, bool)
    starts = np.flatnonzero(free & ~joined)
    ends = np.flatnonzero(free & ~np.append(joined[1:], False))
    at, of_row = np.unique(row[of[starts]], return_counts=True)
    stretches = pa.StructArray.from_arrays([pa.array(place[starts], pa.int32()), pa.array(place[ends], pa.int32())], ["a", "b"])
    return at, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(of_row)), pa.int32()), stretches), seen


def _passing(spot: np.ndarray, letter: np.ndarray, n: np.ndarray, spec: PileupSpec) -> np.ndarray:
    """Indexes of the cells that pass the tests on positions and nucleotides; spots are in order."""
    pair, of = np.unique((spot << 21) | letter, return_inverse=True)
    by_letter = np.bincount(of, n, len(pair)).astype(np.int64)
    new = np.append(True, (pair >> 21)[1:] != (pair >> 21)[:-1])[: len(pair)]
    starts = np.flatnonzero(new)
    minor = np.add.reduceat(by_letter, starts) - np.maximum.reduceat(by_letter, starts) if len(pair) else by_letter
    passes = (by_letter >= spec.min_nucleotide_depth) & (minor >= spec.min_minor_allele_depth)[np.cumsum(new) - 1]
    return np.flatnonzero(passes[of])


def _file_reads(alignments: DataFrame, spec: MultiPileupSpec) -> DataFrame:
    return _reads(alignments, ScanSpec(flag=spec.flag), spec.min_mapq)


def multi_file_depth(alignments: DataFrame, ranges: DataFrame, spec: MultiPileupSpec | None = None) -> DataFrame:
    """Depth of A, C, G, T and N per range, position and file. `alignments` has `file`; yield_all fills in zeros.

    max_depth holds for each file.
    """
    spec = spec or MultiPileupSpec()
    events = PileupSpec(min_base_quality=spec.min_base_quality, ignore_query_ns=False, include_deletions=False)

    def finish(spot: np.ndarray, letter: np.ndarray, strand: np.ndarray, bins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        new = np.append(True, spot[1:] != spot[:-1])
        base = np.full(len(letter), 4)
        for i, b in enumerate("ACGT"):
            base[letter == ord(b)] = i
        sums = np.bincount((np.cumsum(new) - 1) * 5 + base, n, 5 * int(new.sum())).astype(np.int64).reshape(-1, 5)
        return np.flatnonzero(new), {b: pa.array(np.ascontiguousarray(sums[:, i])) for i, b in enumerate("ACGTN")}

    counted = lambda rows, skip=None: places.counted(rows, ["range_id", "file", "seqnames"], events, (False, True), finish, "A long, C long, G long, T long, N long", skip, ["file", "seqnames", "tile"])
    depth = _up_to(_file_reads(alignments, spec), check_ranges(ranges), spec.max_depth, ["file"], counted)
    if spec.min_depth > 0:
        total = sum((F.col(b) for b in "CGTN"), F.col("A"))
        deep = depth.groupBy("range_id", "seqnames", "pos").agg(F.sum(total).alias("t")).where(F.col("t") >= spec.min_depth)
        depth = depth.join(deep.drop("t"), ["range_id", "seqnames", "pos"], "left_semi")
    if not spec.yield_all:
        return depth
    # the list of files goes to the ranges, which are dealt out before they become positions: no side of unfolded positions is ever broadcast
    files = F.broadcast(alignments.select("file").distinct())
    tasks = int(alignments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranges.select("range_id", F.col("contig").alias("seqnames"), "start", "end").repartition(tasks, "range_id").crossJoin(files)
    every = dealt.select("range_id", "file", "seqnames", F.explode(F.sequence("start", "end")).alias("pos"))
    zero = [F.coalesce(b, F.lit(0)).cast("long").alias(b) for b in "ACGTN"]
    return every.join(depth, ["range_id", "file", "seqnames", "pos"], "left").select("range_id", "file", "seqnames", "pos", *zero)


def quality_depth(alignments: DataFrame, ranges: DataFrame, spec: MultiPileupSpec | None = None) -> DataFrame:
    """Counts of base qualities per range, position and file; max_depth holds for each file."""
    spec = spec or MultiPileupSpec()
    # the quality string stands in for the bases, so an event's letter is its quality
    reads = _file_reads(alignments, spec).withColumn("seq", F.col("qual"))
    events = PileupSpec(min_base_quality=spec.min_base_quality, ignore_query_ns=False, include_deletions=False)
    finish = lambda spot, letter, strand, bins, n: (np.arange(len(spot)), {"quality": pa.array(letter - 33, pa.int32()), "count": pa.array(n, pa.int64())})
    counted = lambda rows, skip=None: places.counted(rows, ["range_id", "file", "seqnames"], events, (False, True), finish, "quality int, count long", skip, ["file", "seqnames", "tile"])
    return _up_to(reads, check_ranges(ranges), spec.max_depth, ["file"], counted)


#: Letters and quality values of the arrays of `depth_arrays`.
LETTERS, QUALITIES = 5, 94


def depth_arrays(alignments: DataFrame, ranges: DataFrame, files: list[str], spec: MultiPileupSpec | None = None, n: int = 10_000) -> DataFrame:
    """Depths of n positions a row, as dense arrays: chunk, range_id, seqnames and pos (a value for each position), seq and qual.

    `seq` has, for each position and then each file in the order of `files`, the counts of A, C, G, T and N; `qual` those of
    QUALITIES base qualities. Positions are numbered in the order of ranges, so a range that a chunk leaves unfinished goes on
    in the next. Counts are summed by tasks and by Spark first; a chunk's task puts at most n x files x 99 of them into arrays.
    """
    key = ["range_id", "seqnames", "pos"]
    depth = multi_file_depth(alignments, ranges, spec)
    letters = F.inline(F.array(*[F.struct(F.lit(i).alias("code"), F.col(b).alias("count")) for i, b in enumerate("ACGTN")]))
    quality = quality_depth(alignments, ranges, spec).where((F.col("quality") >= 0) & (F.col("quality") < QUALITIES))
    counts = depth.select(*key, "file", letters).where("count > 0").unionByName(quality.select(*key, "file", (F.col("quality") + LETTERS).alias("code"), "count"))
    counts = cut(counts)  # used twice
    places = numbered(counts.select(*key).distinct(), "place", *key)
    at = places.select(*key, F.floor(F.col("place") / n).alias("chunk"), (F.col("place") % n).cast("int").alias("slot"))
    names, kind = list(files), dict(ranges.dtypes)["range_id"]

    def dense(table: pa.Table) -> pa.Table:
        slot, code, count = (table.column(c).to_numpy() for c in ("slot", "code", "count"))
        file = pa.compute.index_in(table.column("file"), value_set=pa.array(names)).to_numpy()
        if np.isnan(file.astype(float)).any():
            raise ValueError("a file is not listed")
        size = int(slot.max()) + 1
        cells = np.zeros((size, len(names), LETTERS + QUALITIES), np.int64)
        np.add.at(cells, (slot, file.astype(np.int64), code), count)
        _, first = np.unique(slot, return_index=True)
        each = table.take(pa.array(first))
        lists = {c: pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), each.column(c).combine_chunks()) for c in key}
        flat = {c: pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(np.ascontiguousarray(x).ravel())) for c, x in (("seq", cells[:, :, :LETTERS]), ("qual", cells[:, :, LETTERS:]))}
        return pa.table({"chunk": table.column("chunk").slice(0, 1).combine_chunks(), **lists, **flat})

    schema = f"chunk long, range_id array<{kind}>, seqnames array<string>, pos array<int>, seq array<long>, qual array<long>"
    return counts.join(at, key).select("chunk", *key, "slot", "file", F.col("code").cast("int").alias("code"), F.col("count").cast("long").alias("count")).groupBy("chunk").applyInArrow(dense, schema)
