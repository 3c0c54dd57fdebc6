"""Reference sequences: index, regions, strand-aware regions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions.sequence import in_alphabet, reverse_complement


def fasta_index(sequences: DataFrame) -> DataFrame:
    """name and length of each sequence."""
    return sequences.select("name", F.length("seq").alias("length"))


def count_sequences(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("n"))


def merge_indexes(indexes: list[DataFrame]) -> DataFrame:
    """The distinct ranges of several indexes; a name with two lengths is an error."""
    rows = indexes[0]
    for i in indexes[1:]:
        rows = rows.unionByName(i)
    found = rows.groupBy("name").agg(F.min("length").alias("length"), F.max("length").alias("most"))
    return found.select("name", F.when(F.col("length") == F.col("most"), F.col("length")).otherwise(F.raise_error(F.lit("a name has two lengths")).cast("int")).alias("length"))


#: Letters of a stored piece of a sequence, and pieces that a task gives on at once.
PIECE, PIECES_A_BATCH = 1 << 16, 256


def pieces(sequences: DataFrame, width: int = PIECE) -> DataFrame:
    """name, piece (from 0), seq: each sequence in pieces of fixed width. Store these where ranges are asked often.

    A sequence is cut in one pass over its bytes, which are ASCII letters, into views of its Arrow buffer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, seqs = batch.column(0), batch.column(1).cast(pa.large_string())
            for i in range(batch.num_rows):
                offsets = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset + i : seqs.offset + i + 2]
                size = int(offsets[1] - offsets[0]) if seqs[i].is_valid else 0
                for first in range(0, max(size, 1), width * PIECES_A_BATCH):
                    ends = np.append(np.arange(first, min(size, first + width * PIECES_A_BATCH), width), min(size, first + width * PIECES_A_BATCH))
                    ends = ends if len(ends) > 1 else np.zeros(2, np.int64)
                    cut = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends + offsets[0]), seqs.buffers()[2])
                    numbers = pa.array(np.arange(len(cut), dtype=np.int64) + first // width, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.repeat(names[i], len(cut)), numbers, cut.cast(pa.string())], names=["name", "piece", "seq"])

    return sequences.select("name", "seq").mapInArrow(run, "name string, piece int, seq string")


def regions(sequences: DataFrame, ranges: DataFrame, stranded: bool = False, alphabet: str | None = None, width: int = PIECE) -> DataFrame:
    """The sequence of each range; one that ends beyond its sequence is an error. stranded: '-' is reverse-complemented.

    Ranges meet pieces of sequences, not whole ones, and their parts are put together again.
    """
    return piece_regions(pieces(sequences, width), fasta_index(sequences), ranges, stranded, alphabet, width)


def piece_regions(stored: DataFrame, index: DataFrame, ranges: DataFrame, stranded: bool = False, alphabet: str | None = None, width: int = PIECE) -> DataFrame:
    """The same from stored pieces and the index (name, length). Ranges on unknown names give no row."""
    first, last = ((F.col(c) - 1) / width for c in ("start", "end"))
    rows = ranges.join(index.select(F.col("name").alias("contig"), F.col("length").alias("__length")), "contig").withColumn("__row", F.struct(*ranges.columns))
    good = F.when(F.col("end") <= F.col("__length"), F.floor(last)).otherwise(F.raise_error(F.lit("a range ends beyond its sequence")).cast("long"))
    full = F.col("end") >= F.col("start")
    rows = rows.withColumn("__pieces", F.when(full, F.sequence(F.floor(first), good)).otherwise(F.array(F.lit(0).cast("long"))))
    # equal ranges' parts count once each, so a row is one of its equal ones
    rows = rows.withColumn("__row", F.struct(F.monotonically_increasing_id().alias("__id"), "__row"))
    asked = rows.select("__row", F.size("__pieces").alias("__parts"), F.explode("__pieces").alias("piece"), F.col("contig").alias("name"), "start", "end")
    low, high = F.greatest(F.col("start") - F.col("piece") * width, F.lit(1)), F.least(F.col("end") - F.col("piece") * width, F.lit(width))
    met = asked.join(stored, ["name", "piece"]).select("__row", "__parts", "piece", F.substr("seq", low.cast("int"), F.greatest(high - low + 1, F.lit(0)).cast("int")).alias("part"))
    # most ranges lie in one piece; only the others' parts are brought together
    several = met.where(F.col("__parts") > 1).groupBy("__row", "__parts").agg(F.array_sort(F.collect_list(F.struct("piece", "part"))).alias("parts"))
    several = several.select("__row", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("part"))
    whole, part = met.where(F.col("__parts") == 1).select("__row", "part").unionByName(several), F.col("part")
    if alphabet:
        part = in_alphabet(part, alphabet)
    if stranded:
        part = F.when(F.col("__row.__row.strand") == "-", reverse_complement(part)).otherwise(part)
    return whole.select("__row.__row.*", part.alias("seq"))


def regions_by_file(files: list[tuple[DataFrame, DataFrame]], stranded: bool = True) -> DataFrame:
    """Each file's sequences for the ranges at the same place of the list."""
    out = None
    for i, (sequences, ranges) in enumerate(files):
        rows = regions(sequences, ranges, stranded).withColumn("file", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out
