"""Pileup over a stream of coordinate-sorted alignments, with state by (contig, tile) and a watermark as the frontier.

Contigs and positions are one line in the header's order; a read's start on it, in milliseconds, is its event
time, so the watermark is the furthest start of all reads, less one. Tasks unfold and add up their own reads by Arrow
batch. Each tile of TILE positions keeps the counts of its bases, packed into bytes, and a timer for its
last position: once the frontier has passed it, no read can reach the tile any more, it is emitted, and its
state goes. So tiles of one contig are spread over tasks, and state follows the tiles that are open, not the
stream. A record named END_NAME, after all others, moves the frontier behind the last contig and so flushes.
Spark moves the watermark between batches: a run that ends after one batch leaves to the next run what that
batch has closed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandflow.operators import places
from strandflow.operators.pileup import counting
from strandflow.schemas import MAX_COORDINATE
from strandflow.specs import PileupSpec, ScanSpec
from strandflow.streaming.chunks import END_NAME

TILE = 1 << 14
OUT = "seqnames string, pos int, strand string, nucleotide string, count long"
#: What a stream of alignments needs to have.
READS = "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string"
#: Keeps state on disk, as processors with timers need it.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class TileCounts(StatefulProcessor):
    """Counts of a tile by place and letter, held until the frontier is past the tile."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "cells binary, n binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if frames and key[1] >= 0:
            parts = [(c, n) for f in frames for c, n in zip(f["cells"], f["n"], strict=True)]
            if self.held.exists():
                parts.append(tuple(self.held.get()))
            cells, n = (np.concatenate([np.frombuffer(x, np.int64) for x in column]) for column in zip(*parts, strict=True))
            known, group = np.unique(cells, return_inverse=True)
            self.held.update((known.tobytes(), np.bincount(group, n, len(known)).astype(np.int64).tobytes()))
            self.handle.registerTimer(int(frames[0]["last"].iloc[0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cells, n = (np.frombuffer(x, np.int64) for x in (self.held.get() if self.held.exists() else (b"", b"")))
        self.held.clear()
        place, _, strand, letter = places.parted(cells)
        # texts stay in Arrow's form: a Python object for each would take longer than the counting
        texts = {"seqnames": pa.repeat(pa.scalar(key[0], pa.string()), len(n)), "strand": places.texts(strand, ["+", "-"]), "nucleotide": places.texts(letter)}
        series = {c: pd.Series(pd.arrays.ArrowExtensionArray(x)) for c, x in texts.items()}
        yield pd.DataFrame({"seqnames": series["seqnames"], "pos": (key[1] * TILE + place).astype(np.int32), "strand": series["strand"], "nucleotide": series["nucleotide"], "count": n})

    def close(self) -> None:
        pass


_ROWS = "seqnames string, tile int, last long, cells binary, n binary"


def _tiles(spec: PileupSpec):
    """A function of batches of reads, and of the record of the end, that gives rows of _ROWS."""
    pack = places.packer(["seqnames", "rank"], spec, width=TILE)
    names = [c.split()[0] for c in _ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if pa.compute.any(b.column("ended")).as_py():
                yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([b""]), pa.array([b""])], names=names)
            for rows in pack(iter([b.filter(pa.compute.invert(b.column("ended")))])):
                last = rows.column("rank").to_numpy() * MAX_COORDINATE + (rows.column("tile").to_numpy().astype(np.int64) + 1) * TILE - 1
                yield pa.RecordBatch.from_arrays([rows.column("seqnames"), rows.column("tile"), pa.array(last), rows.column("cells"), rows.column("n")], names=names)

    return run


def tile_pileup(alignments: DataFrame, contigs: DataFrame, spec: PileupSpec | None = None, scan_spec: ScanSpec | None = None) -> DataFrame:
    """A streaming DataFrame of final positions (append mode) from one of alignments in the order of contigs (name, tid).

    Reads on a contig that the header lacks are an error. The session must keep state by PROVIDER when the query starts.
    """
    spec = spec or PileupSpec()
    ranks = F.broadcast(contigs.select(F.col("name").alias("rname"), F.col("tid").cast("long").alias("rank")))  # a header's contigs
    ended = F.col("qname") == END_NAME
    unknown = F.raise_error(F.concat(F.lit("the header has no contig "), "rname")).cast("long")
    reads = alignments.where(ended | F.col("rname").isNotNull()).join(ranks, "rname", "left").withColumn("rank", F.when(ended, 1 << 20).otherwise(F.coalesce("rank", unknown)))
    timed = reads.withColumn("__at", F.timestamp_millis(F.col("rank") * MAX_COORDINATE + F.coalesce("pos", F.lit(0)))).withWatermark("__at", "1 millisecond")
    rows = timed.where(ended | counting(scan_spec, spec.min_mapq)).select(F.col("rname").alias("seqnames"), "rank", "pos", "flag", "cigar", "seq", "qual", ended.alias("ended"))
    sums = rows.mapInArrow(_tiles(spec), _ROWS)
    return sums.groupBy("seqnames", "tile").transformWithStateInPandas(TileCounts(), OUT, "append", "eventTime")


def keep_state_on_disk(spark: SparkSession) -> None:
    spark.conf.set(*PROVIDER)
