"""Pileup over a stream of coordinate-sorted alignments, released behind a moving frontier.

Each contig keeps the counts of positions that later reads may still cover: those at or beyond the
largest read start seen. Whatever lies before it is final and is emitted. State is bounded by the
positions that reads at the frontier reach, not by the stream. A record named END_NAME on a contig
tells that no more come, and flushes it. Out-of-order records behind the frontier are not expected.

Tasks add up their own bases by Arrow batch before the shuffle, so a contig's state gets a row for each
position of a batch and not for each base. A contig's frontier is one value: its state is one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from strandflow.operators import places
from strandflow.operators.pileup import _reads
from strandflow.specs import PileupSpec, ScanSpec

END_NAME = "__end__"
_OUT = "seqnames string, pos int, strand string, nucleotide string, count long"
_STATE = "frontier int, pos array<int>, strand array<string>, nucleotide array<string>, n array<long>"


def _release(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    frontier, pos, strand, nucleotide, n = state.get if state.exists else (0, [], [], [], [])
    parts = [pd.DataFrame({"pos": pos, "strand": strand, "nucleotide": nucleotide, "n": n})]
    end = False
    for f in frames:
        end = end or bool(f["ended"].any())
        f = f[~f["ended"]]
        if len(f):
            frontier = max(frontier, int(f["read_start"].max()))
            f = f[f["nucleotide"].notna()]
            parts.append(f.groupby(["pos", "strand", "nucleotide"], as_index=False)["n"].sum())
    held = pd.concat([p for p in parts if len(p)], ignore_index=True) if any(map(len, parts)) else parts[0]
    held = held.groupby(["pos", "strand", "nucleotide"], as_index=False)["n"].sum() if len(held) else held
    done = held["pos"].notna() if end else held["pos"] < frontier
    rest = held[~done]
    state.update((frontier, [int(x) for x in rest["pos"]], list(rest["strand"]), list(rest["nucleotide"]), [int(x) for x in rest["n"]]))
    out = held[done].sort_values(["pos", "nucleotide", "strand"])
    yield pd.DataFrame({"seqnames": key[0], "pos": out["pos"].astype("int32"), "strand": out["strand"], "nucleotide": out["nucleotide"], "count": out["n"].astype("int64")})


_KEYS = ["seqnames", "pos", "strand", "nucleotide", "ended"]


def _batch_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each batch's equal bases, with the furthest start of their reads."""
    for b in batches:
        sums = pa.table(b).group_by(_KEYS).aggregate([("read_start", "max"), ("n", "sum")])
        sums = sums.rename_columns([c.removesuffix("_max").removesuffix("_sum") for c in sums.column_names])
        yield from sums.select(b.schema.names).to_batches()


def stream_pileup(alignments: DataFrame, spec: PileupSpec | None = None, scan_spec: ScanSpec | None = None) -> DataFrame:
    """A streaming DataFrame of final positions (append mode) from a streaming DataFrame of alignments."""
    spec = spec or PileupSpec()
    reads = _reads(alignments, scan_spec, spec.min_mapq).where(F.col("qname") != END_NAME)
    events = places.unfolded(reads.select(F.col("rname").alias("seqnames"), F.col("pos").alias("read_start"), "pos", "flag", "cigar", "seq", "qual"), ["seqnames", "read_start"], spec)
    counted = events.select("seqnames", "pos", "strand", "nucleotide", "read_start", F.lit(1).cast("long").alias("n"), F.lit(False).alias("ended"))
    ends = alignments.where(F.col("qname") == END_NAME).select(F.col("rname").alias("seqnames"), *[F.lit(None).cast(t).alias(c) for c, t in (("pos", "int"), ("strand", "string"), ("nucleotide", "string"), ("read_start", "int"), ("n", "long"))], F.lit(True).alias("ended"))
    rows = counted.unionByName(ends)
    rows = rows.mapInArrow(_batch_sums, rows.schema)
    return rows.groupBy("seqnames").applyInPandasWithState(_release, _OUT, _STATE, "append", "NoTimeout")
