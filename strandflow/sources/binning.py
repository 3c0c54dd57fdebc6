"""Binning indexes of coordinate-sorted blocked-gzip files (.bai of BAM, .tbi of text): built, written, read and asked.

Building is a Spark job: each task goes over one byte range of a file and gives, for the records that begin
there, the chunks of virtual offsets of each bin, the first offset of each window of 16,384 positions, and
counts by contig. Spark brings these together by bin and window. Only a file's index, some thousandth of
the file, is put together by one task, which writes it beside the file. A virtual offset is a member's
place in the file, shifted by 16 bits, and a place in the member's data.

`Index.chunks` tells which stretches of the file may hold records that overlap given ranges, so that a
reader opens these and nothing else.
"""

from __future__ import annotations

import bisect
import gzip
import struct
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shifts and first numbers of the bins of the scheme's levels, the finest first, the window of the linear index, and the bin of counts.
LEVELS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1), (29, 0))
WINDOW, COUNTS_BIN = 14, 37450
#: Chunks that lie closer than this are read as one.
JOIN_BYTES = 1 << 15
PARTS = "file string, kind int, tid int, name string, at long, first long, last long"
BIN, FIRST, COUNT = range(3)


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds [start, end), from 0."""
    for shift, first in LEVELS:
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
    return 0


def bins_of(start: int, end: int) -> Iterator[int]:
    """All bins that share a position with [start, end)."""
    for shift, first in LEVELS:
        yield from range(first + (start >> shift), first + ((end - 1) >> shift) + 1)


def merged(chunks: Iterable[tuple[int, int]], near: int = 0) -> list[tuple[int, int]]:
    """Chunks in order, those joined that overlap or whose members lie at most `near` bytes apart."""
    out: list[list[int]] = []
    for a, b in sorted(chunks):
        if out and (a >> 16) <= (out[-1][1] >> 16) + near:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


@dataclass
class Index:
    """Of each contig the chunks of bins and the first offsets of windows; for text, also the names and the layout's six numbers."""

    bins: list[dict[int, list[tuple[int, int]]]]
    windows: list[list[int]]
    unplaced: int = 0
    names: list[str] = field(default_factory=list)
    layout: tuple[int, ...] = ()

    def chunks(self, tid: int, start: int, end: int) -> list[tuple[int, int]]:
        """Chunks that may hold records of the contig that overlap [start, end), from 0."""
        if not 0 <= tid < len(self.bins) or end <= start or not self.bins[tid]:
            return []
        windows = self.windows[tid]
        least = windows[start >> WINDOW] if start >> WINDOW < len(windows) else (windows[-1] if windows else 0)
        own = self.bins[tid]
        wanted = bins_of(start, min(end, 1 << 29)) if (end - start) >> WINDOW < len(own) else (b for b in own if b != COUNTS_BIN and _meets(b, start, end))
        return [(max(a, least), b) for n in wanted for a, b in own.get(n, ()) if b > least]

    def end_of_placed(self) -> int:
        """The offset behind the last record that has a contig."""
        return max([0, *[c[-1][1] for own in self.bins for n, c in own.items() if c and n != COUNTS_BIN]])

    def count(self, tid: int) -> tuple[int, int]:
        """Mapped and unmapped records of a contig."""
        pair = self.bins[tid].get(COUNTS_BIN)
        return pair[1] if pair else (0, 0)


def _meets(number: int, start: int, end: int) -> bool:
    shift, first = next(x for x in LEVELS if number >= x[1])
    return (number - first) << shift < end and (number - first + 1) << shift > start


def parse(data: bytes) -> Index:
    """An index from the bytes of a .bai or .tbi file."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    kind, n = data[:4], struct.unpack_from("<i", data, 4)[0]
    at, names, layout = 8, [], ()
    if kind == b"TBI\1":
        *layout, size = struct.unpack_from("<7i", data, 8)
        names = [x.decode() for x in data[36 : 36 + size].split(b"\0")[:-1]]
        at = 36 + size
    elif kind != b"BAI\1":
        raise ValueError("neither a .bai nor a .tbi index")
    out = Index([], [], 0, names, tuple(layout))
    for _ in range(n):
        own = {}
        (n_bins,), at = struct.unpack_from("<i", data, at), at + 4
        for _ in range(n_bins):
            number, n_chunks = struct.unpack_from("<Ii", data, at)
            flat = struct.unpack_from(f"<{2 * n_chunks}Q", data, at + 8)
            own[number] = list(zip(flat[::2], flat[1::2], strict=True))
            at += 8 + 16 * n_chunks
        (n_windows,) = struct.unpack_from("<i", data, at)
        out.bins.append(own)
        out.windows.append(list(struct.unpack_from(f"<{n_windows}Q", data, at + 4)))
        at += 4 + 8 * n_windows
    if at + 8 <= len(data):
        out.unplaced = struct.unpack_from("<Q", data, at)[0]
    return out


def render(index: Index) -> bytes:
    """The bytes of a .bai file, or, of an index with a layout, of a .tbi file before compression."""
    if index.layout:
        names = b"".join(n.encode() + b"\0" for n in index.names)
        out = [b"TBI\1", struct.pack("<8i", len(index.bins), *index.layout, len(names)), names]
    else:
        out = [b"BAI\1", struct.pack("<i", len(index.bins))]
    for own, windows in zip(index.bins, index.windows, strict=True):
        out.append(struct.pack("<i", len(own)))
        for number, chunks in sorted(own.items()):
            out.append(struct.pack(f"<Ii{2 * len(chunks)}Q", number, len(chunks), *[x for c in chunks for x in c]))
        out.append(struct.pack(f"<i{len(windows)}Q", len(windows), *windows))
    return b"".join([*out, struct.pack("<Q", index.unplaced)])


def parts_of(file: str, records: Iterable[tuple[int, int, int, bool, int, int]], names: list[str] | None = None) -> list[dict]:
    """Rows of PARTS of records in order: contig, start and end from 0, whether mapped, and the record's virtual offsets. `names` tells contigs apart that have no numbers yet."""
    chunks: list[list] = []
    windows: dict[tuple[int, int], int] = {}
    counts: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    spans: dict[int, list[int]] = {}
    for tid, start, end, mapped, first, last in records:
        tid = tid if start >= 0 else -1
        counts[tid][not mapped] += 1
        if tid < 0:
            continue
        number = bin_of(start, end)
        if chunks and chunks[-1][0] == tid and chunks[-1][1] == number and chunks[-1][3] == first:
            chunks[-1][3] = last
        else:
            chunks.append([tid, number, first, last])
        for w in range(start >> WINDOW, ((end - 1) >> WINDOW) + 1):
            windows.setdefault((tid, w), first)
        spans.setdefault(tid, [first, last])[1] = last
    rows = [(BIN, *c) for c in chunks] + [(FIRST, t, w, v, 0) for (t, w), v in windows.items()]
    for tid, (mapped, unmapped) in counts.items():
        rows += [(COUNT, tid, 1, mapped, unmapped)] + ([(COUNT, tid, 0, *spans[tid])] if tid >= 0 else [])
    return [{"file": file, "kind": k, "tid": 0 if names else t, "name": names[t] if names else None, "at": at, "first": a, "last": b} for k, t, at, a, b in rows]


def assemble(rows: list[dict], n_contigs: int = 0) -> Index:
    """A file's index from all its parts."""
    n = max([n_contigs, *[r["tid"] + 1 for r in rows]])
    found = Index([{} for _ in range(n)], [[] for _ in range(n)])
    lists: dict = defaultdict(list)
    windows: dict = defaultdict(dict)
    for r in rows:
        tid = r["tid"]
        if r["kind"] == BIN:
            lists[tid, r["at"]].append((r["first"], r["last"]))
        elif r["kind"] == FIRST:
            windows[tid][r["at"]] = min(r["first"], windows[tid].get(r["at"], r["first"]))
        elif tid < 0:
            found.unplaced += r["first"] + r["last"]
    for (tid, number), chunks in lists.items():
        found.bins[tid][number] = merged(chunks)
    for tid, own in windows.items():
        last = 0
        for w in range(max(own) + 1):
            last = own.get(w, last)
            found.windows[tid].append(last)
        spans = [r for r in rows if r["kind"] == COUNT and r["tid"] == tid]
        whole, counts = ([(r["first"], r["last"]) for r in spans if r["at"] == k] for k in (0, 1))
        found.bins[tid][COUNTS_BIN] = [(min(a for a, _ in whole), max(b for _, b in whole)), (sum(m for m, _ in counts), sum(u for _, u in counts))]
    return found


def splits_frame(spark: SparkSession, splits: list[tuple[str, int, int]]) -> DataFrame:
    """A row per byte range of a file, dealt out."""
    rows = spark.createDataFrame(splits or [("", 0, 0)], "file string, start long, stop long").where("file <> ''")
    return rows.repartition(max(1, min(len(splits), 10_000)))


def build(splits: DataFrame, scan: Callable[[str, int, int], list[dict]], finish: Callable[[str, list[dict]], Index], store: Callable[[str, Index], str]) -> DataFrame:
    """file, index (the path written) and records of each file of the splits.

    `scan` gives the rows of PARTS of a split, `finish` makes a file's Index of them, `store` writes it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = scan(r["file"], r["start"], r["stop"])
                yield pa.RecordBatch.from_pylist(rows, schema=_PART_KINDS)

    def write(table: pa.Table) -> pa.Table:
        file, rows = table.column("file")[0].as_py(), table.to_pylist()
        index = finish(file, rows)
        return pa.table({"file": [file], "index": [store(file, index)], "records": pa.array([sum(r["first"] + r["last"] for r in rows if r["kind"] == COUNT and r["at"] == 1)], pa.int64())})

    # chunks stay apart by their first offset; windows, spans and counts of a file's splits come together by contig
    parts = splits.mapInArrow(run, PARTS)
    apart = F.when(F.col("kind") == BIN, F.col("first"))
    total = (F.col("kind") == COUNT) & (F.col("at") == 1)
    joined = parts.groupBy("file", "kind", "tid", "name", "at", apart.alias("apart")).agg(
        F.when(F.first(total), F.sum("first")).otherwise(F.min("first")).alias("first"), F.when(F.first(total), F.sum("last")).otherwise(F.max("last")).alias("last")
    )
    return joined.drop("apart").groupBy("file").applyInArrow(write, "file string, index string, records long")


_PART_KINDS = pa.schema([("file", pa.string()), ("kind", pa.int32()), ("tid", pa.int32()), ("name", pa.string()), ("at", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def portions(chunks: list[tuple[int, int]], cuts: list[int], size: int) -> list[list[tuple[int, int]]]:
    """Chunks in lists of about `size` bytes; a longer chunk is cut at the offsets `cuts`, where records begin."""
    pieces: list[tuple[int, int]] = []
    cuts = sorted(set(cuts))
    for a, b in chunks:
        for c in cuts[bisect.bisect_right(cuts, a) : bisect.bisect_left(cuts, b)]:
            if (c >> 16) - (a >> 16) >= size:
                pieces.append((a, c))
                a = c
        pieces.append((a, b))
    out: list[list[tuple[int, int]]] = []
    held = 0
    for a, b in pieces:
        if not out or held + (b >> 16) - (a >> 16) > size:
            out.append([])
            held = 0
        out[-1].append((a, b))
        held += (b >> 16) - (a >> 16)
    return out
