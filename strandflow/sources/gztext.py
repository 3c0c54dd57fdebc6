"""Text lines of blocked-gzip and plain files, split and placed; text indexes (.tbi), FASTA by offsets (.fai, .gzi).

`spark.read.format("lines")` deals a file out in byte ranges: a task begins at the first member (of a plain
file, the first byte) of its range, leaves out what is left of the line before, and ends with the line that
begins at or before the next range. Each line has its offset: virtual in blocked gzip, else in bytes. With
`ranges` and `layout` it reads only what a .tbi index beside the file names. Lines come as Arrow batches.
"""

from __future__ import annotations

import bisect
import dataclasses
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from strandflow.functions.sequence import reverse_complement
from strandflow.operators.intervals import normalize
from strandflow.operators.tabtext import Layout
from strandflow.sources import binning
from strandflow.sources.bgzf import SPLIT_BYTES, Cursor, FolderWriter, Overlaps, SplitReader, _Chunks, _Members, _open, _Range, compress, files_of, index_path, next_member, read_index, write_file

LINES = "line string, file string, offset long"
#: Bytes of lines that are handled at once, and of a block of a plain file.
BATCH_BYTES, BLOCK_BYTES = 4 << 20, 1 << 18


def is_blocked(file) -> bool:
    """Whether a file begins with a member of blocked gzip; other gzip files cannot be split."""
    file.seek(0)
    head = file.read(18)
    if head[:2] == b"\x1f\x8b" and head[12:16] != b"BC\x02\0":
        raise ValueError("gzip, but not in blocks")
    return head[:2] == b"\x1f\x8b"


def _plain(file, at: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Blocks of a plain file; one begins at `end`."""
    file.seek(at)
    while data := file.read(min(BLOCK_BYTES, end - at) if at < end else BLOCK_BYTES):
        yield at, data
        at += len(data)


def line_batches(path: str, begin: int, end: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Lines that belong to a file's byte range, and the offsets of each one and of what follows it."""
    with _open(path) as f:
        blocked = is_blocked(f)
        start = begin if not blocked or begin == 0 else next_member(f, begin)
        if start is None or start >= end:
            return
        data, spans, bound, skip = b"", [], None, start > 0
        blocks = iter(_Members(f, start)) if blocked else _plain(f, start, end)
        while True:
            taken = next(blocks, None)
            if taken is not None:
                at, piece = taken
                if at >= end and bound is None:
                    bound = len(data)
                spans.append((len(data), at))
                data += piece
                if len(data) < BATCH_BYTES and bound is None:
                    continue
            follows = (f.tell() << 16) if blocked else f.tell()
            stops = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
            if taken is None and data and data[-1] != 10:
                stops = np.append(stops, len(data))
            starts = np.concatenate([[0], stops + 1])
            if skip and len(stops):
                starts, stops, skip = starts[1:], stops[1:], False
            places, ats = np.array([s for s, _ in spans], np.int64), np.array([a for _, a in spans], np.int64)
            j = np.maximum(np.searchsorted(places, starts, "right") - 1, 0)
            inside = starts - places[j] if len(places) else starts
            offsets = np.where(starts >= len(data), follows, (ats[j] << 16 | inside) if blocked else ats[j] + inside) if len(places) else np.full(len(starts), follows)
            n = len(stops) if skip is False else 0
            done = taken is None
            if bound is not None and (over := int(np.searchsorted(starts[:n], bound, "right"))) < n:
                n, done = over, True
            if n:
                yield [data[a:b] for a, b in zip(starts[:n].tolist(), stops[:n].tolist(), strict=True)], offsets[:n], offsets[1 : n + 1]
            if done or (bound is not None and n and starts[n] > bound):
                return
            if n:
                rest = int(starts[n])
                kept = [(s - rest, a) for s, a in spans]
                spans = [x for k, x in enumerate(kept) if k + 1 == len(kept) or kept[k + 1][0] > 0]
                data, bound = data[rest:], None if bound is None else bound - rest


def _line(data: bytes, i: int) -> int | None:
    end = data.find(b"\n", i)
    return end + 1 - i if end >= 0 else None


def chunk_lines(path: str, chunks: list[tuple[int, int]]) -> Iterator[tuple[int, bytes]]:
    """Lines, without their ends, that begin in chunks of virtual offsets."""
    with _open(path) as f:
        for a, b in chunks:
            cursor = Cursor(f, a >> 16, a & 0xFFFF)
            if cursor.more():
                yield from ((v, r[:-1]) for v, _, r in cursor.records(_line, b))
                if cursor.i < len(cursor.data) and _line(cursor.data, cursor.i) is None and cursor.offset(cursor.i) < b:
                    yield cursor.offset(cursor.i), cursor.data[cursor.i :]


def spans_of(line: bytes, layout: Layout) -> tuple[str, int, int]:
    """Contig, start from 0 and end of a line."""
    parts = line.split(b"\t", max(layout.seq, layout.start, layout.end))
    start = int(parts[layout.start - 1]) - (not layout.zero_based)
    return parts[layout.seq - 1].decode(), start, max(int(parts[layout.end - 1]) if layout.end else start + 1, start + 1)


def _batch(lines: list[bytes], path: str, offsets) -> pa.RecordBatch:
    text = pa.array([x.removesuffix(b"\r") for x in lines], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([text, pa.repeat(path, len(lines)), pa.array(offsets, pa.int64())], names=["line", "file", "offset"])


class LinesReader(SplitReader):
    def __init__(self, options):
        super().__init__(options)
        self.ranges = json.loads(options["ranges"]) if options.get("ranges") else None
        self.layout = Layout(**json.loads(options["layout"])) if options.get("layout") else None

    def partitions(self):
        if self.ranges is None:
            return super().partitions()
        out = []
        for path, _ in (x for p in self.paths for x in files_of(p)):
            index = read_index(path, (".tbi",))
            if index is None:
                raise ValueError(f"{path} has no .tbi index")
            ids = {n: i for i, n in enumerate(index.names)}
            asked = [(ids[c], a - 1, b) for c, a, b in self.ranges if c in ids]
            chunks = binning.merged((c for w in asked for c in index.chunks(*w)), binning.JOIN_BYTES)
            out += [_Chunks(path, c) for c in binning.portions(chunks, [v for w in index.windows for v in w], self.split)]
        return out

    def read(self, partition):
        if partition is None:
            return
        if isinstance(partition, _Range):
            for lines, offsets, _ in line_batches(partition.path, partition.start, partition.end):
                yield _batch(lines, partition.path, offsets)
            return
        ids: dict[str, int] = {}
        wanted = Overlaps([(ids.setdefault(c, len(ids)), a - 1, b) for c, a, b in self.ranges])
        held: list[tuple[int, bytes]] = []
        for offset, line in chunk_lines(partition.path, partition.chunks):
            contig, start, end = spans_of(line, self.layout)
            if contig in ids and wanted.test(ids[contig], start, end):
                held.append((offset, line))
            if len(held) == 10_000:
                yield _batch([x for _, x in held], partition.path, [v for v, _ in held])
                held = []
        if held:
            yield _batch([x for _, x in held], partition.path, [v for v, _ in held])


class LinesWriter(FolderWriter):
    """Blocked-gzip text files of the column `line`."""

    ending = ".gz"

    def encode(self, row):
        return row["line"].encode() + b"\n"


class LinesSource(DataSource):
    """Options: path (comma-separated files or folders), splitBytes, ranges, layout; for writing path (a folder), which gets blocked gzip."""

    @classmethod
    def name(cls):
        return "lines"

    def schema(self):
        return LINES

    def reader(self, schema):
        return LinesReader(self.options)

    def writer(self, schema, overwrite):
        return LinesWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LinesSource)


def _splits(path: str, split: int) -> list[tuple[str, int, int]]:
    return [(p, a, a + split) for p, size in files_of(path) for a in range(0, max(size, 1), split)]


def index_files(spark: SparkSession, path: str, layout: Layout, split: int = SPLIT_BYTES) -> DataFrame:
    """Write a .tbi index beside each blocked-gzip file of `path`, whose lines stand by contig and in order of start: file, index, records.

    Lines that the layout skips are looked for in a file's first split.
    """

    def scan(file: str, start: int, stop: int) -> list[dict]:
        ids: dict[str, int] = {}
        seen = 0

        def rows():
            nonlocal seen
            for lines, first, last in line_batches(file, start, stop):
                for line, a, b in zip(lines, first.tolist(), last.tolist(), strict=True):
                    seen += 1
                    if line and not line.startswith(layout.comment.encode()) and (start or seen > layout.skip):
                        contig, low, high = spans_of(line, layout)
                        yield ids.setdefault(contig, len(ids)), low, high, True, a, b

        parts = list(rows())
        return binning.parts_of(file, parts, list(ids)) if parts else []

    def finish(file: str, rows: list[dict]) -> binning.Index:
        first: dict[str, int] = {}
        for r in rows:
            if r["kind"] == binning.BIN:
                first[r["name"]] = min(r["first"], first.get(r["name"], r["first"]))
        names = sorted(first, key=first.get)
        out = binning.assemble([r | {"tid": names.index(r["name"])} for r in rows], len(names))
        kind = 1 << 16 if layout.zero_based else 0
        out.names, out.layout = names, (kind, layout.seq, layout.start, layout.end, ord(layout.comment), layout.skip)
        return out

    def store(file: str, index: binning.Index) -> str:
        write_file(file + ".tbi", compress(binning.render(index)))
        return file + ".tbi"

    return binning.build(binning.splits_frame(spark, _splits(path, split)), scan, finish, store)


def read_ranges(spark: SparkSession, path: str, ranges: DataFrame, layout: Layout, split: int = SPLIT_BYTES) -> DataFrame:
    """Lines that overlap any of the ranges, through the files' .tbi indexes; the merged ranges, a scan's parameter, go to the reader."""
    listed = [[r["contig"], r["start"], r["end"]] for r in normalize(ranges).select("contig", "start", "end").orderBy("contig", "start").toLocalIterator()]
    return spark.read.format("lines").option("ranges", json.dumps(listed)).option("layout", json.dumps(dataclasses.asdict(layout))).option("splitBytes", str(split)).load(path)


def known_names(path: str) -> list[str]:
    """The contigs of the .tbi indexes beside the files, in order, each once."""
    return list(dict.fromkeys(n for f, _ in files_of(path) for n in (read_index(f, (".tbi",)) or binning.Index([], [])).names))


# --- FASTA by offsets


def index_blocks(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """Write a .gzi beside each blocked-gzip file: where members begin in the file and in its data. file, index, members."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            with _open(r["file"]) as f:
                at = next_member(f, r["start"])
                rows = []
                while at is not None and at < r["stop"]:
                    f.seek(at)
                    head = f.read(18)
                    if len(head) < 18:
                        break
                    length = struct.unpack_from("<H", head, 16)[0] + 1
                    f.seek(at + length - 4)
                    rows.append({"file": r["file"], "at": at, "size": struct.unpack("<I", f.read(4))[0]})
                    at += length
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())]))

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        at, size = (table.column(c).to_numpy() for c in ("at", "size"))
        pairs = np.stack([at, np.cumsum(size) - size], 1)[1:]  # the first member's pair of zeros is left out
        file = table.column("file")[0].as_py()
        write_file(file + ".gzi", struct.pack("<Q", len(pairs)) + pairs.astype("<u8").tobytes())
        return pa.table({"file": [file], "index": [file + ".gzi"], "members": [len(at)]})

    return binning.splits_frame(spark, _splits(path, split)).mapInArrow(sizes, "file string, at long, size long").groupBy("file").applyInArrow(write, "file string, index string, members long")


def block_starts(path: str) -> list[tuple[int, int]] | None:
    """Where members begin in a file's data and in the file, of the .gzi beside it; None of a plain file."""
    with _open(path) as f:
        if not is_blocked(f):
            return None
    found = index_path(path, (".gzi",))
    if found is None:
        raise ValueError(f"{path} has no .gzi index")
    with _open(found) as f:
        flat = np.frombuffer(f.read()[8:], "<u8").reshape(-1, 2)
    return [(0, 0), *[(int(u), int(c)) for c, u in flat]]


def index_fasta(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """file, name, length, offset, line_bases and line_width of each sequence, as .fai files have them; offsets are of the data.

    A task makes a row of each run of lines of one sequence; runs of a sequence that crosses splits are put together by
    their order in the file. Sequences whose lines, but the last, differ in length are an error.
    """
    blocks = {f: block_starts(f) for f, _ in files_of(path)}

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("name", pa.string()), ("offset", pa.int64()), ("bases", pa.int64()), ("line_bases", pa.int64()), ("line_width", pa.int64()), ("short", pa.int64()), ("uneven", pa.bool_())])
        for r in (r for b in batches for r in b.to_pylist()):
            starts = blocks[r["file"]]
            place = (lambda v: v) if starts is None else (lambda v, c=[x for _, x in starts], u=[x for x, _ in starts]: u[bisect.bisect_right(c, v >> 16) - 1] + (v & 0xFFFF))
            out: list[dict] = []
            for lines, first, last in line_batches(r["file"], r["start"], r["stop"]):
                for line, a, b in zip(lines, first.tolist(), last.tolist(), strict=True):
                    if line[:1] == b">" or not out:
                        out.append({"file": r["file"], "at": place(a), "name": None, "offset": None, "bases": 0, "line_bases": None, "line_width": None, "short": None, "uneven": False})
                    run = out[-1]
                    if line[:1] == b">":
                        run["name"] = (line[1:].split() or [b""])[0].decode()
                        continue
                    size = len(line.removesuffix(b"\r"))
                    if run["offset"] is None:
                        run |= {"offset": place(a), "line_bases": size, "line_width": size + 1 + (len(line) - size)}
                    run["uneven"] |= size > run["line_bases"] or (run["short"] is not None and size > 0)
                    if size < run["line_bases"]:
                        run["short"] = size
                    run["bases"] += size
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    kind = "file string, at long, name string, offset long, bases long, line_bases long, line_width long, short long, uneven boolean"
    found = binning.splits_frame(spark, _splits(path, split)).mapInArrow(runs, kind)
    order = Window.partitionBy("file").orderBy("at")  # a row per sequence and split
    found = found.withColumn("n", F.count("name").over(order))
    inner = Window.partitionBy("file", "n").orderBy("at")
    found = found.withColumn("later", F.lead("bases").over(inner)).withColumn("line", F.first("line_bases", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    bad = F.col("uneven") | (F.col("short").isNotNull() & (F.coalesce("later", F.lit(0)) > 0)) | ((F.col("line_bases") > F.col("line")) | ((F.col("line_bases") < F.col("line")) & (F.coalesce("later", F.lit(0)) > 0)))
    out = found.groupBy("file", "n").agg(F.max("name").alias("name"), F.sum("bases").alias("length"), F.min("offset").alias("offset"), F.min_by("line_bases", "offset").alias("line_bases"), F.min_by("line_width", "offset").alias("line_width"), F.max(F.coalesce(bad, F.lit(False))).alias("bad"))
    length = F.when(F.col("bad"), F.raise_error(F.concat(F.lit("lines of different length in "), "name")).cast("long")).otherwise(F.col("length"))
    return out.where("n > 0").select("file", "name", length.alias("length"), "offset", "line_bases", "line_width")


def fetch(file, starts: list[tuple[int, int]] | None, offset: int, line_bases: int, line_width: int, start: int, end: int) -> bytes:
    """Bases start to end (from 1) of a sequence: only the bytes between them are read, of blocked gzip their members."""
    if end < start:
        return b""
    low, high = ((p // line_bases) * line_width + p % line_bases + offset for p in (start - 1, end - 1))
    if starts is None:
        file.seek(low)
        data = file.read(high + 1 - low)
    else:
        at, member = starts[bisect.bisect_right(starts, (low, 1 << 62)) - 1]
        data = b""
        for _, piece in _Members(file, member):
            data += piece
            if at + len(data) > high:
                break
        data = data[low - at : high + 1 - at]
    return data.replace(b"\n", b"").replace(b"\r", b"")


def fasta_regions(index: DataFrame, ranges: DataFrame, stranded: bool = False) -> DataFrame:
    """The sequence of each range (contig, start, end, ...) by offset arithmetic from the rows of `index_fasta`.

    A range beyond its sequence is an error; stranded: '-' is reverse-complemented. Tasks open the files and read the ranges' bytes.
    """
    columns = ranges.columns
    known = index.select("file", F.col("name").alias("contig"), F.col("length").alias("__length"), "offset", "line_bases", "line_width")
    end = F.when(F.col("end") <= F.col("__length"), F.col("end")).otherwise(F.raise_error(F.lit("a range ends beyond its sequence")).cast("int"))
    asked = ranges.join(known, "contig").withColumn("end", end).select(*columns, "file", "offset", "line_bases", "line_width")
    held = ["file", "offset", "line_bases", "line_width", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f, starts = None, None, None
        for batch in batches:
            seqs = []
            for file, offset, bases, width, a, b in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in held), strict=True):
                if file != name:
                    name, f, starts = file, _open(file), block_starts(file)
                seqs.append(fetch(f, starts, offset or 0, bases or 1, width or 2, a, b).decode())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in columns], pa.array(seqs, pa.string())], names=[*columns, "seq"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema)
    found = asked.repartition("file", F.floor(F.col("offset") / SPLIT_BYTES)).sortWithinPartitions("file", "offset", "start").mapInArrow(run, f"{kinds}, seq string")
    return found.withColumn("seq", F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq"))) if stranded else found
