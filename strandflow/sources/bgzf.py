"""Binary alignments (BAM) as a Spark data source, read and written with the public file format.

A file is a series of gzip members of at most 64 KiB, each of which tells its size, so the reader
splits a file into byte ranges: a task seeks the first member that starts in its range and, inside
the data, the first place from which records follow each other soundly. `register(spark)` makes it
spark.read.format("bam").

Tasks read and write through Arrow's file systems: a path may be local or a URI of any store that Arrow
reaches (file, hdfs, s3, gs, abfs). Written files stand under `_temporary` until the job commits; only
those of the attempts that Spark counts are moved then, and the rest is removed.
"""

from __future__ import annotations

import bisect
import gzip
import heapq
import itertools
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from strandflow.operators.intervals import normalize
from strandflow.schemas import ALIGNMENT
from strandflow.shared import settings
from strandflow.sources import binning

CIGAR_CODES = "MIDNSHP=X"
EOF_MEMBER = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SPLIT_BYTES = 32 << 20
#: Records of an Arrow batch, and about their bytes, at most.
BATCH, BATCH_BYTES = 5000, 4 << 20
#: Rows of an Arrow batch that Spark sends to the writer.
WRITE_BATCH = 1000


def compress(data: bytes) -> bytes:
    """Blocked gzip of the data, with the closing empty member."""
    out = []
    for i in range(0, len(data), 0xFF00):
        part = data[i : i + 0xFF00]
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        out.append(struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out) + EOF_MEMBER


def decompress(data: bytes) -> bytes:
    return gzip.decompress(data)


def batches_of(records: Iterator[bytes], names: list[str], asked: list[str] | None = None) -> Iterator:
    """Records, each with its size before it, as Arrow batches of ALIGNMENT's columns, or those asked for."""
    return batches_from(((r, 0, None) for r in records), names, asked)


def batches_from(records: Iterator[tuple[bytes, int, str | None]], names: list[str], asked: list[str] | None = None) -> Iterator:
    """Arrow batches of records, each with the place in `names` where its file's contigs begin, and the file, a further column if given."""
    import numpy as np  # in tasks only
    import pyarrow as pa

    from strandflow.sources import bamcodec

    columns = _columns(asked) + ["file"]
    held, size = [], 0
    for record in itertools.chain(records, (None,)):
        if held and (record is None or len(held) == BATCH or size > BATCH_BYTES):
            arrays = bamcodec.decode([r for r, _, _ in held], names, np.array([k for _, k, _ in held]), asked)
            if held[0][2] is not None:
                arrays.append(pa.array([f for _, _, f in held], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=columns[: len(arrays)])
            held, size = [], 0
        if record is not None:
            held.append(record)
            size += len(record[0])


def _columns(asked: list[str] | None) -> list[str]:
    return [c for c in (x.split(" ")[0] for x in ALIGNMENT.split(", ")) if asked is None or c in asked]


def batches_within(stretches: Iterator[tuple[bytes, list[int]]], names: list[str], asked: list[str] | None = None) -> Iterator:
    """Arrow batches of all records of stretches (see Cursor.stretches), which are not cut into an object each."""
    import numpy as np  # in tasks only
    import pyarrow as pa

    from strandflow.sources import bamcodec

    held, count, size = [], 0, 0
    for stretch in itertools.chain(stretches, (None,)):
        if held and (stretch is None or count >= BATCH or size > BATCH_BYTES):
            sizes = np.concatenate([np.diff(starts) for _, starts in held])
            yield pa.RecordBatch.from_arrays(bamcodec.decoded(b"".join(data[starts[0] : starts[-1]] for data, starts in held), sizes, names, None, asked), names=_columns(asked))
            held, count, size = [], 0, 0
        if stretch is not None:
            held.append(stretch)
            count += len(stretch[1]) - 1
            size += stretch[1][-1] - stretch[1][0]


def encode_header(text: str, contigs: list[tuple[str, int]]) -> bytes:
    out = b"BAM\1" + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(contigs))
    return out + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs)


class _Members:
    """The decompressed data of a file from a member's start on, with the file offset each piece came from."""

    def __init__(self, file, at: int):
        self.file, self.at = file, at

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        self.file.seek(self.at)
        while True:
            at = self.file.tell()
            head = self.file.read(18)
            if len(head) < 18:
                return
            size = struct.unpack_from("<H", head, 16)[0] + 1
            body = self.file.read(size - 18)
            yield at, zlib.decompress(body[:-8], -15)


def locate(path: str) -> tuple:
    """The Arrow file system of a path or URI, and the path on it."""
    from pyarrow import fs  # in tasks only

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _open(path: str):
    store, place = locate(path)
    return store.open_input_file(place)


#: Endings of index files.
INDEXES = (".bai", ".csi", ".tbi", ".fai", ".gzi")


def files_of(path: str) -> list[tuple[str, int]]:
    """A file, or the data files of a folder, with their sizes; indexes, and what begins with _ or ., are left out."""
    from pyarrow import fs

    store, place = locate(path)
    head = path[: len(path) - len(place)] if path.endswith(place) else ""
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place))
    return sorted((head + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_." and not f.base_name.endswith(INDEXES))


def index_path(path: str, endings: tuple[str, ...] = INDEXES) -> str | None:
    """The first index file that lies beside a file, named by a longer or another ending; None without one."""
    stem = path.rpartition(".")[0] or path
    for name in [path + e for e in endings] + [stem + e for e in endings]:
        store, place = locate(name)
        if store.get_file_info(place).is_file:
            return name
    return None


def read_header(path: str) -> tuple[str, list[tuple[str, int]], int, int]:
    """Text, contigs, and where records begin: member offset and offset in its data."""
    with _open(path) as f:
        data, starts = b"", []
        for at, part in _Members(f, 0):
            starts.append((at, len(data)))
            data += part
            try:
                if data[:4] != b"BAM\1":
                    raise ValueError(f"{path} is no BAM file")
                n = struct.unpack_from("<i", data, 4)[0]
                text, i = data[8 : 8 + n].rstrip(b"\0").decode(), 12 + n
                contigs = []
                for _ in range(struct.unpack_from("<i", data, 8 + n)[0]):
                    k = struct.unpack_from("<i", data, i)[0]
                    contigs.append((data[i + 4 : i + 3 + k].decode(), struct.unpack_from("<i", data, i + 4 + k)[0]))
                    i += 8 + k
            except struct.error:
                continue
            if i > len(data):
                continue
            member, before = [s for s in starts if s[1] <= i][-1]
            return text, contigs, member, i - before
        raise ValueError(f"{path} ends within its header")


def _sound(data: bytes, i: int, n_contigs: int) -> bool:
    """Whether records may begin at i: as many following ones as the data hold, up to three, look right."""
    for _ in range(3):
        if i + 36 > len(data):
            return True
        size, tid, pos, l_name, _, _, n_cigar, _, l_seq, mtid, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", data, i)
        if not (-1 <= tid < n_contigs and -1 <= mtid < n_contigs and pos >= -1 and mpos >= -1 and l_name > 0 and l_seq >= 0):
            return False
        if size < 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq or size > 1 << 26:
            return False
        if i + 36 + l_name <= len(data) and data[i + 35 + l_name]:
            return False
        i += 4 + size
    return True


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class Cursor:
    """Goes forward through a file's data from a member on, and tells virtual offsets."""

    def __init__(self, file, at: int, inside: int = 0):
        self.members, self.file = iter(_Members(file, at)), file
        self.data, self.i, self.inside = b"", 0, inside
        self.spans: list[tuple[int, int]] = []
        self.next = at

    def more(self) -> bool:
        """Take the next member in; False at the file's end."""
        found = next(self.members, None)
        if found is None:
            return False
        at, piece = found
        self.spans = [(s - self.i, m) for s, m in self.spans if s + (1 << 16) > self.i]
        self.data, self.i = self.data[self.i :], 0
        self.spans.append((len(self.data), at))
        if self.inside:
            self.i, self.inside = self.inside, 0
        self.data += piece
        self.next = self.file.tell()
        return True

    def offset(self, i: int) -> int:
        """The virtual offset of a place in the data."""
        if i == len(self.data):
            return self.next << 16
        start, at = [x for x in self.spans if x[0] <= i][-1]
        return at << 16 | (i - start)

    def records(self, length_of, stop: int) -> Iterator[tuple[int, int, bytes]]:
        """The records that begin before the virtual offset `stop`, each with its own and the following offset."""
        while True:
            size = length_of(self.data, self.i)
            if size is None or self.i + size > len(self.data):
                if (self.i == len(self.data) and self.next << 16 >= stop) or not self.more():
                    return
                continue
            here = self.offset(self.i)
            if here >= stop:
                return
            yield here, self.offset(self.i + size), self.data[self.i : self.i + size]
            self.i += size


    def stretches(self, stop: int) -> Iterator[tuple[bytes, list[int]]]:
        """The BAM records that begin before the virtual offset `stop`: pieces of data with the places of their whole records, and of the end of the last."""
        size_at = struct.Struct("<i").unpack_from
        while True:
            limit = next((start + (stop & 0xFFFF if at == stop >> 16 else 0) for start, at in self.spans if at >= stop >> 16), len(self.data))
            data, starts = self.data, [self.i]
            i, last = self.i, min(limit, len(data) - 3)
            while i < last:
                size = 4 + size_at(data, i)[0]
                if size < 36:
                    raise ValueError("a record's size is wrong")
                i += size
                if i > len(data):
                    break
                starts.append(i)
            self.i = starts[-1]
            if len(starts) > 1:
                yield data, starts
            if (self.spans and self.spans[-1][1] >= stop >> 16 and self.i >= limit) or not self.more():
                return


def at_first(file, begin: int, end: int, first: int, inside: int, sound) -> Cursor | None:
    """A cursor at the first record that begins in members of a byte range; None without one."""
    if end <= first:
        return None
    if begin <= first:
        cursor = Cursor(file, first, inside)
        cursor.more()
        return cursor
    start = next_member(file, begin)
    if start is None or start >= end:
        return None
    cursor = Cursor(file, start)
    while True:
        if not cursor.more():
            return None
        while cursor.i < len(cursor.data) and not sound(cursor.data, cursor.i):
            cursor.i += 1
        if cursor.i < len(cursor.data):
            return cursor


def located_records(path: str, begin: int, end: int, first: int, inside: int, length_of, sound) -> Iterator[tuple[int, int, bytes]]:
    """The records that begin in members of a file's byte range, with their virtual offsets. Records of the file begin `inside` the member at `first`.

    length_of(data, i) is a record's whole length, None if too few data tell it; sound(data, i) is whether
    records may begin at i.
    """
    with _open(path) as f:
        cursor = at_first(f, begin, end, first, inside, sound)
        if cursor is not None:
            yield from cursor.records(length_of, end << 16)


def next_member(file, at: int) -> int | None:
    """Where the first member begins at or after a place in a file."""
    file.seek(at)
    window = file.read(1 << 17)
    i = window.find(b"\x1f\x8b\x08\x04")
    while i >= 0:
        if window[i + 10 : i + 16] == b"\x06\0BC\x02\0":
            return at + i
        i = window.find(b"\x1f\x8b\x08\x04", i + 1)
    return None


def split_records(part: _Range, first: int, inside: int, length_of, sound) -> Iterator[bytes]:
    """The records that begin in a file's byte range."""
    return (r for _, _, r in located_records(part.path, part.start, part.end, first, inside, length_of, sound))


def _length(data: bytes, i: int) -> int | None:
    return 4 + struct.unpack_from("<i", data, i)[0] if i + 4 <= len(data) else None


class SplitReader(DataSourceReader):
    """Byte ranges of the files of `path`."""

    def __init__(self, options):
        self.paths = [p for p in options["path"].split(",") if p]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self):
        return [_Range(p, a, a + self.split) for path in self.paths for p, size in files_of(path) for a in range(0, max(size, 1), self.split)]


class _Chunks(InputPartition):
    def __init__(self, path: str, chunks: list[tuple[int, int]]):
        self.path, self.chunks = path, chunks


def spans_of(record: bytes) -> tuple[int, int, int, bool]:
    """A record's contig, its start and end from 0, and whether it is mapped; without CIGAR it takes one position."""
    tid, pos, l_name, _, _, n_cigar, flag = struct.unpack_from("<iiBBHHH", record, 4)
    ops = struct.unpack_from(f"<{n_cigar}I", record, 36 + l_name)
    return tid, pos, pos + (sum(c >> 4 for c in ops if CIGAR_CODES[c & 15] in "MDN=X") or 1), not flag & 4


def index_files(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """Write a .bai index beside each BAM file of `path`, whose records must be in order of coordinate: file, index, records."""

    def scan(file: str, start: int, stop: int) -> list[dict]:
        _, contigs, first, inside = read_header(file)
        rows = located_records(file, start, stop, first, inside, _length, lambda data, i: _sound(data, i, len(contigs)))
        return binning.parts_of(file, ((*spans_of(r), a, b) for a, b, r in rows))

    def store(file: str, index: binning.Index) -> str:
        write_file(file + ".bai", binning.render(index))
        return file + ".bai"

    splits = [(p, a, a + split) for p, size in files_of(path) for a in range(0, max(size, 1), split)]
    return binning.build(binning.splits_frame(spark, splits), scan, lambda file, rows: binning.assemble(rows, len(read_header(file)[1])), store)


def write_file(path: str, data: bytes) -> None:
    store, place = locate(path)
    with store.open_output_stream(place, compression=None) as f:  # names ending in .gz would be compressed again
        f.write(data)


def read_index(path: str, endings: tuple[str, ...] = (".bai",)) -> binning.Index | None:
    """The index beside a file, None without one."""
    found = index_path(path, endings)
    if found is None:
        return None
    with _open(found) as f:
        return binning.parse(f.read())


class BamReader(SplitReader):
    """All records, or, with `ranges`, those that overlap one of them, read through each file's index where it has one.

    `ranges` is a JSON list of [contig, start, end]. Filters are not taken from Spark: it would keep those of one query
    for the next one over the same DataFrame.
    """

    def __init__(self, options):
        super().__init__(options)
        self.ranges = [(c, int(a), int(b)) for c, a, b in json.loads(options["ranges"])] if options.get("ranges") else None

    def wanted(self, contigs: list[tuple[str, int]]) -> list[tuple[int, int, int]] | None:
        """Ranges by contig number, from 0 and half open; None for the whole file."""
        ids = {n: i for i, (n, _) in enumerate(contigs)}
        return None if self.ranges is None else [(ids[c], a - 1, b) for c, a, b in self.ranges if c in ids]

    def partitions(self):
        out = []
        for path, size in (x for p in self.paths for x in files_of(p)):
            _, contigs, _, _ = read_header(path)
            wanted = self.wanted(contigs)
            index = read_index(path) if wanted is not None else None
            if index is None:
                out += [_Range(path, a, a + self.split) for a in range(0, max(size, 1), self.split)]
                continue
            chunks = binning.merged((c for w in wanted for c in index.chunks(*w)), binning.JOIN_BYTES)
            cuts = [v for tid in {w[0] for w in wanted} for v in index.windows[tid]]
            out += [_Chunks(path, c) for c in binning.portions(chunks, cuts, self.split)]
        return out

    def read(self, partition):
        if partition is None:  # no partition at all
            return
        _, contigs, first, inside = read_header(partition.path)
        names = [n for n, _ in contigs]
        wanted = Overlaps(self.wanted(contigs))
        if wanted.all:
            with _open(partition.path) as f:
                cursor = at_first(f, partition.start, partition.end, first, inside, lambda data, i: _sound(data, i, len(names)))
                yield from batches_within(cursor.stretches(partition.end << 16) if cursor is not None else iter(()), names)
            return
        if isinstance(partition, _Chunks):
            records = chunk_records(partition.path, partition.chunks, _length)
        else:
            records = split_records(partition, first, inside, _length, lambda data, i: _sound(data, i, len(names)))
        yield from batches_of((r for r in records if wanted.test(*spans_of(r)[:3])), names)


class Overlaps:
    """Whether a record overlaps one of given ranges; all do if there are none given."""

    def __init__(self, ranges: list[tuple[int, int, int]] | None):
        self.all = ranges is None
        self.starts: dict[int, list[int]] = {}
        self.reach: dict[int, list[int]] = {}  # the furthest end of the ranges so far
        for tid, a, b in sorted(ranges or []):
            self.starts.setdefault(tid, []).append(a)
            reach = self.reach.setdefault(tid, [])
            reach.append(max(b, reach[-1]) if reach else b)

    def test(self, tid: int, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts.get(tid, []), end)
        return k > 0 and self.reach[tid][k - 1] > start


def chunk_records(path: str, chunks: list[tuple[int, int]], length_of) -> Iterator[bytes]:
    """The records that begin in chunks of virtual offsets, each of which begins at a record."""
    with _open(path) as f:
        for a, b in chunks:
            cursor = Cursor(f, a >> 16, a & 0xFFFF)
            if cursor.more():
                yield from (r for _, _, r in cursor.records(length_of, b))


def chunk_stretches(path: str, chunks: list[tuple[int, int]]) -> Iterator[tuple[bytes, list[int]]]:
    """The stretches of BAM records that begin in chunks of virtual offsets, each of which begins at a record."""
    with _open(path) as f:
        for a, b in chunks:
            cursor = Cursor(f, a >> 16, a & 0xFFFF)
            if cursor.more():
                yield from cursor.stretches(b)


class _Slice(InputPartition):
    """A stretch of the merged order: places (contig, position) from `low` on and before `high`, in chunks of those files that have any there.

    `parts` lists (number of the file, path, contig, chunks).
    """

    def __init__(self, low: tuple[int, int], high: tuple[int, int], parts: list[tuple[int, str, int, list[tuple[int, int]]]]):
        self.low, self.high, self.parts = low, high, parts


class _Rest(_Range):
    """A byte range of a file's records without contig, which begin at the virtual offset `first`."""

    def __init__(self, path: str, start: int, end: int, first: int):
        super().__init__(path, start, end)
        self.first = first


class BamMergeReader(DataSourceReader):
    """Several coordinate-sorted files as one, in order: a heap merge of the files' records in every stretch of the order.

    Stretches are cut at windows of the files' linear indexes, so that each reads about `splitBytes` of all files; no row is
    sorted or shuffled. A stretch names the files and chunks that it reads, so that a task opens no other file. Headers' contigs
    are put together by name in the order of the files, and `file` tells a row's file. A record is in the stretch of its start.
    Rows of equal place come in the order of strand, then of the files; rows without contig come last, by byte ranges of each file.
    """

    def __init__(self, options):
        self.files = [x for p in options["path"].split(",") if p for x in files_of(p)]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.headers = [read_header(f) for f, _ in self.files]
        self.contigs = merged_contigs([h[1] for h in self.headers])

    def __getstate__(self):
        return {"contigs": self.contigs}  # all that tasks need

    def partitions(self):
        rank = {n: i for i, (n, _) in enumerate(self.contigs)}
        read: dict[tuple[int, int], int] = {}  # bytes between one window and the next, of all files
        reach: list[tuple[tuple[int, int], tuple[int, int], int, int]] = []  # first and last window of a file's contig
        rest, indexes = [], []
        for k, (f, size) in enumerate(self.files):
            index, (_, contigs, first, inside) = read_index(f), self.headers[k]
            if index is None:
                raise ValueError(f"{f} has no index to be merged by")
            indexes.append(index)
            for tid, windows in enumerate(index.windows):
                if not windows:
                    continue
                place = rank[contigs[tid][0]]
                begin = bisect.bisect_right(windows, 0)  # windows before the first record have no offset
                whole = index.bins[tid].get(binning.COUNTS_BIN) or [(0, windows[-1])]
                for w, (a, b) in enumerate(zip(windows[begin:], [*windows[begin + 1 :], whole[0][1]]), begin):
                    if b > a:
                        read[place, w << binning.WINDOW] = read.get((place, w << binning.WINDOW), 0) + (b >> 16) - (a >> 16)
                reach.append(((place, begin << binning.WINDOW), (place, len(windows) << binning.WINDOW), k, tid))
            placed = index.end_of_placed() or first << 16 | inside
            rest += [_Rest(f, a, a + self.split, placed) for a in range(placed >> 16, size, self.split)]
        cuts, held = [(0, 0)], 0
        for place in sorted(read):
            if held >= self.split:
                cuts.append(place)
                held = 0
            held += read[place]
        ends = [*cuts[1:], (len(self.contigs), 0)]
        parts: list[list] = [[] for _ in cuts]
        for start, stop, k, tid in sorted(reach, key=lambda x: x[2:]):
            for i in range(max(0, bisect.bisect_right(cuts, start) - 1), bisect.bisect_left(cuts, stop)):
                low = cuts[i][1] if cuts[i][0] == start[0] else 0
                high = ends[i][1] if ends[i][0] == start[0] else 1 << 29
                chunks = binning.merged(indexes[k].chunks(tid, low, high))
                if chunks:
                    parts[i].append((k, self.files[k][0], tid, chunks))
        return [*[_Slice(a, b, p) for a, b, p in zip(cuts, ends, parts, strict=True) if p], *rest]

    def read(self, partition):
        if partition is None:  # no partition at all
            return
        if isinstance(partition, _Rest):
            names = [n for n, _ in read_header(partition.path)[1]]
            records = split_records(partition, partition.first >> 16, partition.first & 0xFFFF, _length, lambda data, i: _sound(data, i, len(names)))
            yield from batches_from(((r, 0, partition.path) for r in records), names)
            return
        rank = {n: i for i, (n, _) in enumerate(self.contigs)}
        named = {path: [n for n, _ in read_header(path)[1]] for path in {p[1] for p in partition.parts}}
        streams = [self._stream(*part, partition, named[part[1]], rank) for part in partition.parts]
        every, base = [], {}
        for path, names in named.items():
            base[path] = len(every)
            every += names
        yield from batches_from(((record, base[file], file) for *_, file, record in heapq.merge(*streams, key=lambda x: x[:4])), every)

    @staticmethod
    def _stream(k: int, path: str, tid: int, chunks: list[tuple[int, int]], part: _Slice, names: list[str], rank: dict[str, int]):
        place = rank[names[tid]]
        low = part.low[1] if place == part.low[0] else 0
        high = part.high[1] if place == part.high[0] else 1 << 29
        for r in chunk_records(path, chunks, _length):
            t, start, _, _ = spans_of(r)
            if t == tid and low <= start < high:
                yield place, start, struct.unpack_from("<H", r, 18)[0] & 16, k, path, r


def merged_contigs(headers: list[list[tuple[str, int]]]) -> list[tuple[str, int]]:
    """The contigs of several headers, each once, in the order in which they first come; two lengths of one name are an error."""
    out: dict[str, int] = {}
    for name, size in (c for h in headers for c in h):
        if out.setdefault(name, size) != size:
            raise ValueError(f"{name} has two lengths")
    return list(out.items())


class _Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class FolderWriter(DataSourceWriter):
    """A blocked-gzip file per task, in the folder `path`."""

    ending = ""

    def __init__(self, options, overwrite: bool = False):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def head(self) -> bytes:
        return b""

    def encode(self, row) -> bytes:
        raise NotImplementedError

    def rows(self, iterator) -> Iterator:
        return iterator

    def _places(self) -> tuple:
        store, folder = locate(self.path)
        return store, folder, posixpath.join(folder, "_temporary", self.job)

    def write(self, iterator):
        store, _, held_in = self._places()
        store.create_dir(held_in)
        # names in the order of tasks, so that sorted rows stay in order over a folder's files
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{self.ending}"
        with store.open_output_stream(posixpath.join(held_in, name), compression=None) as f:
            held = [self.head()]
            size = len(held[0])
            for row in self.rows(iterator):
                held.append(self.encode(row))
                size += len(held[-1])
                if size > 1 << 22:
                    f.write(compress(b"".join(held))[: -len(EOF_MEMBER)])
                    held, size = [], 0
            f.write(compress(b"".join(held)))
        return _Written(name)

    def _end(self, store, folder: str) -> None:
        store.delete_dir(posixpath.join(folder, "_temporary"))

    def commit(self, messages):
        from pyarrow import fs

        store, folder, held_in = self._places()
        store.create_dir(held_in)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(folder)):
                if f.type == fs.FileType.File:
                    store.delete_file(f.path)
        for m in messages:
            if m is not None:
                store.move(posixpath.join(held_in, m.path), posixpath.join(folder, m.path))
        self._end(store, folder)

    def abort(self, messages):
        store, folder, held_in = self._places()
        store.create_dir(held_in)
        self._end(store, folder)


class BamWriter(FolderWriter, DataSourceArrowWriter):
    """BAM files; `contigs` lists name:length pairs. Rows come as Arrow batches, not as a Row object each."""

    ending = ".bam"

    def __init__(self, options, overwrite: bool = False):
        super().__init__(options, overwrite)
        self.contigs = [(n, int(k)) for n, _, k in (c.rpartition(":") for c in options.get("contigs", "").split(",") if c)]
        self.ids = {n: i for i, (n, _) in enumerate(self.contigs)}

    def head(self):
        return encode_header("@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in self.contigs), self.contigs)

    def rows(self, iterator):
        import pyarrow.compute as pc  # in tasks only

        from strandflow.operators.places import portions

        for batch in iterator:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("seq"))), 0).to_numpy(zero_copy_only=False) + 64
            yield from (batch.slice(a, b - a) for a, b in portions(sizes, BATCH_BYTES))

    def encode(self, batch):
        from strandflow.sources import bamcodec

        return bamcodec.encode(batch, list(self.ids))


class BamSource(DataSource):
    """Options: path (comma-separated files or folders), splitBytes; for writing path (a folder) and contigs."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return ALIGNMENT

    def reader(self, schema):
        return BamReader(self.options)

    def writer(self, schema, overwrite):
        return BamWriter(self.options, overwrite)


class BamMergeSource(DataSource):
    """Options: path (comma-separated sorted and indexed files or folders), splitBytes."""

    @classmethod
    def name(cls):
        return "bam_merge"

    def schema(self):
        return ALIGNMENT + ", file string"

    def reader(self, schema):
        return BamMergeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)
    spark.dataSource.register(BamMergeSource)


def write(rows: DataFrame, folder: str, contigs: str) -> None:
    """Append BAM files of the rows to a folder; `contigs` lists name:length pairs.

    Where an Arrow batch is limited in bytes, Spark 4.1 asks for its size at each row, which for maps takes as long as the batch is.
    So batches are limited in rows only, and kept short, as reads may be long.
    """
    with settings(rows.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(WRITE_BATCH), "spark.sql.execution.arrow.maxBytesPerBatch": str((1 << 31) - 1)}):
        rows.write.format("bam").mode("append").option("contigs", contigs).save(folder)


def read_ranges(spark: SparkSession, path: str, ranges: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """The alignments that overlap any of the ranges, through the files' indexes.

    The ranges are merged first; what is left of them, a scan's parameter, is sent to the reader as such.
    """
    asked = normalize(ranges).select("contig", "start", "end").orderBy("contig", "start")
    listed = json.dumps([[r["contig"], r["start"], r["end"]] for r in asked.toLocalIterator()])
    return spark.read.format("bam").option("ranges", listed).option("splitBytes", str(split)).load(path)
