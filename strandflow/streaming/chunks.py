"""Chunks of alignments as a stream that goes on where it stopped: n records, or a range, at a time.

A Spark job finds where each chunk of n records begins (a virtual offset), counting by byte range first, so
that no chunk is looked for by reading what lies before it; ranges become chunks by the files' indexes. The
list of units, a row per chunk, is kept in a file. The stream's offset is a number of units: a batch takes
the next `unitsPerBatch`, each read by a task that opens its stretch of the file only. How far batches have
been planned is kept beside the list, so a query that is started again from its checkpoint takes the next
ones: one availableNow run of a query is one call for the next chunk. Where `end` is set, two batches of one
record named END_NAME follow the last unit: the first moves a watermark, the second lets Spark act on it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from strandflow.schemas import ALIGNMENT
from strandflow.sources import bamcodec, binning
from strandflow.sources.bgzf import SPLIT_BYTES, Cursor, Overlaps, _length, _open, _sound, at_first, batches_of, batches_within, chunk_records, chunk_stretches, files_of, locate, read_header, read_index, spans_of, write_file

END_NAME = "__end__"


def _stretches(file: str, begin: int, end: int) -> Iterator[tuple[Cursor, list[int]]]:
    """A cursor that goes through the records that begin in a byte range, and their places in its data and the end of the last."""
    _, contigs, first, inside = read_header(file)
    with _open(file) as f:
        cursor = at_first(f, begin, end, first, inside, lambda data, i: _sound(data, i, len(contigs)))
        if cursor is not None:
            for _, starts in cursor.stretches(end << 16):
                yield cursor, starts


def record_units(spark: SparkSession, path: str, n: int, split: int = SPLIT_BYTES) -> list[dict]:
    """Units of n records each, in the order of the files' names: lists of (file, first, last). The list has a row per n records."""
    splits = [(p, a, a + split) for p, size in files_of(path) for a in range(0, max(size, 1), split)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("records", pa.array([sum(len(starts) - 1 for _, starts in _stretches(r["file"], r["start"], r["stop"])) for r in b.to_pylist()], pa.int64()))

    counted = binning.splits_frame(spark, splits).mapInArrow(count, "file string, start long, stop long, records long").toPandas()  # a row per split
    counted = counted.sort_values(["file", "start"])
    counted["before"] = counted["records"].cumsum() - counted["records"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            rows, k = [], r["before"]
            for cursor, starts in _stretches(r["file"], r["start"], r["stop"]):
                to = k + len(starts) - 1
                for i in sorted({*([] if rows else [k]), *range(-(-k // n) * n, to, n)}):
                    rows.append({"file": r["file"], "unit": i // n, "first": cursor.offset(starts[i - k]), "last": 0})
                    if len(rows) > 1:
                        rows[-2]["last"] = rows[-1]["first"]
                rows[-1]["last"] = cursor.offset(starts[-1])
                k = to
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("unit", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))

    rows = spark.createDataFrame(counted).repartition(max(1, len(counted))).mapInArrow(cut, "file string, unit long, first long, last long")
    joined = rows.groupBy("unit", "file").agg(F.min("first").alias("first"), F.max("last").alias("last")).orderBy("unit", "file")
    units: list[dict] = []
    for r in joined.toLocalIterator():  # a row per n records
        if len(units) <= r["unit"]:
            units.append({"pieces": []})
        units[-1]["pieces"].append([r["file"], r["first"], r["last"]])
    return units


def range_units(path: str, ranges: list[tuple[str, int, int]]) -> list[dict]:
    """A unit per range (contig, start, end), in the order given, from the files' indexes."""
    units = []
    for contig, start, end in ranges:
        pieces = []
        for file, _ in files_of(path):
            names, index = [n for n, _ in read_header(file)[1]], read_index(file)
            if index is None:
                raise ValueError(f"{file} has no index")
            if contig in names:
                pieces += [[file, a, b] for a, b in binning.merged(index.chunks(names.index(contig), start - 1, end))]
        units.append({"pieces": pieces, "range": [contig, start, end]})
    return units


def save_units(units: list[dict], place: str) -> str:
    write_file(place, json.dumps(units).encode())
    return place


def _load(place: str):
    store, name = locate(place)
    return json.loads(store.open_input_file(name).read()) if store.get_file_info(name).is_file else None


class _Unit(InputPartition):
    def __init__(self, unit: dict):
        self.unit = unit


class ChunkReader(DataSourceStreamReader):
    """Rows of the columns asked for, all of ALIGNMENT's if none are named."""

    def __init__(self, options, columns: list[str] | None = None):
        self.kinds = [(n, k) for n, k in bamcodec.SCHEMA if columns is None or n in columns]
        self.place, self.step, self.end = options["path"], int(options.get("unitsPerBatch", 1)), options.get("end", "false") == "true"
        self.units = _load(self.place)
        self.records, self.units = len(self.units), self.units + ([{"end": True}] * 2 if self.end else [])
        self.planned = self.place + "." + options.get("name", "stream") + ".planned"

    def initialOffset(self):
        return {"unit": 0}

    def latestOffset(self):
        planned = _load(self.planned) or 0
        return {"unit": min(self.records, planned + self.step) if planned < self.records else min(len(self.units), planned + 1)}

    def partitions(self, start, end):
        if end["unit"] > (_load(self.planned) or 0):
            write_file(self.planned, json.dumps(end["unit"]).encode())
        return [_Unit(u) for u in self.units[start["unit"] : end["unit"]]]

    def __getstate__(self):
        return {"kinds": self.kinds}  # all that tasks need: not the list of all units

    def batches(self, partition) -> Iterator[pa.RecordBatch]:
        names = [n for n, _ in self.kinds]
        if partition.unit.get("end"):
            row = {"qname": pa.array([END_NAME]), "flag": pa.array([0], pa.int32())}
            yield pa.RecordBatch.from_arrays([row[n] if n in row else pa.nulls(1, k) for n, k in self.kinds], names)
            return
        asked = partition.unit.get("range")
        for file, first, last in partition.unit["pieces"]:
            contigs = [n for n, _ in read_header(file)[1]]
            if not asked:
                yield from batches_within(chunk_stretches(file, [(first, last)]), contigs, names)
                continue
            wanted = Overlaps([(contigs.index(asked[0]), asked[1] - 1, asked[2])])
            yield from batches_of((r for r in chunk_records(file, [(first, last)], _length) if wanted.test(*spans_of(r)[:3])), contigs, names)

    def read(self, partition):
        for batch in self.batches(partition):
            maps = [n == "tags" for n, _ in self.kinds]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield tuple(dict(x or ()) if m else x for m, x in zip(maps, row, strict=True))


class ChunkBatchReader(ChunkReader):
    """The same in Arrow batches, without a Python object for each value."""

    def read(self, partition):
        return self.batches(partition)


class ChunkSource(DataSource):
    """Options: path (of the saved units), unitsPerBatch, name (of the position kept beside them), end.

    A schema of some of ALIGNMENT's columns may be given, in its order; the others are not decoded then.
    """

    @classmethod
    def name(cls):
        return "bam_chunks"

    def schema(self):
        return ALIGNMENT

    def streamReader(self, schema):
        return ChunkBatchReader(self.options, schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChunkSource)


def finish(query: StreamingQuery) -> None:
    """Wait until a query has taken all units in, then stop it; its error, if any, is raised."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def next_unit(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Append the stream's next unit, after those of earlier calls with this checkpoint, to Parquet files."""
    rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
