"""Chunk streams that go on where they stopped, and the pileup with state by tiles."""

import pickle
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandflow.operators import places
from strandflow.operators.pileup import pileup
from strandflow.plans import catalog
from strandflow.schemas import ALIGNMENT
from strandflow.shared import settings
from strandflow.sources import bgzf
from strandflow.specs import PileupSpec
from strandflow.streaming import chunks, tile_pileup

CONTIGS = [("chr2", 200_000), ("chr10", 90_000)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        name, size = CONTIGS[rng.randrange(2)]
        rows.append((f"q{i}", rng.choice([0, 16]), name, rng.randrange(1, size - 4000), 30, rng.choice(["20M", "5M3000N15M", "10M2D10M"]), None, None, 0, "".join(rng.choices("ACGTN", k=20)), "I" * 20, None))
    order = {c: i for i, (c, _) in enumerate(CONTIGS)}
    rows.sort(key=lambda r: (order[r[2]], r[3]))
    bgzf.register(spark)
    chunks.register(spark)
    path = str(tmp_path_factory.mktemp("bam") / "files")
    df = spark.createDataFrame(rows, ALIGNMENT)
    df.repartitionByRange(3, F.monotonically_increasing_id()).sortWithinPartitions(F.when(F.col("rname") == "chr2", 0).otherwise(1), "pos").coalesce(3).write.format("bam").mode("append").option("contigs", ",".join(f"{n}:{k}" for n, k in CONTIGS)).save(path)
    bgzf.index_files(spark, path).count()
    return path, rows


def test_chunks_go_on_after_a_restart(spark, folder, tmp_path):
    path, rows = folder
    units = chunks.record_units(spark, path, 700, split=8000)
    assert len(units) == 5
    place = chunks.save_units(units, str(tmp_path / "units.json"))
    stream = lambda: spark.readStream.format("bam_chunks").option("name", "a").load(place).select("qname", "pos")
    seen: set = set()
    for k in range(6):  # each time a new query, which goes on from the checkpoint
        chunks.next_unit(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
        got = {r.qname for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert len(got - seen) == (700 if k < 4 else 200 if k == 4 else 0)
        seen = got
    assert seen == {r[0] for r in rows}
    # a task reads its unit's stretch only
    reader = chunks.ChunkReader({"path": place, "name": "b", "unitsPerBatch": "2"})
    assert reader.latestOffset() == {"unit": 2} == reader.latestOffset()
    parts = reader.partitions({"unit": 0}, {"unit": 2})
    assert [len(list(reader.read(p))) for p in parts] == [700, 700] and reader.latestOffset() == {"unit": 4}
    again = chunks.ChunkReader({"path": place, "name": "b", "unitsPerBatch": "2"})
    assert again.latestOffset() == {"unit": 4} and len(again.partitions({"unit": 0}, {"unit": 2})) == 2 and again.latestOffset() == {"unit": 4}


def test_ranges_one_after_another(spark, folder, tmp_path):
    path, rows = folder
    asked = [("chr10", 1, 9000), ("chr2", 50_000, 60_000), ("chr9", 1, 5)]
    place = chunks.save_units(chunks.range_units(path, asked), str(tmp_path / "units.json"))
    width = {"20M": 20, "5M3000N15M": 3020, "10M2D10M": 22}
    seen: set = set()
    for contig, a, b in asked:
        chunks.next_unit(spark.readStream.format("bam_chunks").load(place).select("qname"), str(tmp_path / "out"), str(tmp_path / "cp"))
        got = {r.qname for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert got - seen == {r[0] for r in rows if r[2] == contig and r[3] <= b and r[3] + width[r[5]] > a} - seen
        seen = got


def test_tile_pileup(spark, folder, tmp_path):
    path, rows = folder
    place = chunks.save_units(chunks.record_units(spark, path, 800), str(tmp_path / "units.json"))
    tile_pileup.keep_state_on_disk(spark)
    contigs = spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(CONTIGS)], "tid int, name string, length int")
    spec = PileupSpec(max_depth=None, include_insertions=False)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    counts = []
    for _ in range(4):  # every run takes two units, closes tiles behind the run before, and leaves others open for the next; two runs flush
        stream = spark.readStream.format("bam_chunks").option("end", "true").option("unitsPerBatch", "2").load(place)
        tile_pileup.tile_pileup(stream, contigs, spec).writeStream.format("parquet").option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
        counts.append(spark.read.parquet(out).count())
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    want = sorted(map(tuple, pileup(spark.createDataFrame(rows, ALIGNMENT), spec).select("seqnames", "pos", "strand", "nucleotide", "count").collect()))
    assert 0 == counts[0] < counts[1] < counts[2] < counts[3] and got == want
    # one query that is kept running takes all in, and the record of the end flushes it
    stream = spark.readStream.format("bam_chunks").option("name", "second").option("end", "true").option("unitsPerBatch", "3").load(place)
    out = str(tmp_path / "out2")
    chunks.finish(tile_pileup.tile_pileup(stream, contigs, spec).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp2")).outputMode("append").start(out))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want


def test_tasks_read_arrow_batches_of_the_columns_asked_for(spark, folder, tmp_path):
    path, rows = folder
    place = chunks.save_units(chunks.record_units(spark, path, 700, split=8000), str(tmp_path / "units.json"))
    source = chunks.ChunkSource({"path": place, "unitsPerBatch": "5", "end": "true", "name": "batches"})
    reader = source.streamReader(spark.createDataFrame([], "qname string, pos int, seq string").schema)
    parts = reader.partitions({"unit": 0}, {"unit": 7})
    task = pickle.loads(pickle.dumps(reader))
    assert "units" not in vars(task)  # a task is not sent the list of all units
    batches = [b for p in parts for b in task.read(p)]
    assert all(isinstance(b, pa.RecordBatch) and b.schema.names == ["qname", "pos", "seq"] for b in batches)
    got = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    assert sorted(got[:-2]) == sorted((r[0], r[3], r[9]) for r in rows) and got[-2:] == [(chunks.END_NAME, None, None)] * 2


def test_stretches_are_the_records_of_any_byte_range_and_stop(folder):
    path, _ = folder
    for file, size in bgzf.files_of(path):
        text, contigs, first, inside = bgzf.read_header(file)
        sound = lambda data, i: bgzf._sound(data, i, len(contigs))
        whole = list(bgzf.located_records(file, 0, size, first, inside, bgzf._length, None))
        for step in (1000, 7777, size):
            got = []
            for a in range(0, size, step):
                with bgzf._open(file) as f:
                    cursor = bgzf.at_first(f, a, a + step, first, inside, sound)
                    for data, starts in cursor.stretches((a + step) << 16) if cursor else ():
                        got += [data[i:j] for i, j in zip(starts, starts[1:])]
            assert got == [r for _, _, r in whole]
        for a, b in ((0, 1), (3, 3), (10, 400), (0, len(whole))):
            chunk = (whole[a][0], whole[b][0] if b < len(whole) else whole[-1][1])
            assert [data[i:j] for data, starts in bgzf.chunk_stretches(file, [chunk]) for i, j in zip(starts, starts[1:])] == [r for _, _, r in whole[a:b]]


def test_long_records_and_wrong_sizes_in_stretches(tmp_path):
    record = lambda n: (lambda body: struct.pack("<i", len(body)) + body)(struct.pack("<iiBBHHHiiii", 0, 5, 2, 0, 0, 0, 0, n, -1, -1, 0) + b"q\0" + bytes((n + 1) // 2 + n))
    records = [record(n) for n in (10, 200_000, 3, 70_000, 0)]
    (tmp_path / "a.bam").write_bytes(bgzf.compress(bgzf.encode_header("", [("c", 1000)]) + b"".join(records)))
    _, _, first, inside = bgzf.read_header(str(tmp_path / "a.bam"))
    read = lambda file: [data[i:j] for data, starts in bgzf.chunk_stretches(file, [(first << 16 | inside, 1 << 60)]) for i, j in zip(starts, starts[1:])]
    assert read(str(tmp_path / "a.bam")) == records
    (tmp_path / "b.bam").write_bytes(bgzf.compress(bgzf.encode_header("", [("c", 1000)]) + records[0] + struct.pack("<i", -4) + bytes(50)))
    with pytest.raises(ValueError):
        read(str(tmp_path / "b.bam"))


def test_released_texts_are_no_python_objects():
    class Held:
        def get(self):
            reads = pa.RecordBatch.from_pydict({"seqnames": ["c"], "pos": [TILE + 5], "flag": [16], "cigar": ["2M"], "seq": ["AC"], "qual": ["II"]})
            rows = next(places.packer(["seqnames"], PileupSpec(max_depth=None), width=TILE)(iter([reads])))
            return rows.column("cells")[0].as_py(), rows.column("n")[0].as_py()

        exists, clear = (lambda self: True), (lambda self: None)

    TILE = tile_pileup.TILE
    tile = tile_pileup.TileCounts()
    tile.held = Held()
    (frame,) = tile.handleExpiredTimer(("c", 1), None, None)
    assert [tuple(r) for r in frame.itertuples(index=False)] == [("c", TILE + 5, "-", "A", 1), ("c", TILE + 6, "-", "C", 1)]
    assert object not in set(frame.dtypes)


def test_streamed_pileup_takes_few_batches_with_stores_by_the_cores(spark, monkeypatch):
    found = []
    finish = chunks.finish

    def watched(query):
        finish(query)
        found.extend(query.recentProgress)

    monkeypatch.setattr(chunks, "finish", watched)
    with settings(spark, {"spark.sql.shuffle.partitions": "16"}):
        catalog.pileup_streamed(spark, "/root/testdata/sf0.1").count()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "16" and spark.conf.get(tile_pileup.PROVIDER[0], None) in (None, tile_pileup.PROVIDER[1])
    assert [p.numInputRows for p in found] == [600_000, 1, 1]
    assert {s.numShufflePartitions for p in found for s in p.stateOperators} == {spark.sparkContext.defaultParallelism}
