"""Indexes built by Spark, range reads and merges through them, against whole scans."""

import json
import random

import pytest

from strandflow.schemas import ALIGNMENT
from strandflow.operators.tabtext import Layout
from strandflow.sources import bgzf, binning, gztext

CONTIGS = [("chr2", 3_000_000), ("chr10", 2_000_000), ("chr1", 50_000)]


def some_reads(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name, size = CONTIGS[rng.randrange(3)]
        pos = rng.randrange(1, size - 300) if rng.random() < 0.7 else 40_000 + rng.randrange(200)
        cigar = rng.choice(["50M", "10M90N40M", "20M5D30M", "30M20S", None])
        rows.append((f"q{i}", rng.choice([0, 16, 4]), name, pos, 30, cigar, None, None, 0, "".join(rng.choices("ACGT", k=50)), "I" * 50, None))
    rows += [(f"u{i}", 4, None, None, 0, None, None, None, 0, "ACGT", "IIII", None) for i in range(n // 20)]
    order = {c: i for i, (c, _) in enumerate(CONTIGS)}
    return sorted(rows, key=lambda r: (order.get(r[2], 9), r[3] or 0, r[1] & 16))


def stop(row):
    return row[3] + {"50M": 50, "10M90N40M": 140, "20M5D30M": 55, "30M20S": 30, None: 1}[row[5]] - 1


def write(spark, rows, folder):
    bgzf.register(spark)
    listed = ",".join(f"{n}:{k}" for n, k in CONTIGS)
    spark.createDataFrame(rows, ALIGNMENT).coalesce(1).write.format("bam").mode("append").option("contigs", listed).save(folder)
    return bgzf.index_files(spark, folder, split=1 << 15).collect()


def overlapping(rows, ranges):
    return sorted(r[0] for r in rows if r[2] and any(r[2] == c and r[3] <= b and stop(r) >= a for c, a, b in ranges))


def test_index_range_reads(spark, tmp_path, monkeypatch):
    rows = some_reads(20_000, 1)
    folder = str(tmp_path / "one")
    (made,) = write(spark, rows, folder)
    assert made.records == len(rows)
    (file, size), index = bgzf.files_of(folder)[0], bgzf.read_index(made.file)
    assert index.unplaced == 1000 and [sum(index.count(t)) for t in range(3)] == [sum(r[2] == c for r in rows) for c, _ in CONTIGS]
    assert binning.parse(binning.render(index)) == index
    # an index built in one go, without splits, is the same but for how chunks are joined
    whole = binning.assemble(binning.parts_of(file, ((*bgzf.spans_of(r), a, b) for a, b, r in bgzf.located_records(file, 0, size, *bgzf.read_header(file)[2:], bgzf._length, None))), 3)
    assert whole == index

    real, read = bgzf._Members.__iter__, []

    def counted(self):
        for at, piece in real(self):
            read.append(self.file.tell() - at)
            yield at, piece

    monkeypatch.setattr(bgzf._Members, "__iter__", counted)
    rng = random.Random(2)
    for k in range(60):
        ranges = []
        for _ in range(rng.randrange(1, 4)):
            name, length = CONTIGS[rng.randrange(3)]
            a = rng.randrange(1, length)
            ranges.append((name, a, min(length, a + rng.choice([0, 50, 2000, 100_000]))))
        reader = bgzf.BamReader({"path": folder, "ranges": json.dumps(ranges), "splitBytes": "30000"})
        read.clear()
        parts = reader.partitions()
        found = sorted(q for p in parts for b in reader.read(p) for q in b.column(0).to_pylist())
        assert found == overlapping(rows, ranges)
        if all(b - a <= 2000 and c != "chr1" and not a - 20_000 < 40_000 < b + 20_000 for c, a, b in ranges):
            assert sum(read) < size / 4  # of the file, headers read again included


def test_index_in_spark(spark, tmp_path):
    rows = some_reads(3000, 3)
    folder = str(tmp_path / "one")
    write(spark, rows, folder)
    ranges = [(1, "chr10", 500_000, 600_000), (2, "chr10", 550_000, 700_000), (3, "chr7", 1, 10), (4, "chr1", 10, 9)]
    found = bgzf.read_ranges(spark, folder, spark.createDataFrame(ranges, "range_id long, contig string, start int, end int"), split=20_000)
    assert sorted(r.qname for r in found.collect()) == overlapping(rows, [("chr10", 500_000, 700_000)])
    nothing = bgzf.read_ranges(spark, folder, spark.createDataFrame(ranges[2:], "range_id long, contig string, start int, end int"))
    assert nothing.count() == 0 and spark.read.format("bam").load(folder).count() == len(rows)


@pytest.mark.parametrize("split", [20_000, 1 << 22])
def test_heap_merge(spark, tmp_path, split):
    every = []
    for k in range(3):
        rows = [(f"f{k}{r[0]}", *r[1:]) for r in some_reads(1500, 10 + k)]
        write(spark, rows, str(tmp_path / f"f{k}"))
        every.append(rows)
    paths = ",".join(str(tmp_path / f"f{k}") for k in range(3))
    reader = bgzf.BamMergeReader({"path": paths, "splitBytes": str(split)})
    assert reader.contigs == CONTIGS and (len(reader.partitions()) > 3 or split > 20_000)
    order = {c: i for i, (c, _) in enumerate(CONTIGS)}
    want = sorted((order[r[2]], r[3], r[1] & 16, k, i, r[0]) for k, rows in enumerate(every) for i, r in enumerate(rows) if r[2])
    rest = sorted(r[0] for rows in every for r in rows if not r[2])
    got = [r.qname for r in spark.read.format("bam_merge").option("splitBytes", str(split)).load(paths).toLocalIterator()]
    assert got[: len(want)] == [x[5] for x in want] and sorted(got[len(want) :]) == rest
    plan = spark.read.format("bam_merge").load(paths)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan


def test_heap_merge_opens_only_files_of_its_stretch(spark, tmp_path):
    order = {c: i for i, (c, _) in enumerate(CONTIGS)}
    rows = sorted(some_reads(1500, 3), key=lambda r: (r[2] is None, order.get(r[2], 0), r[3] or 0))
    for k in range(6):  # files that follow each other in position
        write(spark, rows[k * 263 : (k + 1) * 263], str(tmp_path / f"f{k}"))
    reader = bgzf.BamMergeReader({"path": ",".join(str(tmp_path / f"f{k}") for k in range(6)), "splitBytes": "1000"})
    slices = [p for p in reader.partitions() if isinstance(p, bgzf._Slice)]
    assert len(slices) > 3 and sum(len({x[1] for x in p.parts}) for p in slices) < 3 * len(slices)
    assert sorted(r for p in reader.partitions() for b in reader.read(p) for r in b.column(0).to_pylist()) == sorted(r[0] for r in rows)


def test_merged_contigs():
    assert bgzf.merged_contigs([[("b", 2), ("a", 1)], [("a", 1), ("c", 3)]]) == [("b", 2), ("a", 1), ("c", 3)]
    with pytest.raises(ValueError, match="two lengths"):
        bgzf.merged_contigs([[("a", 1)], [("a", 2)]])


def test_bins():
    rng = random.Random(1)
    for _ in range(2000):
        a = rng.randrange(1 << 29)
        b = min(1 << 29, a + 1 + int(2 ** rng.uniform(0, 25)))
        c = max(0, a - rng.randrange(1 << 20))
        d = min(1 << 29, b + rng.randrange(1 << 20))
        assert binning.bin_of(a, b) in set(binning.bins_of(c, d)) and binning._meets(binning.bin_of(a, b), c, d)


# --- text


def some_lines(n, seed):
    rng = random.Random(seed)
    rows = sorted((rng.choice(["a", "b", "c"]), rng.randrange(1, 400_000), i) for i in range(n))
    return ["#head", "#er"] + [f"{c}\t{s}\t{s + i % 300}\t{'x' * (i % 90)}{i}" for c, s, i in rows]


@pytest.mark.parametrize("kind", ["plain", "blocked"])
def test_lines_of_splits(spark, tmp_path, kind):
    lines = some_lines(30_000, 4) + ["y" * 200_000, "", "", "last"]
    data = "\n".join(lines).encode() + (b"" if kind == "plain" else b"\n")
    file = tmp_path / "t.gz"
    file.write_bytes(bgzf.compress(data) if kind == "blocked" else data)
    size = file.stat().st_size
    for split in (4999, 20_000, 70_001, size // 2, size + 5):
        got = [(x, a, b) for s in range(0, size, split) for ls, at, to in gztext.line_batches(str(file), s, s + split) for x, a, b in zip(ls, at, to, strict=True)]
        assert [x.decode() for x, _, _ in got] == lines
        assert all(b == a for (_, _, b), (_, a, _) in zip(got, got[1:], strict=False))
    gztext.register(spark)
    df = spark.read.format("lines").option("splitBytes", "50000").load(str(file))
    assert df.rdd.getNumPartitions() > 3 and [r.line for r in df.orderBy("offset").collect()] == lines


def test_text_index(spark, tmp_path):
    gztext.register(spark)
    lines = some_lines(20_000, 5)
    folder = str(tmp_path / "t")
    spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.format("lines").mode("append").save(folder)
    layout = Layout(1, 2, 3)
    (made,) = gztext.index_files(spark, folder, layout, split=30_000).collect()
    assert made.records == 20_000 and gztext.known_names(folder) == ["a", "b", "c"]
    index = bgzf.read_index(made.file, (".tbi",))
    assert index.layout == (0, 1, 2, 3, ord("#"), 0)
    rng = random.Random(6)
    for _ in range(15):
        ranges = [(k, rng.choice("abcd"), a, a + rng.choice([0, 500, 60_000])) for k, a in enumerate(rng.sample(range(1, 400_000), 2))]
        found = gztext.read_ranges(spark, folder, spark.createDataFrame(ranges, "range_id long, contig string, start int, end int"), layout, split=10_000)
        want = [x for x in lines if x[0] != "#" and any(x.split("\t")[0] == c and int(x.split("\t")[1]) <= b and int(x.split("\t")[2]) >= a for _, c, a, b in ranges)]
        assert sorted(r.line for r in found.collect()) == sorted(want)
    narrow = gztext.LinesReader({"path": folder, "ranges": '[["b", 1000, 2000]]', "layout": "{\"seq\": 1, \"start\": 2, \"end\": 3}"})
    assert sum((b >> 16) - (a >> 16) for p in narrow.partitions() for a, b in p.chunks) < bgzf.files_of(folder)[0][1] / 4


@pytest.mark.parametrize("blocked", [False, True])
def test_fasta_by_offsets(spark, tmp_path, blocked):
    rng = random.Random(7)
    seqs = {f"s{i}": "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 59, 60, 61, 5000, 300_000]))) for i in range(40)}
    data = "".join(f">{n} about\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for n, s in seqs.items()).encode()
    file = tmp_path / ("x.fa.gz" if blocked else "x.fa")
    file.write_bytes(bgzf.compress(data) if blocked else data)
    if blocked:
        (made,) = gztext.index_blocks(spark, str(file), split=40_000).collect()
        assert made.members == len(gztext.block_starts(str(file)))
    index = gztext.index_fasta(spark, str(file), split=40_000)
    rows = {r.name: r for r in index.collect()}
    assert {n: r.length for n, r in rows.items()} == {n: len(s) for n, s in seqs.items()}
    assert all(data[r.offset : r.offset + min(60, r.length)].decode() == seqs[n][:60] for n, r in rows.items() if r.length)
    asked = []
    for k in range(200):
        n = rng.choice([x for x in seqs if seqs[x]])
        a = rng.randrange(1, len(seqs[n]) + 1)
        asked.append((k, n, a, min(len(seqs[n]), a + rng.choice([-1, 0, 10, 200, 70_000])), rng.choice("+-")))
    found = gztext.fasta_regions(index, spark.createDataFrame(asked, "k long, contig string, start int, end int, strand string"), stranded=True)
    flip = str.maketrans("ACGT", "TGCA")
    assert {r.k: r.seq for r in found.collect()} == {k: seqs[n][a - 1 : b] if s == "+" else seqs[n][a - 1 : b].translate(flip)[::-1] for k, n, a, b, s in asked}

    class Counted:
        def __init__(self, f):
            self.f, self.n = f, 0

        def __getattr__(self, name):
            return getattr(self.f, name)

        def read(self, n=-1):
            out = self.f.read(n)
            self.n += len(out)
            return out

    with bgzf._open(str(file)) as f:
        r, counted = rows[max(seqs, key=lambda x: len(seqs[x]))], Counted(f)
        assert gztext.fetch(counted, gztext.block_starts(str(file)), r.offset, r.line_bases, r.line_width, 1000, 1100).decode() == seqs[r.name][999:1100]
        assert counted.n <= (1 << 16 if blocked else 110)
    with pytest.raises(Exception, match="ends beyond"):
        gztext.fasta_regions(index, spark.createDataFrame([("s0", 1, 10**7)], "contig string, start int, end int")).collect()


def test_uneven_fasta(spark, tmp_path):
    file = tmp_path / "bad.fa"
    file.write_text(">a\nACGT\nAC\nACGT\n>b\nAC\n")
    with pytest.raises(Exception, match="different length in a"):
        gztext.index_fasta(spark, str(file)).collect()
