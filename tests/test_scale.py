"""Work dealt over tiles, splits and chunks gives what one ordered pass gives; rules that the large queries cannot tell apart."""

import random
import struct
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandflow import shared
from strandflow.functions import cigar
from strandflow.operators import intervals, mates, scan, sequences, sorting, tabtext, variants
from strandflow.operators.pileup import multi_file_depth, pileup, quality_depth
from strandflow.operators.views import Views
from strandflow.schemas import ALIGNMENT
from strandflow.sources import bcf, bgzf, sam, text
from strandflow.specs import MultiPileupSpec, PileupSpec, ScanSpec, VariantSpec
from strandflow.streaming.frontier_pileup import _batch_sums

RANGE = "range_id long, contig string, start int, end int"
READ = "qname string, flag int, rname string, pos int, mapq int, cigar string, mrnm string, mpos int, isize int, seq string, qual string"


def reads(spark, rows, file=None):
    """rows: name, pos, cigar, seq[, flag]"""
    made = [(n, f[0] if f else 0, "c", p, 60, c, None, None, 0, s, "I" * len(s)) for n, p, c, s, *f in rows]
    df = spark.createDataFrame(made, READ).withColumn("tags", F.lit(None).cast("map<string,string>"))
    return df.withColumn("file", F.lit(file)) if file else df


def random_ranges(spark, seed, n=200, top=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.randrange(1, top)
        rows.append((i, rng.choice("xy"), a, a + rng.randrange(-1, 12)))
    return rows, spark.createDataFrame(rows, RANGE)


@pytest.mark.parametrize("tile", [7, 50, intervals.TILE])
def test_tiles_do_not_show(spark, monkeypatch, tile):
    monkeypatch.setattr(intervals, "TILE", tile)
    rows, ranges = random_ranges(spark, tile)
    depth = {}
    for _, c, a, b in rows:
        for p in range(a, b + 1):
            depth[c, p] = depth.get((c, p), 0) + 1
    runs = intervals.coverage(ranges).collect()
    assert {(r.contig, p): r.depth for r in runs for p in range(r.start, r.end + 1)} == depth
    assert all((r.contig, r.end + 1) not in depth or depth[r.contig, r.end + 1] != r.depth or any(s == r.end + 1 or e == r.end for _, c, s, e in rows if c == r.contig) for r in runs)
    merged = sorted(map(tuple, intervals.normalize(ranges).select("contig", "start", "end").collect()))
    assert {(c, p) for c, a, b in merged for p in range(a, b + 1)} == set(depth)
    assert all(x[0] != y[0] or x[2] + 1 < y[1] for x, y in zip(merged, merged[1:], strict=False))


def test_numbers_follow_the_order(spark):
    rows = [(random.Random(i).randrange(50), i) for i in range(300)]
    got = shared.numbered(spark.createDataFrame(rows, "a int, b int").repartition(7), "n", "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == sorted(rows) and sorted(r.n for r in got) == list(range(300))
    assert shared.numbered(spark.createDataFrame([], "a int"), "n", "a").count() == 0


def test_chunks_hold_all_rows_in_order(spark):
    rows = spark.range(1, 26).select(F.col("id").alias("k")).repartition(4)
    parts = [[r.k for r in p.orderBy("k").collect()] for p in scan.iterate(rows, 10, "k")]
    assert parts == [list(range(1, 11)), list(range(11, 21)), list(range(21, 26))]
    assert list(scan.iterate(rows.where("false"), 10, "k")) == []


def test_sample_is_the_same_for_any_partitions(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    one, two = (sorted(r.id for r in scan.sample_n(x, 50, seed=3).collect()) for x in (rows.coalesce(1), rows.repartition(9)))
    assert one == two and len(set(one)) == 50
    assert one != sorted(r.id for r in scan.sample_n(rows, 50, seed=4).collect())
    assert abs(sum(one) / 50 - 500) < 150 and scan.sample_n(rows, 5000).count() == 1000


def test_unknown_contigs_are_errors(spark):
    rows = reads(spark, [("r", 1, "3M", "ACG")])
    contigs = spark.createDataFrame([("c", 100)], "name string, length int")
    good, bad = (spark.createDataFrame([(1, c, 1, 9)], RANGE) for c in ("c", "other"))
    assert scan.scan(rows, ScanSpec(what=("qname",)), good, contigs).count() == 1
    with pytest.raises(PySparkException, match="no contig other"):
        scan.scan(rows, ScanSpec(what=("qname",)), bad, contigs).collect()
    lines = tabtext.keyed(spark.createDataFrame([("c\t1\t9",)], "line string"), tabtext.Layout(1, 2, 3))
    assert tabtext.in_ranges(lines, good, tabtext.names(lines)).count() == 1
    with pytest.raises(PySparkException, match="no contig other"):
        tabtext.in_ranges(lines, bad, tabtext.names(lines)).collect()


def brute_pileup(rows, cap):
    """Counts by position and letter of the first `cap` reads at each position; M, D and N only."""
    at = {}
    for n, p, c, s, *_ in sorted(rows, key=lambda r: (r[1], r[0], 0, r[2], r[3])):
        q, place, number = 0, p, ""
        for x in c:
            if x.isdigit():
                number += x
                continue
            for _ in range(int(number)):
                at.setdefault(place, []).append({"M": s[q : q + 1], "D": "-", "N": None}[x])
                q, place = q + (x == "M"), place + 1
            number = ""
    out = {}
    for place, letters in at.items():
        for x in letters[:cap]:
            if x:
                out[place, x] = out.get((place, x), 0) + 1
    return out


@pytest.mark.parametrize("cap", [1, 3, 250, None])
def test_depth_caps(spark, cap):
    rng = random.Random(cap)
    rows = [(f"r{i}", rng.choice([rng.randrange(1000, 1060), rng.randrange(1, 5000)]), c, "".join(rng.choice("ACGT") for _ in range(6))) for i in range(120) for c in [rng.choice(["6M", "3M2D3M", "2M40N4M"])]]
    table = reads(spark, rows).repartition(3)
    spec = PileupSpec(max_depth=cap, distinguish_strands=False)
    want = brute_pileup(rows, cap)
    assert {(r.pos, r.nucleotide): r["count"] for r in pileup(table, spec).collect()} == want
    ranges = spark.createDataFrame([(1, "c", 1010, 1030), (2, "c", 1025, 4000), (3, "d", 1, 9)], RANGE)
    got = {(r.range_id, r.pos, r.nucleotide): r["count"] for r in pileup(table, spec, ranges=ranges).collect()}
    assert got == {(i, p, x): n for i, a, b in ((1, 1010, 1030), (2, 1025, 4000)) for (p, x), n in want.items() if a <= p <= b}
    both = table.withColumn("file", F.lit("f")).unionByName(table.withColumn("file", F.lit("g")))
    for r in multi_file_depth(both, ranges, MultiPileupSpec(max_depth=cap)).collect():
        assert [r[x] for x in "ACGT"] == [want.get((r.pos, x), 0) for x in "ACGT"]
    total = quality_depth(both, ranges, MultiPileupSpec(max_depth=cap)).agg(F.sum("count")).first()[0]
    assert total == 2 * sum(n for (_, _, x), n in got.items() if x != "-")


def test_reads_without_bases_or_qualities(spark):
    rows = reads(spark, [("a", 1, "2M1I2M", "ACGTA"), ("b", 1, "2M1I2M", "")]).withColumn("seq", F.when(F.col("seq") != "", F.col("seq")))
    spec = PileupSpec(include_insertions=True, distinguish_strands=False, min_base_quality=0)
    assert sorted((r.pos, r.nucleotide, r["count"]) for r in pileup(rows, spec).collect()) == [(1, "A", 1), (2, "+", 2), (2, "C", 1), (3, "T", 1), (4, "A", 1)]


def test_loose_and_strict_mates_differ(spark):
    """Mates on one strand by their bits: the loose rule of whole files takes them, the strict one does not."""
    fields = "key long, qname string, flag int, rname string, mrnm string, pos int, mpos int"
    agree, differ = [(1, "p", 99, "c", "c", 10, 90), (2, "p", 147, "c", "c", 90, 10)], [(3, "q", 65 + 32, "c", "c", 10, 90), (4, "q", 129 + 32, "c", "c", 90, 10)]
    rows = spark.createDataFrame(agree + differ, fields)
    of = lambda strict: {r.key: r.mate_status for r in mates.mate_status(rows, strict=strict).collect()}
    assert of(False) == {1: "mated", 2: "mated", 3: "mated", 4: "mated"}
    assert of(True) == {1: "mated", 2: "mated", 3: "unmated", 4: "unmated"}
    assert scan.first_n_pairs(mates.mate_status(rows), 1).count() == 2


def test_regions_over_pieces(spark):
    rng = random.Random(2)
    whole = {f"s{i}": "".join(rng.choice("ACGT") for _ in range(n)) for i, n in enumerate((1, 10, 33, 100))}
    table = spark.createDataFrame(list(whole.items()), "name string, seq string")
    asked = [(i, n, a, b) for i in range(80) for n in [rng.choice(list(whole))] for a in [rng.randint(1, len(whole[n]))] for b in [rng.randint(a - 1, len(whole[n]))]]
    ranges = spark.createDataFrame(asked, RANGE)
    got = {r.range_id: r.seq for r in sequences.regions(table, ranges, width=10).collect()}
    assert got == {i: whole[n][a - 1 : b] for i, n, a, b in asked}
    with pytest.raises(PySparkException, match="beyond its sequence"):
        sequences.regions(table, spark.createDataFrame([(1, "s1", 5, 11)], RANGE), width=4).collect()
    assert sequences.regions(table, ranges.where("range_id = 0"), alphabet="RNA").first().seq == got[0].replace("T", "U")


def test_lines_are_numbered_by_file(spark, tmp_path):
    for f, n in (("a", 400), ("b", 30)):
        (tmp_path / f).write_text("".join(f"{f}{i}\t{i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")
    try:
        rows = text.numbered_lines(spark, str(tmp_path)).collect()
        assert len(rows) == 430 and all(r.line.split("\t")[1] == str(r.line_no) for r in rows)
        old = text.old_pileup(spark, str(tmp_path / "b"))
        assert [r.space for r in old.orderBy("line_no").collect()] == [f"b{i}" for i in range(30)]
        skip = tabtext.Layout(1, 2, 0, skip=3)
        lines = text.numbered_lines(spark, str(tmp_path / "b"))
        assert tabtext.keyed(lines, skip).count() == 27 and tabtext.header(lines, skip).count() == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_genotype_fields_are_left_out(spark):
    lines = ["c\t5\t.\tA\tG\t9\tPASS\tDP=1\tGT:DP\t0/1:7"]
    rows = variants.parse(spark.createDataFrame([(x,) for x in lines], "line string"), ["one"])
    fields = lambda spec: variants.scan(rows, spec).schema["geno"].dataType.elementType.names
    assert fields(VariantSpec()) == ["sample", "gt", "dp", "other"]
    assert fields(VariantSpec(trim_empty=False)) == ["sample", "gt", "dp", "gq", "sp", "pl", "gl", "other"]


def test_bam_folder_commits(spark, tmp_path):
    """Only committed files are left; folders and URIs can be read; overwriting replaces."""
    bgzf.register(spark)
    rows = sam.parse(spark.createDataFrame([(f"r{i}\t0\tc\t{i + 1}\t9\t3M\t*\t0\t0\tACG\tIII",) for i in range(50)], "line string"))
    folder = tmp_path / "out"
    save = lambda df, mode: df.repartition(3).write.format("bam").mode(mode).option("contigs", "c:1000").save(f"file://{folder}")
    save(rows, "append")
    read = lambda: {r.qname for r in spark.read.format("bam").load(f"file://{folder}").collect()}
    assert read() == {f"r{i}" for i in range(50)} and {p.suffix for p in folder.iterdir()} == {".bam"}
    fail = F.udf(lambda n: 1 / (n - 7), "double")
    with pytest.raises(PySparkException):
        save(rows.withColumn("mapq", F.when(fail("pos") > 5, 0).otherwise(F.col("mapq"))), "append")
    assert len(read()) == 50 and {p.suffix for p in folder.iterdir()} == {".bam"}
    save(rows.where("pos <= 5"), "overwrite")
    assert read() == {f"r{i}" for i in range(5)}


def typed(code, values):
    """A typed value of the binary variant format."""
    n = len(values)
    head = bytes([n << 4 | code]) if n < 15 else bytes([15 << 4 | code, 0x12]) + struct.pack("<h", n)
    return head + (values if code == 7 else struct.pack(f"<{n}{ {1: 'b', 2: 'h', 3: 'i', 5: 'f'}[code] }", *values))


def bcf_record(contig, pos, name, alleles, qual, tests, info, cells):
    shared = struct.pack("<iiiIII", contig, pos - 1, len(alleles[0]), 0x7F800001 if qual is None else struct.unpack("<I", struct.pack("<f", qual))[0], len(alleles) << 16 | len(info), len(cells) << 24 | 2)
    shared += typed(7, name) + b"".join(typed(7, a) for a in alleles) + typed(1, tests) + b"".join(typed(1, [k]) + v for k, v in info)
    indiv = b"".join(typed(1, [k]) + v for k, v in cells)
    return struct.pack("<II", len(shared), len(indiv)) + shared + indiv


@pytest.mark.parametrize("split", [200, 1 << 20])
def test_bcf_gives_vcf_lines(spark, tmp_path, split):
    head = ["##fileformat=VCFv4.2", "##contig=<ID=c1>", "##contig=<ID=c2,length=9>", "##FILTER=<ID=q10>", '##INFO=<ID=DP,Number=1,Type=Integer,Description="x, y">', "##INFO=<ID=DB,Number=0>", "##INFO=<ID=AF>", "##FORMAT=<ID=GT>", "##FORMAT=<ID=PL>", "##FORMAT=<ID=XX>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tone\ttwo"]
    text = "\n".join(head).encode() + b"\n\0"
    body, want = b"", []
    for i in range(300):
        gt = b"\x21" + struct.pack("<4b", 2, 5, 0, 0) if i % 2 else b"\x21" + struct.pack("<4b", 4, -127, 2, 4)
        pl = b"\x32" + struct.pack("<6h", 0, 300, 9, -(2**15), -(2**15) + 1, -(2**15) + 1)
        info = [(2, typed(3, [70_000 + i])), (3, b"\0"), (4, typed(5, [0.5, 0.25]))]
        body += bcf_record(i % 2, i + 1, b"rs%d" % i if i % 3 else b".", [b"A", b"CT" * (i % 20 + 1)], None if i % 5 == 0 else 7.5, [1, 0] if i % 7 == 0 else [0], info, [(5, gt), (6, pl), (7, b"\x37ab\0c\0\0")])
        want.append(f"c{i % 2 + 1}\t{i + 1}\t{f'rs{i}' if i % 3 else '.'}\tA\t{'CT' * (i % 20 + 1)}\t{'.' if i % 5 == 0 else '7.5'}\t{'q10;PASS' if i % 7 == 0 else 'PASS'}\tDP={70_000 + i};DB;AF=0.5,0.25\tGT:PL:XX\t{'0|1' if i % 2 else '1'}:0,300,9:ab\t{'./.' if i % 2 else '0/1'}:.:c")
    data = b"BCF\2\2" + struct.pack("<I", len(text)) + text + body
    packed = b"".join(bgzf.compress(data[k : k + 700])[: -len(bgzf.EOF_MEMBER)] for k in range(0, len(data), 700)) + bgzf.EOF_MEMBER
    (tmp_path / "x.bcf").write_bytes(packed)
    (tmp_path / "x.bcf.csi").write_bytes(b"")
    bcf.register(spark)
    lines = [r.line for r in spark.read.format("bcf").option("splitBytes", split * 8).load(str(tmp_path / "x.bcf")).collect()]
    assert lines[: len(head)] == head and sorted(lines[len(head) :]) == sorted(want)
    rows = bcf.read(spark, str(tmp_path / "x.bcf")).where("pos = 2").collect()
    assert rows[0].geno[0].gt == "0|1" and rows[0].geno[0].pl == [0, 300, 9] and rows[0].geno[1].gt == "./." and rows[0].geno[1].other["XX"] == "c"
    assert bgzf.index_path(str(tmp_path / "x.bcf")) == str(tmp_path / "x.bcf.csi") and bgzf.index_path(str(tmp_path / "y.bam")) is None


def test_callbacks_by_chunk_and_range(spark):
    rows = spark.range(25).select("id", (F.col("id") % 2).alias("range_id"))
    sums = scan.apply_chunks(rows, 10, lambda f: f.agg({"id": "sum"}).to_frame().T, "id long", "id").collect()
    assert sorted(r.id for r in sums) == sorted([45, 145, 110])
    import pandas as pd

    got = scan.apply_groups(rows, "range_id", lambda f: pd.DataFrame({"range_id": [f["range_id"].iloc[0]], "n": [len(f)], "low": [f["id"].iloc[0]]}), "range_id long, n long, low long", n=5).collect()
    assert sorted(map(tuple, got)) == [(0, 3, 20), (0, 5, 0), (0, 5, 10), (1, 2, 21), (1, 5, 1), (1, 5, 11)]


def test_callers_rules_parsers_and_views(spark):
    import pandas as pd

    rows = spark.range(20).repartition(3)
    assert {r.id for r in scan.where_frame(rows, lambda f: f["id"] % 2 == 0, lambda f: f["id"] > 9, lambda f: True).collect()} == {10, 12, 14, 16, 18}
    assert scan.where_frame(rows, lambda f: False).count() == 0
    parsed = tabtext.parse_with(spark.createDataFrame([("a 1",), ("b 2",)], "line string"), lambda f: pd.DataFrame({"n": f["line"].str.split(" ").str[1].astype("int64")}), "n long")
    assert sorted(r.n for r in parsed.collect()) == [1, 2]
    table = reads(spark, [("r1", 1, "3M", "ACG"), ("r2", 3, "3M", "ACG")], "f").unionByName(reads(spark, [("r3", 2, "3M", "ACG")], "g"))
    views = Views(table, spark.createDataFrame([(1, "c", 1, 9)], RANGE), spark.createDataFrame([("one", "f"), ("two", "g")], "sample string, file string"))
    counts = views.apply(lambda f: pd.DataFrame({"sample": [f["sample"].iloc[0]], "n": [len(f)]}), "sample string, n long").collect()
    assert sorted(map(tuple, counts)) == [("one", 2), ("two", 1)]


def test_sort_orders(spark):
    rows = reads(spark, [("b", 5, "1M", "A"), ("a", 9, "1M", "A"), ("a", 5, "1M", "A", 16), ("c", 5, "1M", "A")])
    assert [(r.qname, r.pos) for r in sorting.sort(rows).collect()] == [("b", 5), ("c", 5), ("a", 5), ("a", 9)]
    assert [(r.qname, r.pos) for r in sorting.sort(rows, by="name").collect()] == [("a", 5), ("a", 9), ("b", 5), ("c", 5)]
    assert cigar.reference_end(F.lit(5), F.lit("3M")) is not None
    with pytest.raises(ValueError):
        sorting.sort(rows, by="colour")


def test_stream_batches_are_added_up():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"seqnames": ["c"] * 3, "pos": [1, 1, 2], "strand": ["+"] * 3, "nucleotide": ["A"] * 3, "read_start": [1, 2, 2], "n": [1, 1, 1], "ended": [False] * 3})
    out = pa.Table.from_batches(list(_batch_sums(iter([batch])))).sort_by("pos").to_pylist()
    assert [(r["pos"], r["n"], r["read_start"]) for r in out] == [(1, 2, 2), (2, 1, 2)]


def test_old_pileup_rows_beside_each_other_over_tiles(spark, monkeypatch):
    """The line before or after is found across tiles, also over tiles without lines."""
    rng = random.Random(8)
    base = ["position", "referenceBase", "consensusBase", "consensusQuality", "snpQuality", "maxMappingQuality", "coverage"]
    rows, at = [], {"c1": 0, "c2": 0}
    for _ in range(200):
        c = rng.choice(["c1", "c2"])
        at[c] += rng.choice([1, 1, 2, 40])
        rows.append((at[c], c, at[c], rng.choice("ACG*"), "A", 1, 2, 3, 4))
    df = spark.createDataFrame(rows, "line_no long, space string, position int, referenceBase string, consensusBase string, consensusQuality int, snpQuality int, maxMappingQuality int, coverage int").repartition(4)
    monkeypatch.setattr(tabtext, "TILE", 7)
    snp, indel = set(), set()
    for c in at:
        own = sorted(r for r in rows if r[1] == c)
        snp |= {(c, a[0]) for a, b in zip(own, [*own[1:], None], strict=True) if a[3] != "*" and not (b and b[3] == "*")}
        indel |= {(c, b[0], a[2] if a else None, a[3] if a else None) for a, b in zip([None, *own[:-1]], own, strict=True) if b[3] == "*"}
    assert {(r.space, r.line_no) for r in tabtext.legacy_pileup(df, "SNP").collect()} == snp
    found = tabtext.legacy_pileup(df, "indel")
    assert {(r.space, r.line_no, r.position, r.referenceBase) for r in found.collect()} == indel and set(base) <= set(found.columns)


def test_chunks_are_read_one_by_one(spark):
    rows = spark.range(250).selectExpr("id", "id % 7 AS k").repartition(5)
    parts = [sorted(r.id for r in c.collect()) for c in scan.iterate(rows, 60, "k", "id")]
    order = [r.id for r in rows.orderBy("k", "id").collect()]
    assert [sorted(order[i : i + 60]) for i in range(0, 250, 60)] == parts
    assert list(scan.iterate(rows.where("id < 0"), 60, "k", "id")) == []


@pytest.mark.parametrize("depth", [1, 2, 7])
def test_depth_cap_counts_first_reads_at_every_position(spark, depth):
    """Reads over several bins, with skips, in ranges and without, against a count by hand."""
    rng = random.Random(depth)
    rows = [(f"q{i}", 0, "c", rng.choice([990, 1000, 1010, 2040, 5000 + i]) + rng.randrange(30), 30, rng.choice(["20M", "10M1100N10M"]), None, None, 0, "".join(rng.choices("ACGT", k=20)), "I" * 20, None) for i in range(60)]
    want = Counter()
    seen = Counter()
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        skip = 1100 if "N" in r[5] else 0
        places = {r[3] + i + (skip if skip and i >= 10 else 0): r[9][i] for i in range(20)}
        for p in range(r[3], r[3] + 20 + skip):
            seen[p] += 1
            if seen[p] <= depth and p in places:
                want[p, places[p]] += 1
    spec = PileupSpec(max_depth=depth, distinguish_strands=False)
    df = spark.createDataFrame(rows, ALIGNMENT).repartition(3)
    assert {(r.pos, r.nucleotide): r["count"] for r in pileup(df, spec).collect()} == dict(want)
    ranges = spark.createDataFrame([(1, "c", 1000, 1030), (2, "c", 1020, 2100)], "range_id long, contig string, start int, end int")
    got = {(r.range_id, r.pos, r.nucleotide): r["count"] for r in pileup(df, spec, ranges=ranges).collect()}
    assert got == {(k, p, x): n for k, a, b in ((1, 1000, 1030), (2, 1020, 2100)) for (p, x), n in want.items() if a <= p <= b}


def test_first_of_repeated_keys(spark):
    from strandflow.functions.sequence import first_entries

    row = spark.sql("SELECT array('a', 'b', 'a', 'c') AS k, array('1', '2', '3', null) AS v").select(first_entries(F.col("k"), F.col("v")).alias("m")).first()
    assert row.m == {"a": "1", "b": "2", "c": None}
