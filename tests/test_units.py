"""Filters, intervals, sequences, sources and streaming on small inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandflow.functions import cigar, flags, sequence
from strandflow.operators import count, intervals, mates, scan, sequences, sorting, tabtext, variants
from strandflow.sources import bgzf, sam, text
from strandflow.specs import ScanSpec, VariantSpec
from strandflow.streaming.frontier_pileup import END_NAME, stream_pileup

RANGE = "range_id long, contig string, start int, end int"
SAM = [
    "@HD\tVN:1.3\tSO:coordinate", "@SQ\tSN:c1\tLN:100", "@SQ\tSN:c2\tLN:50",
    "r1\t99\tc1\t5\t30\t8M2I4M1D3M\t=\t37\t39\tTTAGATAAAGGATACTG\t*\tNM:i:1\tAA:A:d\tXF:f:1.5\tZZ:Z:hi there\tBB:B:i,1,-2,3",
    "r2\t4\t*\t0\t0\t*\t*\t0\t0\tACGTN\tIIIII", "r3\t16\tc2\t29\t17\t6H5M\t*\t0\t0\tTAGGC\t=====\tAA:A:a\tII:i:45",
]


def lines(spark, rows):
    return spark.createDataFrame([(x,) for x in rows], "line string")


def plain(rows):
    """Rows as text, with tags in order of name."""
    def one(r):
        d = r.asDict(recursive=True)
        return str({**d, "tags": sorted(d["tags"].items())})

    return sorted(map(one, rows.collect()))


def test_flag_filters_round_trip():
    for states in itertools.product((None, True, False), repeat=2):
        keep = flags.flag_filter(isPaired=states[0], isDuplicate=states[1])
        assert (flags.flag_states(keep)["isPaired"], flags.flag_states(keep)["isDuplicate"]) == states
    with pytest.raises(ValueError):
        flags.flag_filter(isNothing=True)


def test_sam_round_trip(spark, tmp_path):
    rows = sam.parse(lines(spark, SAM))
    assert rows.where("qname = 'r1'").select("mrnm", F.col("tags")["BB"]["ai"]).first() == ("c1", [1, -2, 3])
    assert rows.where("qname = 'r2'").select("rname", "pos", "cigar").first() == (None, None, None)
    sam.write(rows, str(tmp_path / "out"), compression="gzip")
    again = sam.read(spark, str(tmp_path / "out"))
    assert plain(again.drop("file")) == plain(rows)
    assert sam.contigs(lines(spark, SAM)).collect() == [("c1", 100), ("c2", 50)]


@pytest.mark.parametrize("split", [400, 1 << 20])
def test_bam_round_trip(spark, tmp_path, split):
    bgzf.register(spark)
    rows = sam.parse(lines(spark, SAM + [f"n{i}\t0\tc1\t{i % 90 + 1}\t9\t5M\t*\t0\t0\tACGTA\tABCDE\tNM:i:{i}" for i in range(5000)])).coalesce(1)
    rows.write.format("bam").mode("append").option("contigs", "c1:100,c2:50").save(str(tmp_path / "b"))
    files = ",".join(str(p) for p in (tmp_path / "b").glob("*.bam"))
    again = spark.read.format("bam").option("splitBytes", split * 20).load(files)
    assert plain(again) == plain(rows)
    assert bgzf.decompress(bgzf.compress(b"x" * 100_000)) == b"x" * 100_000


def test_cigar(spark):
    row = spark.sql("SELECT '3S8M1D6M4H' AS c, CAST(NULL AS STRING) AS n").select(cigar.query_width(F.col("c")), cigar.reference_width(F.col("c")), cigar.query_width(F.col("n")), cigar.is_simple(F.col("n")), cigar.is_simple(F.col("c"))).first()
    assert tuple(row) == (17, 15, None, True, False)


def test_tag_filter(spark):
    rows = sam.parse(lines(spark, SAM))
    assert [r.qname for r in scan.scan(rows, ScanSpec(what=("qname",), tag_filter={"AA": ["a", "x"], "II": [45]})).collect()] == ["r3"]
    with pytest.raises(Exception, match="another type"):
        scan.scan(rows, ScanSpec(what=("qname",), tag_filter={"XF": [1]})).collect()
    with pytest.raises(ValueError):
        ScanSpec(tag_filter={"AA": []})


def test_interval_join_is_brute_force(spark):
    rng = random.Random(5)
    spans = [(i, rng.choice("ab"), s := rng.randint(1, 500), s + rng.randint(0, 200)) for i in range(200)]
    ranges = [(i, rng.choice("abc"), s := rng.randint(1, 500), s + rng.randint(-1, 300)) for i in range(60)]
    left = spark.createDataFrame(spans, "id long, c string, s int, e int")
    met = intervals.interval_join(left, spark.createDataFrame(ranges, RANGE), "c", "s", "e", bin_width=64)
    want = sorted((x[0], r[0]) for x in spans for r in ranges if x[1] == r[1] and x[2] <= r[3] and x[3] >= r[2] and r[3] >= r[2])
    assert sorted((r.id, r.range_id) for r in met.collect()) == want


def test_ranges(spark):
    rows = spark.createDataFrame([(1, "a", 1, 5), (2, "a", 6, 9), (3, "a", 8, 20), (4, "a", 30, 31), (5, "b", 2, 1)], RANGE)
    assert sorted(map(tuple, intervals.normalize(rows).collect())) == [("a", 1, 20), ("a", 30, 31)]
    with pytest.raises(Exception, match="out of bounds"):
        intervals.check_ranges(spark.createDataFrame([(1, "a", 1, (1 << 29) + 1)], RANGE)).collect()
    assert intervals.unknown_contigs(rows, spark.createDataFrame([(0, "a", 9)], "tid int, name string, length int")).collect() == [("b",)]
    alignments = sam.parse(lines(spark, SAM))
    hits = count.count_ranges(alignments, spark.createDataFrame([(1, "c1", 22, 40), (2, "c1", 1, 4), (3, "c2", 30, 30)], RANGE))
    assert sorted((r.range_id, r.records, r.nucleotides) for r in hits.collect()) == [(1, 0, 0), (2, 0, 0), (3, 1, 5)]


def test_sequences(spark):
    seqs = spark.createDataFrame([("p", "ACGTTNacg"), ("q", "GGGA")], "name string, seq string")
    ranges = spark.createDataFrame([(1, "p", 1, 4, "-"), (2, "q", 2, 4, "+")], RANGE + ", strand string")
    assert [r.seq for r in sequences.regions(seqs, ranges, stranded=True).orderBy("range_id").collect()] == ["ACGT", "GGA"]
    assert [r.seq for r in sequences.regions(seqs, ranges).orderBy("range_id").collect()] == ["ACGT", "GGA"]
    with pytest.raises(Exception, match="beyond"):
        sequences.regions(seqs, spark.createDataFrame([(1, "q", 2, 5)], RANGE)).collect()
    assert seqs.select(sequence.reverse_complement(F.lit("ACMRWSYKVHDBNacgt"))).first()[0] == "acgtNVHDBMRSWYKGT"
    with pytest.raises(Exception, match="alphabet"):
        seqs.select(sequence.in_alphabet(F.lit("ACGE!"), "DNA")).collect()


def test_fasta_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nAC\n>two\nGG\n")
    rows = text.fasta(spark, str(tmp_path / "a.fa"))
    assert sorted(map(tuple, rows.collect())) == [("one", "ACGTAC"), ("two", "GG")]
    listed = spark.createDataFrame([(0, "one", "ACGTAC"), (1, "two", "GG")], "ordinal int, name string, seq string")
    assert [tuple(r) for r in text.index_of(listed, 4).collect()] == [("one", 6, 5, 4, 5), ("two", 2, 18, 4, 5)]


def test_phred(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(sequence.phred_offset(F.lit(-5), "Solexa")) == 26 and one(sequence.phred_offset(F.lit(41))) == 41 and one(sequence.phred_char_offset(F.lit("~"))) == 93
    with pytest.raises(Exception, match="outside"):
        one(sequence.phred_offset(F.lit(2), "Illumina 1.5+"))


def test_trim_name(spark):
    rows = spark.createDataFrame([("lib.a.b/1/2",), ("plain",)], "q string").select(sequence.trim_name(F.col("q"), ".", "/"))
    assert [r[0] for r in rows.collect()] == ["a.b/1", "plain"]


def test_mates(spark):
    schema = "key long, qname string, flag int, rname string, pos int, mrnm string, mpos int"
    pair = [(1, "a", 99, "c", 10, "c", 60), (2, "a", 147, "c", 60, "c", 10)]
    extra = [(3, "b", 99, "c", 10, "c", 60), (4, "b", 147, "c", 60, "c", 10), (5, "b", 147, "c", 60, "c", 10), (6, "b", 4, None, None, None, None)]
    rows = spark.createDataFrame(pair + extra, schema)
    got = {r.key: (r.mate_status, r.mate, r.groupid) for r in mates.mate_status(rows).collect()}
    assert got == {1: ("mated", 2, 1), 2: ("mated", 1, 1), 3: ("ambiguous", None, 3), 4: ("ambiguous", None, 3), 5: ("ambiguous", None, 3), 6: ("unmated", None, 6)}
    assert {r.key: r.hit for r in mates.mates_within_groups(rows).collect()} == {1: 2, 2: 1, 3: 0, 4: -3, 5: -3, 6: None}


def test_order_and_layout(spark, tmp_path):
    rows = sam.parse(lines(spark, SAM))
    assert [r.qname for r in sorting.sort(rows).collect()] == ["r1", "r3", "r2"]
    assert [r.qname for r in sorting.sort(rows, "tag", "AA").collect()][0] == "r2"
    with pytest.raises(ValueError):
        sorting.merge({"one": rows})
    sorting.land(rows, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).where("contig = 'c1' AND pos < 6").count() == 1
    sorting.filter_to(rows, str(tmp_path / "f"), F.col("mapq") > 0, spark.createDataFrame([("c1", 1, 9), ("c1", 5, 30)], "contig string, start int, end int"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 1


def test_tabtext(spark):
    rows = tabtext.keyed(lines(spark, ["#h", "c\t0\t5\tx", "c\t10\t12\ty"]), tabtext.PRESETS["bed"])
    assert [(r.start, r.end) for r in rows.collect()] == [(1, 5), (11, 12)]
    assert [r.records for r in tabtext.count(rows, spark.createDataFrame([(1, "c", 5, 11), (2, "d", 1, 2)], RANGE)).orderBy("range_id").collect()] == [2, 0]


def test_variants(spark, tmp_path):
    body = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2", "1\t7\t.\tAC\tG\t.\tPASS\tDP=3;H2\tGT:DP:PL\t0/1:3:1,2,3\t./."]
    (tmp_path / "v.vcf").write_text("\n".join(body))
    rows = text.vcf(spark, str(tmp_path / "v.vcf"))
    first = rows.first()
    assert first.pos == 7 and first.geno[0].pl == [1, 2, 3] and first.geno[1].dp is None
    some = variants.scan(rows, VariantSpec(info=("DP", "H2", "XX"), geno=("GT",), samples=("s2",)), spark.createDataFrame([(1, "1", 8, 8)], RANGE)).first()
    assert (some.info_DP, some.info_H2, some.info_XX, some.which_label) == ("3", "", None, "1:8-8") and some.geno[0].GT == "./."
    with pytest.raises(Exception, match="#CHROM"):
        variants.samples(lines(spark, body[:1])).collect()


def test_streaming_pileup_releases_behind_the_frontier(spark, tmp_path):
    def read(contig, pos, base):
        return f"B7\t0\t{contig}\t{pos}\t99\t5M\t*\t0\t0\t{base * 5}\t====="

    batches = [[read("c1", 1, "A")], [read("c1", 3, "A"), read("c1", 3, "C")], [read("c1", 5, "A"), read("c2", 5, "G")], [f"{END_NAME}\t0\t{c}\t1\t99\t1M\t*\t0\t0\tA\t=" for c in ("c1", "c2")]]
    out = []
    source = tmp_path / "in"
    source.mkdir()
    for i, b in enumerate(batches):
        (source / f"{i}.txt").write_text("\n".join(b))
        stream = sam.parse(spark.readStream.text(str(source)).select(F.col("value").alias("line")))
        q = stream_pileup(stream).writeStream.foreachBatch(lambda df, n: out.append(sorted((r.seqnames, r.pos, r.nucleotide, r["count"]) for r in df.collect()))).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    released = [x for x in out if x]
    assert [sorted({(c, p) for c, p, _, _ in x}) for x in released] == [[("c1", 1), ("c1", 2)], [("c1", 3), ("c1", 4)], [("c1", p) for p in range(5, 10)] + [("c2", p) for p in range(5, 10)]]
    assert ("c1", 5, "A", 3) in released[-1] and ("c1", 3, "C", 1) in released[1]
