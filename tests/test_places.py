"""Packed tiles of places: what a batch of reads costs the shuffle, and odd reads, by hand."""

import numpy as np
import pyarrow as pa

from strandflow.operators import pileup as P
from strandflow.operators import places
from strandflow.specs import PileupSpec


def batch(*rows):
    """rows: seqnames, pos, flag, cigar, seq, qual"""
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["seqnames", "pos", "flag", "cigar", "seq", "qual"])


def counts(*batches, spec=None):
    """Packed batch by batch, sorted, and added up in batches of one row, so that groups go on from one to the next."""
    spec = spec or PileupSpec()
    packed = pa.Table.from_batches(list(places.packer(["seqnames"], spec)(iter(batches)))).sort_by([("seqnames", "ascending"), ("tile", "ascending")])
    finish = lambda spot, letter, strand, bins, n: (np.arange(len(spot)), {"strand": places.texts(strand, ["+", "-"]), "letter": places.texts(letter), "bin": pa.array(bins), "n": pa.array(n)})
    out = list(places.adder(["seqnames"], spec, finish)(iter(packed.to_batches(max_chunksize=1))))
    return sorted(tuple(r.values()) for b in out for r in b.to_pylist())


def test_a_batch_sends_a_row_for_each_tile_not_for_each_base():
    rows = [("c", 100, 0, "100M", "ACGTN" * 20, "I" * 100)] * 50
    packed = list(places.packer(["seqnames"], PileupSpec(ignore_query_ns=False))(iter([batch(*rows)])))
    assert [b.num_rows for b in packed] == [1] and len(packed[0].column("cells")[0].as_py()) == 8 * 100
    edge = list(places.packer(["seqnames"], PileupSpec())(iter([batch(("c", 1020, 0, "10M", "A" * 10, "I" * 10))])))
    assert edge[0].column("tile").to_pylist() == [0, 1]
    long = list(places.packer(["seqnames"], PileupSpec())(iter([batch(("c", 1024, 0, "1000M", "A" * 1000, "I" * 1000))])))
    assert long[0].num_rows == 2 and max(len(x) for x in long[0].column("cells").to_pylist()) == 8 * places.PIECE


def test_groups_go_on_from_batch_to_batch():
    one, two = ("c", 1, 0, "2M", "AC", "II"), ("d", 1, 16, "1M", "A", "I")
    got = counts(batch(one, two), batch(one), batch(two, one))
    assert got == [("c", 1, "+", "A", 0, 3), ("c", 2, "+", "C", 0, 3), ("d", 1, "-", "A", 0, 2)]


def test_odd_reads():
    rows = [("c", 1, 0, "3M", "AC", "III"), ("c", 1, 0, "3M", "ACG", "I"), ("c", 1, 0, "2M", "AA", None), ("c", 1, 0, "2M", None, "II"), ("c", 9, 0, "1M1D1M", None, "II"), ("c", 1, 0, "5S", "AAAAA", "IIIII"), ("c", 5, 0, "2M", "é日", "II")]
    assert counts(batch(*rows)) == [("c", 1, "+", "A", 0, 2), ("c", 2, "+", "C", 0, 1), ("c", 5, "+", "é", 0, 1), ("c", 6, "+", "日", 0, 1), ("c", 10, "+", "-", 0, 1)]


def test_letters_merge_after_the_tests_on_them(spark):
    reads = [(1, "A", 0), (1, "A", 16), (1, "G", 0), (2, "A", 0), (2, "A", 0)]
    df = spark.createDataFrame([("q", f, "c", p, 30, "1M", s, "I") for p, s, f in reads], "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string")
    flat = PileupSpec(min_minor_allele_depth=1, distinguish_nucleotides=False, left_bins=(0, 5))
    assert sorted(map(tuple, P.pileup(df, flat).collect())) == [("c", 1, "+", "(0,5]", 2), ("c", 1, "-", "(0,5]", 1)]


def test_sweep_goes_on_from_batch_to_batch(spark):
    df = spark.createDataFrame([(f"q{i:02}", 0, "c", 1000 + i % 7, 30, "60M", "A" * 60, "I" * 60) for i in range(40)], "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {r["pos"]: r["count"] for r in P.pileup(df, PileupSpec(max_depth=5)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    depth = {p: sum(1000 + i % 7 <= p < 1060 + i % 7 for i in range(40)) for p in range(1000, 1066)}
    assert got == {p: min(5, n) for p, n in depth.items() if n}


def test_characters_of_a_slice_are_its_own_only():
    whole = pa.array(["A" * 1000, "CG", None, "", "T"])
    for column in (whole.slice(1), whole.slice(1, 4), pa.array(["é", *whole.to_pylist()]).slice(2)):
        data, first, length = places.characters(column)
        assert bytes(data.astype("u1")) == b"CGT\0" and length.tolist() == [2, 0, 0, 1]
        assert [bytes(data[a : a + n].astype("u1")) for a, n in zip(first, length)] == [b"CG", b"", b"", b"T"]
    assert [len(x) for x in places.characters(whole.slice(5))] == [1, 0, 0]
