"""Pileup rules on small hand-made alignments."""

import pytest
from pyspark.sql import functions as F

from strandflow.operators.pileup import pileup
from strandflow.sources.sam import parse
from strandflow.specs import PileupSpec, ScanSpec


def reads(spark, *rows):
    """rows: contig, pos, cigar, seq[, qual[, flag]]"""
    lines = []
    for contig, pos, cigar, seq, *more in rows:
        qual = more[0] if more else "=" * len(seq)
        lines.append(("\t".join(["B7", str(more[1] if len(more) > 1 else 0), contig, str(pos), "99", cigar, "*", "0", "0", seq, qual]),))
    return parse(spark.createDataFrame(lines, "line string"))


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns, "count").collect())


def test_insertion_follows_the_base_before_it(spark):
    spec = PileupSpec(include_insertions=True, distinguish_strands=False)
    rows = reads(spark, ("ins", 1, "1M3I1M", "ATTTC"))
    assert got(pileup(rows, spec), "pos", "nucleotide") == [(1, "+", 1), (1, "A", 1), (2, "C", 1)]


def test_insertion_after_a_skip(spark):
    spec = PileupSpec(include_insertions=True, distinguish_strands=False)
    rows = reads(spark, ("ins", 1, "1M1N1I1M", "AGC"))
    assert got(pileup(rows, spec), "pos", "nucleotide") == [(1, "A", 1), (2, "+", 1), (3, "C", 1)]


def test_insertion_survives_base_tests(spark):
    spec = PileupSpec(include_insertions=True, distinguish_strands=False, min_base_quality=11)
    rows = reads(spark, ("ins", 1, "1M1I1M", "ATC", "+=+"))
    assert got(pileup(rows, spec), "pos", "nucleotide") == [(1, "+", 1)]


def test_all_letters(spark):
    spec = PileupSpec(ignore_query_ns=False, distinguish_strands=False)
    rows = reads(spark, ("all", 1, "2M1D4M", "ACGTN="))
    assert [r[1] for r in got(pileup(rows, spec), "pos", "nucleotide")] == list("AC-GTN=")


def test_deletions_and_ns_can_be_left_out(spark):
    rows = reads(spark, ("x", 1, "1M1D2M", "ANC"))
    assert got(pileup(rows, PileupSpec(include_deletions=False)), "pos", "nucleotide") == [(1, "A", 1), (4, "C", 1)]


def test_clipping_does_not_shift(spark):
    soft = pileup(reads(spark, ("x", 1, "2S2M1S", "GGACT")), PileupSpec())
    hard = pileup(reads(spark, ("x", 1, "2H2M1H", "AC")), PileupSpec())
    assert got(soft, "pos", "nucleotide") == got(hard, "pos", "nucleotide") == [(1, "A", 1), (2, "C", 1)]


@pytest.mark.parametrize(("least", "positions"), [(0, [1, 2, 3]), (20, [3]), (21, [])])
def test_base_quality(spark, least, positions):
    rows = reads(spark, ("x", 1, "3M", "ACG", "!+5"))
    assert [r[0] for r in got(pileup(rows, PileupSpec(min_base_quality=least)), "pos")] == positions


def test_minor_allele_and_nucleotide_depth(spark):
    rows = reads(spark, *[("x", 1, "1M", b) for b in "AAGT"])
    flat = dict(distinguish_strands=False, distinguish_nucleotides=False)
    assert got(pileup(rows, PileupSpec(min_minor_allele_depth=1, **flat)), "pos") == [(1, 4)]
    assert got(pileup(rows, PileupSpec(min_minor_allele_depth=3, **flat)), "pos") == []
    assert got(pileup(rows, PileupSpec(min_nucleotide_depth=2, **flat)), "pos") == [(1, 2)]


def test_query_bins_mirror_the_minus_strand(spark):
    plus, minus = reads(spark, ("sim", 1, "6M", "ACGT=N")), reads(spark, ("sim", 7, "6M", "ACGT=N", "======", 16))
    spec = PileupSpec(query_bins=(1, 3, 5))
    assert got(pileup(plus, spec), "nucleotide", "query_bin") == [("=", "(3,5]", 1), ("C", "(1,3]", 1), ("G", "(1,3]", 1), ("T", "(3,5]", 1)]
    assert got(pileup(minus, spec), "nucleotide", "query_bin") == [("=", "(1,3]", 1), ("C", "(3,5]", 1), ("G", "(3,5]", 1), ("T", "(1,3]", 1)]


def test_left_bins_from_the_end(spark):
    rows = reads(spark, ("x", 1, "5M", "ACGTA"))
    assert got(pileup(rows, PileupSpec(left_bins=(-4, -1))), "pos", "left_bin") == [(3, "(-4,-1]", 1), (4, "(-4,-1]", 1), (5, "(-4,-1]", 1)]
    assert got(pileup(rows, PileupSpec(left_bins=(0, 3, float("inf")))), "pos", "left_bin")[-1] == (5, "(3,Inf]", 1)


def test_max_depth_and_ranges(spark):
    rows = reads(spark, *[("x", 1, "3M", "ACG")] * 3)
    assert got(pileup(rows, PileupSpec(max_depth=2)), "pos") == [(1, 2), (2, 2), (3, 2)]
    assert got(pileup(rows, PileupSpec(max_depth=250)), "pos") == [(1, 3), (2, 3), (3, 3)]
    ranges = spark.createDataFrame([(1, "x", 2, 2), (2, "x", 2, 2), (3, "y", 1, 9)], "range_id long, contig string, start int, end int")
    assert got(pileup(rows, PileupSpec(), ranges=ranges), "which_label", "pos") == [("x:2-2.1", 2, 3), ("x:2-2.2", 2, 3)]
    assert got(pileup(rows, PileupSpec(max_depth=1), ranges=ranges), "range_id", "pos") == [(1, 2, 1), (2, 2, 1)]
    with pytest.raises(ValueError):
        PileupSpec(max_depth=0)


@pytest.mark.parametrize("bins", [(1,), (-1, 2), (0, -3), (2, 2), (None, 3)])
def test_bad_bins(bins):
    with pytest.raises(ValueError):
        PileupSpec(left_bins=bins)


def test_counts_match_matched_bases(spark):
    rows = reads(spark, *[("x", i, c, "ACGTACGTAC") for i, c in enumerate(["10M", "5M2D5M", "4M3I3M", "2S8M", "5M100N5M"] * 20, 1)])
    total = pileup(rows, PileupSpec(include_deletions=False)).agg(F.sum("count")).first()[0]
    assert total == 20 * (10 + 10 + 7 + 8 + 10)
    assert pileup(rows, PileupSpec(), ScanSpec(mapq=100)).count() == 0
