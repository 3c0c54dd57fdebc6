"""Explicit schemas of the records this library works on."""

from __future__ import annotations

TAG = "struct<type:string,i:long,d:double,s:string,ai:array<long>,ad:array<double>>"
#: A sequence alignment; positions are 1-based, `flag` and `mapq` are as stored.
ALIGNMENT = f"qname string, flag int, rname string, pos int, mapq int, cigar string, mrnm string, mpos int, isize int, seq string, qual string, tags map<string,{TAG}>"
CONTIG = "tid int, name string, length int"
RANGE = "range_id long, contig string, start int, end int"
FASTA = "name string, seq string"
FASTA_INDEX = "name string, length int, offset long, line_bases int, line_width int"
GENOTYPE = "struct<sample:string,gt:string,dp:int,gq:int,sp:int,pl:array<int>,gl:array<double>,other:map<string,string>>"
VARIANT = f"chrom string, pos int, id string, ref string, alt string, qual double, filter string, info string, format string, geno array<{GENOTYPE}>"
#: Fixed names of the columns of old pileup text.
PILEUP_TEXT = (
    "space string, position int, referenceBase string, consensusBase string, consensusQuality int, snpQuality int, maxMappingQuality int, coverage int, "
    "alleleOne string, alleleTwo string, alleleOneSupport int, alleleTwoSupport int, additionalIndels int"
)
#: Output fields of a scan, in order.
SCAN_FIELDS = ("qname", "flag", "rname", "strand", "pos", "qwidth", "mapq", "cigar", "mrnm", "mpos", "isize", "seq", "qual")
#: The largest coordinate a range may have.
MAX_COORDINATE = 1 << 29
