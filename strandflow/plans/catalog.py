"""The registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow import shared
from strandflow.functions import cigar, flags, sequence
from strandflow.operators import count, intervals, mates, scan, sequences, sorting, tabtext, variants
from strandflow.operators.pileup import depth_arrays, multi_file_depth, pileup, quality_depth
from strandflow.operators.views import Views
from strandflow.plans import testviews as tv
from strandflow.schemas import ALIGNMENT
from strandflow.sources import bcf, bgzf, gztext, sam, text
from strandflow.specs import MultiPileupSpec, PileupSpec, ScanSpec, VariantSpec
from strandflow.streaming import chunks, tile_pileup

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

ALN, RANGES, CONTIGS, PAIRED = (tv.in_oracle(s) for s in (tv.ALIGNMENTS, tv.RANGES, tv.CONTIGS, tv.PAIRED))
SEQ = tv.in_oracle(tv.SEQUENCES, letters="regexp_replace(text, '[^ACGTNacgtn]', '', 'g')")
WITH = f"WITH aln AS ({ALN}), ranges AS ({RANGES}), contigs AS ({CONTIGS})"
_SUM = "coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[{}]', 1), lambda x: CAST(x AS INT))), 0)"
REF_W, QUERY_W = _SUM.format("MDN=X"), _SUM.format("MIS=X")
#: Placed rows with their last position, and rows with the ranges they overlap.
PLACED = f"placed AS (SELECT *, pos + greatest(CASE WHEN cigar IS NULL THEN 1 ELSE {REF_W} END, 1) - 1 AS stop FROM aln WHERE rname IS NOT NULL)"
MET = 'met AS (SELECT placed.*, range_id, "start" AS r_start, "end" AS r_end FROM placed JOIN ranges ON rname = contig AND pos <= "end" AND stop >= "start")'
LABEL = "contig || ':' || CAST(\"start\" AS STRING) || '-' || CAST(\"end\" AS STRING)"


def _register(oracle: str | None = None):
    def add(f):
        name = f.__name__.lstrip("_")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


# --- counts and scans

COUNTED = f"""{WITH}, {PLACED}, {MET},
hits AS (SELECT range_id, count(*) AS records, sum(length(seq)) AS nucleotides FROM met {{where}} GROUP BY range_id)
SELECT range_id, contig AS space, "start", "end", "end" - "start" + 1 AS width, CAST(coalesce(records, 0) AS BIGINT) AS records, CAST(coalesce(nucleotides, 0) AS BIGINT) AS nucleotides
FROM ranges LEFT JOIN hits USING (range_id)"""


@_register(COUNTED.format(where="WHERE flag & 4 = 0 AND flag & 1024 = 0 AND mapq >= 10"))
def count_ranges(spark, d):
    spec = ScanSpec(flag=flags.flag_filter(isUnmappedQuery=False, isDuplicate=False), mapq=10)
    return count.count_ranges(tv.alignments(spark, d), tv.ranges(spark, d), spec)


@_register(f"{WITH} SELECT file, count(*) AS records, CAST(sum(length(seq)) AS BIGINT) AS nucleotides FROM aln GROUP BY file")
def count_whole_file(spark, d):
    return count.count_file(tv.alignments(spark, d), by=("file",))


@_register(f"{WITH} SELECT qname, flag FROM aln WHERE flag & 1 = 1 AND flag & 16 = 16 AND flag & 256 = 0 AND flag & 1024 = 0")
def scan_flag_filter(spark, d):
    keep = flags.flag_filter(isPaired=True, isMinusStrand=True, isSecondaryAlignment=False, isDuplicate=False)
    return scan.scan(tv.alignments(spark, d), ScanSpec(what=("qname", "flag"), flag=keep))


@_register(f"{WITH} SELECT qname, CASE WHEN flag & 4 = 0 THEN mapq END AS mapq FROM aln WHERE mapq >= 30")
def scan_mapq_filter(spark, d):
    return scan.scan(tv.alignments(spark, d), ScanSpec(what=("qname", "mapq"), mapq=30))


@_register(f"""{WITH} SELECT qname, flag, rname, CASE WHEN flag & 4 = 0 THEN CASE WHEN flag & 16 = 0 THEN '+' ELSE '-' END END AS strand, CASE WHEN flag & 4 = 0 AND rname IS NOT NULL THEN pos END AS pos,
CASE WHEN flag & 4 = 0 AND cigar IS NOT NULL THEN CAST({QUERY_W} AS INT) END AS qwidth, CASE WHEN flag & 4 = 0 THEN mapq END AS mapq, CASE WHEN flag & 4 = 0 AND rname IS NOT NULL THEN cigar END AS cigar,
mrnm, CASE WHEN flag & 8 = 0 THEN mpos END AS mpos, CASE WHEN flag & 12 = 0 THEN isize END AS isize, seq, qual, CAST(nm AS STRING) AS "NM", rg AS "RG" FROM aln""")
def scan_projection_null_rules(spark, d):
    return scan.scan(tv.alignments(spark, d), ScanSpec(tags=("NM", "RG")))


@_register(f"""{WITH}, {PLACED}, {MET} SELECT range_id, contig || ':' || CAST(r_start AS STRING) || '-' || CAST(r_end AS STRING) AS which_label, qname, CASE WHEN flag & 4 = 0 THEN pos END AS pos
FROM (SELECT met.*, 'chr' || CAST(range_id % 6 AS STRING) AS contig FROM met)""")
def scan_ranges_labelled(spark, d):
    return scan.scan(tv.alignments(spark, d), ScanSpec(what=("qname", "pos")), tv.ranges(spark, d))


_BITS = ", ".join(f'CAST((flag & {1 << i}) <> 0 AS INT) AS "{n}"' for i, n in enumerate(flags.FLAG_BITNAMES))


@_register(f"{WITH} SELECT qname, flag, {_BITS} FROM aln")
def flag_bit_matrix(spark, d):
    return tv.alignments(spark, d).select("qname", "flag", *flags.bit_matrix(F.col("flag")))


@_register(f"{WITH} SELECT qname, flag & mapq AS both FROM aln")
def flag_and(spark, d):
    return tv.alignments(spark, d).select("qname", flags.flag_and(F.col("flag"), F.col("mapq")).alias("both"))


@_register(f"{WITH} SELECT (flag & 256) <> 0 AS secondary, count(*) AS n FROM aln GROUP BY 1")
def flag_test(spark, d):
    return tv.alignments(spark, d).groupBy(flags.flag_test(F.col("flag"), "isSecondaryAlignment").alias("secondary")).agg(F.count("*").alias("n"))


@_register(f"{WITH} SELECT qname, CAST(nm AS STRING) AS \"NM\", rg AS \"RG\" FROM aln WHERE nm IN (1, 3) AND rg IN ('rg0', 'rg2')")
def tag_filter(spark, d):
    return scan.scan(tv.alignments(spark, d), ScanSpec(what=("qname",), tags=("NM", "RG"), tag_filter={"NM": [1, 3], "RG": ["rg0", "rg2"]}))


@_register(f"{WITH} SELECT qname, flag FROM aln WHERE cigar IS NULL OR cigar = '10M'")
def simple_cigar(spark, d):
    return scan.scan(tv.alignments(spark, d), ScanSpec(what=("qname", "flag"), simple_cigar=True))


@_register(f"{WITH} SELECT qname, cigar, CASE WHEN cigar IS NOT NULL THEN CAST({QUERY_W} AS INT) END AS query_width, CASE WHEN cigar IS NOT NULL THEN CAST({REF_W} AS INT) END AS reference_width FROM aln")
def cigar_widths(spark, d):
    c = F.col("cigar")
    return tv.alignments(spark, d).select("qname", "cigar", cigar.query_width(c).alias("query_width"), cigar.reference_width(c).alias("reference_width"))


@_register(f"""{WITH}, n AS (SELECT coalesce(rname, '*') AS seqnames, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 4 <> 0) AS unmapped FROM aln GROUP BY 1)
SELECT seqnames, seqlength, CAST(coalesce(mapped, 0) AS BIGINT) AS mapped, CAST(coalesce(unmapped, 0) AS BIGINT) AS unmapped
FROM (SELECT name AS seqnames, length AS seqlength FROM contigs UNION ALL SELECT '*', 0) LEFT JOIN n USING (seqnames)""")
def contig_stats(spark, d):
    return count.contig_stats(tv.alignments(spark, d), tv.contigs(spark, d))


@_register(f"{WITH} SELECT bool_or(flag & 1 = 1) AS paired FROM aln")
def paired_any(spark, d):
    return count.any_paired(tv.alignments(spark, d))


_GROUP_ROWS = "UNION ALL ".join(
    f"SELECT qname, flag, '{g}' AS g FROM aln WHERE {t} "
    for g, t in {"A": "true", "S": "flag & 1 = 0", "M": "flag & 1 = 1", "F": "flag & 193 = 65", "L": "flag & 193 = 129", "O": "flag & 1 = 1 AND flag & 192 IN (0, 192)"}.items()
)
_SUMMED = """SELECT k.grp, CAST(coalesce(sum(n), 0) AS BIGINT) AS records, count(n) AS names, round(sum(n) / nullif(count(n), 0), 6) AS mean_per_name, CAST(coalesce(max(n), 0) AS BIGINT) AS most_per_name
FROM k LEFT JOIN (SELECT grp, qname, count(*) AS n FROM rows_ GROUP BY grp, qname) c ON c.grp = k.grp GROUP BY k.grp"""


@_register(f"{WITH}, g AS ({_GROUP_ROWS}), rows_ AS (SELECT g AS grp, qname FROM g), k AS (SELECT unnest(['A', 'S', 'M', 'F', 'L', 'O']) AS grp) {_SUMMED}")
def flag_summary_groups(spark, d):
    return count.flag_summary(tv.alignments(spark, d))


@_register(f"""{WITH}, g AS ({_GROUP_ROWS}), rows_ AS (SELECT g || '1' AS grp, qname FROM g WHERE flag & 4 = 0 UNION ALL SELECT g || '2', qname FROM g WHERE flag & 260 = 0
UNION ALL SELECT g || '3', qname FROM g WHERE flag & 260 = 256 UNION ALL SELECT g || '4', qname FROM g WHERE flag & 4 = 4),
k AS (SELECT g || p AS grp FROM (SELECT unnest(['A', 'S', 'M', 'F', 'L', 'O']) AS g), (SELECT unnest(['1', '2', '3', '4']) AS p)) {_SUMMED}""")
def flag_summary_details(spark, d):
    return count.flag_details(tv.alignments(spark, d))


# --- intervals and destinations


@_register(f"{WITH}, {PLACED}, {MET} SELECT range_id, count(*) AS n, sum(pos) AS pos_sum, min(stop) AS least_stop FROM met GROUP BY range_id")
def interval_join_binned(spark, d):
    rows = tv.alignments(spark, d).where("rname IS NOT NULL").withColumn("stop", cigar.reference_end(F.col("pos"), F.col("cigar")))
    met = intervals.interval_join(rows, tv.ranges(spark, d), "rname", "pos", "stop", bin_width=1024)
    return met.groupBy("range_id").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"), F.min("stop").alias("least_stop"))


NORMAL = """n1 AS (SELECT contig, "start", "end", CASE WHEN "start" > 1 + max("end") OVER (PARTITION BY contig ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM ranges),
n2 AS (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM n1), normal AS (SELECT contig, min("start") AS "start", max("end") AS "end" FROM n2 GROUP BY contig, island)"""


@_register(f"{WITH}, {NORMAL} SELECT * FROM normal")
def normalize_ranges(spark, d):
    return intervals.normalize(tv.ranges(spark, d))


@_register(f"{WITH}, {NORMAL} SELECT * FROM normal")
def normalize_repeated_ranges(spark, d):
    """Every range three times, over more partitions than one: the same islands."""
    ranges = tv.ranges(spark, d)
    return intervals.normalize(ranges.unionByName(ranges).unionByName(ranges).repartition(4))


@_register(f"""{WITH} SELECT dest, count(*) AS n, sum(pos) AS pos_sum FROM (SELECT 'good' AS dest, pos FROM aln WHERE mapq >= 20 AND flag & 1796 = 0 UNION ALL SELECT 'spliced', pos FROM aln WHERE cigar LIKE '%N%'
UNION ALL SELECT 'rest', pos FROM aln WHERE mapq < 5) GROUP BY dest""")
def filter_to_destinations(spark, d):
    rules = {"good": (F.col("mapq") >= 20) & (F.col("flag").bitwiseAND(1796) == 0), "spliced": F.col("cigar").contains("N"), "rest": F.col("mapq") < 5}
    return scan.demultiplex(tv.alignments(spark, d), rules).groupBy("dest").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@_register(f"""{WITH}, {PLACED}, {NORMAL} SELECT qname, flag, pos FROM placed WHERE EXISTS (SELECT 1 FROM normal WHERE contig = rname AND pos <= "end" AND stop >= "start")""")
def filter_by_ranges(spark, d):
    rows = tv.alignments(spark, d).where("rname IS NOT NULL").withColumn("stop", cigar.reference_end(F.col("pos"), F.col("cigar"))).withColumn("row", F.monotonically_increasing_id())
    met = intervals.interval_join(rows.select("row", "qname", "flag", "rname", "pos", "stop"), intervals.normalize(tv.ranges(spark, d)), "rname", "pos", "stop")
    return met.dropDuplicates(["row"]).select("qname", "flag", "pos")


@_register(f"""{WITH}, {PLACED}, {NORMAL} SELECT rname AS contig, qname, flag, pos, flag & 1796 <> 0 AS is_excluded FROM placed
WHERE mapq >= 10 AND rname IN ('chr1', 'chr3') AND EXISTS (SELECT 1 FROM normal WHERE contig = rname AND pos <= "end" AND stop >= "start")""")
def filter_to_folders(spark, d):
    """Passing rows written once, by contig and in order of position; a query of some contigs reads their folders only."""
    place = f"{shared.folder(spark)}/landed-{uuid.uuid4().hex}"
    sorting.filter_to(tv.alignments(spark, d), place, F.col("mapq") >= 10, tv.ranges(spark, d))
    rows = spark.read.parquet(place).where(F.col("contig").isin("chr1", "chr3"))
    return _kept(spark, rows.select("contig", "qname", "flag", "pos", "is_excluded"), place)


@_register(f"{WITH} SELECT name AS contig, CAST(i * 1000000 + 1 AS INT) AS \"start\", CAST(least((i + 1) * 1000000, length) AS INT) AS \"end\" FROM contigs, (SELECT unnest(range(100)) AS i)")
def tiles(spark, d):
    return intervals.tile(tv.contigs(spark, d), 1_000_000)


# --- pileup

#: Events of every read: the blocks of each distinct CIGAR, unfolded.
EVENTS = """
cig AS (SELECT cigar, regexp_extract_all(cigar, '(\\d+)[MIDNSH=X]', 1) AS n, regexp_extract_all(cigar, '\\d+([MIDNSH=X])', 1) AS o FROM (SELECT DISTINCT cigar FROM aln WHERE cigar IS NOT NULL)),
ops AS (SELECT cigar, i, CAST(n[i] AS INT) AS len, o[i] AS op, coalesce(o[i + 1] = 'I', false) AS ins FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM cig)),
blk AS (SELECT *, coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len ELSE 0 END) OVER w, 0) AS r, coalesce(sum(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN len ELSE 0 END) OVER w, 0) AS q
        FROM ops WINDOW w AS (PARTITION BY cigar ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
steps AS (SELECT cigar, op, r + k AS r, CASE WHEN op IN ('M', '=', 'X') THEN q + k ELSE q END AS q, ins AND k = len - 1 AS ins FROM (SELECT *, unnest(range(len)) AS k FROM blk WHERE op IN ('M', 'D', 'N', '=', 'X'))),
ev AS (SELECT aln.file, rname AS seqnames, CAST(pos + r AS INT) AS pos, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand, q, op, ins, length(seq) AS qlen, ascii(substr(qual, CAST(q + 1 AS INT), 1)) - 33 AS bq,
              CASE WHEN op = 'D' THEN '-' ELSE substr(seq, CAST(q + 1 AS INT), 1) END AS letter
       FROM aln JOIN steps USING (cigar) WHERE flag & 1796 = 0 AND pos IS NOT NULL AND mapq >= {mapq})
"""
BASES = "b AS (SELECT seqnames, pos, strand, letter AS nucleotide, q, qlen FROM ev WHERE op <> 'N' AND bq >= {bq} AND letter <> 'N' {more})"


def _pile(select: str, mapq: int = 0, bq: int = 13, more: str = "") -> str:
    return f"{WITH}, {EVENTS.format(mapq=mapq)}, {BASES.format(bq=bq, more=more)} {select}"


@_register(_pile("SELECT seqnames, pos, strand, nucleotide, count(*) AS count FROM b GROUP BY ALL"))
def pileup_all_dims(spark, d):
    return pileup(tv.alignments(spark, d, spread=True))


@_register(_pile("SELECT seqnames, pos, count(*) AS count FROM b GROUP BY ALL", mapq=5))
def pileup_collapsed(spark, d):
    return pileup(tv.alignments(spark, d, spread=True), PileupSpec(min_mapq=5, distinguish_strands=False, distinguish_nucleotides=False))


@_register(_pile("""SELECT seqnames, pos, nucleotide, count(*) AS count FROM (SELECT seqnames, pos, nucleotide FROM b UNION ALL SELECT seqnames, pos, '+' FROM ev WHERE ins) GROUP BY ALL""", bq=20))
def pileup_insertions(spark, d):
    return pileup(tv.alignments(spark, d, spread=True), PileupSpec(include_insertions=True, distinguish_strands=False, min_base_quality=20))


@_register(_pile("""SELECT seqnames, pos, strand, nucleotide, n AS count FROM (SELECT *, sum(n) OVER (PARTITION BY seqnames, pos, nucleotide) AS by_nuc FROM (SELECT seqnames, pos, strand, nucleotide, count(*) AS n FROM b GROUP BY ALL))
JOIN (SELECT seqnames, pos, sum(n) AS total, max(n) AS most FROM (SELECT seqnames, pos, nucleotide, count(*) AS n FROM b GROUP BY ALL) GROUP BY ALL) USING (seqnames, pos) WHERE by_nuc >= 2 AND total - most >= 1"""))
def pileup_depth_filters(spark, d):
    return pileup(tv.alignments(spark, d, spread=True), PileupSpec(min_nucleotide_depth=2, min_minor_allele_depth=1))


@_register(_pile("SELECT seqnames, pos, CASE WHEN q + 1 <= 3 THEN '(0,3]' WHEN q + 1 <= 7 THEN '(3,7]' ELSE '(7,Inf]' END AS left_bin, strand, nucleotide, count(*) AS count FROM b GROUP BY ALL"))
def pileup_left_bins(spark, d):
    return pileup(tv.alignments(spark, d, spread=True), PileupSpec(left_bins=(0, 3, 7, float("inf"))))


@_register(_pile("""SELECT seqnames, pos, CASE WHEN e > -4 THEN '(-4,-1]' ELSE '(-8,-4]' END AS query_bin, strand, nucleotide, count(*) AS count
FROM (SELECT *, CASE WHEN strand = '-' THEN -(q + 1) ELSE -(qlen - q) END AS e FROM b) WHERE e > -8 AND e <= -1 GROUP BY ALL"""))
def pileup_query_bins(spark, d):
    return pileup(tv.alignments(spark, d, spread=True), PileupSpec(query_bins=(-8, -4, -1)))


@_register(f"""{WITH}, {EVENTS.format(mapq=0)}, {BASES.format(bq=13, more="")} SELECT range_id, {LABEL} AS which_label, seqnames, pos, nucleotide, count(*) AS count
FROM b JOIN ranges ON seqnames = contig AND pos >= "start" AND pos <= "end" GROUP BY ALL""")
def pileup_ranges(spark, d):
    return pileup(tv.alignments(spark, d, spread=True), PileupSpec(distinguish_strands=False), ranges=tv.ranges(spark, d))


#: Records of a unit of the stream, and a batch's units for each core.
UNIT_RECORDS, UNITS_PER_CORE = 100_000, 4


@_register(_pile("SELECT seqnames, pos, strand, nucleotide, count(*) AS count FROM b GROUP BY ALL"))
def pileup_streamed(spark, d):
    """Sorted files taken in by a stream of chunks, positions released behind its frontier, and the result read back."""
    chunks.register(spark)
    top = f"{shared.folder(spark)}/stream-{uuid.uuid4().hex}"
    _written(spark, d, tv.alignments(spark, d, spread=True), f"{top}/bam", indexed=False)
    units = chunks.save_units(chunks.record_units(spark, f"{top}/bam", UNIT_RECORDS), f"{top}/units.json")
    # a batch has a fixed time for each of its state stores: stores follow the cores, and a batch has some units for each core
    cores = spark.sparkContext.defaultParallelism
    with shared.settings(spark, dict([tile_pileup.PROVIDER, ("spark.sql.shuffle.partitions", str(cores))])):
        stream = spark.readStream.format("bam_chunks").schema(tile_pileup.READS).option("end", "true").option("unitsPerBatch", str(UNITS_PER_CORE * cores)).load(units)
        counted = tile_pileup.tile_pileup(stream, tv.contigs(spark, d), PileupSpec(max_depth=None))
        chunks.finish(counted.writeStream.format("parquet").option("checkpointLocation", f"{top}/checkpoint").outputMode("append").start(f"{top}/out"))
        return _kept(spark, spark.read.schema(tile_pileup.OUT).parquet(f"{top}/out"), top)


#: The same, of the first reads at each position only.
CAPPED = EVENTS.replace("ev AS (SELECT aln.file,", "every AS (SELECT aln.pos AS read_start, qname, flag, cigar, seq, qual, aln.file,") + """,
ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by}seqnames, pos ORDER BY read_start, qname, flag, cigar, seq, qual) AS nth FROM every) WHERE nth <= {cap})
"""


@_register(f"{WITH}, {CAPPED.format(mapq=0, by='', cap=3)}, {BASES.format(bq=13, more='')} SELECT seqnames, pos, strand, nucleotide, count(*) AS count FROM b GROUP BY ALL")
def pileup_max_depth(spark, d):
    return pileup(tv.alignments(spark, d, spread=True), PileupSpec(max_depth=3))


@_register(f"""{WITH}, {CAPPED.format(mapq=0, by='', cap=2)}, {BASES.format(bq=13, more="")} SELECT range_id, {LABEL} AS which_label, seqnames, pos, strand, nucleotide, count(*) AS count
FROM b JOIN ranges ON seqnames = contig AND pos >= "start" AND pos <= "end" GROUP BY ALL""")
def pileup_max_depth_ranges(spark, d):
    return pileup(tv.alignments(spark, d, spread=True), PileupSpec(max_depth=2), ranges=tv.ranges(spark, d))


@_register(f"""{WITH}, {PLACED}, steps AS (SELECT rname, p, sum(d) AS d FROM (SELECT rname, pos AS p, 1 AS d FROM placed UNION ALL SELECT rname, stop + 1, -1 FROM placed) GROUP BY ALL),
runs AS (SELECT rname AS contig, p AS "start", lead(p) OVER w - 1 AS "end", sum(d) OVER w AS depth FROM steps WINDOW w AS (PARTITION BY rname ORDER BY p))
SELECT contig, CAST("start" AS INT) AS "start", CAST("end" AS INT) AS "end", CAST(depth AS BIGINT) AS depth FROM runs WHERE depth > 0""")
def coverage(spark, d):
    rows = tv.alignments(spark, d, spread=True).where("rname IS NOT NULL").select(F.col("rname").alias("contig"), F.col("pos").alias("start"), cigar.reference_end(F.col("pos"), F.col("cigar")).alias("end"))
    return intervals.coverage(rows)


_DEPTH = ", ".join(f"count(*) FILTER (letter = '{b}') AS \"{b}\"" for b in "ACGT") + ", count(*) FILTER (letter NOT IN ('A', 'C', 'G', 'T')) AS \"N\""
_MULTI = f"""{WITH}, {EVENTS.format(mapq=0)}, depth AS (SELECT range_id, file, seqnames, pos, {_DEPTH} FROM ev JOIN ranges ON seqnames = contig AND pos >= "start" AND pos <= "end" WHERE op NOT IN ('N', 'D') AND bq >= 13 GROUP BY ALL)"""


@_register(f"{_MULTI} SELECT * FROM depth")
def multi_file_depth_per_base(spark, d):
    return multi_file_depth(tv.alignments(spark, d, spread=True), tv.ranges(spark, d))


_ZERO = ", ".join(f'CAST(coalesce("{b}", 0) AS BIGINT) AS "{b}"' for b in "ACGTN")


@_register(f"""{_MULTI}, cells AS (SELECT range_id, contig AS seqnames, CAST(unnest(range("start", "end" + 1)) AS INT) AS pos FROM ranges) SELECT range_id, file, seqnames, pos, {_ZERO}
FROM cells CROSS JOIN (SELECT DISTINCT file FROM aln) LEFT JOIN depth USING (range_id, file, seqnames, pos)""")
def multi_file_depth_zero_filled(spark, d):
    return multi_file_depth(tv.alignments(spark, d, spread=True), tv.ranges(spark, d), MultiPileupSpec(yield_all=True))


@_register(f"""{WITH}, {EVENTS.format(mapq=0)} SELECT range_id, file, seqnames, pos, bq AS quality, count(*) AS count FROM ev JOIN ranges ON seqnames = contig AND pos >= "start" AND pos <= "end"
WHERE op NOT IN ('N', 'D') AND bq >= 13 GROUP BY ALL""")
def multi_file_quality(spark, d):
    return quality_depth(tv.alignments(spark, d, spread=True), tv.ranges(spark, d))


@_register(f"""{WITH}, {CAPPED.format(mapq=0, by='file, ', cap=1)}, depth AS (SELECT range_id, file, seqnames, pos, {_DEPTH} FROM ev JOIN ranges ON seqnames = contig AND pos >= "start" AND pos <= "end"
WHERE op NOT IN ('N', 'D') AND bq >= 13 GROUP BY ALL) SELECT * FROM depth""")
def multi_file_max_depth(spark, d):
    return multi_file_depth(tv.alignments(spark, d, spread=True), tv.ranges(spark, d), MultiPileupSpec(max_depth=1))


_CELLS = f"""{WITH}, {EVENTS.format(mapq=0)}, e AS (SELECT range_id, file, seqnames, pos, CASE letter WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END AS letter, bq
FROM ev JOIN ranges ON seqnames = contig AND pos >= "start" AND pos <= "end" WHERE op NOT IN ('N', 'D') AND bq >= 13 AND range_id % 3 = 0),
spots AS (SELECT *, row_number() OVER (ORDER BY range_id, seqnames, pos) - 1 AS place FROM (SELECT DISTINCT range_id, seqnames, pos FROM e)),
cell AS (SELECT range_id, seqnames, pos, place, file, code FROM spots, (SELECT unnest(['f0', 'f1', 'f2']) AS file), (SELECT unnest(range(5)) AS code)),
n AS (SELECT range_id, seqnames, pos, file, letter AS code, count(*) AS n FROM e GROUP BY ALL), q AS (SELECT range_id, seqnames, pos, file, bq, count(*) AS n FROM e GROUP BY ALL)"""


@_register(f"""{_CELLS}, s AS (SELECT place // 500 AS chunk, count(*) // 15 AS positions, md5(string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY place, file, code)) AS seq_md5 FROM cell LEFT JOIN n USING (range_id, seqnames, pos, file, code) GROUP BY 1),
p AS (SELECT place // 500 AS chunk, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY place) AS pos FROM spots GROUP BY 1),
w AS (SELECT place // 500 AS chunk, CAST(sum(n * ((place % 500) * 282 + CAST(substr(file, 2) AS INT) * 94 + bq)) AS BIGINT) AS qual_sum FROM q JOIN spots USING (range_id, seqnames, pos) GROUP BY 1)
SELECT chunk, positions, pos, seq_md5, qual_sum FROM s JOIN p USING (chunk) JOIN w USING (chunk)""")
def multi_file_depth_arrays(spark, d):
    """Letters and qualities of 500 positions a row as dense arrays; the query sums each quality's place in its array."""
    rows = depth_arrays(tv.alignments(spark, d, spread=True), tv.ranges(spark, d).where("range_id % 3 = 0"), ["f0", "f1", "f2"], n=500)
    zero = F.lit(0).cast("long")
    total = F.aggregate(F.transform("qual", lambda x, i: x * i), zero, lambda a, x: a + x)
    return rows.select("chunk", F.size("pos").cast("long").alias("positions"), F.array_join("pos", ",").alias("pos"), F.md5(F.array_join("seq", ",")).alias("seq_md5"), total.alias("qual_sum"))


@_register(_pile("SELECT *, (dense_rank() OVER (ORDER BY seqnames, pos) - 1) // 500 AS chunk FROM (SELECT seqnames, pos, count(*) AS count FROM b GROUP BY ALL)"))
def pileup_chunks(spark, d):
    flat = PileupSpec(distinguish_strands=False, distinguish_nucleotides=False)
    return scan.each_position(pileup(tv.alignments(spark, d, spread=True), flat), 500)


# --- mates

_BIT = "({x} & {m} <> 0)"
_STRICT = """x.flag & 13 = 1 AND y.flag & 13 = 1 AND (x.flag & 64 <> 0) <> (x.flag & 128 <> 0) AND (y.flag & 64 <> 0) <> (y.flag & 128 <> 0) AND (x.flag & 64 <> 0) <> (y.flag & 64 <> 0)
AND x.flag & 258 = y.flag & 258 AND x.mpos = y.pos AND y.mpos = x.pos AND x.mrnm = y.rname AND y.mrnm = x.rname AND (x.flag & 32 <> 0) = (y.flag & 16 <> 0) AND (y.flag & 32 <> 0) = (x.flag & 16 <> 0)"""
_LOOSE = """x.flag & 13 = 1 AND y.flag & 13 = 1 AND (x.flag & 64 <> 0) <> (x.flag & 128 <> 0) AND (y.flag & 64 <> 0) <> (y.flag & 128 <> 0) AND (x.flag & 64 <> 0) <> (y.flag & 64 <> 0)
AND x.flag & 258 = y.flag & 258 AND x.mpos = y.pos AND y.mpos = x.pos AND (x.mrnm = y.rname OR y.mrnm = x.rname) AND ((x.flag & 32 <> 0) = (y.flag & 16 <> 0)) = ((y.flag & 32 <> 0) = (x.flag & 16 <> 0))"""
_PAIRS = """pairs AS (SELECT x."key" AS k, y."key" AS m FROM p x JOIN p y ON x.qname = y.qname AND x."key" <> y."key" WHERE {rule}),
deg AS (SELECT k, count(*) AS n, min(m) AS m FROM pairs GROUP BY k), j AS (SELECT deg.*, o.n AS mn FROM deg LEFT JOIN deg o ON o.k = deg.m)"""
_MATES = f"WITH p AS ({PAIRED}), " + _PAIRS.format(rule=_STRICT)
_STATUS = """s AS (SELECT p."key", qname, CASE WHEN n = 1 AND mn = 1 THEN 'mated' WHEN n IS NOT NULL THEN 'ambiguous' ELSE 'unmated' END AS mate_status, CASE WHEN n = 1 AND mn = 1 THEN m END AS mate FROM p LEFT JOIN j ON j.k = p."key"),
t AS (SELECT "key", mate_status, mate, CASE WHEN mate_status = 'mated' THEN least("key", mate) ELSE min("key") OVER (PARTITION BY qname, mate_status) END AS groupid FROM s)"""


@_register(f"WITH p AS ({PAIRED}), {_PAIRS.format(rule=_LOOSE)}, {_STATUS} SELECT * FROM t")
def mates_status(spark, d):
    return mates.mate_status(tv.paired(spark, d)).select("key", "mate_status", "mate", "groupid")


@_register(f"""WITH ranges AS ({RANGES}), every AS ({PAIRED}), p AS (SELECT * FROM every WHERE qname IN (SELECT qname FROM every JOIN ranges ON rname = contig AND pos >= "start" AND pos <= "end")),
{_PAIRS.format(rule=_LOOSE)}, {_STATUS} SELECT * FROM t""")
def mates_ranged(spark, d):
    rows = tv.paired(spark, d)
    here = intervals.interval_join(rows.select("qname", "rname", "pos"), tv.ranges(spark, d), "rname", "pos", "pos")
    return mates.ranged_mates(rows, here).select("key", "mate_status", "mate", "groupid")


_RG = "CASE WHEN CAST(floor(\"key\" / 4) AS BIGINT) % 17 = 0 AND \"key\" % 4 = 1 THEN 'b' ELSE 'a' END"


@_register(f"""WITH ranges AS ({RANGES}), every AS (SELECT *, {_RG} AS rg FROM ({PAIRED})), here AS (SELECT * FROM every WHERE EXISTS (SELECT 1 FROM ranges WHERE range_id % 4 = 1 AND rname = contig AND pos >= "start" AND pos <= "end")),
p AS (SELECT * FROM here UNION SELECT y.* FROM every y JOIN here x ON x.qname = y.qname AND x.mrnm = y.rname AND x.mpos = y.pos WHERE x.flag & 13 = 1 AND (x.flag & 64 <> 0) <> (x.flag & 128 <> 0)),
{_PAIRS.format(rule="(" + _LOOSE + ") AND x.rg = y.rg")}, {_STATUS}, kept AS (SELECT t.*, flag FROM t JOIN p USING ("key") WHERE mate_status <> 'unmated' OR "key" IN (SELECT "key" FROM here))
SELECT "key", mate_status, mate, groupid, row_number() OVER (ORDER BY CASE mate_status WHEN 'mated' THEN 0 WHEN 'ambiguous' THEN 1 ELSE 2 END, groupid, flag & 64 DESC, "key") - 1 AS place FROM kept""")
def mates_by_bins(spark, d):
    """Records in ranges and their mates outside, which are looked for in the bins of their places only."""
    rows = tv.paired(spark, d).withColumn("rg", F.expr(_RG.replace('"', "`")))
    here = intervals.interval_join(rows, tv.ranges(spark, d).where("range_id % 4 = 1"), "rname", "pos", "pos").select(*rows.columns)
    return mates.mates_by_bins(here, mates.in_bins(rows)).select("key", "mate_status", "mate", "groupid", "place")


@_register(f"""WITH p AS ({PAIRED}), {_PAIRS.format(rule=_LOOSE)}, {_STATUS} SELECT "key", mate, groupid FROM t WHERE groupid IN (SELECT DISTINCT groupid FROM t WHERE mate_status = 'mated' ORDER BY groupid LIMIT 50) AND mate_status = 'mated'""")
def first_n_pairs(spark, d):
    return scan.first_n_pairs(mates.mate_status(tv.paired(spark, d)), 50).select("key", "mate", "groupid")


@_register(f"""{_MATES} SELECT p."key", CASE WHEN n > 1 THEN 0 WHEN mn > 1 THEN -m ELSE m END AS hit FROM p LEFT JOIN j ON j.k = p."key" """)
def mates_within_groups(spark, d):
    return mates.mates_within_groups(tv.paired(spark, d)).select("key", "hit")


@_register(f"""WITH p AS ({PAIRED}) SELECT x."key" AS x_key, y."key" AS y_key, coalesce({_STRICT}, false) AS valid FROM p x JOIN p y ON x.qname = y.qname AND x."key" < y."key" """)
def mate_valid_hit(spark, d):
    p = tv.paired(spark, d)
    x, y = (p.select(*[F.col(c).alias(s + c) for c in p.columns]) for s in ("x_", "y_"))
    return x.join(y, (F.col("x_qname") == F.col("y_qname")) & (F.col("x_key") < F.col("y_key"))).select("x_key", "y_key", mates.valid_hit().alias("valid"))


@_register(f"""WITH p AS ({PAIRED}) SELECT "key", qname AS trimmed FROM p""")
def qname_trim(spark, d):
    return tv.paired(spark, d).select("key", sequence.trim_name(F.col("full_name"), ".", "/").alias("trimmed"))


# --- order, limits, merging, views


_REST = "qname, flag, mapq, cigar NULLS FIRST, seq, qual"
_ORDERS = {"coordinate": "rname NULLS LAST, pos NULLS LAST, flag & 16, " + _REST, "name": "qname, flag & 192, rname NULLS LAST, pos NULLS LAST, flag & 16, " + _REST}
_ORDERS |= {"tag": f"rg, {_ORDERS['coordinate']}", "tag_name": f"rg, {_ORDERS['name']}"}
_SORTED = f"{WITH} SELECT file, rname, pos, qname, flag, mapq, cigar, seq, qual, row_number() OVER (PARTITION BY file ORDER BY {{order}}) AS place FROM aln"


def _placed(spark, d, **order) -> DataFrame:
    return sorting.place(tv.alignments(spark, d), "place", "file", **order).select("file", "rname", "pos", "qname", "flag", "mapq", "cigar", "seq", "qual", "place")


@_register(_SORTED.format(order=_ORDERS["coordinate"]))
def sort_coordinate(spark, d):
    return _placed(spark, d)


@_register(_SORTED.format(order=_ORDERS["name"]))
def sort_by_name(spark, d):
    return _placed(spark, d, by="name")


@_register(_SORTED.format(order=_ORDERS["tag"]))
def sort_by_tag(spark, d):
    return _placed(spark, d, by="tag", tag="RG")


@_register(_SORTED.format(order=_ORDERS["tag_name"]))
def sort_by_tag_then_name(spark, d):
    return _placed(spark, d, by="tag", tag="RG", then_name=True)


#: A header whose order of contigs is not that of their names: chr10 comes after chr9, and chr4 before all.
_HEADER = """SELECT CAST((i + 6) % 11 AS INT) AS tid, 'chr' || CAST(i AS STRING) AS name, 1000000 AS length FROM (SELECT DISTINCT CAST(l_suppkey % 11 AS INT) AS i FROM {lineitem})"""
_ELEVEN = "CASE WHEN rname IS NOT NULL THEN 'chr' || CAST(length(qname) * 7 % 3 * 5 + pos % 6 AS STRING) END"


@_register(f"""{WITH}, h AS ({tv.in_oracle(_HEADER)}), a AS (SELECT * REPLACE ({_ELEVEN} AS rname) FROM aln)
SELECT file, rname, pos, qname, flag, mapq, cigar, seq, qual, row_number() OVER (PARTITION BY file ORDER BY tid NULLS LAST, {_ORDERS["coordinate"]}) AS place FROM a LEFT JOIN h ON name = rname""")
def sort_header_order(spark, d):
    rows = tv.alignments(spark, d).withColumn("rname", F.expr(_ELEVEN))
    return sorting.place(rows, "place", "file", contigs=tv.view(spark, d, _HEADER)).select("file", "rname", "pos", "qname", "flag", "mapq", "cigar", "seq", "qual", "place")


@_register(f"{WITH} SELECT qname, flag, pos, (row_number() OVER (ORDER BY qname, flag, pos NULLS FIRST) - 1) // 1000 AS chunk FROM aln")
def yield_chunks(spark, d):
    return scan.in_chunks(tv.alignments(spark, d).select("qname", "flag", "pos"), 1000, "qname", "flag", "pos")


@_register(f"{WITH} SELECT qname, flag, pos FROM aln ORDER BY qname, flag, pos NULLS FIRST LIMIT 1000")
def yield_first(spark, d):
    return scan.first_n(tv.alignments(spark, d).select("qname", "flag", "pos"), 1000, "qname", "flag", "pos")


@_register(f"{WITH} SELECT file AS \"RG\", count(*) AS n, sum(pos) AS pos_sum FROM aln GROUP BY file")
def merge_with_read_group(spark, d):
    rows = tv.alignments(spark, d)
    files = {f: rows.where(F.col("file") == f).drop("file") for f in ("f0", "f1", "f2")}
    merged = sorting.merge(files, add_read_group=True)
    return merged.groupBy(F.col("tags")["RG"]["s"].alias("RG")).agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@_register(f"{WITH} SELECT qname, flag, seq FROM aln WHERE qname IN (SELECT DISTINCT qname FROM aln ORDER BY qname LIMIT 100)")
def first_n_qnames(spark, d):
    return scan.first_n_names(tv.alignments(spark, d), 100).select("qname", "flag", "seq")


@_register(f"""{WITH}, {PLACED}, {MET}, hits AS (SELECT range_id, count(*) AS records FROM met GROUP BY range_id), c AS (SELECT range_id, CAST(coalesce(records, 0) AS BIGINT) AS records FROM ranges LEFT JOIN hits USING (range_id))
SELECT range_id, records FROM (SELECT *, coalesce(sum(records) OVER (ORDER BY range_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) WHERE before < 1000""")
def ranges_until_yield(spark, d):
    return scan.whole_ranges_until(count.count_ranges(tv.alignments(spark, d), tv.ranges(spark, d)).select("range_id", "records"), 1000)


@_register(f"""{WITH}, {PLACED}, {MET}, hits AS (SELECT range_id, 's_' || file AS sample, count(*) AS records, sum(length(seq)) AS nucleotides FROM met GROUP BY ALL)
SELECT range_id, sample, CAST(coalesce(records, 0) AS BIGINT) AS records, CAST(coalesce(nucleotides, 0) AS BIGINT) AS nucleotides FROM ranges CROSS JOIN (SELECT DISTINCT 's_' || file AS sample FROM aln) LEFT JOIN hits USING (range_id, sample)""")
def views_rect_counts(spark, d):
    rows = tv.alignments(spark, d)
    samples = rows.select("file").distinct().withColumn("sample", F.concat(F.lit("s_"), "file"))
    return Views(rows, tv.ranges(spark, d), samples).count()


# --- callers' functions, which Spark runs in its tasks


@_register(f"{WITH} SELECT qname, flag, mapq, pos FROM aln WHERE mapq >= 20 AND pos % 2 = 0")
def filter_rules(spark, d):
    """Callers' rules on pandas frames, all of which a row must pass."""
    rows = tv.alignments(spark, d).select("qname", "flag", "mapq", "pos")
    return scan.where_frame(rows, lambda f: f["mapq"] >= 20, lambda f: f["pos"] % 2 == 0, lambda f: True)


def _span(frame):
    """A caller's function of some of a range's rows: how many, from where to where."""
    return frame[["range_id"]].head(1).assign(n=len(frame), least=frame["pos"].min(), most=frame["pos"].max())


@_register(f"{WITH}, {PLACED}, {MET} SELECT range_id, count(*) AS n, min(pos) AS least, max(pos) AS most FROM met GROUP BY range_id")
def callback_by_range(spark, d):
    """A caller's function of each range's hits, at most 64 at a time; its results are brought together by what they mean."""
    hits = scan.overlap(tv.alignments(spark, d), tv.ranges(spark, d)).select("range_id", "qname", "flag", "pos")
    parts = scan.apply_groups(hits, "range_id", _span, "range_id long, n long, least int, most int", n=64)
    return parts.groupBy("range_id").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def _letters(frame):
    """A caller's function of some of a sample's records: how many letters they have."""
    return frame[["sample"]].head(1).assign(n=len(frame), letters=int(frame["seq"].str.len().sum()))


@_register(f"{WITH}, {PLACED}, {MET} SELECT 's_' || file AS sample, count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS letters FROM met WHERE mapq >= 10 GROUP BY 1")
def callback_by_view(spark, d):
    """A caller's function of each sample's records in the ranges of a rectangle of views."""
    rows = tv.alignments(spark, d)
    samples = rows.select("file").distinct().withColumn("sample", F.concat(F.lit("s_"), "file"))
    parts = Views(rows, tv.ranges(spark, d), samples).apply(_letters, "sample string, n long, letters long", ScanSpec(what=("qname", "seq"), mapq=10), n=1000)
    return parts.groupBy("sample").agg(F.sum("n").alias("n"), F.sum("letters").alias("letters"))


@_register(f"""{WITH}, c AS (SELECT flag, mapq, (row_number() OVER (ORDER BY qname, flag, pos NULLS FIRST, mapq) - 1) // 1000 AS chunk FROM aln) SELECT count(*) AS n, CAST(sum(flag) AS BIGINT) AS flags, CAST(max(mapq) AS BIGINT) AS best FROM c GROUP BY chunk""")
def callback_by_chunk(spark, d):
    """A caller's function of each next 1,000 rows in order."""
    import pandas as pd

    rows = tv.alignments(spark, d).select("qname", "flag", "pos", "mapq")
    fun = lambda f: pd.DataFrame({"n": [len(f)], "flags": [int(f["flag"].sum())], "best": [int(f["mapq"].max())]})
    return scan.apply_chunks(rows, 1000, fun, "n long, flags long, best long", "qname", "flag", "pos", "mapq")


@_register(f"""{WITH} SELECT qname, flag, pos FROM aln
ORDER BY md5(concat_ws(chr(9), '7', coalesce(qname, '\\N'), CAST(flag AS VARCHAR), coalesce(CAST(pos AS VARCHAR), '\\N'))), qname, flag, pos NULLS FIRST LIMIT 500""")
def sample_n(spark, d):
    return scan.sample_n(tv.alignments(spark, d).select("qname", "flag", "pos"), 500, seed=7)


# --- headers and files

_RECORD = "qname, flag, rname, pos, mapq, cigar, mrnm, mpos, isize, seq, qual, CAST(nm AS BIGINT) AS \"NM\", rg AS \"RG\""


def _record(rows: DataFrame) -> DataFrame:
    return rows.select("qname", "flag", "rname", "pos", "mapq", "cigar", "mrnm", "mpos", "isize", "seq", "qual", F.col("tags")["NM"]["i"].alias("NM"), F.col("tags")["RG"]["s"].alias("RG"))


@_register(f"{WITH} SELECT {_RECORD} FROM aln")
def sam_text_round_trip(spark, d):
    return _record(sam.parse(sam.to_lines(tv.alignments(spark, d, spread=True))))


@_register(f"{WITH} SELECT {_RECORD} FROM aln")
def bam_round_trip(spark, d):
    """Written as binary files into a folder of the shared one, and read back from there."""
    bgzf.register(spark)
    folder = f"{shared.folder(spark)}/bam-{uuid.uuid4().hex}"
    contigs = ",".join(f"{r['name']}:{r['length']}" for r in tv.contigs(spark, d).orderBy("tid").collect())  # a header's contigs
    bgzf.write(tv.alignments(spark, d, spread=True).select(*[c.split(" ")[0] for c in ALIGNMENT.split(", ")]), folder, contigs)
    return _kept(spark, _record(spark.read.format("bam").load(folder)), folder)


def _kept(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """The rows, kept apart from the files of `folder`, which go, also if reading them fails."""
    try:
        return shared.cut(rows)
    finally:
        shared.remove(spark, folder)


def _written(spark, d, rows: DataFrame, folder: str, indexed: bool = True) -> None:
    """Rows as sorted BAM files in a folder, with indexes where they are needed."""
    bgzf.register(spark)
    contigs = tv.contigs(spark, d)
    header = ",".join(f"{r['name']}:{r['length']}" for r in contigs.orderBy("tid").collect())  # a header's contigs
    columns = [c.split(" ")[0] for c in ALIGNMENT.split(", ")]
    bgzf.write(sorting.sort(rows.select(*columns), contigs=contigs), folder, header)
    if indexed:
        bgzf.index_files(spark, folder).count()


@_register(f"""{WITH}, {PLACED}, {MET} SELECT range_id, contig || ':' || CAST(r_start AS STRING) || '-' || CAST(r_end AS STRING) AS which_label, qname, flag, pos, cigar, seq
FROM (SELECT met.*, 'chr' || CAST(range_id % 6 AS STRING) AS contig FROM met) WHERE range_id % 10 = 3""")
def bam_index_ranges(spark, d):
    """Range queries of sorted, indexed files: tasks read the chunks that the indexes name, and nothing else."""
    folder = f"{shared.folder(spark)}/bam-{uuid.uuid4().hex}"
    _written(spark, d, tv.alignments(spark, d), folder)
    ranges = tv.ranges(spark, d).where("range_id % 10 = 3")
    found = scan.overlap(bgzf.read_ranges(spark, folder, ranges, split=1 << 16), ranges)
    return _kept(spark, found.select("range_id", F.col("range_label").alias("which_label"), "qname", "flag", "pos", "cigar", "seq"), folder)


@_register(f"""{WITH}, c AS (SELECT name, row_number() OVER (ORDER BY tid) AS tid FROM contigs), a AS (SELECT coalesce(tid, 99) AS tid, rname, pos, (flag & 16) <> 0 AS minus, length(qname) AS n FROM aln LEFT JOIN c ON name = rname)
SELECT rname, pos, CASE WHEN rname IS NOT NULL THEN minus END AS minus, row_number() OVER (ORDER BY tid, pos, minus) - 1 AS place FROM a""")
def bam_merge_files(spark, d):
    """Three sorted, indexed files as one, in order, by a heap merge of their stretches."""
    top = f"{shared.folder(spark)}/bam-{uuid.uuid4().hex}"
    rows = tv.alignments(spark, d)
    for f in ("f0", "f1", "f2"):
        _written(spark, d, rows.where(F.col("file") == f), f"{top}/{f}")
    merged = spark.read.format("bam_merge").option("splitBytes", str(1 << 16)).load(",".join(f"{top}/{f}" for f in ("f0", "f1", "f2")))
    minus = F.when(F.col("rname").isNotNull(), F.col("flag").bitwiseAND(16) != 0)
    return _kept(spark, shared.as_they_stand(merged.select("rname", "pos", minus.alias("minus")), "place"), top)


_SQ = "SELECT '@SQ' || chr(9) || 'SN:' || name || chr(9) || 'LN:' || CAST(length AS STRING) AS line FROM ({contigs}) UNION ALL SELECT '@HD' || chr(9) || 'VN:1.6'"


def _header_lines(spark, d):
    return tv.view(spark, d, _SQ.replace("{contigs}", tv.CONTIGS))


@_register(f"{WITH} SELECT name, length FROM contigs")
def sam_header_contigs(spark, d):
    return sam.contigs(_header_lines(spark, d))


@_register(f"{WITH} SELECT 'SQ' AS tag, 'SN:' || name || ',LN:' || CAST(length AS VARCHAR) AS fields FROM contigs UNION ALL SELECT 'HD', 'VN:1.6'")
def sam_header(spark, d):
    return sam.header(_header_lines(spark, d)).select("tag", F.array_join("fields", ",").alias("fields"))


@_register(f"{WITH} SELECT DISTINCT contig FROM ranges WHERE contig NOT IN (SELECT name FROM contigs)")
def unknown_range_contigs(spark, d):
    return intervals.unknown_contigs(tv.ranges(spark, d), tv.contigs(spark, d))


@_register(f"""{WITH}, {PLACED}, {MET} SELECT range_id, qname FROM met WHERE range_id % 6 < 5""")
def scan_known_contigs(spark, d):
    ranges = tv.ranges(spark, d).where("range_id % 6 < 5")
    return scan.scan(tv.alignments(spark, d), ScanSpec(what=("qname",)), ranges, tv.contigs(spark, d)).select("range_id", "qname")


@_register(f"""{WITH}, names AS (SELECT DISTINCT coalesce(rname, '*') AS seqnames FROM aln)
SELECT seqnames, row_number() OVER (ORDER BY seqnames <> '*', regexp_replace(seqnames, '\\d+$', ''), coalesce(TRY_CAST(regexp_extract(seqnames, '(\\d+)$', 1) AS BIGINT), -1), seqnames) - 1 AS place FROM names""")
def natural_contig_order(spark, d):
    names = tv.alignments(spark, d).select(F.coalesce("rname", F.lit("*")).alias("seqnames")).distinct()
    return shared.numbered(names, "place", *count.natural_order())


@_register(f"{WITH} SELECT qname, pos, CAST((pos - 1) % 1000 + 1 AS INT) AS turned FROM aln")
def circular_positions(spark, d):
    return tv.alignments(spark, d).select("qname", "pos", sequence.circular(F.col("pos"), F.lit(1000)).alias("turned"))


@_register(f"{WITH} SELECT qname, flag, CASE WHEN flag & 16 <> 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq, CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS qual FROM aln")
def scan_reverse_complement(spark, d):
    return scan.scan(tv.alignments(spark, d), ScanSpec(what=("qname", "flag", "seq", "qual"), reverse_complement=True))


# --- sequences, text, variants


@_register(f"WITH s AS ({SEQ}) SELECT name, CAST(length(seq) AS INT) AS length FROM s")
def fasta_index(spark, d):
    return sequences.fasta_index(tv.sequences(spark, d))


@_register(f"WITH s AS ({SEQ}) SELECT count(*) AS n FROM s")
def fasta_count(spark, d):
    return sequences.count_sequences(sequences.fasta_index(tv.sequences(spark, d)))


@_register(f"WITH s AS ({SEQ}) SELECT name, CAST(length(seq) AS INT) AS length FROM s")
def fasta_merged_index(spark, d):
    index = sequences.fasta_index(tv.sequences(spark, d))
    return sequences.merge_indexes([index, index.where("length % 2 = 0"), index.where("length > 50")])


#: Tiles over all of each sequence, every other one on the minus strand.
_TILE = 70
_REGION = f"""WITH s AS ({SEQ}), r AS (SELECT name AS contig, seq AS whole, unnest(range(1, length(seq) + 1, {_TILE})) AS "start" FROM s),
t AS (SELECT contig, CAST("start" AS INT) AS "start", CAST(least("start" + {_TILE - 1}, length(whole)) AS INT) AS "end", CASE WHEN "start" // {_TILE} % 2 = 0 THEN '+' ELSE '-' END AS strand, substr(whole, "start", {_TILE}) AS seq FROM r)"""


def _tiles(rows: DataFrame) -> DataFrame:
    tiles = intervals.tile(sequences.fasta_index(rows), _TILE)
    return tiles.withColumn("strand", F.when(F.floor(F.col("start") / _TILE) % 2 == 0, "+").otherwise("-"))


@_register(f"{_REGION} SELECT * FROM t")
def fasta_regions(spark, d):
    rows = tv.sequences(spark, d)
    return sequences.regions(rows, _tiles(rows), width=256)


@_register(f"{_REGION} SELECT * EXCLUDE (seq), CASE WHEN strand = '-' THEN reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) ELSE seq END AS seq FROM t")
def fasta_getseq_revcomp(spark, d):
    rows = tv.sequences(spark, d)
    return sequences.regions(rows, _tiles(rows), stranded=True, width=256)


@_register(f"{_REGION} SELECT * EXCLUDE (seq), translate(seq, 'Tt', 'Uu') AS seq FROM t")
def fasta_regions_rna(spark, d):
    rows = tv.sequences(spark, d)
    return sequences.regions(rows, _tiles(rows), alphabet="RNA", width=256)


@_register(f"{_REGION} SELECT *, CAST(0 AS INT) AS file FROM t UNION ALL SELECT * EXCLUDE (seq), CASE WHEN strand = '-' THEN reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) ELSE seq END, 1 FROM t WHERE contig LIKE '%7'")
def fasta_regions_by_file(spark, d):
    rows = tv.sequences(spark, d)
    tiles = _tiles(rows)
    return sequences.regions_by_file([(rows, tiles.withColumn("strand", F.lit("+"))), (rows, tiles.where("contig LIKE '%7'"))]).withColumn("strand", F.when(F.floor(F.col("start") / _TILE) % 2 == 0, "+").otherwise("-"))


_TAB = f"""WITH l AS ({tv.in_oracle(tv.TABLE_LINES)}), ranges AS ({tv.in_oracle(tv.TABLE_RANGES)}), rows_ AS (SELECT line, split_part(line, chr(9), 1) AS c, CAST(split_part(line, chr(9), 2) AS INT) AS a, CAST(split_part(line, chr(9), 3) AS INT) AS b FROM l),
met AS (SELECT range_id, line FROM rows_ JOIN ranges ON c = contig AND a <= "end" AND b >= "start")"""


def _text(spark, d):
    return tabtext.keyed(tv.view(spark, d, tv.TABLE_LINES), tabtext.Layout(1, 2, 3)), tv.view(spark, d, tv.TABLE_RANGES)


@_register(f"{_TAB} SELECT * FROM met")
def tabix_ranges(spark, d):
    rows, ranges = _text(spark, d)
    return tabtext.in_ranges(rows, ranges, tabtext.names(rows)).select("range_id", "line")


@_register(f"{_TAB} SELECT DISTINCT c AS contig FROM rows_")
def tabix_names(spark, d):
    return tabtext.names(_text(spark, d)[0])


@_register(f"""{_TAB}, n AS (SELECT range_id, count(*) AS records FROM met GROUP BY range_id) SELECT range_id, contig, "start", "end", CAST(coalesce(records, 0) AS BIGINT) AS records FROM ranges LEFT JOIN n USING (range_id)""")
def tabix_count(spark, d):
    rows, ranges = _text(spark, d)
    return tabtext.count(rows, ranges)


#: Lines of a zero-based format under comments of their own; every line is numbered.
_BED = """
SELECT CAST(event_id AS BIGINT) AS line_no, CASE WHEN event_id % 50 = 0 THEN '# part ' || CAST(event_id AS STRING)
       ELSE event_type || chr(9) || CAST(event_id * 10 AS STRING) || chr(9) || CAST(6 + event_id * 10 AS STRING) || chr(9) || CAST(user_id AS STRING) END AS line FROM {events}
"""


@_register(f"""WITH l AS ({tv.in_oracle(_BED)}) SELECT split_part(line, chr(9), 1) AS contig, CAST(split_part(line, chr(9), 2) AS INT) + 1 AS "start", CAST(split_part(line, chr(9), 3) AS INT) AS "end", line_no
FROM l WHERE line NOT LIKE '#%' AND line_no >= 3""")
def tabix_preset(spark, d):
    """Lines of a zero-based layout, from 1, without comments and the first three lines, which the layout skips."""
    layout = dataclasses.replace(tabtext.PRESETS["bed"], skip=3)
    return tabtext.keyed(tv.view(spark, d, _BED), layout).select("contig", "start", "end", "line_no")


@_register(f"WITH l AS ({tv.in_oracle(_BED)}) SELECT line_no, line FROM l WHERE line LIKE '#%' OR line_no < 3")
def tabix_header(spark, d):
    layout = dataclasses.replace(tabtext.PRESETS["bed"], skip=3)
    return tabtext.header(tv.view(spark, d, _BED), layout).select("line_no", "line")


def _numbers(line: str):
    """A caller's parser: the whole numbers of a line, with their column."""
    for i, part in enumerate(line.split("\t")):
        if part.isdigit():
            yield i, int(part)


@_register(f"{_TAB} SELECT line, CAST(i - 1 AS INT) AS at, CAST(x AS BIGINT) AS number FROM (SELECT line, unnest(range(1, 5)) AS i, unnest(string_split(line, chr(9))) AS x FROM rows_) WHERE regexp_full_match(x, '[0-9]+')")
def tabix_parser(spark, d):
    return tabtext.parse_table(tv.view(spark, d, tv.TABLE_LINES), _numbers, "at int, number long")


def _folder(spark) -> str:
    return f"{shared.folder(spark)}/text-{uuid.uuid4().hex}"


@_register(f"{_TAB} SELECT range_id, line FROM met WHERE range_id % 10 = 3")
def tabix_index_ranges(spark, d):
    """Lines in sorted blocked gzip with .tbi indexes: tasks read the chunks that the indexes name."""
    gztext.register(spark)
    folder, layout = _folder(spark), tabtext.Layout(1, 2, 3)
    rows, ranges = _text(spark, d)
    rows.orderBy("contig", "start", "line").select("line").write.format("lines").mode("append").save(folder)
    gztext.index_files(spark, folder, layout).count()
    ranges = ranges.where("range_id % 10 = 3")
    found = gztext.read_ranges(spark, folder, ranges, layout, split=1 << 16)
    return _kept(spark, tabtext.in_ranges(tabtext.keyed(found, layout), ranges).select("range_id", "line"), folder)


@_register(f"{_TAB} SELECT line, row_number() OVER (ORDER BY c, a, line) - 1 AS place FROM rows_")
def gzip_lines_in_splits(spark, d):
    """Blocked gzip text read by several tasks a file, in order of file and offset."""
    gztext.register(spark)
    folder = _folder(spark)
    _text(spark, d)[0].orderBy("contig", "start", "line").select("line").write.format("lines").mode("append").save(folder)
    lines = spark.read.format("lines").option("splitBytes", str(1 << 15)).load(folder)
    return _kept(spark, shared.numbered(lines, "place", "file", "offset").select("line", "place"), folder)


@_register(f"{_REGION} SELECT * EXCLUDE (seq), CASE WHEN strand = '-' THEN reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) ELSE seq END AS seq FROM t")
def fasta_offset_regions(spark, d):
    """Regions of FASTA files by the offsets of their index: tasks read the regions' bytes."""
    folder = _folder(spark)
    rows = tv.sequences(spark, d)
    text.write_fasta(rows.select("name", "seq"), folder)
    return _kept(spark, gztext.fasta_regions(gztext.index_fasta(spark, folder), _tiles(rows), stranded=True), folder)


_OLD = tv.in_oracle(tv.PILEUP_TEXT)


@_register(f"""WITH t AS ({_OLD}), u AS (SELECT *, lead("referenceBase") OVER (PARTITION BY space ORDER BY line_no) AS nxt FROM t) SELECT * EXCLUDE (nxt) FROM u WHERE "referenceBase" <> '*' AND coalesce(nxt, '') <> '*'""")
def legacy_pileup_snp(spark, d):
    return tabtext.legacy_pileup(tv.view(spark, d, tv.PILEUP_TEXT), "SNP")


_LAGGED = ", ".join(f'lag("{c}") OVER w AS "{c}"' for c in ("position", "referenceBase", "consensusBase", "consensusQuality", "snpQuality", "maxMappingQuality", "coverage"))


@_register(f"""WITH t AS ({_OLD}), u AS (SELECT line_no, space, {_LAGGED}, "alleleOne", "alleleTwo", "alleleOneSupport", "alleleTwoSupport", "additionalIndels", "referenceBase" AS own FROM t WINDOW w AS (PARTITION BY space ORDER BY line_no))
SELECT * EXCLUDE (own) FROM u WHERE own = '*'""")
def legacy_pileup_indel(spark, d):
    return tabtext.legacy_pileup(tv.view(spark, d, tv.PILEUP_TEXT), "indel")


@_register(f"""WITH t AS ({_OLD}) SELECT * FROM t WHERE "referenceBase" <> '*'""")
def legacy_pileup_all(spark, d):
    return tabtext.legacy_pileup(tv.view(spark, d, tv.PILEUP_TEXT), "all")


@_register(f"""{WITH} SELECT qname, score, score AS sanger, score + 31 AS solexa, score AS illumina_18, score + 31 AS illumina_13, score + 31 AS illumina_15, of_char
FROM (SELECT qname, mapq % 38 + 3 AS score, ascii(substr(qual, 1, 1)) - 33 AS of_char FROM aln)""")
def phred_offsets(spark, d):
    score = F.col("mapq") % 38 + 3
    schemes = {"sanger": "Sanger", "solexa": "Solexa", "illumina_18": "Illumina 1.8+", "illumina_13": "Illumina 1.3+", "illumina_15": "Illumina 1.5+"}
    return tv.alignments(spark, d).select("qname", score.alias("score"), *[sequence.phred_offset(score, s).alias(n) for n, s in schemes.items()], sequence.phred_char_offset(F.substring("qual", 1, 1)).alias("of_char"))


_VARIANTS = f"""WITH ranges AS ({RANGES}), v AS (SELECT p_partkey, 'chr' || CAST(p_partkey % 6 AS STRING) AS chrom, CAST(1 + p_partkey * 53 AS INT) AS pos, CASE WHEN p_partkey % 2 <> 0 THEN 'rs' || CAST(p_partkey AS STRING) END AS id,
substr('ACGTACGT', 1 + CAST(p_partkey % 4 AS INT), 1 + CAST(p_partkey % 3 AS INT)) AS ref, CASE WHEN p_partkey % 5 = 0 THEN 'A,T' ELSE 'G' END AS alt, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS qual, p_size FROM part)"""


def _variants(spark, d):
    return variants.parse(tv.view(spark, d, tv.VARIANT_LINES, spread=True), ["one", "two"])


@_register(f"""{_VARIANTS} SELECT chrom, pos, id, ref, alt, qual, 'PASS' AS filter, CAST(p_size AS STRING) AS "info_DP", '' AS "info_DB", '0/1' AS gt1, CAST(p_size AS INT) AS pl1, CASE WHEN p_partkey % 3 <> 0 THEN '1/1' ELSE './.' END AS gt2,
CASE WHEN p_partkey % 3 <> 0 THEN 7 END AS dp2, CASE WHEN p_partkey % 3 <> 0 THEN 'b' END AS xx2 FROM v""")
def variant_scan(spark, d):
    rows = variants.scan(_variants(spark, d), VariantSpec(info=("DP", "DB")))
    g = F.col("geno")
    return rows.select("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info_DP", "info_DB", g[0]["gt"].alias("gt1"), g[0]["pl"][0].alias("pl1"), g[1]["gt"].alias("gt2"), g[1]["dp"].alias("dp2"), g[1]["other"]["XX"].alias("xx2"))


#: The header of the variants' binary files; repeated keys are one entry of its dictionary.
_BCF_HEADER = "\n".join(
    ["##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="">', '##INFO=<ID=DB,Number=0,Type=Flag,Description="">', *[f'##FORMAT=<ID={k},Number=.,Type={t},Description="">' for k, t in (("GT", "String"), ("PL", "Integer"), ("DP", "Integer"), ("XX", "String"))]]
    + [f"##contig=<ID=chr{i}>" for i in range(6)] + ["#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tone\ttwo\n"]
)


@_register(f"""{_VARIANTS} SELECT chrom, pos, id, ref, alt, qual, 'PASS' AS filter, CAST(p_size AS STRING) AS dp, '0/1' AS gt1, CAST(p_size AS INT) AS pl1, CASE WHEN p_partkey % 3 <> 0 THEN '1/1' ELSE './.' END AS gt2,
CASE WHEN p_partkey % 3 <> 0 THEN 7 END AS dp2, CASE WHEN p_partkey % 3 <> 0 THEN 'b' ELSE '.' END AS xx2 FROM v""")
def bcf_round_trip(spark, d):
    """Variant lines written as binary files and read back in splits."""
    bcf.register(spark)
    folder = _folder(spark)
    tv.view(spark, d, tv.VARIANT_LINES, spread=True).write.format("bcf").mode("append").option("header", _BCF_HEADER).save(folder)
    rows = variants.scan(bcf.read(spark, folder), VariantSpec(info=("DP",), geno=("GT", "PL", "DP", "XX")))
    g = F.col("geno")
    fields = [g[0]["GT"].alias("gt1"), g[0]["PL"][0].alias("pl1"), g[1]["GT"].alias("gt2"), g[1]["DP"].alias("dp2"), g[1]["XX"].alias("xx2")]
    return _kept(spark, rows.select("chrom", "pos", "id", "ref", "alt", "qual", "filter", F.col("info_DP").alias("dp"), *fields), folder)


@_register(f"""{_VARIANTS} SELECT range_id, contig, "start", "end", count(pos) AS records FROM ranges LEFT JOIN v ON chrom = contig AND pos <= "end" AND pos + length(ref) - 1 >= "start" GROUP BY ALL""")
def variant_ranges(spark, d):
    return variants.records_per_range(_variants(spark, d), tv.ranges(spark, d))


#: Header lines of the part table: an INFO, a FORMAT or a plain line of each part; ids are repeated, some with a repeated attribute.
_HEAD = """
SELECT CAST(p_partkey AS INT) AS line_no, CASE WHEN p_partkey % 3 = 0 THEN '##source=part ' || CAST(p_partkey AS STRING) ELSE '##' || CASE WHEN p_partkey % 3 = 1 THEN 'INFO' ELSE 'FORMAT' END || '=<ID=X' || CAST(p_size AS STRING)
       || ',Number=1,' || CASE WHEN p_partkey % 7 = 0 THEN 'Number=2,' ELSE '' END || 'Type=Integer,Description=' || chr(34) || 'size, of ' || CAST(p_partkey AS STRING) || chr(34) || '>' END AS line FROM {part}
"""


@_register("""WITH h AS (SELECT CAST(p_partkey AS INT) AS line_no, CASE WHEN p_partkey % 3 = 0 THEN 'source' WHEN p_partkey % 3 = 1 THEN 'INFO' ELSE 'FORMAT' END AS "key", CASE WHEN p_partkey % 3 > 0 THEN 'X' || p_size END AS x,
p_partkey FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY "key", x ORDER BY line_no) - 1 AS n FROM h)
SELECT line_no, "key", CASE WHEN x IS NOT NULL AND n > 0 THEN x || '.' || n ELSE x END AS id, CASE WHEN x IS NULL THEN 'part ' || p_partkey END AS value, CASE WHEN x IS NOT NULL THEN 'size, of ' || p_partkey END AS description,
CASE WHEN x IS NOT NULL THEN '1' END AS number FROM n""")
def variant_header_tables(spark, d):
    fields = F.col("fields")
    return variants.header_tables(tv.view(spark, d, _HEAD)).select("line_no", "key", "id", "value", fields["Description"].alias("description"), fields["Number"].alias("number"))


@_register(f"""{_VARIANTS} SELECT f AS field FROM (SELECT unnest(['gt', 'dp', 'gq', 'sp', 'pl', 'gl']) AS f) WHERE f NOT IN (SELECT DISTINCT unnest(['gt', 'dp', 'pl']) FROM v WHERE p_partkey % 3 <> 0) AND EXISTS (SELECT 1 FROM v)""")
def variant_trim_empty(spark, d):
    return variants.empty_fields(_variants(spark, d))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup_all_dims(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
