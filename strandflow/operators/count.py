"""Counts and summaries of alignments. Every sum has a map-side part; ranges and contigs are small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.operators.scan import overlap, predicate
from strandflow.specs import ScanSpec


def count_ranges(alignments: DataFrame, ranges: DataFrame, spec: ScanSpec | None = None) -> DataFrame:
    """Records and nucleotides per range; ranges without records count 0. The small result meets the ranges, not the rows."""
    rows = alignments.where(predicate(spec or ScanSpec())).select("rname", "pos", "cigar", "seq")
    hits = overlap(rows, ranges).groupBy("range_id").agg(F.count("*").alias("records"), F.sum(F.length("seq")).alias("nucleotides"))
    out = ranges.join(hits, "range_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("range_id", F.col("contig").alias("space"), "start", "end", (F.col("end") - F.col("start") + 1).alias("width"), zero("records"), zero("nucleotides"))


def count_file(alignments: DataFrame, spec: ScanSpec | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Records and nucleotides of the whole input, or by file."""
    rows = alignments.where(predicate(spec or ScanSpec()))
    return rows.groupBy(*by).agg(F.count("*").alias("records"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("nucleotides"))


def contig_stats(alignments: DataFrame, contigs: DataFrame) -> DataFrame:
    """Mapped and unmapped records per contig of the header, with `*` for unplaced ones."""
    name = F.coalesce("rname", F.lit("*"))
    unmapped = F.col("flag").bitwiseAND(4) != 0
    counts = alignments.groupBy(name.alias("seqnames")).agg(F.count_if(~unmapped).alias("mapped"), F.count_if(unmapped).alias("unmapped"))
    every = contigs.select(F.col("name").alias("seqnames"), F.col("length").alias("seqlength"))
    star = contigs.sparkSession.range(1).select(F.lit("*").alias("seqnames"), F.lit(0).alias("seqlength"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.unionByName(star).join(counts, "seqnames", "left").select("seqnames", "seqlength", zero("mapped"), zero("unmapped"))


def natural_order(name: str = "seqnames"):
    """Sort keys of contig names: `*` first, then by prefix, then by trailing number."""
    c = F.col(name)
    return [(c != "*"), F.regexp_replace(c, r"\d+$", ""), F.coalesce(F.expr(f"try_cast(regexp_extract({name}, '(\\\\d+)$', 1) AS bigint)"), F.lit(-1)), c]


def any_paired(alignments: DataFrame) -> DataFrame:
    """Whether any record is paired: stops at the first one found."""
    found = alignments.where(F.col("flag").bitwiseAND(1) != 0).select(F.lit(True).alias("p")).limit(1)
    return found.agg((F.count("*") > 0).alias("paired"))


def _groups():
    bit = lambda m: F.col("flag").bitwiseAND(m) != 0
    many = bit(1)
    first, last = many & bit(64) & ~bit(128), many & bit(128) & ~bit(64)
    return {"A": F.lit(True), "S": ~many, "M": many, "F": first, "L": last, "O": many & ~first & ~last}


def flag_summary(alignments: DataFrame) -> DataFrame:
    """By group of template segments: records, unique names, mean and most records per name.

    Names are counted first, with all groups side by side, so one shuffle by name serves all six.
    """
    groups = _groups()
    by_name = alignments.groupBy("qname").agg(*[F.count_if(test).alias(g) for g, test in groups.items()])
    sums = by_name.agg(*[F.struct(F.sum(g).alias("records"), F.count_if(F.col(g) > 0).alias("names"), F.max(g).alias("most")).alias(g) for g in groups])
    rows = F.array(*[F.struct(F.lit(g).alias("grp"), F.col(g)["records"].alias("records"), F.col(g)["names"].alias("names"), F.col(g)["most"].alias("most")) for g in groups])
    return _finish(sums.select(F.inline(rows)))


def flag_details(alignments: DataFrame) -> DataFrame:
    """The same within each group for mapped (1), primary (2), secondary (3) and unmapped (4) records."""
    bit = lambda m: F.col("flag").bitwiseAND(m) != 0
    parts = {"1": ~bit(4), "2": ~bit(4) & ~bit(256), "3": ~bit(4) & bit(256), "4": bit(4)}
    tests = {g + p: a & b for g, a in _groups().items() for p, b in parts.items()}
    by_name = alignments.groupBy("qname").agg(*[F.count_if(t).alias(k) for k, t in tests.items()])
    sums = by_name.agg(*[F.struct(F.sum(k).alias("records"), F.count_if(F.col(k) > 0).alias("names"), F.max(k).alias("most")).alias(k) for k in tests])
    rows = F.array(*[F.struct(F.lit(k).alias("grp"), F.col(k)["records"].alias("records"), F.col(k)["names"].alias("names"), F.col(k)["most"].alias("most")) for k in tests])
    return _finish(sums.select(F.inline(rows)))


def _finish(rows: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    mean = F.when(F.col("names") > 0, F.round(F.col("records") / F.col("names"), 6))
    return rows.select("grp", zero("records").alias("records"), zero("names").alias("names"), mean.alias("mean_per_name"), zero("most").alias("most_per_name"))
