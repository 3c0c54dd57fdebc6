"""FASTA, FASTA indexes, VCF text, indexed text and old pileup text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.operators import variants
from strandflow.schemas import FASTA_INDEX, PILEUP_TEXT


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`line` and the file it is in, of plain or gzip text (blocked gzip is gzip of many members)."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name and seq. Records are split at '>' by the text source, so a file is read in parallel by record."""
    rows = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", "^>", "")
    head, body = F.substring_index(record, "\n", 1), F.expr("substring(regexp_replace(value, '^>', ''), locate('\n', regexp_replace(value, '^>', '')))")
    has = F.instr(record, "\n") > 0
    return rows.where(F.trim("value") != "").select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.when(has, F.regexp_replace(body, r"\s", "")).otherwise("").alias("seq"))


def fasta_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=FASTA_INDEX)


def write_fasta(sequences: DataFrame, path: str, width: int = 60, mode: str = "errorifexists") -> None:
    wrapped = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    sequences.select(F.concat(F.lit(">"), "name", F.lit("\n"), wrapped)).write.mode(mode).text(path)


def index_of(sequences: DataFrame, width: int = 60) -> DataFrame:
    """The index of a FASTA file that holds the sequences in order of `ordinal`: offsets are a running sum of record sizes."""
    size = F.octet_length("name") + 2 + F.length("seq") + F.ceil(F.length("seq") / width)
    w = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)  # a row per reference sequence
    before = F.coalesce(F.sum(size).over(w), F.lit(0))
    return sequences.select("name", F.length("seq").alias("length"), (before + F.octet_length("name") + 2).cast("long").alias("offset"), F.lit(width).alias("line_bases"), F.lit(width + 1).alias("line_width"))


def vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Variant records. The header's sample names, a single line, are read first."""
    rows = lines(spark, path)
    names = [r["sample"] for r in variants.samples(rows).orderBy("ordinal").collect()]
    return variants.parse(rows, names)


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`line`, the file and `line_no`, from 0 in each file: places inside each split of a file, and the lines of its splits before."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__at"))
    sizes = rows.groupBy("file", "__split").agg(F.count("*").alias("__n"))
    w = Window.partitionBy("file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    sizes = sizes.select("file", "__split", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("file", "__split").orderBy("__at")) - 1
    return rows.withColumn("__inside", inside).join(sizes, ["file", "__split"]).select("line", "file", (F.col("__before") + F.col("__inside")).alias("line_no"))


def old_pileup(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Old pileup text with the file and a line number; short rows are filled with null."""
    fields = [f.split(" ") for f in PILEUP_TEXT.split(", ")]
    p = F.split("line", "\t")
    rows = numbered_lines(spark, path)
    return rows.select("file", "line_no", *[F.get(p, F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields)])
