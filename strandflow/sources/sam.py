"""SAM text: a reader and a writer over Spark's text source, all in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions.sequence import first_of_keys
from strandflow.schemas import TAG


def _tags(fields: Column) -> Column:
    def one(p: Column) -> Column:
        kind, v = p[1], p[2]
        numbers = F.slice(F.split(v, ","), 2, 1 << 20)
        fractional = (kind == "B") & v.startswith("f")
        return F.struct(
            p[0].alias("key"),
            F.struct(
                kind.alias("type"), F.when(kind == "i", v.try_cast("long")).alias("i"), F.when(kind == "f", v.try_cast("double")).alias("d"), F.when(kind.isin("A", "Z", "H"), v).alias("s"),
                F.when((kind == "B") & ~fractional, F.transform(numbers, lambda n: n.try_cast("long"))).alias("ai"), F.when(fractional, F.transform(numbers, lambda n: n.try_cast("double"))).alias("ad"),
            ).cast(TAG).alias("value"),
        )

    return first_of_keys(F.transform(F.transform(fields, lambda x: F.split(x, ":", 3)), one))


def parse(lines: DataFrame) -> DataFrame:
    """Alignments of SAM lines (column `line`), with the lines' other columns; '*', and 0 for a position, become null."""
    p = F.col("__fields")
    at = lambda i: F.get(p, F.lit(i))
    star = lambda c: F.when(c != "*", c)
    place = lambda c: F.when(c != "0", c.cast("int"))
    others = [c for c in lines.columns if c != "line"]
    # A filter would be pushed below the lines and make each of them again; a generator drops the others' rows where it stands.
    record = ~F.col("line").startswith("@") & (F.col("line") != "")
    rows = lines.select(*others, F.explode(F.when(record, F.array(F.split("line", "\t")))).alias("__fields"))
    return rows.select(
        at(0).alias("qname"), at(1).cast("int").alias("flag"), star(at(2)).alias("rname"), place(at(3)).alias("pos"), at(4).cast("int").alias("mapq"), star(at(5)).alias("cigar"),
        F.when(at(6) == "=", star(at(2))).otherwise(star(at(6))).alias("mrnm"), place(at(7)).alias("mpos"), at(8).cast("int").alias("isize"), star(at(9)).alias("seq"), star(at(10)).alias("qual"),
        _tags(F.slice(p, 12, 1 << 20)).alias("tags"), *others,
    )


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Alignments of SAM files, with the file each is in. Files are split: a line is a record."""
    return parse(spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")))


def header(lines: DataFrame) -> DataFrame:
    """Header lines: tag and fields."""
    p = F.split("line", "\t")
    return lines.where(F.col("line").startswith("@")).select(F.substring(p[0], 2, 2).alias("tag"), F.slice(p, 2, 1 << 20).alias("fields"))


def contigs(lines: DataFrame) -> DataFrame:
    """name and length of the @SQ lines."""
    value = lambda k: F.regexp_extract("line", rf"\t{k}:([^\t]+)", 1)
    return lines.where(F.col("line").startswith("@SQ")).select(value("SN").alias("name"), value("LN").try_cast("int").alias("length"))


def to_lines(alignments: DataFrame) -> DataFrame:
    """SAM lines (column `line`) of alignments, tags in order of name."""
    star = lambda c: F.coalesce(F.col(c), F.lit("*"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))

    def tag(e: Column) -> Column:
        v = e["value"]
        text = F.coalesce(v["s"], v["i"].cast("string"), v["d"].cast("string"), F.concat(F.lit("i,"), F.array_join(v["ai"], ",")), F.concat(F.lit("f,"), F.array_join(v["ad"], ",")))
        return F.concat_ws(":", e["key"], v["type"], text)

    tags = F.transform(F.sort_array(F.map_entries("tags")), tag)
    mate = F.when(F.col("mrnm") == F.col("rname"), "=").otherwise(star("mrnm"))
    columns = [star("qname"), number("flag"), star("rname"), number("pos"), number("mapq"), star("cigar"), mate, number("mpos"), number("isize"), star("seq"), star("qual")]
    return alignments.select(F.concat_ws("\t", *columns, F.coalesce(tags, F.array().cast("array<string>"))).alias("line"))


def write(alignments: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    """SAM text files; compression may be any codec of the text sink, such as gzip."""
    to_lines(alignments).write.mode(mode).option("compression", compression).text(path)
