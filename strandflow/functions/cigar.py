"""CIGAR algebra in built-in functions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operations that advance on the query and on the reference.
QUERY_OPS, REFERENCE_OPS = "MIS=X", "MDN=X"


def ops(cigar: Column) -> Column:
    """array<struct<len int, op string>>; null for null."""
    lens = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    kinds = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.zip_with(lens, kinds, lambda n, k: F.struct(n.cast("int").alias("len"), k.alias("op")))


def width(cigar: Column, kinds: str) -> Column:
    """Sum of the lengths of operations of these kinds."""
    lens = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{kinds}]"), F.lit(1))
    return F.aggregate(lens, F.lit(0), lambda a, n: a + n.cast("int"))


def query_width(cigar: Column) -> Column:
    return width(cigar, QUERY_OPS)


def reference_width(cigar: Column) -> Column:
    return width(cigar, REFERENCE_OPS)


def reference_end(pos: Column, cigar: Column) -> Column:
    """Last reference position; a placed read without a CIGAR, or without reference bases, counts one."""
    return pos + F.greatest(F.coalesce(reference_width(cigar), F.lit(1)), F.lit(1)) - 1


def is_simple(cigar: Column) -> Column:
    """No CIGAR, or exactly one M operation."""
    return cigar.isNull() | cigar.rlike(r"^\d+M$")


def blocks(cigar: Column) -> Column:
    """array<struct<op, len, r, q, ins>>: reference and query offsets before each operation, and whether
    an insertion follows it (padding between does not count). Lambdas run once per operation, not per base."""
    pattern = F.lit(r"(\d+)([MIDNSH=X])(?:\d+P)*(?=(\d+I)?)")
    part = [F.regexp_extract_all(cigar, pattern, F.lit(i)) for i in (1, 2, 3)]
    listed = F.arrays_zip(part[0].alias("n"), part[1].alias("op"), part[2].alias("next"))
    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<op:string,len:int,r:int,q:int,ins:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        n, op = x["n"].cast("int"), x["op"]
        on_ref, on_query = (F.when(op.isin(*kinds), n).otherwise(0) for kinds in (REFERENCE_OPS, QUERY_OPS))
        here = F.array(F.struct(op.alias("op"), n.alias("len"), acc["r"].alias("r"), acc["q"].alias("q"), (x["next"] != "").alias("ins")))
        return F.struct((acc["r"] + on_ref).alias("r"), (acc["q"] + on_query).alias("q"), F.concat(acc["out"], here).alias("out"))

    return F.aggregate(listed, start, step, lambda acc: acc["out"])
