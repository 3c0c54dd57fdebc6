"""Variant records: header tables, parsing, ranges, genotype fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.sequence import first_entries
from strandflow.operators.intervals import check_ranges, interval_join, unique_labels
from strandflow.specs import VariantSpec


def header_tables(lines: DataFrame) -> DataFrame:
    """`##` lines as rows: key, id, fields (of structured lines), value (of plain ones); a repeated id gets its ordinal as a suffix."""
    rows = lines.where(F.col("line").startswith("##")).select("line_no", F.regexp_extract("line", "^##([^=]+)=(.*)$", 1).alias("key"), F.regexp_extract("line", "^##([^=]+)=(.*)$", 2).alias("rest"))
    body = F.regexp_extract("rest", "^<(.*)>$", 1)
    names = F.regexp_extract_all(body, F.lit(r'([A-Za-z0-9_]+)=("[^"]*"|[^,]*)'), F.lit(1))
    values = F.transform(F.regexp_extract_all(body, F.lit(r'([A-Za-z0-9_]+)=("[^"]*"|[^,]*)'), F.lit(2)), lambda v: F.regexp_replace(v, '^"|"$', ""))
    rows = rows.select("line_no", "key", F.when(body != "", first_entries(names, values)).alias("fields"), F.when(body == "", F.col("rest")).alias("value"))
    rows = rows.withColumn("id", F.col("fields")["ID"])
    w = Window.partitionBy("key", "id").orderBy("line_no")  # a header's lines are few
    n = F.row_number().over(w)
    return rows.withColumn("id", F.when(F.col("id").isNotNull() & (n > 1), F.concat_ws(".", "id", (n - 1).cast("string"))).otherwise(F.col("id")))


def samples(lines: DataFrame) -> DataFrame:
    """Sample names of the #CHROM line, in order; without such a line the result is an error."""
    found = lines.where(F.col("line").startswith("#CHROM")).agg(F.first("line").alias("line"))
    names = F.slice(F.split("line", "\t"), 10, 1 << 20)
    return found.select(F.posexplode(F.when(F.col("line").isNotNull(), names).otherwise(F.raise_error(F.lit("no #CHROM line")).cast("array<string>"))).alias("ordinal", "sample"))


def parse(lines: DataFrame, sample_names: list[str]) -> DataFrame:
    """Variant records of text lines; a missing value ('.') of a typed field is null, unknown genotype fields stay text."""
    p = F.split("line", "\t")
    at = lambda i: F.get(p, F.lit(i))
    keys = F.split(at(8), ":")

    def genotype(values: Column, name: Column) -> Column:
        m = first_entries(F.slice(keys, 1, F.size(values)), F.slice(values, 1, F.size(keys)))
        known = lambda k: F.when(m[k] != ".", m[k])
        numbers = lambda k, t: F.when(known(k).isNotNull(), F.transform(F.split(known(k), ","), lambda x: x.try_cast(t)))
        rest = F.map_filter(m, lambda k, v: ~k.isin("GT", "DP", "GQ", "SP", "PL", "GL"))
        return F.struct(
            name.alias("sample"), known("GT").alias("gt"), known("DP").try_cast("int").alias("dp"), known("GQ").try_cast("int").alias("gq"), known("SP").try_cast("int").alias("sp"),
            numbers("PL", "int").alias("pl"), numbers("GL", "double").alias("gl"), rest.alias("other"),
        )

    names = F.array(*[F.lit(s) for s in sample_names]).cast("array<string>")
    cells = F.transform(F.slice(p, 10, len(sample_names) or 1), lambda x: F.split(x, ":"))
    geno = F.zip_with(F.slice(names, 1, F.size(cells)), cells, lambda n, v: genotype(v, n)) if sample_names else F.lit(None)
    dot = lambda c: F.when(c != ".", c)
    return lines.where(~F.col("line").startswith("#") & (F.col("line") != "")).select(
        at(0).alias("chrom"), at(1).cast("int").alias("pos"), dot(at(2)).alias("id"), at(3).alias("ref"), at(4).alias("alt"), dot(at(5)).cast("double").alias("qual"),
        at(6).alias("filter"), at(7).alias("info"), at(8).alias("format"), geno.alias("geno"),
    )


def info_value(name: str, info: Column | None = None) -> Column:
    """A value of the INFO text, the first of a repeated key; a flag's is an empty string, an absent key's is null."""
    found = F.filter(F.split(F.col("info") if info is None else info, ";"), lambda x: (x == name) | x.startswith(f"{name}="))
    return F.substring(F.get(found, F.lit(0)), len(name) + 2, 1 << 30)


def scan(variants: DataFrame, spec: VariantSpec | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """Records, per range if any, with the asked fields, INFO keys, samples and genotype fields.

    Where all genotype fields are asked for and trim_empty is set, the records are looked through at once
    for fields that none has a value of, and these are left out.
    """
    spec = spec or VariantSpec()
    rows = variants
    if ranges is not None:
        rows = interval_join(rows.withColumn("__end", F.col("pos") + F.greatest(F.length("ref"), F.lit(1)) - 1), unique_labels(check_ranges(ranges)), "chrom", "pos", "__end")
    extra = [F.col("range_id"), F.col("range_label").alias("which_label")] if ranges is not None else []
    fixed = list(spec.fixed) or ["chrom", "pos", "id", "ref", "alt", "qual", "filter"]
    info = [info_value(k).alias(f"info_{k}") for k in spec.info] or [F.col("info")]
    geno = F.col("geno")
    if spec.samples:
        geno = F.filter(geno, lambda g: g["sample"].isin(*spec.samples))
    if spec.geno:
        typed = {"GT": "gt", "DP": "dp", "GQ": "gq", "SP": "sp", "PL": "pl", "GL": "gl"}
        geno = F.transform(geno, lambda g: F.struct(g["sample"].alias("sample"), *[(g[typed[k]] if k in typed else g["other"][k]).alias(k) for k in spec.geno]))
    elif spec.trim_empty:
        empty = {r["field"] for r in empty_fields(variants).collect()}  # six rows at most
        kept = [f for f in ("sample", "gt", "dp", "gq", "sp", "pl", "gl", "other") if f not in empty]
        geno = F.transform(geno, lambda g: F.struct(*[g[f].alias(f) for f in kept]))
    return rows.select(*extra, *fixed, *info, "format", geno.alias("geno"))


def records_per_range(variants: DataFrame, ranges: DataFrame) -> DataFrame:
    rows = variants.select("chrom", "pos", (F.col("pos") + F.greatest(F.length("ref"), F.lit(1)) - 1).alias("__end"))
    hits = interval_join(rows, check_ranges(ranges), "chrom", "pos", "__end").groupBy("range_id").agg(F.count("*").alias("records"))
    return ranges.join(hits, "range_id", "left").select(*ranges.columns, F.coalesce("records", F.lit(0)).cast("long").alias("records"))


def empty_fields(variants: DataFrame) -> DataFrame:
    """Genotype fields that no record has a value of (what trim_empty drops), found in one pass."""
    has = lambda f: F.coalesce(F.max(F.exists("geno", lambda g: g[f].isNotNull())), F.lit(False)).alias(f)
    found = variants.agg(*[has(f) for f in ("gt", "dp", "gq", "sp", "pl", "gl")])
    return found.select(F.explode(F.array_compact(F.array(*[F.when(~F.col(f), F.lit(f)) for f in ("gt", "dp", "gq", "sp", "pl", "gl")]))).alias("field"))
