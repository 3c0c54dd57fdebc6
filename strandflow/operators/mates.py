"""Mate pairing inside templates.

Segments meet by an equi-join on template and on the positions that mates must share, so even a
template with many records joins only those whose positions agree; degrees are counted after that.
`key` is a unique row id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions.sequence import circular, trim_name
from strandflow.shared import cut, numbered

#: Positions of a bin in which mates are looked for.
BIN = 16_384


def _bit(flag: str, mask: int) -> Column:
    return F.col(flag).bitwiseAND(mask) != 0


def can_pair(flag: str = "flag") -> Column:
    """Paired, mapped, mate mapped, exactly one of first and last."""
    return (F.col(flag).bitwiseAND(0x00D) == 0x001) & (_bit(flag, 64) != _bit(flag, 128))


def valid_hit(x: str = "x_", y: str = "y_", strict: bool = True) -> Column:
    """Whether the records in columns x_* and y_* are mates: the strict rule, or the loose one of whole-file pairing."""
    xf, yf = x + "flag", y + "flag"
    first = _bit(xf, 64) != _bit(yf, 64)
    same = (_bit(xf, 2) == _bit(yf, 2)) & (_bit(xf, 256) == _bit(yf, 256))
    places = (F.col(x + "mpos") == F.col(y + "pos")) & (F.col(y + "mpos") == F.col(x + "pos"))
    one, two = _bit(xf, 32) == _bit(yf, 16), _bit(yf, 32) == _bit(xf, 16)
    strands = (one & two) if strict else (one == two)
    contigs = F.col(x + "mrnm") == F.col(y + "rname")
    if strict:
        contigs = contigs & (F.col(y + "mrnm") == F.col(x + "rname"))
    return F.coalesce(can_pair(xf) & can_pair(yf) & first & same & places & strands & contigs, F.lit(False))


def _pairs(rows: DataFrame, strict: bool) -> DataFrame:
    """(key, mate) in both directions."""
    need = [c for c in ("key", "template", "flag", "rname", "pos", "mrnm", "mpos", "rg") if c in rows.columns]
    able = rows.where(can_pair()).select(*need)
    x = able.select(*[F.col(c).alias("x_" + c) for c in need])
    y = able.select(*[F.col(c).alias("y_" + c) for c in need])
    on = (F.col("x_template") == F.col("y_template")) & (F.col("x_pos") == F.col("y_mpos")) & (F.col("x_mpos") == F.col("y_pos")) & (F.col("x_key") < F.col("y_key"))
    test = valid_hit(strict=strict)
    if not strict:  # the rule tests one direction of the contigs; a pair counts where either record's holds
        test = test | valid_hit("y_", "x_", strict=False)
    if "rg" in need:
        test = test & F.col("x_rg").eqNullSafe(F.col("y_rg"))
    met = x.join(y, on).where(test).select(F.col("x_key").alias("a"), F.col("y_key").alias("b"))
    return met.select(F.inline(F.array(F.struct(F.col("a").alias("key"), F.col("b").alias("mate")), F.struct(F.col("b").alias("key"), F.col("a").alias("mate")))))


def mate_status(rows: DataFrame, strict: bool = False, prefix_end: str | None = None, suffix_start: str | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """Rows with mate_status (mated, ambiguous, unmated), mate and groupid.

    A record with one candidate that has it as its only one is mated. Records with several
    candidates, and those that point to one of these, are ambiguous. groupid names a pair by its
    smaller key, and the ambiguous or unmated records of a template together by their smallest.
    With lengths (name, length), positions are taken modulo the contig's length.
    """
    named = rows.withColumn("template", trim_name(F.col("qname"), prefix_end, suffix_start))
    if lengths is not None:
        of = lengths.select(F.col("name").alias("rname"), F.col("length").alias("__n"))
        named = named.join(of, "rname", "left").join(of.withColumnsRenamed({"rname": "mrnm", "__n": "__m"}), "mrnm", "left")
        named = named.withColumns({"pos": F.coalesce(circular(F.col("pos"), F.col("__n")), "pos"), "mpos": F.coalesce(circular(F.col("mpos"), F.col("__m")), "mpos")}).drop("__n", "__m")
    pairs = _pairs(named, strict)
    degree = pairs.groupBy("key").agg(F.count("*").alias("n"), F.min("mate").alias("mate"))
    other = degree.select(F.col("key").alias("mate"), F.col("n").alias("mate_n"))
    judged = degree.join(other, "mate", "left").select("key", F.when((F.col("n") == 1) & (F.col("mate_n") == 1), "mated").otherwise("ambiguous").alias("mate_status"), F.when((F.col("n") == 1) & (F.col("mate_n") == 1), F.col("mate")).alias("mate"))
    out = named.join(judged, "key", "left").withColumn("mate_status", F.coalesce("mate_status", F.lit("unmated")))
    groups = out.where("mate_status <> 'mated'").groupBy("template", "mate_status").agg(F.min("key").alias("__g"))
    out = out.join(groups, ["template", "mate_status"], "left")
    return out.withColumn("groupid", F.when(F.col("mate_status") == "mated", F.least("key", "mate")).otherwise(F.col("__g"))).drop("__g", "template")


def mates_within_groups(rows: DataFrame) -> DataFrame:
    """`hit` per record: its mate's key; null without one, 0 with several, negative if the mate has several (keys from 1 on)."""
    pairs = _pairs(rows.withColumn("template", F.col("qname")), strict=True)
    degree = pairs.groupBy("key").agg(F.count("*").alias("n"), F.min("mate").alias("mate"))
    other = degree.select(F.col("key").alias("mate"), F.col("n").alias("mate_n"))
    hit = F.when(F.col("n") > 1, 0).when(F.col("mate_n") > 1, -F.col("mate")).otherwise(F.col("mate"))
    return rows.join(degree.join(other, "mate", "left").select("key", hit.alias("hit")), "key", "left")


def ranged_mates(rows: DataFrame, in_range: DataFrame, **options) -> DataFrame:
    """Mate status of the templates that have a record in a range, looking for mates anywhere; read groups (`rg`) must agree."""
    return mate_status(rows.join(in_range.select("qname").distinct(), "qname", "left_semi"), **options)


def mates_by_bins(here: DataFrame, lookup: Callable[[DataFrame], DataFrame], prefix_end: str | None = None, suffix_start: str | None = None, **options) -> DataFrame:
    """Mate status of the records in ranges (`here`) and of the mates found outside, with `place`, their rank in the order of output.

    Only the bins of BIN positions that records name as their mates' places are looked into: `lookup` gives the
    records that start in such ranges (contig, start, end), be it by an index, a layout by contig and position, or
    `in_bins`. Of these, the ones that stand where a record of the same name has its mate are taken, so the table
    is never searched by name. Those that turn out to be nobody's mate are left out. Read groups (`rg`) must agree.
    Mated records come first, a pair's first read before its last one, then ambiguous, then unmated ones.
    """
    named = lambda df: df.withColumn("__t", trim_name(F.col("qname"), prefix_end, suffix_start))
    here = cut(here.dropDuplicates(["key"]))
    asked = named(here).where(can_pair() & F.col("mrnm").isNotNull() & F.col("mpos").isNotNull()).select("__t", F.col("mrnm").alias("rname"), F.col("mpos").alias("pos"))
    bins = asked.select(F.col("rname").alias("contig"), F.floor((F.col("pos") - 1) / BIN).alias("__bin")).distinct()
    ranges = bins.select("contig", (F.col("__bin") * BIN + 1).cast("int").alias("start"), ((F.col("__bin") + 1) * BIN).cast("int").alias("end"))
    found = named(lookup(ranges)).join(asked.distinct(), ["__t", "rname", "pos"], "left_semi").drop("__t").join(here.select("key"), "key", "left_anti")
    every = here.withColumn("__here", F.lit(True)).unionByName(found.select(*here.columns).withColumn("__here", F.lit(False)))
    judged = mate_status(every, prefix_end=prefix_end, suffix_start=suffix_start, **options).where(F.col("__here") | (F.col("mate_status") != "unmated")).drop("__here")
    rank = F.when(F.col("mate_status") == "mated", 0).when(F.col("mate_status") == "ambiguous", 1).otherwise(2)
    return numbered(judged, "place", rank, "groupid", F.col("flag").bitwiseAND(64).desc(), "key")


def in_bins(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A lookup in a table: rows meet the asked bins by contig and bin."""

    def lookup(ranges: DataFrame) -> DataFrame:
        bins = ranges.select(F.col("contig").alias("rname"), F.floor((F.col("start") - 1) / BIN).alias("__bin"))
        return rows.withColumn("__bin", F.floor((F.col("pos") - 1) / BIN)).join(bins, ["rname", "__bin"], "left_semi").select(*rows.columns)

    return lookup
