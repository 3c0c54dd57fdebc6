"""Connected components of a link table, by rounds of large-star and small-star.

Every round is a few grouped minima and equi-joins on link rows, so a hub with any number of links is
pre-aggregated on the map side and its join is split as a skewed one; no neighbourhood is collected.
A round's links are checkpointed, which cuts the lineage, and compared by count and checksum only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import cut


def _both(links: DataFrame) -> DataFrame:
    return links.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Link neighbours to the least of each neighbourhood: those larger than the node, else the others and the node."""
    sides = _both(links) if larger else links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = sides.join(least, "u")
    met = met.where("v > u") if larger else met
    out = met.select(F.col("v").alias("a"), F.col("m").alias("b"))
    out = out if larger else out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """`node` and `component`, its least reachable node, for the nodes of links (a, b); null links are ignored."""
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = mark
        links = cut(_star(_star(links, True), False))
