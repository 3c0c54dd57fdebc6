"""A rectangle of ranges by samples over one table of alignments with a `file` column."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.operators.scan import apply_groups, overlap, predicate, scan
from strandflow.specs import ScanSpec


@dataclass(frozen=True)
class Views:
    """Ranges (rows) and samples (columns: sample, file, metadata); nothing is read before a scan or count."""

    alignments: DataFrame
    ranges: DataFrame
    samples: DataFrame

    def select(self, range_ids: list[int] | None = None, sample_names: list[str] | None = None) -> "Views":
        out = self
        if range_ids is not None:
            out = replace(out, ranges=out.ranges.where(F.col("range_id").isin(range_ids)))
        if sample_names is not None:
            out = replace(out, samples=out.samples.where(F.col("sample").isin(sample_names)))
        return out

    def dims(self) -> tuple[int, int]:
        return self.ranges.count(), self.samples.count()

    def _rows(self) -> DataFrame:
        # a join by file would deal each file to one task
        return self.alignments.join(F.broadcast(self.samples.select("file", "sample")), "file")

    def scan(self, spec: ScanSpec | None = None) -> DataFrame:
        """Records per range and sample."""
        spec = spec or ScanSpec()
        return scan(self._rows(), spec, self.ranges)

    def apply(self, fun, schema: str, spec: ScanSpec | None = None, n: int = 100_000) -> DataFrame:
        """`fun` of each sample's records in the ranges, at most n at a time."""
        spec = spec or ScanSpec()
        rows = overlap(self._rows().where(predicate(spec)), self.ranges).select("sample", "range_id", *[c for c in spec.what if c in self.alignments.columns])
        return apply_groups(rows, "sample", fun, schema, n)

    def count(self, spec: ScanSpec | None = None) -> DataFrame:
        """Counts for every cell of the rectangle, zeros included."""
        grid = self.ranges.crossJoin(self.samples.select("sample"))  # a query's parameters, not data
        rows = self._rows()
        hits = overlap(rows.where(predicate(spec or ScanSpec())), self.ranges).groupBy("range_id", "sample").agg(F.count("*").alias("records"), F.sum(F.length("seq")).alias("nucleotides"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return grid.join(hits, ["range_id", "sample"], "left").select("range_id", "sample", zero("records"), zero("nucleotides"))
