"""What a query asks for, as plain validated values."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from strandflow.functions.flags import ALL_BITS
from strandflow.schemas import SCAN_FIELDS


@dataclass(frozen=True)
class ScanSpec:
    """Projection and predicates of a scan. tag_filter: every named tag must hold one of its values."""

    what: Sequence[str] = SCAN_FIELDS
    tags: Sequence[str] = ()
    flag: tuple[int, int] = (ALL_BITS, ALL_BITS)
    mapq: int = 0
    tag_filter: dict[str, Sequence] = field(default_factory=dict)
    simple_cigar: bool = False
    reverse_complement: bool = False

    def __post_init__(self):
        unknown = set(self.what) - set(SCAN_FIELDS) - {"groupid", "mate_status"}
        if unknown:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        for tag in [*self.tags, *self.tag_filter]:
            if len(tag) != 2:
                raise ValueError(f"a tag has two characters: {tag!r}")
        if self.mapq < 0:
            raise ValueError("mapq must not be negative")
        for tag, values in self.tag_filter.items():
            kinds = {type(v) for v in values}
            if not values or len(kinds) > 1 or not kinds <= {int, str}:
                raise ValueError(f"values of tag filter {tag} must be all integers or all strings")


def check_bins(bins: Sequence[float]) -> list[float]:
    """Sorted bin points: whole numbers or infinities, distinct, of one sign, none or at least two."""
    if not bins:
        return []
    if any(b is None or math.isnan(b) for b in bins):
        raise ValueError("bins must not hold nulls")
    if len(bins) == 1:
        raise ValueError("bins need none or at least two points")
    if any(b < 0 for b in bins) and any(b >= 0 for b in bins):
        raise ValueError("bins must all have one sign")
    if len(set(bins)) < len(bins):
        raise ValueError("bins must be distinct")
    return sorted(bins)


@dataclass(frozen=True)
class PileupSpec:
    #: Reads that count at a position at most; None for all.
    max_depth: int | None = 250
    min_base_quality: int = 13
    min_mapq: int = 0
    min_nucleotide_depth: int = 1
    min_minor_allele_depth: int = 0
    distinguish_strands: bool = True
    distinguish_nucleotides: bool = True
    ignore_query_ns: bool = True
    include_deletions: bool = True
    include_insertions: bool = False
    left_bins: Sequence[float] = ()
    query_bins: Sequence[float] = ()

    def __post_init__(self):
        if self.left_bins and self.query_bins:
            raise ValueError("give left_bins or query_bins, not both")
        object.__setattr__(self, "left_bins", tuple(check_bins(self.left_bins)))
        object.__setattr__(self, "query_bins", tuple(check_bins(self.query_bins)))
        if self.max_depth is not None and self.max_depth < 1:
            raise ValueError("max_depth must be at least 1")


@dataclass(frozen=True)
class VariantSpec:
    """Fields of a variant scan; empty means all. trim_empty drops genotype fields without a value."""

    fixed: Sequence[str] = ()
    info: Sequence[str] = ()
    geno: Sequence[str] = ()
    samples: Sequence[str] = ()
    trim_empty: bool = True


@dataclass(frozen=True)
class MultiPileupSpec:
    """Depths over several files."""

    flag: tuple[int, int] = (ALL_BITS, ALL_BITS)
    min_base_quality: int = 13
    min_mapq: int = 0
    min_depth: int = 0
    #: Reads of a file that count at a position at most; None for all.
    max_depth: int | None = 250
    yield_all: bool = False

    def __post_init__(self):
        if self.max_depth is not None and self.max_depth < 1:
            raise ValueError("max_depth must be at least 1")
