"""Alignment flags: the twelve bits, tests on them and tri-state filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed names of the bits 0x1, 0x2, ... 0x800.
FLAG_BITNAMES = (
    "isPaired", "isProperPair", "isUnmappedQuery", "hasUnmappedMate", "isMinusStrand", "isMateMinusStrand",
    "isFirstMateRead", "isSecondMateRead", "isSecondaryAlignment", "isNotPassingQualityControls", "isDuplicate", "isSupplementaryAlignment",
)
ALL_BITS = 4095


def flag_mask(name: str) -> int:
    if name not in FLAG_BITNAMES:
        raise ValueError(f"unknown flag: {name}")
    return 1 << FLAG_BITNAMES.index(name)


def flag_filter(**states: bool | None) -> tuple[int, int]:
    """(keep0, keep1) of named bits: True asks for a set bit, False for a clear one, None for either."""
    keep0 = keep1 = ALL_BITS
    for name, state in states.items():
        mask = flag_mask(name)
        if state is True:
            keep0 &= ~mask
        elif state is False:
            keep1 &= ~mask
    return keep0, keep1


def flag_states(keep: tuple[int, int]) -> dict[str, bool | None]:
    """The tri-state of each bit of a filter."""
    keep0, keep1 = keep
    return {n: None if keep0 >> i & 1 and keep1 >> i & 1 else bool(keep1 >> i & 1) for i, n in enumerate(FLAG_BITNAMES)}


def passes(flag: Column, keep: tuple[int, int]) -> Column:
    """Whether a flag passes the filter; bits that must be clear and bits that must be set, as two tests."""
    keep0, keep1 = keep
    clear, ones = ALL_BITS & ~keep1, ALL_BITS & ~keep0
    test = F.lit(True)
    if clear:
        test = test & (flag.bitwiseAND(clear) == 0)
    if ones:
        test = test & (flag.bitwiseAND(ones) == ones)
    return test


def flag_and(one: Column, two: Column) -> Column:
    return one.bitwiseAND(two)


def flag_test(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(flag_mask(name)) != 0


def bit_matrix(flag: Column, names: tuple[str, ...] = FLAG_BITNAMES) -> list[Column]:
    """A 0/1 column per named bit."""
    return [flag_test(flag, n).cast("int").alias(n) for n in names]
