"""Sequence and quality functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes and their complements; W, S and N are their own.
CODES, COMPLEMENTS = "ACGTUMRYKVHDBacgtumrykvhdb", "TGCAAKYRMBDHVtgcaakyrmbdhv"
#: Letters of each alphabet.
ALPHABETS = {"DNA": "ACGTMRWSYKVHDBN+.-", "RNA": "ACGUMRWSYKVHDBN+.-", "AA": "ARNDCQEGHILKMFPSTWYVUOBJZX*-+."}
#: Quality schemes: the range of scores and what is added for an offset from '!'.
SCHEMES = {"Illumina 1.8+": (0, 41, 0), "Sanger": (0, 40, 0), "Solexa": (-5, 40, 31), "Illumina 1.3+": (0, 40, 31), "Illumina 1.5+": (3, 40, 31)}


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, CODES, COMPLEMENTS))


def on_forward(seq: Column, flag: Column) -> Column:
    """A sequence as read: minus-strand rows reverse-complemented."""
    return F.when(flag.bitwiseAND(16) != 0, reverse_complement(seq)).otherwise(seq)


def quality_on_forward(qual: Column, flag: Column) -> Column:
    return F.when(flag.bitwiseAND(16) != 0, F.reverse(qual)).otherwise(qual)


def trim_name(qname: Column, prefix_end: str | None = None, suffix_start: str | None = None) -> Column:
    """Cut a name at the last suffix character, inclusive, and remove all through the first prefix character."""
    if suffix_start:
        qname = F.when(F.instr(qname, suffix_start) > 0, F.regexp_replace(qname, f"[{_class(suffix_start)}][^{_class(suffix_start)}]*$", "")).otherwise(qname)
    if prefix_end:
        qname = F.regexp_replace(qname, f"^[^{_class(prefix_end)}]*[{_class(prefix_end)}]", "")
    return qname


def _class(c: str) -> str:
    return "\\" + c if c in "\\]^-[&" else c


def phred_offset(score: Column, scheme: str = "Illumina 1.8+") -> Column:
    """Offset from '!' of numeric scores; an error outside the scheme's range."""
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme!r}")
    low, high, add = SCHEMES[scheme]
    return F.when(score.between(low, high), score + add).otherwise(F.raise_error(F.lit(f"a score is outside {low}..{high}")).cast("int"))


def phred_char_offset(char: Column) -> Column:
    """Offset from '!' of a quality character; an error if it is no printable one."""
    code = F.ascii(char)
    return F.when((F.length(char) == 1) & code.between(33, 126), code - 33).otherwise(F.raise_error(F.lit("not a quality character")).cast("int"))


def circular(pos: Column, length: Column) -> Column:
    """A 1-based position on a circular sequence."""
    return F.pmod(pos - 1, length) + 1


def first_entries(keys: Column, values: Column) -> Column:
    """A map of keys to values; of a repeated key the first value counts, null is no key."""
    return first_of_keys(F.filter(F.arrays_zip(keys.alias("key"), values.alias("value")), lambda e: e["key"].isNotNull()))


def first_of_keys(entries: Column) -> Column:
    """A map of entries (structs of `key`, not null, and `value`); of a repeated key the first entry counts.

    What stands in a lambda is worked out anew for every element, so the entries and their keys are bound to variables.
    """

    def first(e: Column) -> Column:
        again = F.transform(F.array(e["key"]), lambda keys: F.filter(e, lambda x, i: F.array_position(keys, x["key"]) == i + 1))
        return F.when(F.size(F.array_distinct(e["key"])) == F.size(e), e).otherwise(F.get(again, F.lit(0)))

    return F.map_from_entries(F.get(F.transform(F.array(entries), first), F.lit(0)))


def in_alphabet(seq: Column, alphabet: str) -> Column:
    """The sequence, or an error if a letter is not of the alphabet. RNA is given with U for T, DNA with T for U."""
    if alphabet == "RNA":
        seq = F.translate(seq, "Tt", "Uu")
    elif alphabet == "DNA":
        seq = F.translate(seq, "Uu", "Tt")
    letters = ALPHABETS[alphabet].replace("-", "") + ALPHABETS[alphabet].lower().replace("-", "")
    good = seq.rlike(rf"^[{''.join(map(_class, sorted(set(letters))))}-]*$") | seq.isNull()
    return F.when(good, seq).otherwise(F.raise_error(F.lit(f"a letter is not of the {alphabet} alphabet")).cast("string"))
