"""Spelling variant grouping: words one edit apart meet by their rarest bigrams (rare-first q-gram prefix filter).

Words are runs of letters with A-Z lower-cased; in a run whose CRC-32 with the document's id is divisible
by GARBLED one code point is deleted (a null id counts as no text). Words of at least MIN_LENGTH code points
with at least MIN_COUNT occurrences in all documents take part. They are near if they differ by exactly one
inserted, deleted or replaced code point.

One edit touches at most two bigrams of a word. So of its three rarest bigrams, in one global order by
frequency in the vocabulary (ties by the bigram, then by position), one is left whole; and as the whole
bigrams of two near words correspond in order, the first whole one of either word is among the other's
three. It stands before the edit or behind it: either all up to it is equal in both words, at the same
position from the start, or all from it on, at the same position from the end. So only the three rarest
bigrams of each word are joined, each with either side of it, and every pair found is verified. Words that
share a side with more than CROWD others are not paired: there the rest of the word, which holds the edit, is
joined as well, whole or without one of its code points. So the pairs tried follow the rows, not the
squares of groups.

A word's form is its near word of the largest count, the smallest in code-point order of equal ones, if that
is at least RATIO times the word's own; its root follows forms to the last. As counts grow tenfold with each
step, a chain of forms is as long as the largest count has digits, and halves with each round of joins.

Null texts have no words; repeated rows count again; an empty table, or one without words, gives an empty
result. Only doc_id and text are read; other columns, whatever their names, are left out. Very long texts and
runs are taken whole. Bigrams are of 90 letters, so their order, which goes to every task, has at most 8,100
entries.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import cut

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GARBLED, MIN_LENGTH, MIN_COUNT, RATIO = 31, 7, 2, 10
#: Bigrams of a word that are joined: one more than an edit touches.
RAREST = 3
#: Words that share a bigram and a side of it, up to which they are paired.
CROWD = 64
#: The hash of a word's rest: a prime and a base.
PRIME, BASE = (1 << 61) - 1, 1_000_003_579


def vocabulary(documents: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n, its occurrences in all documents."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    runs = documents.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_length).select("run", F.crc32(F.concat("id", "run")).alias("h"), F.length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    garbled = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(F.col("h") % GARBLED == 0, garbled).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """The place of each bigram, the rarest first: at most 8,100 entries, as letters are 90."""
    letters = words.select(F.split("word", "").alias("c"))
    pairs = letters.select(F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: F.concat(a, b))).alias("gram"))
    counted = pairs.groupBy("gram").agg(F.count("*").alias("n")).collect()
    return {r.gram: i for i, r in enumerate(sorted(counted, key=lambda r: (r.n, r.gram)))}


def rarest(word: str, order: dict[str, int]) -> list[int]:
    """Where a word's rarest bigrams stand."""
    return [i for _, i in heapq.nsmallest(RAREST, ((order[word[i : i + 2]], i) for i in range(len(word) - 1)))]


def rest_hashes(rest: str) -> set[tuple[int, int]]:
    """Length and hash of the rest of a word, and of what is left when one of its code points is taken out, in linear time."""
    codes = [ord(c) for c in rest]
    whole = without = 0
    for c in reversed(codes):
        whole = (whole * BASE + c) % PRIME
    for c in reversed(codes[1:]):
        without = (without * BASE + c) % PRIME
    out, power = {(len(codes), whole)}, 1
    for c, following in zip(codes, [*codes, 0][1:], strict=True):
        out.add((len(codes) - 1, without))
        without, power = (without + (c - following) * power) % PRIME, power * BASE % PRIME
    return out


def _keyed(words: DataFrame, rows: Callable[[dict], Iterator[tuple[int, int]]]) -> DataFrame:
    """word and n with each key and place that `rows` makes of a word's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(k, *x) for k, row in enumerate(batch.to_pylist()) for x in rows(row)]
            at, key, place = zip(*made, strict=True) if made else ((), (), ())
            found = batch.select(["word", "n"]).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(key, pa.int64()), pa.array(place, pa.int32())], names=["word", "n", "key", "place"])

    return words.mapInArrow(run, "word string, n long, key long, place int")


def _sides(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """Rows of a word for either side of each of its rarest bigrams; `place` is where the rest begins, or for the other side -1 less where it ends."""

    def rows(row: dict) -> Iterator[tuple[int, int]]:
        word = row["word"]
        for i in rarest(word, order):
            for part, side, place in ((word[: i + 2], 0, i + 2), (word[i:], 1, -1 - i)):
                yield xxhash.xxh3_64_intdigest(part.encode(), side) - (1 << 63), place

    return _keyed(words.select("word", "n"), rows)


def _rests(crowded: DataFrame) -> DataFrame:
    """The rows of `_sides` with the rest of the word, whole and short of a code point, in the key."""

    def rows(row: dict) -> Iterator[tuple[int, int]]:
        word, place = row["word"], row["place"]
        for size, rest in rest_hashes(word[place:] if place >= 0 else word[: -1 - place]):
            yield hash((row["key"], size, rest)), 0  # of whole numbers: the same in every process

    return _keyed(crowded, rows)


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, n_a, b, n_b: each pair of near words once, a before b."""
    sides = _sides(words, bigram_order(words))
    crowds = sides.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > crowd).select("key", F.lit(True).alias("crowded"))
    sides = sides.join(crowds, "key", "left")

    def met(rows: DataFrame) -> DataFrame:
        a, b = (rows.select("key", F.col("word").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
        return a.join(b, "key").where("a < b").where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")

    return met(sides.where("crowded IS NULL")).unionByName(met(_rests(sides.where("crowded")))).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word and root, the last of its chain of forms, for the words that have a form."""
    up = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = cut(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if up.where("moved").isEmpty():
            return up.select("word", "root")
        up = up.select("word", "root")


def group(documents: DataFrame) -> DataFrame:
    """Per word: n, its form and the form's n, its root, and the number of its near words."""
    words = cut(vocabulary(documents))
    pairs = near_pairs(words)
    sides = F.array(*[F.struct(F.col(w).alias("word"), F.col(f"n_{w}").alias("n"), F.col(x).alias("near"), F.col(f"n_{x}").alias("near_n")) for w, x in (("a", "b"), ("b", "a"))])
    best = pairs.select(F.inline(sides)).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    good = -F.col("best.less") >= RATIO * F.col("n")
    judged = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n"))
    judged = cut(judged)
    return judged.join(_roots(judged.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
