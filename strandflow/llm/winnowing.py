"""Document fingerprints by winnowing, in DataFrame functions only.

A text is lower-cased and cut into pieces: up to three characters that are no white space, counted
from the start of their word, so that a piece depends on its own word alone; a character from U+2E80 on
(scripts without spaces) is a piece by itself. Rolling hashes of K pieces are built from each other by
shifts (of 1, 2, 4 and K pieces), none from its pieces anew. Of every W hashes in a row the least is
kept, of equal ones the rightmost, once, with its position in pieces. So two texts that share a passage
of K + W - 1 whole pieces share a kept hash, and no passage of fewer than K pieces makes one.

A text of fewer than K pieces, but not none, has one hash of all; one of fewer than W hashes keeps the
least of all. Null and empty texts, and white space alone, have no hashes; two fingerprints without
hashes are alike (1), one with and one without are not (0). The likeness of two fingerprints is that of
the sets of their hashes: shared by all. Equal texts have equal fingerprints.

Each document is also compared with an edited text and with the next document, in descending order of
doc_id (null last; rows of equal doc_id by the digest of their texts, copies of a row next to each
other), the last one's next being the first. The order is made of ids, digests and lengths; texts move
twice, once to meet their place and once, as far as it is needed, to the document before. A table of
one row is its own next; an empty table gives an empty one. Every row has a result row. Only doc_id and
text are read; other columns, whatever their names, are left out. A very long text is fingerprinted
whole, as arrays inside one row of its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm.common import KEY, key_column
from strandflow.shared import numbered

#: Pieces of a hash, and hashes of a window (a power of two).
K, W = 6, 16
PIECE = r"[^\x09-\x0D\x20\x{2E80}-\x{10FFFF}]{1,3}|[\x{2E80}-\x{10FFFF}]"
#: The rolling hash: a prime below 2**31, and a base.
PRIME, BASE = (1 << 31) - 1, 1_103_515_245
_LAST = (1 << 31) - 1
_REST = 1 << 30


def _rolled(a: str, b: str, shift: int, width: int) -> Column:
    """Hashes of `a`, each followed by that of the `width` pieces in `b` that stand `shift` pieces on; null where none stands there."""
    by = F.lit(pow(BASE, width, PRIME))
    return F.zip_with(a, F.slice(b, shift + 1, _REST), lambda x, y: (x * by + y) % PRIME)


def prints(df: DataFrame, text: str, name: str) -> DataFrame:
    """The table with `name`, the kept hashes of the column `text` in order of position: array of (hash, pos)."""
    out = df.withColumn("__1", F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(PIECE), F.lit(0)), lambda p: F.pmod(F.xxhash64(p), F.lit(PRIME))))
    out = out.withColumn("__2", _rolled("__1", "__1", 1, 1))
    out = out.withColumn("__4", _rolled("__2", "__2", 2, 2)).withColumn("__6", _rolled("__4", "__2", 4, 2))
    few = F.transform(F.array(F.lit(0)), lambda _: F.aggregate("__1", F.lit(0).cast("long"), lambda h, u: (h * BASE + u) % PRIME))
    grams = F.when(F.size("__1") >= K, F.slice("__6", F.lit(1), F.greatest(F.size("__1") - (K - 1), F.lit(0)))).when(F.size("__1") > 0, few).otherwise(F.array().cast("array<bigint>"))
    # one number for hash and position: the least of a window is the least hash, the rightmost of equal ones
    out = out.withColumn("__v", F.transform(grams, lambda g, i: F.shiftleft(g, 32) + (F.lit(_LAST) - i))).drop("__1", "__2", "__4", "__6")
    out, least, shift = out.withColumn("__size", F.size("__v")), "__v", 1
    while shift < W:
        out = out.withColumn(f"__m{shift}", F.zip_with(least, F.slice(least, shift + 1, _REST), lambda x, y: F.least(x, y)))
        least, shift = f"__m{shift}", 2 * shift
    kept = F.when(F.col("__size") >= W, F.slice(least, F.lit(1), F.greatest(F.col("__size") - (W - 1), F.lit(0)))).when(F.col("__size") > 0, F.array(F.array_min("__v"))).otherwise(F.col("__v"))
    one = lambda v: F.struct(F.shiftright(v, 32).cast("int").alias("hash"), (F.lit(_LAST) - v.bitwiseAND(F.lit((1 << 32) - 1))).cast("int").alias("pos"))
    return out.withColumn(name, F.transform(F.array_distinct(kept), one)).select(*df.columns, name)


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and its `prints`, the kept hashes with their positions."""
    return prints(documents.select("doc_id", "text"), "text", "prints").select("doc_id", "prints")


def hashes(kept: str) -> Column:
    return F.transform(kept, lambda p: p["hash"])


def likeness(a: str, b: str) -> Column:
    """Of two arrays of hashes: the share of all their hashes that both have."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both.cast("double") / F.greatest(either, F.lit(1)))


def written(a: str) -> Column:
    """Hashes as text, eight hexadecimal digits each, in order of position."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h.cast("long")), 8, "0")), " ")


def _links(documents: DataFrame) -> DataFrame:
    """Per distinct (KEY, digest): how many rows it has, and the row before the first of them in the order: its key, digest, ordinal and length."""
    rows = documents.groupBy(KEY, "__digest").agg(F.count("*").alias("__rows"), F.first("__n").alias("__n"), F.max("doc_id").alias("doc_id"))
    placed = numbered(rows, "__place", F.col("doc_id").desc_nulls_last(), F.col("__digest"))
    total = placed.count()
    before = placed.select(((F.col("__place") + 1) % F.lit(max(total, 1))).alias("__place"), F.col(KEY).alias("__to"), F.col("__digest").alias("__to_digest"), F.col("__rows").alias("__to_row"), F.col("__n").alias("__to_n"))
    return placed.select("__place", KEY, "__digest", "__rows").join(before, "__place").drop("__place", "__rows")


def compare(documents: DataFrame) -> DataFrame:
    """Per document: its and its edited text's hashes, the edited text, and how like they and the next document are.

    Both sides of the last join read all of `own`'s columns, so that Spark makes it, with its hashes, once.
    """
    texts = documents.select(key_column(), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("__digest", F.md5("text")).withColumn("__n", F.length("text"))
    links = _links(texts.drop("text"))
    own = prints(texts, "text", "__prints").withColumn("hashes", hashes("__prints")).drop("__prints")
    row = F.row_number().over(Window.partitionBy(KEY, "__digest").orderBy(F.lit(0)))  # of equal rows: which one is which tells nothing
    own = own.withColumn("__row", row).join(links, [KEY, "__digest"])
    first = F.col("__row") == 1
    sent = own.select(
        F.when(first, F.col("__to")).otherwise(F.col(KEY)).alias(KEY), F.when(first, F.col("__to_digest")).otherwise(F.col("__digest")).alias("__digest"),
        F.when(first, F.col("__to_row")).otherwise(F.col("__row") - 1).alias("__for"), F.expr("left(text, CAST(floor((CASE WHEN __row = 1 THEN __to_n ELSE __n END) / 2) AS INT))").alias("__head"), F.col("hashes").alias("next_hashes"), F.col("doc_id").alias("next_doc_id"),
    )
    met = own.select(KEY, "__digest", "__row", "doc_id", "text", "__n", "hashes").join(sent, [KEY, "__digest"]).where(F.col("__row") - F.col("__for") == 0)
    edited = met.withColumn("edited", F.concat(F.expr("left(text, __n - CAST(floor(__n / 2) AS INT))"), "__head"))
    edited = prints(edited.select("doc_id", F.col("__n").cast("long").alias("n_chars"), "hashes", "next_hashes", "next_doc_id", "edited"), "edited", "__prints").withColumn("edited_hashes", hashes("__prints"))
    return edited.select("doc_id", "n_chars", "next_doc_id", "edited", "hashes", "edited_hashes", likeness("hashes", "edited_hashes").alias("near_edited"), likeness("hashes", "next_hashes").alias("near_next"))


def digests(documents: DataFrame) -> DataFrame:
    """The results as plain columns: the edited text's digest, fingerprints as text, likenesses."""
    return compare(documents).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written("hashes").alias("fingerprint"), written("edited_hashes").alias("edited_fingerprint"), "near_edited", "near_next", "next_doc_id")
