"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of anything but ASCII characters other than letters and digits, with A-Z lower-cased.
A test item's windows are its runs of WIDTH consecutive words; an item with fewer words is one
window. The windows' hashes (of a fixed number of items at a time, so a broadcast has a proven
bound) go to every task, which scans its documents' windows of the same widths, verifies each hit
against the item's words, and gives the hit spans. A larger benchmark is taken in blocks, one at a
time, each a pass over a checkpoint of the documents that numbers their rows; spans of all blocks are
merged by that number, so any number of blocks gives what one would.

Null and empty texts have no words and no hits; repeated rows, also those of equal or null doc_id,
are judged one by one; item_ids are compared as strings, and items of null id count as one item that
the digest of names leaves out. Where both tables or either is empty, there are no hits, and a row for
each document. judge reads doc_id and text only; remove keeps all columns, whatever their names. A very
long text is scanned whole, in memory in proportion to its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import cut, small_batches
from strandflow.llm.textkernel import NON_ALNUM, chunks, raw_text, split_words, window_hash

WIDTH = 13
#: Text bytes and items of the benchmark that one broadcast may hold.
BLOCK_BYTES, BLOCK_ITEMS = 8 << 20, 20_000


class TestSet:
    """Windows of some benchmark items: sorted hashes by width, and each hash's windows as words."""

    def __init__(self, items: list[tuple[str | None, str]], width: int = WIDTH):
        self.windows: dict[int, dict[int, dict[bytes, list[str | None]]]] = {}
        for item, text in items:
            column = pa.array([text or ""])
            buf, offsets = raw_text(column)
            words = split_words(buf, offsets, NON_ALNUM, lower=True)
            n = len(words.hashes)
            if not n:
                continue
            w = min(width, n)
            hashes = window_hash(words.hashes, w)
            spelt = [bytes(buf[s:e]).lower() for s, e in zip(words.starts, words.ends, strict=True)]
            for i in range(n - w + 1):
                owners = self.windows.setdefault(w, {}).setdefault(int(hashes[i]), {}).setdefault(b" ".join(spelt[i : i + w]), [])
                if item not in owners:
                    owners.append(item)
        self.sorted = {w: np.array(sorted(x), dtype=np.uint64) for w, x in self.windows.items()}
        self.filters = {}
        for w, h in self.sorted.items():
            seen = np.zeros(1 << 16, dtype=bool)
            seen[(h & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.filters[w] = seen

    def scan(self, buf: np.ndarray, words) -> Iterator[tuple[int, int, int, list[str | None]]]:
        """Verified hits: document, first word, width, items."""
        if not len(words.hashes):
            return
        doc, room = words.doc(), words.room()
        for w, known in self.sorted.items():
            hashes = window_hash(words.hashes, w)
            maybe = np.flatnonzero(self.filters[w][(hashes & np.uint64(0xFFFF)).astype(np.int64)] & (room >= w))
            at = np.searchsorted(known, hashes[maybe])
            for i in maybe[known[np.minimum(at, len(known) - 1)] == hashes[maybe]]:
                spelt = b" ".join(bytes(buf[s:e]).lower() for s, e in zip(words.starts[i : i + w], words.ends[i : i + w], strict=True))
                if owners := self.windows[w][int(hashes[i])].get(spelt):
                    yield int(doc[i]), int(i - words.first[doc[i]]), w, owners


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark's items in order of id, in lists that each hold a bounded share."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if block and (size + len(row["text"]) * 4 > BLOCK_BYTES or len(block) >= BLOCK_ITEMS):
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"]) * 4
    if block:
        yield block


def several(benchmark: DataFrame) -> tuple[bool, Iterator[list[tuple[str | None, str]]]]:
    """Whether the benchmark takes more than one block, and its blocks (one at least), read as they are used."""
    left = blocks(benchmark)
    head = [x for x in (next(left, []), next(left, None)) if x is not None]
    return len(head) > 1, chain(head, left)


def find(documents: DataFrame, key: str, shared: Broadcast, width: int = WIDTH) -> DataFrame:
    """For one block of the benchmark, a row per document: its key, n_words, hit spans (first word, width), items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = TestSet(shared.value, width)
        for batch, buf, offsets in chunks(batches):
            words = split_words(buf, offsets, NON_ALNUM, lower=True)
            spans: list[list[int]] = [[] for _ in range(batch.num_rows)]
            names: list[set[str | None]] = [set() for _ in range(batch.num_rows)]
            for d, i, w, owners in tests.scan(buf, words):
                spans[d] += [i, w]
                names[d].update(owners)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), pa.array(words.counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array([list(x) for x in names], pa.list_(pa.string()))], names=[key, "n_words", "spans", "items"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n_words long, spans array<int>, items array<string>")


def numbered(documents: DataFrame) -> tuple[DataFrame, str]:
    """A checkpoint of the documents with a number of each row's own, and that column's name."""
    row = "__row"
    while any(c.lower().startswith(row) for c in documents.columns):
        row += "_"
    return cut(documents.withColumn(row, F.monotonically_increasing_id())), row


def merged(rows: DataFrame, row: str, every: Iterator[list[tuple[str | None, str]]], width: int) -> DataFrame:
    """Spans and items of all blocks for each row with a hit; one block at a time is held and broadcast."""
    out = []
    for items in every:
        shared = rows.sparkSession.sparkContext.broadcast(items)
        out.append(cut(find(rows, row, shared, width).where("size(spans) > 0").drop("n_words")))
        shared.destroy()
    return reduce(DataFrame.unionAll, out).groupBy(row).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))


def _judge(found: DataFrame, key: str = "doc_id") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit, items, digest = [], [], []
            for spans, names in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                covered: set[int] = set()
                for i, w in zip(spans[::2], spans[1::2], strict=True):
                    covered.update(range(i, i + w))
                names = set(names)
                hit.append(len(covered))
                items.append(len(names))
                digest.append(hashlib.sha256(",".join(sorted(names - {None})).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array(items, pa.int64()), pa.array(digest, pa.string())], names=[key, "n_words", "n_hit", "n_items", "items_sha256"])

    kind = found.schema[key].dataType.simpleString()
    judged = found.mapInArrow(run, f"`{key}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string")
    return judged.withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def _judge_rows(rows: DataFrame, row: str, key: str, every: Iterator[list[tuple[str | None, str]]], width: int) -> DataFrame:
    """Verdicts over all blocks, with the column `key` of `rows`."""
    hits = merged(rows, row, every, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in chunks(batches):
            counts = split_words(buf, offsets, NON_ALNUM, lower=True).counts
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("__key")), batch.column(batch.schema.get_field_index(row)), pa.array(counts, pa.int64())], names=["__key", row, "n_words"])

    kind = rows.schema[key].dataType.simpleString()
    counted = rows.select(F.col(key).alias("__key"), row, "text").mapInArrow(run, f"__key {kind}, `{row}` long, n_words long")
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    found = counted.join(hits, row, "left").select(F.col("__key").alias(key), "n_words", none("spans", "array<int>").alias("spans"), none("items", "array<string>").alias("items"))
    return _judge(found, key)


def judge(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document row: words, hit words, items met and their digest, and whether a twentieth is hit."""
    small_batches(documents.sparkSession)
    many, every = several(benchmark)
    if not many:
        return _judge(find(documents, "doc_id", documents.sparkSession.sparkContext.broadcast(next(every)), width))
    rows, row = numbered(documents.select("doc_id", "text"))
    return _judge_rows(rows, row, "doc_id", every, width)


def remove(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, whole: bool = True) -> DataFrame:
    """The documents, with all their columns, without the contaminated ones (whole) or without hit spans.

    Removing spans cuts the hit words out of the text, with what separates them from the next word.
    """
    small_batches(documents.sparkSession)
    names, kinds = documents.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    many, every = several(benchmark)
    known = None
    if many:  # a document's hits in all blocks count together
        rows, row = numbered(documents)
        if whole:
            bad = _judge_rows(rows, row, row, every, width).where("contaminated").select(row)
            return rows.join(bad, row, "left_anti").select(*names)
        known = f"{row}_spans"
        documents = rows.join(merged(rows, row, every, width).select(row, F.col("spans").alias(known)), row, "left").select(*names, known)
    shared = None if many else documents.sparkSession.sparkContext.broadcast(next(every))

    def hits(tests: TestSet | None, batch: pa.RecordBatch, buf: np.ndarray, words) -> Iterator[tuple[int, int, int]]:
        if tests:
            yield from (x[:3] for x in tests.scan(buf, words))
            return
        for d, spans in enumerate(batch.column(batch.schema.get_field_index(known)).to_pylist()):
            yield from ((d, i, w) for i, w in zip((spans or [])[::2], (spans or [])[1::2], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = TestSet(shared.value, width) if shared else None
        for batch, buf, offsets in chunks(batches):
            words = split_words(buf, offsets, NON_ALNUM, lower=True)
            hit = np.zeros(len(words.hashes) + 1, dtype=bool)
            for d, i, w in hits(tests, batch, buf, words):
                hit[words.first[d] + i : words.first[d] + i + w] = True
            sums = np.concatenate([[0], np.cumsum(hit[:-1])])
            n_hit = sums[words.first[1:]] - sums[words.first[:-1]]
            if whole:
                yield batch.filter(pa.array(~((n_hit > 0) & (20 * n_hit >= words.counts))))
                continue
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            for d in np.flatnonzero(n_hit):
                keep = np.ones(offsets[d + 1] - offsets[d], dtype=bool)
                for i in range(words.first[d], words.first[d + 1]):
                    if hit[i]:
                        end = words.starts[i + 1] if i + 1 < words.first[d + 1] else words.ends[i]
                        keep[words.starts[i] - offsets[d] : end - offsets[d]] = False
                texts[d] = buf[offsets[d] : offsets[d + 1]][keep].tobytes().decode()
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents.mapInArrow(run, kinds)
