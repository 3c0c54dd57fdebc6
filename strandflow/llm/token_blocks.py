"""Token-id output: documents in ascending doc_id order as range-coded binary blocks.

Texts are encoded by the tokenizers library and get an end id each. Documents are dealt out by
ranges of doc_id, so files follow each other in order, and within a file blocks do. A block holds
whole documents of about BLOCK_IDS ids (a longer document has a block of its own) and is coded on
its own, see range_coder. Files are Parquet files of one row per block: file and block number, the
documents' ids and lengths, and the block's bytes; Spark's committer writes them, so lost executors
and repeated tasks leave no half files. Where a document starts in the whole stream is the sum of
the files before, of the file's blocks before and of the block's documents before.

Texts are cut, on their bytes and with numpy, where a match of the tokenizer's pattern surely ends: at
ASCII white space after a character that is no white space, and at ASCII punctuation after an ASCII or
Latin-1 letter or an ASCII digit. What stands before and behind such a place is encoded alike alone. A
task asks the library for each distinct piece once and keeps up to MEMORY of them, by 128-bit digest.

Null and empty texts have the end id only; a null doc_id comes first; documents with equal doc_id come
in order of a hash of their texts, each with its own row; an empty table gives an empty one. Only
doc_id and text are read; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.llm import range_coder
from strandflow.llm.common import KEY, NO_ID, cut, keyed, partitions, remove_folder, shared_folder, small_batches
from strandflow.llm.textkernel import SPACE, chunks, ids_of, span_digest

BLOCK_IDS = 1 << 21
#: Pieces whose ids a task remembers; the memory is emptied when it is full.
MEMORY = 1_500_000

_BYTES = np.arange(256)
_VISIBLE = (_BYTES > 32) & (_BYTES < 127)
_ALNUM = np.isin(_BYTES, np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))
_MARK = _VISIBLE & ~_ALNUM


def cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces of the texts start: where texts do, and inside them where a match surely ends."""
    at = np.zeros(len(buf), bool)
    at[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    if len(buf) < 2:
        return np.flatnonzero(at)
    here, before = buf[1:], buf[:-1]
    ends = _VISIBLE[before]
    word = _ALNUM[before]
    wide = np.flatnonzero(before > 127)  # characters of more bytes: none that is white space ends a piece
    if len(wide):
        last = before[wide]
        one = np.where(wide > 0, buf[wide - 1], 0)
        two = np.where(wide > 1, buf[wide - 2], 0)
        blank = (one == 0xC2) & ((last == 0x85) | (last == 0xA0)) | (one == 0x80) & ((two == 0xE2) | (two == 0xE3)) | (one == 0x9A) & (two == 0xE1) | (one == 0x81) & (two == 0xE2)
        ends[wide] = ~blank
        word[wide] = (one == 0xC3) & (last != 0x97) & (last != 0xB7)
    at[1:] |= (SPACE[here] & ends) | (_MARK[here] & word)
    return np.flatnonzero(at)


class Encoder:
    """Ids of whole texts, as the library gives them."""

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.symbols = self.library.get_vocab_size() + 1
        self.size_of = np.zeros(self.symbols, np.int64)
        for token, i in self.library.get_vocab().items():
            self.size_of[i] = len(token)  # a character of a token's name stands for a byte
        self.memory = memory
        self._empty()

    def _empty(self) -> None:
        self.one = np.zeros(0, np.uint64)  # sorted, with each piece's number
        self.number = np.zeros(0, np.int64)
        self.two, self.first, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def ask(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces by the library: each one's number of ids, and the ids.

        Pieces that begin with a space and end with a visible ASCII character are asked for in one text.
        """
        plain = np.array([p[:1] == b" " and 32 < p[-1] < 127 for p in pieces], bool)
        parts: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        at = np.flatnonzero(plain)
        if len(at):
            some = [pieces[i] for i in at]
            ids = np.array(self.library.encode_batch_fast([b"".join(some).decode()], add_special_tokens=False)[0].ids, np.int32)
            edges = np.searchsorted(np.cumsum(self.size_of[ids]), np.cumsum([len(p) for p in some]))
            for i, part in zip(at, np.split(ids, edges[:-1] + 1), strict=True):
                parts[i] = part
        at = np.flatnonzero(~plain)
        if len(at):
            for i, found in zip(at, self.library.encode_batch_fast([pieces[i].decode() for i in at], add_special_tokens=False), strict=True):
                parts[i] = np.array(found.ids, np.int32)
        return np.array([len(p) for p in parts], np.int64), np.concatenate(parts)

    def _numbers(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The numbers of pieces, -1 for those not remembered."""
        if not len(self.one):
            return np.full(len(one), -1)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        number = self.number[at]
        return np.where((self.one[at] == one) & (self.two[number] == two), number, -1)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids, one text after another, and each text's number of ids."""
        starts = cuts(buf, offsets)
        ends = np.append(starts[1:], len(buf))[: len(starts)]
        one, two = span_digest(buf, starts, ends)
        order = np.argsort(one, kind="stable")
        s1, s2 = one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
        kind = np.empty(len(order), np.int64)  # each piece's place among the distinct ones
        kind[order] = np.cumsum(new) - 1
        which, d1, d2 = order[new], s1[new], s2[new]
        number = self._numbers(d1, d2)
        missed = np.flatnonzero(number < 0)
        if len(missed) and len(self.two) + len(missed) > self.memory:
            self._empty()
            number[:] = -1
            missed = np.arange(len(number))
        if len(missed):
            size, ids = self.ask([buf[starts[i] : ends[i]].tobytes() for i in which[missed]])
            number[missed] = len(self.two) + np.arange(len(missed))
            at = np.searchsorted(self.one, d1[missed])
            self.one, self.number = np.insert(self.one, at, d1[missed]), np.insert(self.number, at, number[missed])
            self.two, self.ids = np.concatenate([self.two, d2[missed]]), np.concatenate([self.ids, ids])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        each = number[kind]
        n = self.first[each + 1] - self.first[each]
        flat = np.arange(n.sum()) + np.repeat(self.first[each] - (np.cumsum(n) - n), n)
        sums = np.concatenate([[0], np.cumsum(n)])
        return self.ids[flat], np.diff(sums[np.searchsorted(starts, offsets)])


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write(documents: DataFrame, tokenizer: str, folder: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Write the documents' blocks to the folder."""
    spark = documents.sparkSession
    small_batches(spark)
    ordered = keyed(documents, "text").withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(partitions(spark), KEY, "tie").sortWithinPartitions(KEY, "tie").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, encoder = TaskContext.get().partitionId(), _encoder(tokenizer)
        docs: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        number = size = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            row = [[file], [number], [len(ids)], [np.concatenate(docs).tobytes()], [np.concatenate(lengths).tobytes()], [range_coder.encode(ids, encoder.symbols)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["file", "block", "n_ids", "docs", "lengths", "data"])

        for batch, buf, offsets in chunks(batches):
            keys, (ids, n) = ids_of(batch, KEY), encoder.encode(buf, offsets)
            ids = np.insert(ids.astype(np.uint32), np.cumsum(n), np.uint32(end_id))
            n = n + 1
            edges = np.concatenate([[0], np.cumsum(n)])
            at = 0
            while at < len(n):  # as many of the texts as the block has room for
                to = max(int(np.searchsorted(edges, edges[at] + block_ids - size, side="right")) - 1, at if size else at + 1)
                if to > at:
                    docs.append(keys[at:to])
                    lengths.append(n[at:to])
                    parts.append(ids[edges[at] : edges[to]])
                    size, at = size + int(edges[to] - edges[at]), to
                if at < len(n):
                    yield flush()
                    docs, parts, lengths, number, size = [], [], [], number + 1, 0
        if size:
            yield flush()

    ordered.mapInArrow(run, "file int, block int, n_ids long, docs binary, lengths binary, data binary").write.mode("errorifexists").parquet(folder)


def read(spark: SparkSession, folder: str, symbols: int) -> DataFrame:
    """KEY, start, and the document's ids (`ids binary`, little-endian 32 bits), from the files."""
    blocks = spark.read.parquet(folder)
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("total"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("file", before(Window.orderBy("file"), "total").alias("file_start"))  # a row per file
    inside = blocks.select("file", "block", before(Window.partitionBy("file").orderBy("block"), "n_ids").alias("block_start"))
    starts = inside.join(files, "file").select("file", "block", (F.col("file_start") + F.col("block_start")).alias("base"))
    rows = blocks.join(starts, ["file", "block"]).select("base", "docs", "lengths", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, docs, lengths, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids, n = range_coder.decode(data, symbols).astype("<u4"), np.frombuffer(lengths, np.int64)
                ends = np.cumsum(n)
                parts = [ids[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(docs, np.int64)), pa.array(base + ends - n), pa.array(parts, pa.binary())], names=[KEY, "start", "ids"])

    return rows.mapInArrow(run, f"{KEY} long, start long, ids binary")


def digests(documents: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the blocks, read them back and give each document's place, length and checksum."""
    spark = documents.sparkSession
    folder = shared_folder(spark, "token-blocks")
    write(documents, tokenizer, folder, end_id)
    back = read(spark, folder, _encoder(tokenizer).symbols)
    kind = documents.schema["doc_id"].dataType.simpleString()
    out = cut(back.select(F.when(F.col(KEY) != NO_ID, F.col(KEY)).cast(kind).alias("doc_id"), "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")))
    remove_folder(spark, folder)  # the query's rows are few bytes for a document, its blocks many
    return out
