"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without white space at both ends and with A-Z lower-cased, if it has
MIN_CHARS code points or more; it is known by its 128-bit BLAKE2b digest. The state is three tables:

* `holders`: each key with each document that holds it, once;
* `keys`: each key's reference count (the documents that hold it) and the largest of them;
* `filters`: a row per shard of keys, a cuckoo filter of those that MIN_DOCS documents hold.

Inserting documents adds what is new to them and counts it; deleting documents, named by their ids,
takes their holders away, counts down, and asks the holders left for the largest of the keys
concerned: no text is read. Keys that cross the threshold enter or leave the filter of their shard, so
any sequence of insertions and deletions gives what the remaining documents alone would give.

Deduping documents screens their lines by the filters and joins what passes to the exact table; lines
that a larger document keeps go, with all their repeats. Filters are broadcast while they stay under
FILTER_BYTES; beyond that a shard's keys are sent to its filter, in SALTS parts by document with a copy of
the filter each, and screened as they come. A key that a third of all
documents hold is counted by partial sums, and its join is one that Spark splits as skewed.

Null and empty texts are one empty line and stay null or empty. Rows with equal doc_id are one
document: a line that only they hold counts once, and is kept in all of them if it is kept. A null
doc_id counts as the smallest. Deleting a document that never came, or inserting one again, changes
nothing. An empty table gives an empty one. All columns are kept; n_lines and n_dropped replace
columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import KEY, cut, group_count, key_column, keyed, small_batches
from strandflow.llm.textkernel import LOWER, SPACE, chunks, ids_of, long_digests

MIN_CHARS, MIN_DOCS = 40, 5
#: What a broadcast of all shards' filters may take.
FILTER_BYTES = 32 << 20
#: Documents whose lines one shard takes on.
DOCS_A_SHARD = 20_000
#: Parts of a shard's keys, by document, where filters are not broadcast.
SALTS = 16
#: A key's digest, in two columns.
DIGEST = ["__one", "__two"]


class CuckooFilter:
    """16-bit fingerprints in buckets of four; keys are 64-bit digests. It grows when it is full."""

    def __init__(self, slots: int):
        self.n = 1 << max(2, (slots // 3).bit_length())
        self.table = np.zeros((self.n, 4), np.uint16)

    @classmethod
    def of(cls, keys: np.ndarray) -> "CuckooFilter":
        size = len(keys)
        while True:
            out = cls(size)
            if all(out.insert(int(k)) for k in keys):
                return out
            size = size * 2 + 4

    @staticmethod
    def _print(key: int) -> int:
        return (key >> 48) or 1

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.n - 1)

    def insert(self, key: int) -> bool:
        """False if there is no room; the caller then builds a larger filter from the exact table."""
        mark, bucket = self._print(key), key & (self.n - 1)
        for turn in range(500):
            for at in (bucket, self._other(bucket, mark)):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = mark
                    return True
            slot = turn & 3
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = self._other(bucket, mark)
        return False

    def delete(self, key: int) -> bool:
        mark, bucket = self._print(key), key & (self.n - 1)
        for at in (bucket, self._other(bucket, mark)):
            found = np.flatnonzero(self.table[at] == mark)
            if len(found):
                self.table[at, found[0]] = 0
                return True
        return False

    def holds(self, keys: np.ndarray) -> np.ndarray:
        mark = np.maximum(keys >> np.uint64(48), np.uint64(1))
        low = np.uint64(self.n - 1)
        one = keys & low
        two = (one ^ (mark * np.uint64(0x5BD1E995))) & low
        mark = mark.astype(np.uint16)[:, None]
        return (self.table[one.astype(np.int64)] == mark).any(1) | (self.table[two.astype(np.int64)] == mark).any(1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "CuckooFilter":
        out = cls(0)
        out.table = np.frombuffer(data, np.uint16).reshape(-1, 4).copy()
        out.n = len(out.table)
        return out


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line of the texts, and each text's first line (n + 1 entries)."""
    breaks = np.flatnonzero(buf == 10)
    before = np.searchsorted(breaks, offsets)
    first = before + np.arange(len(offsets))
    starts = np.zeros(first[-1], np.int64)
    ends = np.zeros(first[-1], np.int64)
    doc = np.searchsorted(offsets, breaks, side="right") - 1
    starts[first[:-1]] = offsets[:-1]
    starts[np.arange(len(breaks)) + doc + 1] = breaks + 1
    ends[first[1:] - 1] = offsets[1:]
    ends[np.arange(len(breaks)) + doc] = breaks
    return starts, ends, first


def line_keys(buf: np.ndarray, offsets: np.ndarray, min_chars: int, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which lines have a key that is long enough (of `some` texts only), the digest of each, and first lines of texts."""
    starts, ends, first = line_spans(buf, offsets)
    lines = np.arange(len(starts)) if some is None else np.flatnonzero(np.repeat(some, np.diff(first)))
    if not len(lines) or not len(buf):
        return lines[:0], np.zeros((0, 2), np.uint64), first
    text = np.flatnonzero(~SPACE[buf])  # ends of a line's key: the first and last characters that are no space
    lo, hi = np.searchsorted(text, starts[lines]), np.searchsorted(text, ends[lines])
    full = hi > lo
    lines, a, b = lines[full], text[lo[full]], text[hi[full] - 1] + 1
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    long = points[b] - points[a] >= min_chars
    lines, a, b = lines[long], a[long], b[long]
    return lines, long_digests(LOWER[buf].tobytes(), a, b), first


def _pairs(documents: DataFrame, min_chars: int, screen=None, shards: int = 0) -> DataFrame:
    """A row per document row and key: DIGEST, KEY; with `screen`, a broadcast of filters by shard, only keys that pass."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {s: CuckooFilter.from_bytes(f) for s, f in screen.value.items()} if screen else None
        for batch, buf, offsets in chunks(batches):
            lines, keys, first = line_keys(buf, offsets, min_chars)
            if filters is not None:
                go, shard = np.zeros(len(lines), bool), shard_of(keys[:, 0], shards)
                for s in np.unique(shard).tolist():
                    if s in filters:
                        at = np.flatnonzero(shard == s)
                        go[at] = filters[s].holds(keys[at, 0])
                lines, keys = lines[go], keys[go]
            doc = np.searchsorted(first, lines, side="right") - 1
            order = np.lexsort((keys[:, 1], keys[:, 0], doc))
            keys, doc = keys[order], doc[order]
            new = np.ones(len(doc), bool)  # a text's repeats of a line
            new[1:] = (keys[1:] != keys[:-1]).any(1) | (doc[1:] != doc[:-1])
            one, two = np.ascontiguousarray(keys[new].view(np.int64).T)
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(ids_of(batch, KEY)[doc[new]])], names=[*DIGEST, KEY])

    return keyed(documents, "text").mapInArrow(run, f"{DIGEST[0]} long, {DIGEST[1]} long, {KEY} long")


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys % np.uint64(shards)).astype(np.int64)


def _shard_column(shards: int) -> Column:
    """The same of the signed column."""
    one = F.col(DIGEST[0])
    return F.pmod(F.pmod(one, F.lit(shards)) + F.when(one < 0, F.lit((1 << 64) % shards)).otherwise(0), F.lit(shards)).cast("int").alias("shard")


def _new_filter(table: pa.Table) -> pa.Table:
    keys = table.column(DIGEST[0]).to_numpy().view(np.uint64)
    return pa.table({"shard": table.column("shard").slice(0, 1), "filter": pa.array([CuckooFilter.of(keys).to_bytes()], pa.binary())})


def _changed_filter(events: pa.Table, state: pa.Table) -> pa.Table:
    """The shard's filter after its keys came and went; null if it must be made anew, as it has no room."""
    shard = (events if events.num_rows else state).column("shard").slice(0, 1)
    old = state.column("filter")[0].as_py() if state.num_rows else None
    filter_ = CuckooFilter.from_bytes(old) if old else None
    for key, comes in zip(events.column(DIGEST[0]).to_numpy().view(np.uint64).tolist(), events.column("comes").to_pylist(), strict=True):
        if filter_ and not (filter_.insert(key) if comes else filter_.delete(key)):
            filter_ = None
    return pa.table({"shard": shard, "filter": pa.array([filter_.to_bytes() if filter_ else None], pa.binary())})


class LineIndex:
    """The state; `save` keeps it between runs."""

    def __init__(self, holders: DataFrame, keys: DataFrame, filters: DataFrame, shards: int, min_chars: int, min_docs: int):
        self.holders, self.keys, self.filters = holders, keys, filters
        self.shards, self.min_chars, self.min_docs = shards, min_chars, min_docs

    @classmethod
    def build(cls, documents: DataFrame, shards: int | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> "LineIndex":
        shards = shards or group_count(documents, DOCS_A_SHARD)
        holders = _pairs(documents, min_chars).distinct()
        keys = cut(holders.groupBy(*DIGEST).agg(F.count("*").alias("n"), F.max(KEY).alias("largest")).select(_shard_column(shards), *DIGEST, "n", "largest"))
        return cls(holders, keys, cut(cls._filters(keys, min_docs)), shards, min_chars, min_docs)

    @staticmethod
    def _filters(keys: DataFrame, min_docs: int) -> DataFrame:
        return keys.where(F.col("n") >= min_docs).select("shard", DIGEST[0]).groupBy("shard").applyInArrow(_new_filter, "shard int, filter binary")

    def save(self, folder: str) -> None:
        for name in ("holders", "keys", "filters"):
            getattr(self, name).write.mode("errorifexists").parquet(f"{folder}/{name}")
        rows = [(self.shards, self.min_chars, self.min_docs)]
        self.keys.sparkSession.createDataFrame(rows, "shards int, min_chars int, min_docs int").write.parquet(f"{folder}/settings")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> "LineIndex":
        return cls(*(spark.read.parquet(f"{folder}/{name}") for name in ("holders", "keys", "filters")), *spark.read.parquet(f"{folder}/settings").first())

    def _with(self, holders: DataFrame, keys: DataFrame) -> "LineIndex":
        """The state of these holders and keys, which have the count before as `was`."""
        keys, hot = cut(keys), lambda n: F.coalesce(F.col(n), F.lit(0)) >= self.min_docs
        events = keys.where(hot("n") != hot("was")).select("shard", DIGEST[0], hot("n").alias("comes"))
        changed = cut(events.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_changed_filter, "shard int, filter binary"))
        keys = keys.where("n > 0").drop("was")
        anew = self._filters(keys.join(changed.where("filter is null").select("shard"), "shard", "left_semi"), self.min_docs)
        filters = cut(changed.where("filter is not null").unionByName(anew))
        return LineIndex(cut(holders), keys, filters, self.shards, self.min_chars, self.min_docs)

    def insert(self, documents: DataFrame) -> "LineIndex":
        new = cut(_pairs(documents, self.min_chars).distinct().join(self.holders, [*DIGEST, KEY], "left_anti"))
        more = new.groupBy(*DIGEST).agg(F.count("*").alias("more"), F.max(KEY).alias("high"))
        none = lambda c: F.coalesce(F.col(c), F.lit(0))
        keys = self.keys.join(more, DIGEST, "full").select(_shard_column(self.shards), *DIGEST, (none("n") + none("more")).alias("n"), F.greatest("largest", "high").alias("largest"), F.col("n").alias("was"))
        return self._with(self.holders.unionByName(new), keys)

    def delete(self, documents: DataFrame) -> "LineIndex":
        """Take out again every document whose doc_id is among those of `documents`; no other column is read."""
        ids = keyed(documents).distinct()
        fewer = cut(self.holders.join(ids, KEY, "left_semi").groupBy(*DIGEST).agg(F.count("*").alias("fewer")))
        left = cut(self.holders.join(ids, KEY, "left_anti"))
        high = left.join(fewer, DIGEST, "left_semi").groupBy(*DIGEST).agg(F.max(KEY).alias("high"))
        n = F.col("n") - F.coalesce("fewer", F.lit(0))
        largest = F.when(F.col("fewer").isNull(), F.col("largest")).otherwise(F.col("high")).alias("largest")
        keys = self.keys.join(fewer, DIGEST, "left").join(high, DIGEST, "left").select("shard", *DIGEST, n.alias("n"), largest, F.col("n").alias("was"))
        return self._with(left, keys)

    def dedup(self, documents: DataFrame, text: str = "text") -> DataFrame:
        """All rows and columns, with `text` without repeated lines, and n_lines and n_dropped."""
        names = [f for f in documents.columns if f.lower() not in ("n_lines", "n_dropped")]
        plain = [f"c{i}" for i in range(len(names))]  # no name that a table has can clash
        rows = documents.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, plain, strict=True)])
        c_text, c_id = (plain[[n.lower() for n in names].index(x)] for x in (text.lower(), "doc_id"))
        gone = self._repeats(rows.select(F.col(c_id).alias("doc_id"), F.col(c_text).alias("text")))
        min_chars = self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, buf, offsets in chunks(batches, c_text):
                at = lambda n: batch.column(batch.schema.get_field_index(n))
                known = at("__gone")
                some = known.is_valid().to_numpy(zero_copy_only=False)
                lines, keys, first = line_keys(buf, offsets, min_chars, some)
                column, dropped = at(c_text), np.zeros(batch.num_rows, np.int64)
                if some.any():
                    texts, edges, one = column.to_pylist(), np.searchsorted(lines, first), keys.view(np.int64)
                    for d in np.flatnonzero(some):
                        bad = {(k[DIGEST[0]], k[DIGEST[1]]) for k in known[int(d)].as_py()}
                        drop = {int(lines[i] - first[d]) for i in range(edges[d], edges[d + 1]) if (int(one[i, 0]), int(one[i, 1])) in bad}
                        if drop:
                            texts[d] = "\n".join([x for i, x in enumerate(texts[d].split("\n")) if i not in drop])
                        dropped[d] = len(drop)
                    column = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*[column if c == c_text else at(c) for c in plain], pa.array(np.diff(first), pa.int64()), pa.array(dropped, pa.int64())], names=[*plain, "n_lines", "n_dropped"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        joined = rows.select(key_column(c_id), *plain).join(gone.hint("shuffle_hash"), KEY, "left")
        return joined.mapInArrow(run, f"{kinds}, n_lines long, n_dropped long").toDF(*names, "n_lines", "n_dropped")

    def _screened(self, asked: DataFrame) -> DataFrame:
        """The pairs whose key passes its shard's filter; filters and keys meet by shard and part, a part's filter first."""
        salted = asked.select(_shard_column(self.shards), F.pmod(F.xxhash64(KEY), F.lit(SALTS)).cast("int").alias("salt"), F.lit(None).cast("binary").alias("filter"), *DIGEST, KEY)
        none = [F.lit(None).cast("long").alias(c) for c in (*DIGEST, KEY)]
        filters = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "filter", *none)
        both = filters.unionByName(salted).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, filter_ = None, None
            for batch in batches:
                parts = np.stack([batch.column(i).to_numpy() for i in (0, 1)], 1)
                edges = np.flatnonzero(np.concatenate([[True], (parts[1:] != parts[:-1]).any(1)])) if len(parts) else []
                for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                    rows = batch.slice(a, b - a)
                    if tuple(parts[a]) != part:
                        part, filter_ = tuple(parts[a]), None
                    if rows.column(2)[0].is_valid:  # a part has one filter, its first row
                        filter_ = CuckooFilter.from_bytes(rows.column(2)[0].as_py())
                        rows = rows.slice(1)
                    if filter_ is not None and rows.num_rows:
                        go = filter_.holds(rows.column(3).to_numpy().view(np.uint64))
                        yield rows.select([*DIGEST, KEY]).filter(pa.array(go))

        return both.mapInArrow(run, f"{DIGEST[0]} long, {DIGEST[1]} long, {KEY} long")

    def _repeats(self, documents: DataFrame) -> DataFrame:
        """KEY and `__gone`: digests of the document's lines that a larger document keeps."""
        screen = None
        if (self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0) <= FILTER_BYTES:
            rows = self.filters.select("shard", "filter").toLocalIterator()  # of a checked size
            screen = documents.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in rows})
        asked = _pairs(documents, self.min_chars, screen, self.shards)
        asked = asked if screen else self._screened(asked)
        hot = self.keys.where(F.col("n") >= self.min_docs).select(*DIGEST, "largest")
        return asked.join(hot, DIGEST).where(F.col(KEY) != F.col("largest")).groupBy(KEY).agg(F.collect_set(F.struct(*DIGEST)).alias("__gone"))


def dedup(documents: DataFrame) -> DataFrame:
    """The documents without lines that MIN_DOCS documents hold, but for the largest one's."""
    return LineIndex.build(documents).dedup(documents)


def digests(documents: DataFrame) -> DataFrame:
    kept = dedup(documents.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
