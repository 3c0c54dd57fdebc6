"""Which hashes occur in more than one document, without a row per hash.

Each task packs the hashes of its documents into one binary row per hash range, every distinct hash
once; one that two of the task's documents share is known as shared there and then. So a hash that
stands in a third of all documents costs a range one entry per task, not one per document. Ranges
meet by a grouped shuffle, and what comes back are the documents' shared hashes or their number.
Only 48 bits are sent beside the range's number: this finds candidates, which callers verify.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import KEY, partitions, small_batches
from strandflow.llm.textkernel import chunks, ids_of

#: Hashes that a task gathers before it packs them.
FLUSH = 1_500_000
_SCHEMA = "bucket int, tokens binary, docs binary, counts binary, found boolean"
_NAMES = ["bucket", "tokens", "docs", "counts", "found"]
_KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]


def token_of(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of each hash, and the range's number with 48 more bits of the hash."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return bucket.astype(np.int64), (bucket << np.uint64(48)) | (hashes & np.uint64(0xFFFFFFFFFFFF))


def pack48(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(data: bytes, bucket: int) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel() | (np.uint64(bucket) << np.uint64(48))


def by_owner(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that groups equal documents, the documents, and their numbers of entries."""
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    return order, docs[first], np.diff(np.append(first, len(docs)))


def _pack(hashes: np.ndarray, docs: np.ndarray, buckets: int, counts_only: bool) -> Iterator[tuple]:
    bucket, tokens = token_of(hashes, buckets)
    order = np.lexsort((docs, tokens)) if (docs[1:] < docs[:-1]).any() else np.argsort(tokens, kind="stable")
    tokens, docs = tokens[order], docs[order]
    if not len(tokens):
        return
    new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (docs[1:] != docs[:-1])])
    tokens, docs = tokens[new], docs[new]
    begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    size = np.diff(np.append(begin, len(tokens)))
    met = np.repeat(size > 1, size)
    if met.any():
        o, who, n = by_owner(docs[met])
        yield from _found(tokens[met][o], who, n, buckets, counts_only)
    for known, keep in ((False, begin[size == 1]), (True, begin[size > 1])):
        edges = np.searchsorted(tokens[keep], np.arange(buckets + 1, dtype=np.uint64) << np.uint64(48))
        for b in np.flatnonzero(np.diff(edges)):
            at = keep[edges[b] : edges[b + 1]]
            if known:
                yield int(b), pack48(tokens[at]), b"", b"", False
            else:
                o, who, n = by_owner(docs[at])
                yield int(b), pack48(tokens[at][o]), who.tobytes(), n.astype(np.uint32).tobytes(), False


def _found(tokens: np.ndarray, who: np.ndarray, n: np.ndarray, buckets: int, counts_only: bool) -> Iterator[tuple]:
    for a in range(0, len(who), 2_000):
        b = min(a + 2_000, len(who))
        lo, hi = int(n[:a].sum()), int(n[:b].sum())
        yield int(who[a] % buckets), b"" if counts_only else tokens[lo:hi].tobytes(), who[a:b].tobytes(), n[a:b].astype(np.uint32).tobytes(), True


def spread(docs: np.ndarray, n: np.ndarray, values: np.ndarray, width: int, shards: int) -> Iterator[tuple]:
    """Rows of shard, owners (or rows of owner and more), their numbers of values, and values; `values` lie in order of owner."""
    shard = ((docs if docs.ndim == 1 else docs[:, 0]) % shards).astype(np.int64)
    ends = np.cumsum(n) * width
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    data = np.ascontiguousarray(values).view(np.uint8) if width else b""
    for s in np.flatnonzero(np.diff(edges)):
        at = order[edges[s] : edges[s + 1]]
        packed = b"".join([data[ends[i] - n[i] * width : ends[i]].tobytes() for i in at]) if width else b""
        yield int(s), docs[at].tobytes(), n[at].astype(np.uint32).tobytes(), packed


def gather(width: int):
    """The values of every owner of a shard, brought together from rows made by `spread`."""

    def run(table: pa.Table) -> pa.Table:
        docs = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("docs").to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) for x in table.column("counts").to_pylist()])
        order = np.argsort(docs, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], docs[order][1:] != docs[order][:-1]]))
        out = {KEY: pa.array(docs[order][begin], pa.int64()), "n_shared": pa.array(np.add.reduceat(n[order], begin), pa.int64())}
        if width:
            data, ends = b"".join(table.column("packed").to_pylist()), np.cumsum(n) * width
            cut = [data[ends[i] - n[i] * width : ends[i]] for i in order]
            stop = np.append(begin[1:], len(order))
            out["packed"] = pa.array([b"".join(cut[a:b]) for a, b in zip(begin, stop, strict=True)], pa.binary())
        return pa.table(out)

    return run


SPREAD = "shard int, docs binary, counts binary, packed binary"
SPREAD_KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def spread_table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, SPREAD_KINDS, strict=True)], names=["shard", "docs", "counts", "packed"])


def _meet(table: pa.Table, counts_only: bool, shards: int) -> pa.Table:
    rows: list[tuple] = []

    def add(tokens: np.ndarray, who: np.ndarray, n: np.ndarray) -> None:
        rows.extend(spread(who, n, tokens, 0 if counts_only else 8, shards))

    parts, owners = [], []
    for bucket, tokens, docs, counts, found in zip(*(table.column(c).to_pylist() for c in _NAMES), strict=True):
        who, n = np.frombuffer(docs, np.int64), np.frombuffer(counts, np.uint32).astype(np.int64)
        if found:
            add(np.frombuffer(tokens, np.uint64), who, n)
            continue
        parts.append(unpack48(tokens, bucket))
        # an entry known as shared has no owner to tell; it stands for two
        owners.append((np.repeat(who, n), np.ones(len(parts[-1]), bool)) if docs else (np.zeros(len(parts[-1]), np.int64), np.zeros(len(parts[-1]), bool)))
    if parts:
        tokens = np.concatenate(parts)
        docs, owned = (np.concatenate([o[i] for o in owners]) for i in (0, 1))
        order = np.argsort(tokens, kind="stable")
        tokens, docs, owned = tokens[order], docs[order], owned[order]
        begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        size = np.diff(np.append(begin, len(tokens)))
        least, most = np.minimum.reduceat(docs, begin), np.maximum.reduceat(docs, begin)
        met = np.repeat((least != most) | ~np.logical_and.reduceat(owned, begin), size) & owned
        if (size > 1).any():  # an owner may have sent a token more than once
            again = np.lexsort((docs, tokens))
            dup = np.zeros(len(tokens), bool)
            dup[again[1:]] = (tokens[again[1:]] == tokens[again[:-1]]) & (docs[again[1:]] == docs[again[:-1]]) & owned[again[:-1]]
            met &= ~dup
        o, who, n = by_owner(docs[met])
        add(tokens[met][o], who, n)
    return spread_table(rows)


def text_hashes(extract: Callable) -> Callable:
    """Entries from KEY and text: extract(bytes, offsets) gives hashes and each one's text, in order of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch, buf, offsets in chunks(batches):
            hashes, doc = extract(buf, offsets)
            yield hashes, ids_of(batch, KEY)[doc]

    return run


def shared(entries: DataFrame, extract: Callable, buckets: int, counts_only: bool) -> DataFrame:
    """A row per KEY that shares hashes: their number (`n_shared`) and the hashes (`packed`).

    extract(batches) gives hashes and their owners. Where an owner's hashes come in one task's
    stretch, no hash is counted twice.
    """
    small_batches(entries.sparkSession)
    shards = partitions(entries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            hashes, docs = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            rows = list(_pack(hashes, docs, buckets, counts_only))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, _KINDS, strict=True)], names=_NAMES)

        for hashes, docs in extract(batches):
            held.append((hashes, docs))
            size += len(hashes)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    met = entries.mapInArrow(run, _SCHEMA).groupBy("bucket").applyInArrow(lambda t: _meet(t, counts_only, shards), SPREAD)
    kind = f"{KEY} long, n_shared long" + ("" if counts_only else ", packed binary")
    return met.groupBy("shard").applyInArrow(gather(0 if counts_only else 8), kind)
