"""Substring dedup by difference-cover anchors.

A run of WIDTH equal words at i in one document and j in another has a shift k below PERIOD for
which i + k and j + k, modulo PERIOD, both lie in COVER, as every difference modulo PERIOD occurs in
COVER. So windows of ANCHOR = WIDTH - PERIOD + 1 words are hashed at cover positions only; two
documents with a common run share an anchor that lies inside it. The documents that hold a shared
anchor extend it: the WIDTH-word windows round it are hashed, and each one's smallest document is
found. A word is removed where a window covers it that also starts in a document with a smaller
doc_id; windows are judged on the input.

Hot passages: a task sends each distinct digest once and answers for its own documents itself, so no
range of digests gets a row per document, and no pairs are made. Anchors only name candidates.
Windows are equal if two independent hashes of their words' 128-bit digests are: 96 bits of these and
the number of the range of digests, 128 bits within a task.

Null and empty texts, and texts of fewer than WIDTH words, lose nothing. Rows with equal doc_id count
as one document of several texts, told apart by a 64-bit hash: they keep what they share with each
other and lose what a smaller one holds; a null doc_id counts as the smallest. An empty table gives an empty one. Only doc_id and text are read;
other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm import hashmeet
from strandflow.llm.common import KEY, NO_ID, group_count, keyed, partitions, small_batches
from strandflow.llm.textkernel import SPACE, chunks, ids_of, split_words, window_digest, window_hash

WIDTH, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WIDTH - PERIOD + 1
#: Documents whose anchors, or windows, one range takes on.
DOCS_A_RANGE = 20_000


def _anchors(words) -> np.ndarray:
    """Where words stand at a cover position of their text, with a whole anchor from there on."""
    at = np.arange(len(words.hashes)) - np.repeat(words.first[:-1], words.counts)
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    long = np.repeat(words.counts >= WIDTH, words.counts)
    return np.flatnonzero(inside[at % PERIOD] & (words.room() >= ANCHOR) & long)


def _extract(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = split_words(buf, offsets, SPACE, lower=False)
    at = _anchors(words)
    return window_hash(words.hashes, ANCHOR)[at], words.doc()[at]


def _spans(starts: np.ndarray) -> np.ndarray:
    """Word spans covered by windows at the starts, as first word and end, flat."""
    starts = np.unique(starts)
    if not len(starts):
        return np.zeros(0, np.int32)
    gap = np.flatnonzero(starts[1:] > starts[:-1] + WIDTH)
    first = np.concatenate([[0], gap + 1])
    last = np.concatenate([gap, [len(starts) - 1]])
    return np.stack([starts[first], starts[last] + WIDTH], axis=1).astype(np.int32).ravel()


def _owners(docs: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that groups the texts of each document, these (document and tie), and their numbers of entries."""
    order = np.lexsort((ties, docs))
    both = np.stack([docs[order], ties[order]], axis=1)
    first = np.flatnonzero(np.concatenate([[True], (both[1:] != both[:-1]).any(1)])) if len(both) else np.zeros(0, np.int64)
    return order, both[first], np.diff(np.append(first, len(both)))


def _document_spans(docs: np.ndarray, ties: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, their numbers of spans, and the spans, one 64-bit value each."""
    o, who, n = _owners(docs, ties)
    found, ends = starts[o], np.cumsum(n)
    spans = [_spans(found[e - k : e]) for e, k in zip(ends, n, strict=True)]
    flat = np.concatenate(spans) if spans else np.zeros(0, np.int32)
    return who, np.array([len(x) // 2 for x in spans], np.int64), flat.view(np.int64)


def ties_of(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each whole text, which tells the texts of one doc_id apart."""
    data = buf.tobytes()
    return np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64).view(np.int64)


_SCHEMA = "bucket int, hashes binary, seconds binary, docs binary, counts binary, starts binary"
_NAMES = ["bucket", "hashes", "seconds", "docs", "counts", "starts"]
_KINDS = [pa.int32(), *[pa.binary()] * 5]


def _later(hashes: np.ndarray, seconds: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of windows by digest and document, and which of them, in it, have a smaller document before."""
    order = np.lexsort((docs, seconds, hashes))
    hashes, seconds, docs = hashes[order], seconds[order], docs[order]
    begin = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (seconds[1:] != seconds[:-1])]))
    return order, docs > np.repeat(docs[begin], np.diff(np.append(begin, len(docs))))


def _candidates(buckets: int, anchor_ranges: int):
    """Windows round shared anchors: packed by range of hashes, or answered here."""

    def pack(hashes: np.ndarray, seconds: np.ndarray, docs: np.ndarray, ties: np.ndarray, starts: np.ndarray) -> Iterator[tuple]:
        order, later = _later(hashes, seconds, docs)
        hashes, seconds, docs, ties, starts = hashes[order], seconds[order], docs[order], ties[order], starts[order]
        who, n, spans = _document_spans(docs[later], ties[later], starts[later])  # known already: rows without hashes
        for a in range(0, len(who), 2_000):
            b = min(a + 2_000, len(who))
            yield int(who[a, 0] % buckets), b"", b"", who[a:b].tobytes(), n[a:b].astype(np.uint32).tobytes(), spans[n[:a].sum() : n[:b].sum()].tobytes()
        keep = np.flatnonzero(~later)
        bucket, hashes = hashmeet.token_of(hashes, buckets)
        edges = np.searchsorted(bucket[keep], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            at = keep[edges[b] : edges[b + 1]]
            o, who, n = _owners(docs[at], ties[at])
            at = at[o]
            yield int(b), hashmeet.pack48(hashes[at]), hashmeet.pack48(seconds[at]), who.tobytes(), n.astype(np.uint32).tobytes(), starts[at].astype(np.int32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = list(pack(*(np.concatenate([h[i] for h in held]) for i in range(5))))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)

        for batch, buf, offsets in chunks(batches):
            words = split_words(buf, offsets, SPACE, lower=False)
            doc, at = words.doc(), _anchors(words)
            _, tokens = hashmeet.token_of(window_hash(words.hashes, ANCHOR)[at], anchor_ranges)
            shared = np.zeros(len(at), bool)
            edges = np.searchsorted(doc[at], np.arange(batch.num_rows + 1))
            for d, known in enumerate(batch.column(batch.schema.get_field_index("packed")).to_pylist()):
                mine = np.frombuffer(known, np.uint64)
                shared[edges[d] : edges[d + 1]] = np.isin(tokens[edges[d] : edges[d + 1]], mine)
            start = np.zeros(len(doc) + 1, bool)
            first = words.first[:-1][doc] if len(doc) else doc
            for k in range(PERIOD):  # the anchor may stand up to PERIOD - 1 words into a window
                p = at[shared] - k
                start[p[p >= first[at[shared]]]] = True
            go = np.flatnonzero(start[:-1] & (words.room() >= WIDTH))
            if len(go):
                one, two = window_digest(words, WIDTH)
                held.append((one[go], two[go], ids_of(batch, KEY)[doc[go]], ties_of(buf, offsets)[doc[go]], go - first[go]))
                size += len(go)
            if size >= hashmeet.FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _least(shards: int):
    """The windows of a range that a smaller document holds too, as spans by shard of document."""

    def run(table: pa.Table) -> pa.Table:
        rows, parts = [], []
        for bucket, hashes, seconds, docs, counts, starts in zip(*(table.column(c).to_pylist() for c in _NAMES), strict=True):
            who, n = np.frombuffer(docs, np.int64).reshape(-1, 2), np.frombuffer(counts, np.uint32).astype(np.int64)
            if hashes:
                parts.append((hashmeet.unpack48(hashes, bucket), hashmeet.unpack48(seconds, 0), *np.repeat(who, n, axis=0).T, np.frombuffer(starts, np.int32)))
            else:
                rows.extend(hashmeet.spread(who, n, np.frombuffer(starts, np.int64), 8, shards))
        if parts:
            hashes, seconds, docs, ties, starts = (np.concatenate([p[i] for p in parts]) for i in range(5))
            order, later = _later(hashes, seconds, docs)
            go = order[later]
            rows.extend(hashmeet.spread(*_document_spans(docs[go], ties[go], starts[go]), 8, shards))
        return hashmeet.spread_table(rows)

    return run


def _gather(table: pa.Table) -> pa.Table:
    """A row per document of a shard: its texts' ties, their numbers of spans (32 bits each), and the spans."""
    who = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in table.column("docs").to_pylist()])
    n = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) for x in table.column("counts").to_pylist()])
    data, ends = b"".join(table.column("packed").to_pylist()), np.cumsum(n) * 8
    order = np.argsort(who[:, 0], kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], who[order][1:, 0] != who[order][:-1, 0]]))
    out = []
    for at in np.split(order, begin[1:]):
        out.append((int(who[at[0], 0]), np.ascontiguousarray(who[at, 1]).tobytes(), n[at].astype(np.uint32).tobytes(), b"".join([data[ends[i] - n[i] * 8 : ends[i]] for i in at])))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=[KEY, "ties", "sizes", "spans"])


def repeated_spans(documents: DataFrame) -> DataFrame:
    """KEY and `spans`: word spans (first, end; 32 bits each) that a smaller document repeats; they may overlap.

    `ties` and `sizes` tell how many of them belong to which text of the doc_id.
    """
    small_batches(documents.sparkSession)
    buckets, shards = group_count(documents, DOCS_A_RANGE), partitions(documents.sparkSession)
    ranges = group_count(documents, DOCS_A_RANGE, shards // 4)  # few, so that a document is named in few of them
    texts = keyed(documents, "text")
    anchors = hashmeet.shared(texts, hashmeet.text_hashes(_extract), buckets, counts_only=False).drop("n_shared")
    windows = texts.join(anchors.hint("shuffle_hash"), KEY).mapInArrow(_candidates(ranges, buckets), _SCHEMA)
    spans = windows.groupBy("bucket").applyInArrow(_least(shards), hashmeet.SPREAD)
    return spans.groupBy("shard").applyInArrow(_gather, f"{KEY} long, ties binary, sizes binary, spans binary")


def remove(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (`kept`), for every row."""
    spans = repeated_spans(documents)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in chunks(batches):
            words = split_words(buf, offsets, SPACE, lower=False, hashes=False)
            kept, removed = [], []
            own, sizes, spans = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ties", "sizes", "spans"))
            ties = ties_of(buf, offsets)
            for d in range(batch.num_rows):
                a, b = words.first[d], words.first[d + 1]
                edge = np.zeros(b - a + 1, np.int64)
                mine = np.repeat(np.frombuffer(own[d] or b"", np.int64) == ties[d], np.frombuffer(sizes[d] or b"", np.uint32))
                pairs = np.frombuffer(spans[d] or b"", np.int32).reshape(-1, 2)[mine].ravel()
                np.add.at(edge, np.minimum(pairs[::2], b - a), 1)
                np.add.at(edge, np.minimum(pairs[1::2], b - a), -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                text = buf[offsets[d] : offsets[d + 1]].tobytes()
                parts = text.split()  # bytes: exactly the separators of SPACE
                kept.append(b" ".join(parts if not removed[-1] else [w for w, g in zip(parts, gone, strict=True) if not g]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(KEY)), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[KEY, "n_words", "n_removed", "kept"])

    # the same columns as for the anchors' join, so that one shuffle of the texts serves both
    joined = keyed(documents, "text").join(spans.hint("shuffle_hash"), KEY, "left")
    out = joined.mapInArrow(run, f"{KEY} long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col(KEY) != NO_ID, F.col(KEY)).cast(kind).alias("doc_id"), "n_words", "n_removed", "kept")


def digests(documents: DataFrame) -> DataFrame:
    return remove(documents).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
