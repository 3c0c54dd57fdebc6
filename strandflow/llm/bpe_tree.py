"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved until pieces are short; a piece is encoded by the rank file's encoder. Two
neighbouring encodings are joined by encoding anew only a window round the seam:

* The window reaches from the last place in the left part to the first place in the right part where
  a white-space character follows another character. No match of the pattern goes on from such a
  character into white space, and none looks behind, so both places are ends of matches whatever
  stands beyond them: the tokens outside the window are final.
* Where the window is one match cut in two, its tokens are joined by windows growing from the seam:
  some tokens on either side are encoded anew, and those outside are final once the pair at either
  edge of the window is stable, that is, encodes to itself. A sequence whose neighbouring pairs are
  all stable is the encoding of its bytes. Otherwise the window doubles.

Decoding is a homomorphism: the bytes of halves are concatenated up the tree.
Null and empty texts have no tokens; equal texts have equal tokens, and repeated rows, also those of
equal or null doc_id, have a row each; an empty table gives an empty one. Other columns are kept, but
`ids` and `decoded` replace columns of those names. A very long text takes memory in proportion to its
own size. Nothing is shuffled, and nothing grows with the
table: a task holds one Arrow batch.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import small_batches

#: Characters of a leaf; a parameter of the tree, not of the result. Most texts take several.
LEAF = 128

_EDGE = regex.compile(r"\S(?=\s)")
_LAST_EDGE = regex.compile(r"(?r)\S(?=\s)")


class TreeCodec:
    """Encoder and decoder for one rank file and pattern.

    The pattern must never look behind, and no match may hold white space after another character.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        self.coding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.leaf = regex.compile(pattern), max(1, leaf)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.size_of = [len(b) for b in self.bytes_of]

    def encode(self, text: str) -> list[int]:
        return self._tree(text, 0, len(text))

    def _tree(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self.coding.encode_ordinary(text[a:b])
        m = (a + b) // 2
        return self._join(text, a, m, b, self._tree(text, a, m), self._tree(text, m, b))

    def _join(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        edge = _LAST_EDGE.search(text, a, min(m + 1, b))
        p = edge.end() if edge else a
        edge = _EDGE.search(text, m, b)
        q = edge.end() if edge else b
        i, j = len(left) - self._count(reversed(left), text[p:m]), self._count(right, text[m:q])
        if all(x < y and self.pattern.fullmatch(text, x, y) for x, y in ((p, m), (m, q), (p, q))) and self.pattern.match(text, p).end() == q:
            return left[:i] + self.seam(left[i:], right[:j]) + right[j:]
        return left[:i] + self.coding.encode_ordinary(text[p:q]) + right[j:]

    def _count(self, tokens: Iterator[int], covered: str) -> int:
        """How many of the tokens stand for the covered text."""
        size, n = len(covered.encode()), 0
        for t in tokens:
            if size <= 0:
                break
            size -= self.size_of[t]
            n += 1
        return n

    def piece(self, tokens: list[int]) -> list[int]:
        """The encoding of the tokens' bytes as a single match."""
        return self.coding._encode_single_piece(b"".join([self.bytes_of[t] for t in tokens]))

    def seam(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of a match from the encodings of its two parts."""
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            middle = self.piece(left[i:] + right[:j])
            before, after = left[i - 1 : i] if i else [], right[j : j + 1]
            if all(not pair[1:] or self.piece(pair) == pair for pair in (before + middle[:1], middle[-1:] + after)):
                return left[:i] + middle + right[j:]
            k *= 2

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join([self.bytes_of[i] for i in ids])
        m = len(ids) // 2
        return self.decode(ids[:m]) + self.decode(ids[m:])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, leaf: int = LEAF) -> TreeCodec:
    """The codec of a rank file that every executor has at this path; kept by the Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return TreeCodec(ranks, pattern, leaf)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", leaf: int = LEAF) -> DataFrame:
    """`ids array<int>`: the tokens of `text`, by the ranks at `path`."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(path, pattern, leaf)
        for batch in batches:
            out, sizes = [], [0]
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                ids = tree.encode(t) if t else []
                out.append(np.array(ids, dtype=np.int32))
                sizes.append(sizes[-1] + len(ids))
            flat = np.concatenate(out) if out else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))
            yield _with(batch, "ids", lists)

    return df.mapInArrow(run, _schema(df, "ids", "array<int>"))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", leaf: int = LEAF) -> DataFrame:
    """`decoded binary`: the bytes that the token ids in `ids` stand for; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(path, pattern, leaf)
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(ids))
            out = [tree.decode(v.values.to_numpy().tolist()) if v.is_valid else b"" for v in values]
            yield _with(batch, "decoded", pa.array(out, pa.binary()))

    return df.mapInArrow(run, _schema(df, "decoded", "binary"))


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [column], names=[*names, name])


def _schema(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != name] + [f"`{name}` {kind}"])


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: token count and digests of ids and decoded bytes."""
    coded = decode(encode(df.select("doc_id", "text"), path, pattern).drop("text"), path, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
