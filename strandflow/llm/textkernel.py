"""Vectorised word splitting and hashing of Arrow text columns.

Spark deals the rows out; inside a task these helpers work on the raw UTF-8 buffers of one Arrow
batch at a time with numpy, so that hardly a Python object is made per word. A byte span's digest is
128 bits in two lanes. Spans of up to 15 bytes and their lengths fill 128 bits, which a permutation
stirs, so no two of them have equal digests; longer spans take BLAKE2b. Digests depend on the span's
bytes alone, so every task on every executor computes the same values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20
#: Rows an Arrow batch carries at most, which bounds a Python worker's memory on long texts.
BATCH_ROWS = 1000

_RNG = np.random.default_rng(20240601)
_LANES = _RNG.integers(1, 2**63, (4, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROUNDS = _RNG.integers(1, 2**63, 4, dtype=np.uint64)
#: The longest span that is stirred and not given to BLAKE2b.
SHORT_SPAN = 15
#: Masks of the first 0 to 8 bytes of a little-endian 64-bit number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _mask(spans: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


#: Separators of words made of anything but ASCII white space, and of words of letters and digits.
SPACE = _mask([(0x20, 0x20), (0x09, 0x0D)])
NON_ALNUM = _mask([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in new memory)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def long_digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """BLAKE2b digests of 128 bits of the byte spans, a row of two lanes for each."""
    spans = zip(starts.tolist(), ends.tolist(), strict=True)
    return np.frombuffer(b"".join([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in spans]), "<u8").reshape(-1, 2)


def span_digest(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two lanes of each byte span's digest; equal bytes have equal digests wherever they stand."""
    padded = np.zeros(len(mapped) + 16, np.uint8)
    padded[: len(mapped)] = mapped
    eight = np.ndarray((len(mapped) + 9,), "<u8", padded.data, strides=(1,))  # the 8 bytes from each place on
    size = ends - starts
    one = eight[starts] & _FIRST[np.minimum(size, 8)]
    two = size.astype(np.uint64) << np.uint64(56)
    more = np.flatnonzero(size > 8)
    two[more] |= eight[starts[more] + 8] & _FIRST[np.minimum(size[more] - 8, 7)]
    for k in (0, 2):
        two ^= mix(one + _ROUNDS[k])
        one ^= mix(two + _ROUNDS[k + 1])
    long = np.flatnonzero(size > SHORT_SPAN)
    if len(long):
        one[long], two[long] = long_digests(mapped.tobytes(), starts[long], ends[long]).T
    return one, two


@dataclass
class Words:
    """Words of a chunk of texts: byte spans, both lanes of their digests, and each text's first word (n + 1 entries)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    second: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def room(self) -> np.ndarray:
        """How many words of its text stand from each word on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))


def window_hash(hashes: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of the `width` words from each word on; past the end the rest counts as none."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(min(width, len(hashes))):
        out[: len(hashes) - k] += hashes[k:] * _LANES[lane, k]
    return mix(out + np.uint64(width))


def window_digest(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the windows, one of either lane of the words' digests."""
    return window_hash(words.hashes, width, 0), window_hash(words.second, width, 1)


def split_words(buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray, lower: bool, hashes: bool = True) -> Words:
    """Words of texts lying in `buf` between consecutive `offsets`, which begin at 0."""
    if len(buf) == 0:
        none, nothing = np.zeros(0, dtype=np.int64), np.zeros(0, np.uint64)
        return Words(none, none, nothing, nothing, np.zeros(len(offsets), dtype=np.int64))
    mapped = LOWER[buf] if lower else buf
    word = ~sep[mapped]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    finish = word.copy()
    finish[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    begin[inner] |= word[inner]
    finish[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    one, two = span_digest(mapped, starts, ends) if hashes else (np.zeros(0, np.uint64),) * 2
    return Words(starts, ends, one, two, np.searchsorted(starts, offsets))


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and its n + 1 offsets into them; null counts as empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about CHUNK_BYTES of text, with the text's bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        buf, offsets = raw_text(batch.column(at))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
            yield batch.slice(i, j - i), buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def ids_of(batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
