"""Token ids in binary blocks: an adaptive context-mixing range coder over many lanes at once.

A block holds some whole documents' ids. They are dealt to LANES lanes of equal length, which are
coded side by side with numpy: one step codes the next id of every lane. All lanes of a block share
one adaptive model, which starts anew with each block:

* order 2: the id that last followed a hash of the two ids before, with a confidence of 0 to 3;
* order 1: the id that last followed the id before, with a confidence of 0 to 3;
* order 0: counts of the ids that neither predicted, turned into frequencies every REFRESH steps.

The two confidences choose a class, and the class's counts of what came true so far mix the three:
a share of the range for the order-2 id, one for the order-1 id, and the rest for order 0. A lane's
range coder keeps 48 bits and sends 16 at a time; carries are settled when the block is closed.

Block layout (little-endian): magic, version, ids, lanes, steps (32 bits each), CRC-32 of the ids,
CRC-32 of the rest; then each lane's number of 16-bit words (32 bits each) and the words. Decoding
repeats the encoder's model updates and checks both sums. A block decodes without any other.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"SFTB", 1
#: Lanes of a full block, and the ids a lane has at least in a smaller one.
LANES, SHORT = 4096, 64
REFRESH = 32
_HEAD = struct.Struct("<4sIIIIII")
_SHARE, _BASE = 11, 19  # bits of a mixing share and of an order-0 frequency
_TOTAL = np.uint64(_SHARE + _BASE)
_LOW, _TOP = np.uint64(1 << 32), np.uint64(1 << 48)
_HASH_BITS = 18


class _Mixer:
    """The model that encoder and decoder keep alike; the alphabet is 0 .. symbols - 1."""

    def __init__(self, symbols: int, lanes: int):
        if symbols >= 1 << (_BASE - 1):
            raise ValueError("too many symbols")
        self.symbols = symbols
        self.one, self.one_sure = np.zeros(symbols, np.int32), np.zeros(symbols, np.int8)
        self.two, self.two_sure = np.zeros(1 << _HASH_BITS, np.int32), np.zeros(1 << _HASH_BITS, np.int8)
        self.seen = np.zeros((16, 3))
        self.seen[:] = (0.5, 0.3, 1.0)
        self.counts = np.zeros(symbols, np.int64)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.steps = 0
        self._refresh()

    def _refresh(self) -> None:
        total = int(self.counts.sum())
        spare = (1 << _BASE) - self.symbols
        self.freq = np.ones(self.symbols, np.int64)
        if total:
            self.freq += self.counts * spare // total
        self.freq[0] += (1 << _BASE) - int(self.freq.sum())
        self.cum = np.cumsum(self.freq) - self.freq
        self.lookup = None
        share = self.seen[:, :2] / self.seen.sum(1, keepdims=True)
        self.shares = np.minimum(np.maximum((share * (1 << _SHARE)).astype(np.int64), 1), 2000)
        over = self.shares.sum(1) > (1 << _SHARE) - 8
        self.shares[over] = (self.shares[over] * 0.49).astype(np.int64) + 1

    def look(self) -> tuple[np.ndarray, ...]:
        """Predicted ids of order 2 and 1 and their shares of 2**_SHARE."""
        self.context = ((self.last * 0x2545F491 + self.before * 0x9E3779B1) >> 7) & ((1 << _HASH_BITS) - 1)
        p2, p1 = self.two[self.context], self.one[self.last]
        self.sure2, self.sure1 = self.two_sure[self.context], self.one_sure[self.last]
        self.kind = self.sure2.astype(np.int64) * 4 + self.sure1
        share = self.shares[self.kind]
        m2, m1 = share[:, 0], np.where(p1 == p2, 0, share[:, 1])
        return p2, p1, m2, m1

    def learn(self, ids: np.ndarray, p2: np.ndarray, p1: np.ndarray) -> None:
        hit2, hit1 = ids == p2, ids == p1
        outcome = np.where(hit2, 0, np.where(hit1, 1, 2))
        self.seen = self.seen * 0.98 + np.bincount(self.kind * 3 + outcome, minlength=48).reshape(16, 3)
        missed = ids[outcome == 2]
        self.counts += np.bincount(missed, minlength=self.symbols) if len(missed) * 8 > self.symbols else 0
        if len(missed) * 8 <= self.symbols:
            np.add.at(self.counts, missed, 1)
        self.two[self.context] = ids
        self.two_sure[self.context] = np.where(hit2, np.minimum(self.sure2 + 1, 3), 0)
        self.one[self.last] = ids
        self.one_sure[self.last] = np.where(hit1, np.minimum(self.sure1 + 1, 3), 0)
        self.before, self.last = self.last, ids.astype(np.int64)
        self.steps += 1
        if self.steps % REFRESH == 0 or self.steps in (1, 2, 4, 8, 16):
            self._refresh()

    def symbol_at(self, slots: np.ndarray) -> np.ndarray:
        if self.lookup is None:
            self.lookup = np.repeat(np.arange(self.symbols, dtype=np.int32), self.freq)
        return self.lookup[slots]


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // SHORT))
    return lanes, -(-n // lanes)


def encode(ids: np.ndarray, symbols: int) -> bytes:
    """One block of the ids, all below `symbols`."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    if n and int(ids.max()) >= symbols:
        raise ValueError("an id is out of range")
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    columns = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    mixer = _Mixer(symbols, lanes)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, _TOP - np.uint64(1), np.uint64)
    sent_lane, sent_word = [], []
    every = np.arange(lanes, dtype=np.uint16 if lanes <= 1 << 16 else np.uint32)

    def send(which: np.ndarray) -> None:
        sent_lane.append(every[which])
        sent_word.append((low[which] >> np.uint64(32)).astype(np.uint32))
        low[which] = (low[which] & np.uint64(0xFFFFFFFF)) << np.uint64(16)

    for row in columns:
        p2, p1, m2, m1 = mixer.look()
        hit2 = row == p2
        hit1 = (row == p1) & ~hit2
        rest = (1 << _SHARE) - m2 - m1
        start = np.where(hit2, 0, np.where(hit1, m2 << _BASE, ((m2 + m1) << _BASE) + mixer.cum[row] * rest))
        size = np.where(hit2, m2 << _BASE, np.where(hit1, m1 << _BASE, mixer.freq[row] * rest))
        unit = width >> _TOTAL
        low += start.astype(np.uint64) * unit
        width = size.astype(np.uint64) * unit
        short = np.flatnonzero(width < _LOW)
        while len(short):
            send(short)
            width[short] <<= np.uint64(16)
            short = short[width[short] < _LOW]
        mixer.learn(row, p2, p1)
    for _ in range(3):
        send(slice(None))
    lane, word = np.concatenate(sent_lane), np.concatenate(sent_word)
    order = np.argsort(lane, kind="stable")
    word, counts = word[order], np.bincount(lane, minlength=lanes)
    first = np.cumsum(counts) - counts
    while True:  # a word of 17 bits adds one to the word before it in its lane
        carry = word >> 16
        carry[first] = 0
        word &= 0xFFFF
        if not carry.any():
            break
        word[:-1] += carry[1:]
    body = counts.astype("<u4").tobytes() + word.astype("<u2").tobytes()
    return _HEAD.pack(MAGIC, VERSION, n, lanes, steps, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode(block: bytes, symbols: int) -> np.ndarray:
    """The block's ids; ValueError if it is damaged."""
    magic, version, n, lanes, steps, ids_sum, body_sum = _HEAD.unpack_from(block)
    body = memoryview(block)[_HEAD.size :]
    if magic != MAGIC or version != VERSION or zlib.crc32(body) != body_sum:
        raise ValueError("a damaged block")
    counts = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(body, "<u2", offset=4 * lanes), np.zeros(4, np.uint16)]).astype(np.uint64)
    at = np.cumsum(counts) - counts
    code = np.zeros(lanes, np.uint64)
    for _ in range(3):
        code = (code << np.uint64(16)) | words[at]
        at += 1
    mixer = _Mixer(symbols, lanes)
    width = np.full(lanes, _TOP - np.uint64(1), np.uint64)
    out = np.zeros((steps, lanes), np.int32)
    for t in range(steps):
        p2, p1, m2, m1 = mixer.look()
        unit = width >> _TOTAL
        value = (code // unit).astype(np.int64)
        both, rest = (m2 + m1) << _BASE, (1 << _SHARE) - m2 - m1
        hit2 = value < m2 << _BASE
        miss = value >= both
        row = np.where(hit2, p2, p1)
        slot = np.minimum((value[miss] - both[miss]) // rest[miss], (1 << _BASE) - 1)
        row[miss] = mixer.symbol_at(slot)
        start = np.where(hit2, 0, m2 << _BASE)
        size = np.where(hit2, m2, m1) << _BASE
        start[miss] = both[miss] + mixer.cum[row[miss]] * rest[miss]
        size[miss] = mixer.freq[row[miss]] * rest[miss]
        code -= start.astype(np.uint64) * unit
        width = size.astype(np.uint64) * unit
        short = np.flatnonzero(width < _LOW)
        while len(short):
            code[short] = (code[short] << np.uint64(16)) | words[at[short]]
            at[short] += 1
            width[short] <<= np.uint64(16)
            short = short[width[short] < _LOW]
        out[t] = row
        mixer.learn(row, p2, p1)
    ids = out.T.ravel()[:n].astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_sum:
        raise ValueError("a damaged block")
    return ids
