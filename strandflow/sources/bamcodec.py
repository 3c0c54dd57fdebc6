"""BAM records of an Arrow batch, encoded and decoded column by column."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandflow.operators.places import characters, ramp

SEQ_CODES, CIGAR_CODES = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_HEAD = np.dtype([("tid", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("mtid", "<i4"), ("mpos", "<i4"), ("isize", "<i4")])
_NIBBLE = np.array([SEQ_CODES.index(chr(c).upper()) if c < 128 and chr(c).upper() in SEQ_CODES else 15 for c in range(257)], np.uint8)
_LETTER = np.frombuffer(SEQ_CODES.encode(), np.uint8)
#: Bytes of a tag's value by kind; 0 where the value tells.
_WIDTH = np.zeros(256, np.int64)
for _kind, _size in {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4, "d": 8}.items():
    _WIDTH[ord(_kind)] = _size
_NUMBERS = {"c": "i1", "C": "u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4", "f": "<f4", "d": "<f8"}
TEXT = pa.string()
TAG_TYPE = pa.struct([("type", TEXT), ("i", pa.int64()), ("d", pa.float64()), ("s", TEXT), ("ai", pa.list_(pa.int64())), ("ad", pa.list_(pa.float64()))])

_INT = pa.int32()
SCHEMA = list(zip("qname flag rname pos mapq cigar mrnm mpos isize seq qual tags".split(), [TEXT, _INT, TEXT, _INT, _INT, TEXT, TEXT, _INT, _INT, TEXT, TEXT, pa.map_(TEXT, TAG_TYPE)], strict=True))


@functools.lru_cache(maxsize=10_000)
def _operations(cigar: str) -> tuple[np.ndarray, int]:
    """Packed operations of a CIGAR, and how many positions it takes."""
    found = re.findall(r"(\d+)(\D)", cigar)
    return np.array([int(n) << 4 | CIGAR_CODES.index(c) for n, c in found], "<u4"), sum(int(n) for n, c in found if c in "MDN=X")


def _bins(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """binning.bin_of for arrays."""
    out, done, last = np.zeros(len(begin), np.int64), np.zeros(len(begin), bool), end - 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        here = ~done & (begin >> shift == last >> shift)
        out[here] = first + (begin[here] >> shift)
        done |= here
    return out


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a column of texts, and each one's first place and length; null is empty."""
    column = column.cast(TEXT).cast(pa.binary())
    if not len(column):
        return np.zeros(1, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(1, np.uint8)
    return data, offsets[:-1], np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)


def _put(out: np.ndarray, at: np.ndarray, data: np.ndarray, first: np.ndarray, length: np.ndarray) -> None:
    """Copy stretches of bytes to places of `out`."""
    i = ramp(length)
    out[np.repeat(at, length) + i] = data[np.repeat(first, length) + i]


def _put_fixed(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Write each of the values, of one width, at its place."""
    values = np.ascontiguousarray(values)
    out[at[:, None] + np.arange(values.dtype.itemsize)] = values.view(np.uint8).reshape(len(at), values.dtype.itemsize)


def _number(column: pa.Array, absent: int = 0) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), absent).to_numpy(zero_copy_only=False)


def _small(values: np.ndarray) -> np.ndarray:
    if len(values) and (values.min() < -(1 << 31) or values.max() >= 1 << 31):
        raise ValueError("a number does not fit 32 bits")
    return values.astype("<i4")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    return values, offsets[:-1], np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)


def _encoded_tags(column: pa.Array, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows' tags, in order of name within a row, and how many each row has."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    n = int(offsets[-1] - offsets[0])
    if not n:
        return np.zeros(0, np.uint8), np.zeros(n_rows, np.int64)
    keys, items = column.keys.slice(offsets[0], n), column.items.slice(offsets[0], n)
    row = np.repeat(np.arange(n_rows), np.diff(offsets))
    rank = pc.rank(keys, tiebreaker="dense").to_numpy()
    order = pa.array(np.lexsort((rank, row)))
    keys, items = keys.take(order), items.take(order)
    fields = dict(zip([f.name for f in items.type], items.flatten(), strict=True))
    have = {k: v.is_valid().to_numpy(zero_copy_only=False) for k, v in fields.items()}
    is_list = have["ai"] | have["ad"]
    is_int = ~is_list & have["i"]
    is_real = ~is_list & ~is_int & have["d"]
    is_text = ~(is_list | is_int | is_real)
    if (is_text & ~have["s"]).any():
        raise ValueError("a tag has no value")
    kind, kind_at, _ = _raw(fields["type"])
    kind = np.where(have["type"], kind[np.minimum(kind_at, len(kind) - 1)], 0).astype(np.int64)
    text, text_at, text_n = _raw(fields["s"])
    ints, ints_at, ints_n = _lists(fields["ai"])
    reals, reals_at, reals_n = _lists(fields["ad"])
    n_list = np.where(have["ad"], reals_n, ints_n)
    name, name_at, name_n = _raw(keys)
    real_width = np.where(kind == ord("d"), 8, 4)
    width = np.select([is_list, is_int, is_real], [5 + 4 * n_list, np.full(n, 4), real_width], text_n + (kind != ord("A")))
    size = name_n + 1 + width
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    _put(out, at, name, name_at, name_n)
    value = at + name_n + 1
    out[value - 1] = np.select([is_list, is_int], [np.full(n, ord("B")), np.full(n, ord("i"))], kind).astype(np.uint8)
    _put_fixed(out, value[is_int], _small(_number(fields["i"])[is_int]))
    real = pc.fill_null(fields["d"], 0).to_numpy(zero_copy_only=False)
    for w, form in ((4, "<f4"), (8, "<f8")):
        _put_fixed(out, value[is_real & (real_width == w)], real[is_real & (real_width == w)].astype(form))
    _put(out, value[is_text], text, text_at[is_text], text_n[is_text])
    out[value[is_list]] = np.where(have["ad"][is_list], ord("f"), ord("i")).astype(np.uint8)
    _put_fixed(out, value[is_list] + 1, n_list[is_list].astype("<i4"))
    for chosen, values, first in ((is_list & have["ad"], reals, reals_at), (is_list & ~have["ad"], ints, ints_at)):
        k = n_list[chosen]
        i = ramp(k)
        taken = values[np.repeat(first[chosen], k) + i]
        _put_fixed(out, np.repeat(value[chosen] + 5, k) + 4 * i, taken.astype("<f4") if values is reals else _small(taken.astype(np.int64)))
    return out, np.bincount(row, size, n_rows).astype(np.int64)


def encode(batch: pa.RecordBatch, contigs: list[str]) -> bytes:
    """The records of a batch of ALIGNMENT's columns, each with its size before it."""
    n = batch.num_rows
    if not n:
        return b""
    column = batch.column
    if column("qname").null_count or column("flag").null_count:
        raise ValueError("a record has no name or no flag")
    known = pa.array(contigs, TEXT)
    cigars = pc.dictionary_encode(column("cigar").cast(TEXT), null_encoding="encode")
    of = cigars.indices.to_numpy(zero_copy_only=False)
    parsed = [_operations(c or "") for c in cigars.dictionary.to_pylist()]
    n_of = np.array([len(ops) for ops, _ in parsed], np.int64)
    ops, first_op = np.concatenate([ops for ops, _ in parsed]).view(np.uint8), (np.cumsum(n_of) - n_of) * 4
    name, name_at, name_n = _raw(column("qname"))
    seq, seq_at, l_seq = characters(column("seq"))
    qual, qual_at, qual_n = characters(column("qual"))
    if ((qual_n > 0) & (qual_n != l_seq)).any():
        raise ValueError("qualities are not as many as letters")
    if (name_n > 254).any():
        raise ValueError("a name is longer than 254 bytes")
    tags, tags_n = _encoded_tags(column("tags"), n)
    pos = _number(column("pos")) - 1
    head = np.zeros(n, _HEAD)
    head["tid"], head["mtid"] = (pc.fill_null(pc.index_in(column(c).cast(TEXT), value_set=known), -1).to_numpy(zero_copy_only=False) for c in ("rname", "mrnm"))
    head["pos"], head["mpos"], head["isize"] = pos, _number(column("mpos")) - 1, _number(column("isize"))
    head["l_name"], head["mapq"], head["flag"] = name_n + 1, _number(column("mapq")), _number(column("flag"))
    head["n_cigar"], head["l_seq"] = n_of[of], l_seq
    width = np.maximum(np.array([w for _, w in parsed], np.int64)[of], 1)
    head["bin"] = _bins(pos, pos + width) & 0xFFFF
    half = (l_seq + 1) // 2
    size = 36 + name_n + 1 + 4 * n_of[of] + half + l_seq + tags_n
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    _put_fixed(out, at, (size - 4).astype("<i4"))
    _put_fixed(out, at + 4, head)
    at = at + 36
    _put(out, at, name, name_at, name_n)
    at = at + name_n + 1
    _put(out, at, ops, first_op[of], 4 * n_of[of])
    at = at + 4 * n_of[of]
    i, of_read = ramp(half), np.repeat(np.arange(n), half)
    letters = np.append(_NIBBLE[seq if seq.dtype == np.uint8 else np.minimum(seq, 256)], np.uint8(0))
    low = 2 * i + 1 < l_seq[of_read]
    high_at = seq_at[of_read] + 2 * i
    out[at[of_read] + i] = letters[high_at] << 4 | np.where(low, letters[np.where(low, high_at + 1, -1)], 0)
    at = at + half
    i = ramp(l_seq)
    has = np.repeat(qual_n > 0, l_seq)
    out[np.repeat(at, l_seq) + i] = (np.where(has, qual[np.where(has, np.repeat(qual_at, l_seq) + i, -1)].astype(np.int64) - 33, 255) % 256).astype(np.uint8)
    _put(out, at + l_seq, tags, np.cumsum(tags_n) - tags_n, tags_n)
    return out.tobytes()


def _texts(data: np.ndarray, first: np.ndarray, length: np.ndarray, absent: np.ndarray | None = None) -> pa.Array:
    """Stretches of bytes as texts; null where absent."""
    length = length if absent is None else np.where(absent, 0, length)
    taken = data[np.repeat(first, length) + ramp(length)] if length.sum() else np.zeros(0, np.uint8)
    offsets = np.append(0, np.cumsum(length)).astype(np.int32)
    mask = pa.array(~absent).buffers()[1] if absent is not None else None
    out = pa.Array.from_buffers(TEXT, len(length), [mask, pa.py_buffer(offsets), pa.py_buffer(taken)])
    out.validate(full=True)
    return out


def _values(data: np.ndarray, at: np.ndarray, form: str) -> np.ndarray:
    kind = np.dtype(form)
    return np.ascontiguousarray(data[at[:, None] + np.arange(kind.itemsize)]).view(kind).ravel()


def _decoded_tags(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> pa.Array:
    """Tags between places of the data: in each round every row that has one more gives it."""
    zeros = np.flatnonzero(data == 0)
    found, row = [], np.flatnonzero(at + 3 <= end)
    at = at[row]
    while len(row):
        kind = data[at + 2]
        size = _WIDTH[kind].copy()
        text, listed = (kind == ord("Z")) | (kind == ord("H")), kind == ord("B")
        size[text] = zeros[np.searchsorted(zeros, at[text] + 3)] - at[text] - 2
        size[listed] = 5 + _values(data, at[listed] + 4, "<u4").astype(np.int64) * _WIDTH[data[at[listed] + 3]]
        if (size == 0).any():
            raise ValueError("a tag is of no known kind")
        found.append((row, at, size))
        at = at + 3 + size
        more = at + 3 <= end[row]
        row, at = row[more], at[more]
    row, at, size = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
    key = _values(data, at, "<u2").astype(np.int64)
    # of equal names in a row the last value stands
    _, last = np.unique((row << 16 | key)[::-1], return_index=True)
    order = len(row) - 1 - last
    order = order[np.lexsort((order, row[order]))]
    row, at, size = row[order], at[order], size[order]
    kind, value, n = data[at + 2], at + 3, len(at)
    of = lambda kinds: np.isin(kind, np.frombuffer(kinds.encode(), np.uint8))
    ints, reals = np.zeros(n, np.int64), np.zeros(n)
    for k, form in _NUMBERS.items():
        here = kind == ord(k)
        (reals if k in "fd" else ints)[here] = _values(data, value[here], form)
    whole, real, text, listed = of("cCsSiI"), of("fd"), of("AZH"), of("B")
    sub = np.where(listed, data[np.where(listed, value, 0)], 0)
    lists = []
    for chosen, kinds, none in ((listed & (sub != ord("f")), "cCsSiI", np.int64), (listed & (sub == ord("f")), "f", np.float64)):
        length = np.where(chosen, (size - 5) // np.maximum(_WIDTH[sub], 1), 0)
        i, owner = ramp(length), np.repeat(np.arange(n), length)
        numbers = np.zeros(len(i), none)
        for k in kinds:
            here = sub[owner] == ord(k)
            numbers[here] = _values(data, value[owner[here]] + 5 + i[here] * _WIDTH[ord(k)], _NUMBERS[k])
        lists.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(numbers), mask=pa.array(~chosen)))
    shown = np.where(whole, ord("i"), kind).astype(np.uint8)
    fields = [_texts(shown, np.arange(n), np.ones(n, np.int64)), pa.array(ints, mask=~whole), pa.array(reals, mask=~real), _texts(data, value, size - (kind != ord("A")), ~text), *lists]
    keys = _texts(data, at, np.full(n, 2))
    counts = np.bincount(row, minlength=len(end))
    return pa.MapArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), keys, pa.StructArray.from_arrays(fields, fields=list(TAG_TYPE)))


def decode(records: list[bytes], names: list[str], base: np.ndarray | None = None, asked: list[str] | None = None) -> list[pa.Array]:
    """ALIGNMENT's columns, or those asked for, of records, each with its size before it. `base`: where each record's file begins in `names`."""
    return decoded(b"".join(records), np.array([len(r) for r in records], np.int64), names, base, asked)


def decoded(records: bytes, sizes: np.ndarray, names: list[str], base: np.ndarray | None = None, asked: list[str] | None = None) -> list[pa.Array]:
    """The same of records one after another, of the sizes given."""
    data = np.frombuffer(records, np.uint8)
    stop = np.cumsum(sizes)
    start = stop - sizes + 4
    head = np.ascontiguousarray(data[start[:, None] + np.arange(_HEAD.itemsize)]).view(_HEAD).ravel()
    l_name, n_cigar, l_seq = (head[c].astype(np.int64) for c in ("l_name", "n_cigar", "l_seq"))
    known = pa.array(names, TEXT)
    name_at = start + 32
    cigar_at = name_at + l_name
    seq_at, half = cigar_at + 4 * n_cigar, (l_seq + 1) // 2
    qual_at = seq_at + half

    def contig(c: str) -> pa.Array:
        return known.take(pa.array(head[c].astype(np.int64) + (0 if base is None else base), mask=head[c] < 0))

    def place(c: str) -> pa.Array:
        return pa.array(head[c] + 1, pa.int32(), mask=head[c] < 0)

    def cigar() -> pa.Array:
        i = ramp(n_cigar)
        kinds, of = np.unique(_values(data, np.repeat(cigar_at, n_cigar) + 4 * i, "<u4"), return_inverse=True)
        parts = pa.array([f"{k >> 4}{CIGAR_CODES[k & 15]}" for k in kinds.tolist()], TEXT).take(pa.array(of))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_cigar)), pa.int32()), parts), "")
        return pc.if_else(pa.array(n_cigar > 0), texts, pa.scalar(None, TEXT))

    def seq() -> pa.Array:
        packed = data[np.repeat(seq_at, half) + ramp(half)]
        letters = _LETTER[np.stack([packed >> 4, packed & 15], 1).ravel()] if len(packed) else packed
        return _texts(letters, 2 * (np.cumsum(half) - half), l_seq, l_seq == 0)

    def qual() -> pa.Array:
        absent = (l_seq == 0) | (data[np.minimum(qual_at, len(data) - 1)] == 255)
        scores = data[np.repeat(qual_at, l_seq) + ramp(l_seq)] + np.uint8(33)
        first = np.cumsum(l_seq) - l_seq
        if (scores[np.repeat(~absent, l_seq)] > 127).any():
            raw = scores.tobytes()
            return pa.array([None if x else raw[a : a + k].decode("latin-1") for x, a, k in zip(absent, first, l_seq, strict=True)], TEXT)
        return _texts(scores, first, l_seq, absent)

    def number(c: str) -> pa.Array:
        return pa.array(head[c].astype(np.int32))

    columns = {
        "qname": lambda: _texts(data, name_at, l_name - 1), "flag": lambda: number("flag"), "rname": lambda: contig("tid"), "pos": lambda: place("pos"), "mapq": lambda: number("mapq"), "cigar": cigar,
        "mrnm": lambda: contig("mtid"), "mpos": lambda: place("mpos"), "isize": lambda: number("isize"), "seq": seq, "qual": qual, "tags": lambda: _decoded_tags(data, qual_at + l_seq, stop),
    }
    return [make() for c, make in columns.items() if asked is None or c in asked]
