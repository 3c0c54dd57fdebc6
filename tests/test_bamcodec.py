"""BAM records by Arrow batch: written by hand and read back, tags of every kind."""

import struct

import pyarrow as pa
import pytest

from strandflow.sources import bamcodec, bgzf, binning


def tag(kind, **value):
    return {"type": kind, "i": None, "d": None, "s": None, "ai": None, "ad": None} | value


ROWS = [
    ("q1", 16, "c2", 7, 30, "3M1I1M", "c1", 9, -4, "ACGTN", "I!#5~", {"XZ": tag("Z", s="é x"), "NM": tag("i", i=-3), "XA": tag("A", s="k"), "XF": tag("f", d=0.5), "XD": tag("d", d=0.1), "XB": tag("B", ai=[1, -2, 3]), "XG": tag("B", ad=[0.5]), "XE": tag("B", ai=[]), "XH": tag("H", s="1AE3")}),
    ("q2", 4, None, None, 0, None, None, None, 0, None, None, {}),
    ("q3", 0, "c1", 1, 255, "2M", "c2", 1, 5, "=C", None, {"NM": tag("i", i=1)}),
    ("q4", 0, "c1", 70000, 1, "100000N1M", None, None, 0, "A", "I", {"XZ": tag("Z", s="")}),
]


def table(rows):
    return pa.RecordBatch.from_arrays([pa.array([list(x.items()) for x in c] if n == "tags" else c, k) for (n, k), c in zip(bamcodec.SCHEMA, zip(*rows, strict=True), strict=True)], [n for n, _ in bamcodec.SCHEMA])


def records(data):
    out, i = [], 0
    while i < len(data):
        n = 4 + struct.unpack_from("<i", data, i)[0]
        out.append(data[i : i + n])
        i += n
    return out


def rows_of(columns):
    return [(*r[:-1], dict(r[-1])) for r in zip(*(c.to_pylist() for c in columns), strict=True)]


@pytest.mark.parametrize("at", [0, 1, 3])
def test_what_is_written_is_read_back(at):
    got = rows_of(bamcodec.decode(records(bamcodec.encode(table(ROWS).slice(at), ["c1", "c2"])), ["c1", "c2"]))
    assert got == ROWS[at:]


def test_a_record_byte_by_byte():
    found = bamcodec.encode(table([ROWS[2]]), ["c1", "c2"])
    body = struct.pack("<iiBBHHHiiii", 0, 0, 3, 255, binning.bin_of(0, 2), 1, 0, 2, 1, 0, 5) + b"q3\0" + struct.pack("<I", 2 << 4) + b"\x02" + b"\xff\xff" + b"NMi" + struct.pack("<i", 1)
    assert found == struct.pack("<i", len(body)) + body
    assert struct.unpack_from("<H", bamcodec.encode(table([ROWS[3]]), ["c1"]), 14)[0] == binning.bin_of(69999, 170000)


def test_tags_as_others_write_them():
    head = struct.pack("<iiBBHHHiiii", -1, -1, 2, 0, 4680, 0, 4, 0, -1, -1, 0) + b"q\0"
    tags = b"XcC\xff" + b"Xss" + struct.pack("<h", -300) + b"XII" + struct.pack("<I", 1 << 31) + b"XBBS" + struct.pack("<I2H", 2, 1, 65535) + b"XZZab\0" + b"XcC\x07"
    out = rows_of(bamcodec.decode([struct.pack("<i", len(head + tags)) + head + tags], []))[0][-1]
    assert out == {"Xc": tag("i", i=7), "Xs": tag("i", i=-300), "XI": tag("i", i=1 << 31), "XB": tag("B", ai=[1, 65535]), "XZ": tag("Z", s="ab")}


def test_batches_of_long_records_are_bounded():
    long = ("q", 4, None, None, 0, None, None, None, 0, "A" * 100_000, None, {})
    data = records(bamcodec.encode(table([long] * 100), []))
    sizes = [b.num_rows for b in bgzf.batches_of(iter(data), [])]
    assert sum(sizes) == 100 and max(sizes) <= 1 + bgzf.BATCH_BYTES // 150_000 + 1


def test_wrong_records_are_errors():
    with pytest.raises(ValueError):
        bamcodec.encode(table([(*ROWS[2][:10], "I", {})]), ["c1", "c2"])
    with pytest.raises(ValueError):
        bamcodec.encode(table([(*ROWS[2][:11], {"NM": tag("i", i=1 << 31)})]), ["c1", "c2"])
