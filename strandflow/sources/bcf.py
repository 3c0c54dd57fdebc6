"""Binary variants (BCF 2) as a Spark data source of VCF text lines.

Header lines come from the task with a file's beginning, records from the task in whose byte range they
begin, as for BAM. What reads VCF text reads these lines. `register(spark)` makes it
spark.read.format("bcf"); `read` gives variant records.
"""

from __future__ import annotations

import re
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from strandflow.operators import variants
from strandflow.sources.bgzf import FolderWriter, SplitReader, _Members, _open, split_records

#: Value types by code: struct letter, bytes, and the codes of a missing value and of a vector's end.
_TYPES = {1: ("b", 1, -128, -127), 2: ("h", 2, -(2**15), -(2**15) + 1), 3: ("i", 4, -(2**31), -(2**31) + 1), 5: ("I", 4, 0x7F800001, 0x7F800002)}


class Header:
    """The header's text and its dictionaries of names; records begin `inside` the member at `first`."""

    def __init__(self, path: str):
        with _open(path) as f:
            data, starts = b"", []
            for at, piece in _Members(f, 0):
                starts.append((at, len(data)))
                data += piece
                if data[:4] != b"BCF\2":
                    raise ValueError(f"{path} is no BCF file")
                if len(data) >= 9 and len(data) > (end := 9 + struct.unpack_from("<I", data, 5)[0]):
                    break
            else:
                end = len(data)
        self.first, before = [s for s in starts if s[1] <= end][-1]
        self.inside = end - before
        self.know(data[9:end].rstrip(b"\0").decode().splitlines())

    def know(self, lines: list[str]) -> None:
        self.lines = lines
        self.names, self.contigs = {0: "PASS"}, {}
        self.n_samples = max([0, *[line.count("\t") - 8 for line in self.lines if line.startswith("#CHROM")]])
        for line in self.lines:
            m = re.match(r"##(FILTER|INFO|FORMAT|contig)=<.*?\bID=([^,>]+)", line)
            if not m:
                continue
            known = self.contigs if m[1] == "contig" else self.names
            if m[2] in known.values():
                continue
            given = re.search(r"\bIDX=(\d+)", line)
            known[int(given[1]) if given else max(known, default=-1) + 1] = m[2]


def _number(v: int, code: int) -> str:
    if v == _TYPES[code][2]:
        return "."
    return f"{struct.unpack('<f', struct.pack('<I', v))[0]:g}" if code == 5 else str(v)


class _Values:
    """Typed values of a record, one after another."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, code: int, n: int) -> list[int] | bytes:
        if code in (0, 7):
            out = self.data[self.at : self.at + n * (code == 7)]
            self.at += n * (code == 7)
            return out
        letter, size = _TYPES[code][:2]
        out = list(struct.unpack_from(f"<{n}{letter}", self.data, self.at))
        self.at += n * size
        return out

    def kind(self) -> tuple[int, int]:
        head = self.data[self.at]
        self.at += 1
        n = head >> 4
        if n == 15:
            n = self.one()
        return head & 15, n

    def one(self) -> int:
        return self.take(*self.kind())[0]

    def text(self) -> str:
        code, n = self.kind()
        return show(self.take(code, n), code)


def show(values: list[int] | bytes, code: int) -> str:
    """Values as VCF text."""
    if code in (0, 7):
        return bytes(values).rstrip(b"\0").decode() or "."
    end = _TYPES[code][3]
    return ",".join(_number(v, code) for v in values if v != end) or "."


def _genotype(values: list[int], code: int) -> str:
    out = ""
    for i, v in enumerate(x for x in values if x != _TYPES[code][3]):
        allele = "." if v >> 1 <= 0 else str((v >> 1) - 1)
        out += (("|" if v & 1 else "/") if i else "") + allele
    return out or "."


def decode_record(data: bytes, header: Header) -> str:
    """One record, with its two lengths, as a VCF line."""
    shared, _, contig, pos, _, qual, counts, cells = struct.unpack_from("<IIiiiIII", data)
    n_info, n_allele, n_sample, n_format = counts & 0xFFFF, counts >> 16, cells & 0xFFFFFF, cells >> 24
    v = _Values(data, 32)
    name = v.text()
    alleles = [v.text() for _ in range(n_allele)]
    tests = v.take(*v.kind())
    info = []
    for _ in range(n_info):
        key = header.names[v.one()]
        code, n = v.kind()
        info.append(key if code == 0 or n == 0 else f"{key}={show(v.take(code, n), code)}")
    v.at = 8 + shared
    keys, columns = [], []
    for _ in range(n_format):
        keys.append(header.names[v.one()])
        code, n = v.kind()
        each = [v.take(code, n) for _ in range(n_sample)]
        columns.append([_genotype(x, code) if keys[-1] == "GT" and code in (1, 2, 3) else show(x, code) for x in each])
    fields = [header.contigs[contig], str(pos + 1), name, alleles[0] if alleles else ".", ",".join(alleles[1:]) or ".", _number(qual, 5), ";".join(header.names[t] for t in tests) or ".", ";".join(info) or "."]
    if n_format:
        fields += [":".join(keys), *[":".join(cell) for cell in zip(*columns, strict=True)]]
    return "\t".join(fields)


def _length(data: bytes, i: int) -> int | None:
    return 8 + sum(struct.unpack_from("<II", data, i)) if i + 8 <= len(data) else None


def _sound(data: bytes, i: int, header: Header) -> bool:
    """Whether records may begin at i: as many following ones as the data hold, up to three, look right."""
    for _ in range(3):
        if i + 33 > len(data):
            return True
        shared, indiv, contig, pos, size, _, counts, cells = struct.unpack_from("<IIiiiIII", data, i)
        if not (contig in header.contigs and pos >= -1 and size >= 0 and counts >> 16 and 24 < shared < 1 << 26 and indiv < 1 << 28):
            return False
        if cells & 0xFFFFFF != header.n_samples or (indiv > 0) != (cells >> 24 > 0 and header.n_samples > 0) or data[i + 32] & 15 not in (0, 7):
            return False
        i += 8 + shared + indiv
    return True


def _typed(kind: int, n: int, body: bytes) -> bytes:
    return (bytes([n << 4 | kind]) if n < 15 else bytes([0xF0 | kind]) + _integers([n])) + body


def _integers(values: list[int | None], width: int = 0) -> bytes:
    """Whole numbers as a typed vector of 32 bits, filled up to `width`."""
    return _typed(3, max(width, len(values)), _pack(values, width, "i"))


def _pack(values: list, width: int, letter: str) -> bytes:
    """Values of 32 bits with codes for missing ones and behind the last."""
    _, _, missing, end = _TYPES[3 if letter == "i" else 5]
    bits = [missing if v is None else v if letter == "i" else struct.unpack("<I", struct.pack("<f", v))[0] for v in values]
    return struct.pack(f"<{max(width, len(bits))}{'i' if letter == 'i' else 'I'}", *bits, *[end] * (width - len(bits)))


def _text(value: str) -> bytes:
    body = b"" if value == "." else value.encode()
    return _typed(7, len(body), body)


def _parsed(value: str, kind: str) -> list:
    number = int if kind == "Integer" else float
    return [None if x == "." else number(x) for x in value.split(",")]


class Encoder:
    """Records from VCF lines, by the dictionaries of a header's lines."""

    def __init__(self, text: str):
        header = Header.__new__(Header)
        header.know(text.splitlines())
        self.text = text
        self.names = {n: i for i, n in header.names.items()}
        self.contigs = {n: i for i, n in header.contigs.items()}
        self.kinds = {(m[1], m[2]): m[3] for m in re.finditer(r"##(INFO|FORMAT)=<.*?\bID=([^,>]+).*?\bType=([A-Za-z]+)", text)}

    def head(self) -> bytes:
        data = self.text.encode() + b"\0"
        return b"BCF\2\2" + struct.pack("<I", len(data)) + data

    def _info(self, entry: str) -> bytes:
        key, has, value = entry.partition("=")
        kind = self.kinds.get(("INFO", key), "String")
        if kind == "Flag" or not has:
            body = b"\0"
        elif kind == "Integer":
            body = _integers(_parsed(value, kind))
        elif kind == "Float":
            values = _parsed(value, kind)
            body = _typed(5, len(values), _pack(values, 0, "f"))
        else:
            body = _text(value)
        return _integers([self.names[key]]) + body

    def _format(self, key: str, cells: list[str]) -> bytes:
        kind = self.kinds.get(("FORMAT", key), "String")
        if key == "GT":
            calls = [re.findall(r"([|/]?)([.0-9]+)", c) for c in cells]
            values = [[(0 if a == "." else int(a) + 1) << 1 | (s == "|") for s, a in call] for call in calls]
        elif kind in ("Integer", "Float"):
            values = [_parsed(c, kind) for c in cells]
        else:
            raw = [b"." if c == "." else c.encode() for c in cells]
            width = max(map(len, raw))
            return _integers([self.names[key]]) + _typed(7, width, b"".join(x.ljust(width, b"\0") for x in raw))
        width, letter = max(map(len, values)), "f" if kind == "Float" and key != "GT" else "i"
        return _integers([self.names[key]]) + _typed(5 if letter == "f" else 3, width, b"".join(_pack(v, width, letter) for v in values))

    def record(self, line: str) -> bytes:
        contig, pos, name, ref, alt, qual, tests, info, *cells = line.split("\t")
        alleles = [ref, *([] if alt == "." else alt.split(","))]
        entries = [] if info == "." else info.split(";")
        keys = cells[0].split(":") if cells else []
        samples = [(c.split(":") + ["."] * len(keys))[: len(keys)] for c in cells[1:]]
        body = _text(name) + b"".join(map(_text, alleles)) + (b"\0" if tests == "." else _integers([self.names[t] for t in tests.split(";")])) + b"".join(map(self._info, entries))
        indiv = b"".join(self._format(k, [s[i] for s in samples]) for i, k in enumerate(keys)) if samples else b""
        score = struct.pack("<I", _TYPES[5][2]) if qual == "." else struct.pack("<f", float(qual))
        shared = struct.pack("<iii", self.contigs[contig], int(pos) - 1, len(ref)) + score + struct.pack("<II", len(entries) | len(alleles) << 16, len(samples) | (len(keys) if samples else 0) << 24) + body
        return struct.pack("<II", len(shared), len(indiv)) + shared + indiv


class BcfWriter(FolderWriter):
    """BCF files of VCF lines (column `line`); `header` is the header's text."""

    ending = ".bcf"

    def __init__(self, options, overwrite: bool = False):
        super().__init__(options, overwrite)
        self.encoder = Encoder(options["header"])

    def head(self):
        return self.encoder.head()

    def encode(self, row):
        return self.encoder.record(row["line"])


class BcfReader(SplitReader):
    def read(self, partition):
        header = Header(partition.path)
        if partition.start == 0:
            yield from ((line,) for line in header.lines)
        for record in split_records(partition, header.first, header.inside, _length, lambda data, i: _sound(data, i, header)):
            yield (decode_record(record, header),)


class BcfSource(DataSource):
    """Options: path (comma-separated files or folders), splitBytes; for writing path (a folder) and header."""

    @classmethod
    def name(cls):
        return "bcf"

    def schema(self):
        return "line string"

    def reader(self, schema):
        return BcfReader(self.options)

    def writer(self, schema, overwrite):
        return BcfWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BcfSource)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Variant records of the files, which have the same samples."""
    register(spark)
    rows = spark.read.format("bcf").load(path)
    names = [r["sample"] for r in variants.samples(rows.where(F.col("line").startswith("#CHROM")).limit(1)).orderBy("ordinal").collect()]  # one line
    return variants.parse(rows, names)
