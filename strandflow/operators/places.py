"""Reads unfolded into places by Arrow batch, and counts of places added up by tile.

A task turns its reads into cells, one per covered place, letter, strand and bin, adds up equal ones and sends a
row per tile of TILE places with the cells packed into bytes. After the shuffle by tile, rows come sorted and are
added up as they pass; only the cells of the tile that a batch ends in are held for the next. So a read costs a
row or two in the shuffle, not one for each base, and a deep tile costs each task's batch its distinct cells.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.specs import PileupSpec

#: Places of a tile.
TILE = 1024
#: Places unfolded at once, cells of a packed row, and rows of a batch sent on.
PORTION, PIECE, OUT_ROWS = 1 << 20, 512, 100_000
_LETTER_BITS = 21  # of a code point
_BLOCK = re.compile(r"(\d+)([MIDNSH=X])(?:\d+P)*(?=(\d+I)?)", re.ASCII)


def bin_points(spec: PileupSpec) -> list[float]:
    return [p if math.isinf(p) else int(p) for p in spec.left_bins or spec.query_bins]


def bin_labels(spec: PileupSpec) -> list[str]:
    """Labels of the half-open bins (a, b]."""
    show = [("Inf" if p > 0 else "-Inf") if math.isinf(p) else str(p) for p in bin_points(spec)]
    return [f"({a},{b}]" for a, b in zip(show, show[1:], strict=False)]


@functools.lru_cache(maxsize=10_000)
def _blocks(cigar: str, insertions: bool) -> np.ndarray:
    """Blocks that have places, a row each: kind (0 bases, 1 deletion, 2 skip), length, offsets on the reference and the query, insertion behind."""
    out, r, q = [], 0, 0
    for n, op, behind in _BLOCK.findall(cigar):
        n = int(n)
        if n and (op in "M=XD" or (op == "N" and insertions and behind)):
            out.append(("M=XDN".index(op), n, r, q, behind != ""))
        r += n if op in "MDN=X" else 0
        q += n if op in "MIS=X" else 0
    table = np.array(out, np.int64).reshape(-1, 5)
    table[:, 0] = np.maximum(table[:, 0] - 2, 0)
    return table


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def portions(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows whose sizes add up to about the limit, or of one row."""
    ends, at, before = np.cumsum(sizes), 0, 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, to
        at, before = to, int(ends[to - 1])


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, and each text's first place and length; null is empty."""
    column = column.cast(pa.string())
    lengths = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    text = "".join(x for x in column.to_pylist() if x) if not pc.all(pc.string_is_ascii(column)).as_py() else None
    if text is not None:
        return np.append(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0).astype(np.int64), np.cumsum(lengths) - lengths, lengths
    if not len(column):
        return np.zeros(1, np.uint8), np.zeros(0, np.int64), lengths
    buffers = column.buffers()
    ends = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    # a slice's own stretch: its buffer is that of the whole batch
    data = np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return np.append(data, np.uint8(0)), ends[:-1] - ends[0], lengths


def codes_of(columns: list[pa.Array], n: int) -> np.ndarray:
    """A number for each distinct row of the columns, nulls being equal; dense, in no given order."""
    out = np.zeros(n, np.int64)
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        c = pc.dictionary_encode(c, null_encoding="encode")
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        out = out * max(1, len(c.dictionary)) + c.indices.to_numpy(zero_copy_only=False)
        out = np.unique(out, return_inverse=True)[1]
    return out


def _cells(batch: pa.RecordBatch, spec: PileupSpec, keep: tuple[bool, bool]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, place and cell of every base, deletion and insertion that counts; a cell holds strand and letter if `keep` says so, and bin."""
    number = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
    cigars = pc.dictionary_encode(batch.column("cigar"))
    tables = [_blocks(c, spec.include_insertions) for c in cigars.dictionary.to_pylist()]
    if not any(len(t) for t in tables):
        return
    of = cigars.indices.to_numpy(zero_copy_only=False)
    n_blocks = np.array([len(t) for t in tables])
    first = np.cumsum(n_blocks) - n_blocks
    kind, length, on_ref, on_query, ins = np.concatenate(tables).T
    width = np.where(kind == 2, 1, length)
    sizes = np.array([t[t[:, 0] != 2][:, 1].sum() + len(t) for t in tables])
    pos, minus = number("pos"), (number("flag") & 16) != 0
    letters, seq_at, seq_n = characters(batch.column("seq"))
    quals, qual_at, qual_n = characters(batch.column("qual"))
    has_seq = batch.column("seq").is_valid().to_numpy(zero_copy_only=False)
    ranged = "range_start" in batch.schema.names
    points = bin_points(spec)
    for a, b in portions(sizes[of], PORTION):
        k = n_blocks[of[a:b]]
        row = np.repeat(np.arange(a, b), k)
        block = np.repeat(first[of[a:b]], k) + ramp(k)
        at = pos[row] + on_ref[block] + np.where(kind[block] == 2, length[block] - 1, 0)
        low, high = np.zeros(len(row), np.int64), width[block]
        if ranged:
            low, high = np.maximum(low, number("range_start")[row] - at), np.minimum(high, number("range_end")[row] - at + 1)
        n = np.maximum(high - low, 0)
        i = ramp(n) + np.repeat(low, n)
        row, block, place = np.repeat(row, n), np.repeat(block, n), np.repeat(at, n) + i
        what = kind[block]
        q = on_query[block] + np.where(what == 0, i, 0)
        code = np.zeros(len(row), np.int64)
        if points:
            one, total = q + 1, seq_n[row]
            forward, backward, known = one, one - total - 1, has_seq[row]
            if spec.query_bins:
                forward, backward = np.where(minus[row], total - one + 1, one), np.where(minus[row], -one, backward)
                known = known | ~minus[row] if points[0] >= 0 else known | minus[row]
            elif points[0] >= 0:
                known = np.ones(len(row), bool)
            found = np.searchsorted(np.array(points, float), forward if points[0] >= 0 else backward, "left") - 1
            inside = known & (found >= 0) & (found < len(points) - 1)
            row, block, place, what, q, i, code = (x[inside] for x in (row, block, place, what, q, i, found))
        code = (code * 2 + (minus[row] if keep[0] else 0)) << _LETTER_BITS
        there = q < qual_n[row]
        good = there & (what != 2) & (quals[np.where(there, qual_at[row] + q, -1)].astype(np.int64) - 33 >= spec.min_base_quality)
        there = q < seq_n[row]
        letter = np.where(what == 0, letters[np.where(there, seq_at[row] + q, -1)], ord("-")).astype(np.int64)
        good &= there | (what != 0)
        if not spec.include_deletions:
            good &= what != 1
        if spec.ignore_query_ns:
            good &= letter != ord("N")
        out = [(row[good], place[good], code[good] + (letter[good] if keep[1] else 0))]
        if spec.include_insertions:
            plus = (ins[block] == 1) & ((what == 2) | (i == length[block] - 1))
            out.append((row[plus], place[plus], code[plus] + (ord("+") if keep[1] else 0)))
        yield tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Stretches of 8-byte numbers as binary values."""
    values = np.ascontiguousarray(values, np.int64)
    offsets = (np.append(starts, len(values)) * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of binary values, and how many each holds."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view(np.int64), np.diff(offsets) // 8


def _summed(group: np.ndarray, cell: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (group, cell) added up, in order."""
    shift = int(cell.max(initial=0)).bit_length()
    if n is None:
        both, n = np.unique((group << shift) | cell, return_counts=True)
    else:
        both, first = np.unique((group << shift) | cell, return_inverse=True)
        n = np.bincount(first, n, len(both)).astype(np.int64)
    return both >> shift, both & ((1 << shift) - 1), n


def packer(keys: list[str], spec: PileupSpec, keep: tuple[bool, bool] = (True, True), width: int = TILE) -> Callable:
    """A function of batches of reads that gives rows of `keys`, tile, cells and counts. A cell's top bits are its place in the tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            label = codes_of([batch.column(k) for k in keys], batch.num_rows)
            top = 2 * max(1, len(bin_points(spec))) << _LETTER_BITS
            for row, place, cell in _cells(batch, spec, keep):
                if not len(row):
                    continue
                tile = place // width
                least = int(tile.min())
                both, first, group = np.unique(label[row] * (int(tile.max()) - least + 1) + tile - least, return_index=True, return_inverse=True)
                g, cell, n = _summed(group, (place - tile * width) * top + cell)
                new = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                ranks = np.arange(len(g)) - np.repeat(new, np.diff(np.append(new, len(g))))
                starts = np.flatnonzero(ranks % PIECE == 0)
                of = first[g[starts]]
                columns = [batch.column(k).take(pa.array(row[of])) for k in keys]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(tile[of], pa.int32()), _packed(cell, starts), _packed(n, starts)], [*keys, "tile", "cells", "n"])

    return run


def adder(keys: list[str], spec: PileupSpec, finish: Callable) -> Callable:
    """A function of batches of packed rows, sorted by keys and tile, that gives rows of `keys`, pos and what `finish` makes of cells.

    finish(spot, letter, strand, bin, n) is given equal cells added up, in the order of spots (places of groups), and
    returns the indexes of the cells whose keys and places its rows have, and columns by name.
    """
    bins = max(1, len(bin_points(spec)))

    def rows(table: pa.Table, first: np.ndarray, g: np.ndarray, cell: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(g):
            return
        place, of_bin, strand, letter = parted(cell, bins)
        at, columns = finish(g * TILE + place, letter, strand, of_bin, n)
        tile = table.column("tile").to_numpy().astype(np.int64)[first[g[at]]]
        pos = pa.array(tile * TILE + place[at], pa.int32())
        each = table.select(keys).take(pa.array(first[g[at]]))
        out = pa.table([*each.columns, pos, *columns.values()], [*keys, "pos", *columns])
        yield from out.combine_chunks().to_batches(OUT_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.binary_length(batch.column("cells")).to_numpy() // 8
            for a, b in portions(sizes, PORTION):
                table = pa.Table.from_batches([batch.slice(a, b - a)])
                table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
                cell, m = _unpacked(table.column("cells").combine_chunks())
                n, _ = _unpacked(table.column("n").combine_chunks())
                code = codes_of([table.column(k) for k in [*keys, "tile"]], table.num_rows)
                new = np.append(True, code[1:] != code[:-1])
                first, group = np.flatnonzero(new), np.cumsum(new) - 1
                g, cell, n = _summed(np.repeat(group, m), cell, n)
                # the last group may go on in the next batch
                to = int(np.searchsorted(g, len(first) - 1))
                last = table.slice(int(first[-1]), 1).select([*keys, "tile"])
                zero = np.zeros(1, np.int64)
                held = last.append_column("cells", _packed(cell[to:], zero)).append_column("n", _packed(n[to:], zero))
                yield from rows(table, first, g[:to], cell[:to], n[:to])
        if held is not None:
            cell, _ = _unpacked(held.column("cells").combine_chunks())
            n, _ = _unpacked(held.column("n").combine_chunks())
            yield from rows(held, np.zeros(1, np.int64), np.zeros(len(cell), np.int64), cell, n)

    return run


def unfolded(reads: DataFrame, keys: list[str], spec: PileupSpec) -> DataFrame:
    """A row per read and place that counts: `keys`, pos, strand and nucleotide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, place, cell in _cells(batch, spec, (True, True)) if batch.num_rows else ():
                columns = [batch.column(k).take(pa.array(row)) for k in keys]
                letter, strand = texts(cell & ((1 << _LETTER_BITS) - 1)), texts(cell >> _LETTER_BITS & 1, ["+", "-"])
                yield pa.RecordBatch.from_arrays([*columns, pa.array(place, pa.int32()), strand, letter], [*keys, "pos", "strand", "nucleotide"])

    rows = reads.select(*dict.fromkeys([*keys, "pos", "flag", "cigar", "seq", "qual"]))
    return rows.mapInArrow(run, ", ".join([*(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes), "pos int", "strand string", "nucleotide string"]))


def parted(cell: np.ndarray, bins: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place in the tile, bin, strand and letter of cells."""
    rest = cell >> _LETTER_BITS
    return (rest >> 1) // bins, (rest >> 1) % bins, rest & 1, cell & ((1 << _LETTER_BITS) - 1)


def texts(codes: np.ndarray, names: list[str] | None = None) -> pa.Array:
    """Code points as letters, or numbers as names."""
    known, of = np.unique(codes, return_inverse=True)
    return pa.array([names[k] if names else chr(k) for k in known], pa.string()).take(pa.array(of))


def counted(reads: DataFrame, keys: list[str], spec: PileupSpec, keep: tuple[bool, bool], finish: Callable, columns: str, skip: DataFrame | None = None, skip_by: list[str] | None = None) -> DataFrame:
    """Rows of `keys` (of which seqnames is the reads' rname), pos and `columns`, by one shuffle of packed tiles. Tiles of `skip` are left out before it."""
    ranges = [c for c in ("range_start", "range_end") if c in reads.columns]
    rows = reads.select(*[F.col("rname").alias(k) if k == "seqnames" else F.col(k) for k in keys], *ranges, "pos", "flag", "cigar", "seq", "qual")
    kinds = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes)
    packed = rows.mapInArrow(packer(keys, spec, keep), f"{kinds}, tile int, cells binary, n binary")
    if skip is not None:
        packed = packed.join(skip, skip_by, "left_anti").select(*keys, "tile", "cells", "n")
    dealt = packed.repartition(*keys, "tile").sortWithinPartitions(*keys, "tile")
    return dealt.mapInArrow(adder(keys, spec, finish), f"{kinds}, pos int, {columns}")
