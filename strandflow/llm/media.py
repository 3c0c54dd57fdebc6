"""Media columns: Netpbm and BMP images decoded, resized by integral images, written as NPY tiles.

Decoding: Netpbm P1 to P6 (bitmaps become 0 and 255; samples of other depths are brought to 8 bits)
and uncompressed BMP of 1, 4, 8, 16, 24 or 32 bits, with masks or without. Resizing takes the exact
mean of each target cell's area, with fractional edges, from one integral image. A tile is an NPY file
in a binary column, and its difference hash tells whether each grey cell is darker than its right
neighbour. Media and tiles are Parquet tables that Spark's committer writes; nothing is shuffled, and a
task holds one Arrow batch.

Null media give null results; media that are broken, or of a kind not read here, give null results and
say so in `problem`; an image without pixels has no tile. Null and empty texts are one row of spaces.
Repeated rows, also those of equal or null key, have a row each; an empty table gives an empty one.
Columns of the names that are made here are replaced; `digests` reads doc_id and text only.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import cut, remove_folder, shared_folder, small_batches

#: Bytes of a payload row: 64 pixels of three samples.
ROW = 192
_HEAD = re.compile(rb"(P[1-6])((?:\s|#[^\n]*\n)+)(\d+)((?:\s|#[^\n]*\n)+)(\d+)")


class Unsupported(ValueError):
    """A valid file, as far as it was read, of a kind that is not decoded."""


def decode(data: bytes) -> np.ndarray:
    """Samples of a Netpbm or BMP image: height x width [x 3], 8 bits each."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    head = _HEAD.match(data)
    if not head:
        raise Unsupported("neither Netpbm nor BMP")
    kind, width, height, at = head[1], int(head[3]), int(head[5]), head.end()
    top = 1
    if kind not in (b"P1", b"P4"):
        depth = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)").match(data, at)
        top, at = int(depth[1]), depth.end()
        if not 0 < top < 65536:
            raise ValueError("no depth of samples")
    planes = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        found = re.findall(rb"[01]" if kind == b"P1" else rb"\d+", body)[: width * height * planes]
        samples = np.array(found, dtype="S").astype(np.int64) if found else np.zeros(0, np.int64)
    elif kind == b"P4":
        row = (width + 7) // 8
        bits = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        samples = np.unpackbits(bits, axis=1)[:, :width].ravel()
    else:
        samples = np.frombuffer(data, np.uint8 if top < 256 else ">u2", width * height * planes, at + 1)
    if kind in (b"P1", b"P4"):
        samples = (1 - samples) * 255
    elif top != 255:
        samples = np.minimum(samples.astype(np.int64), top) * 255 // top
    return samples.astype(np.uint8, copy=False).reshape((height, width, 3) if planes == 3 else (height, width))


def _decode_bmp(data: bytes) -> np.ndarray:
    at, size, width, height, _, bits, packed = struct.unpack_from("<I I i i H H I", data, 10)
    if bits not in (1, 4, 8, 16, 24, 32) or packed not in ((0, 3) if bits in (16, 32) else (0,)):
        raise Unsupported("a BMP of another kind")
    row = (width * bits + 31) // 32 * 4
    lines = np.frombuffer(data, np.uint8, row * abs(height), at).reshape(abs(height), row)
    lines = lines[::-1] if height > 0 else lines
    if bits == 24:
        return lines[:, : width * 3].reshape(abs(height), width, 3)[:, :, ::-1]
    if bits <= 8:
        each = np.unpackbits(lines, axis=1).reshape(abs(height), -1, bits)  # the first pixel is in the highest bits
        index = (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)[:, :width]
        colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.zeros((256, 4), np.uint8)
        palette[:colours] = np.frombuffer(data, np.uint8, colours * 4, 14 + size).reshape(-1, 4)
        return palette[:, 2::-1][index]
    whole = np.ascontiguousarray(lines).view("<u2" if bits == 16 else "<u4")[:, :width].astype(np.int64)
    masks = struct.unpack_from("<III", data, 54) if packed else (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
    planes = []
    for mask in masks:
        if not mask:
            raise ValueError("a plane without bits")
        low = mask & -mask
        planes.append((whole & mask) // low * 255 // (mask // low))
    return np.stack(planes, axis=2).astype(np.uint8)


def encode_ppm(samples: np.ndarray) -> bytes:
    """A binary Netpbm file of the samples: P6 for three planes, else P5."""
    return b"P%d\n%d %d\n255\n" % (6 if samples.ndim == 3 else 5, samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP file of three planes, bottom row first."""
    height, width = samples.shape[:2]
    row = (width * 3 + 3) // 4 * 4
    lines = np.zeros((height, row), np.uint8)
    lines[:, : width * 3] = samples[::-1, :, ::-1].reshape(height, width * 3)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + row * height, 0, 0, 54, 40, width, height, 1, 24, 0, row * height, 2835, 2835, 0, 0) + lines.tobytes()


def _edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the edges of m equal cells lie on n pixels: whole pixels before each, and what is left in m-ths of one."""
    edge = np.arange(m + 1) * n
    return edge // m, edge % m


def area_sums(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Sums over equal cells of the image, times height * width: whole numbers from its integral image, taken linearly between pixels."""
    sums = np.zeros((grey.shape[0] + 2, grey.shape[1] + 2), np.int64)
    sums[1:-1, 1:-1] = grey.astype(np.int64).cumsum(0).cumsum(1)
    sums[-1], sums[:, -1] = sums[-2], sums[:, -2]
    rows, r = _edges(grey.shape[0], height)
    cols, c = _edges(grey.shape[1], width)
    upper = sums[rows] * (height - r)[:, None] + sums[rows + 1] * r[:, None]
    at = upper[:, cols] * (width - c) + upper[:, cols + 1] * c
    return at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of equal cells of the image, to the nearest whole number, halves up."""
    area = grey.shape[0] * grey.shape[1]
    return ((2 * area_sums(grey, height, width) + area) // (2 * area)).astype(np.uint8)


def grey_of(samples: np.ndarray) -> np.ndarray:
    """Grey levels by the usual integer weights."""
    if samples.ndim == 2:
        return samples
    s = samples.astype(np.uint32)
    return ((299 * s[:, :, 0] + 587 * s[:, :, 1] + 114 * s[:, :, 2]) // 1000).astype(np.uint8)


def tile(samples: np.ndarray, height: int = 8, width: int = 9) -> tuple[bytes, str]:
    """An NPY file of the resized grey image, and its difference hash in hexadecimal digits."""
    small = area_resize(grey_of(samples), height, width)
    out = io.BytesIO()
    np.save(out, small, allow_pickle=False)
    bits = (small[:, :-1] < small[:, 1:]).ravel()
    return out.getvalue(), np.packbits(bits).tobytes().hex()


def text_image(text: str | None) -> bytes:
    """A text stored as an image of 64 pixels a row, padded with spaces to whole rows.

    Both formats are in use: payloads of an odd CRC-32 are BMP, others binary Netpbm; a payload beyond
    what BMP's 32-bit sizes hold is Netpbm too.
    """
    data = (text or "").encode()
    data += b" " * (-len(data) % ROW if data else ROW)
    samples = np.frombuffer(data, np.uint8).reshape(-1, ROW // 3, 3)
    return encode_bmp(samples) if zlib.crc32(data) & 1 and len(data) < 1 << 31 else encode_ppm(samples)


def store_texts(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`media binary`: each text as an image file, with its unpadded size; a null text is empty."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([text_image(t) for t in texts], pa.binary())], names=["key", "n_bytes", "media"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


_MADE = {"pixels": pa.binary(), "height": pa.int32(), "width": pa.int32(), "npy": pa.binary(), "dhash": pa.string(), "problem": pa.string()}


def _tile_row(data: bytes | None, height: int, width: int) -> tuple:
    if data is None:
        return (None,) * 6
    try:
        samples = decode(data)
    except Unsupported:
        return (None, None, None, None, None, "of a kind not read here")
    except (ValueError, TypeError, struct.error):
        return (None, None, None, None, None, "broken")
    if not samples.size:
        return (b"", None, None, None, None, None)
    return (samples.tobytes(), *samples.shape[:2], *tile(samples, height, width), None)


def tiles(df: DataFrame, media: str = "media", height: int = 8, width: int = 9) -> DataFrame:
    """All columns, and of each media file pixels (the samples in row order), shape, NPY tile, difference hash and problem."""
    small_batches(df.sparkSession)
    kept = [f for f in df.schema if f.name.lower() not in _MADE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_tile_row(data, height, width) for data in b.column(b.schema.get_field_index(media)).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(_MADE)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(f.name)) for f in kept] + [pa.array(c, k) for c, k in zip(columns, _MADE.values(), strict=True)], names=[*[f.name for f in kept], *_MADE])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, f"{kinds}, pixels binary, height int, width int, npy binary, dhash string, problem string")


def write_tiles(df: DataFrame, folder: str) -> None:
    """Write the columns, NPY tiles among them, as a Parquet table."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(folder)


def digests(df: DataFrame) -> DataFrame:
    """One row per document: sizes and digests of the payload as read back and of the stored form, its tile's hash and digest.

    Texts are written as media files, read back, tiled, and the tiles written and read back; both
    tables are removed once their digests are kept.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "media")
    write_tiles(store_texts(df), f"{folder}/files")
    made = tiles(spark.read.parquet(f"{folder}/files")).select(
        "doc_id", "n_bytes", F.length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.expr("substring(pixels, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "npy", F.col("dhash").alias("feature"),
    )
    write_tiles(made, f"{folder}/tiles")
    back = spark.read.parquet(f"{folder}/tiles")
    out = cut(back.withColumn("npy_sha256", F.sha2("npy", 256)).drop("npy"))
    remove_folder(spark, folder)
    return out
