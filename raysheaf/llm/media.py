"""Image columns: Netpbm and BMP codecs on numpy, area resizing, NPY tiles, difference hashes.

``decode`` reads binary and plain Netpbm (P1 to P6) and uncompressed 8- and 24-bit BMP of
either row order into (height, width, channels) arrays; ``encode`` writes P5, P6 and
24-bit BMP. ``area_resize`` averages over fractional source areas by one integral image,
so its cost does not depend on the size of the areas. A difference hash compares adjacent
cells of a 9 by 8 grey tile. Tiles are stored as version 1.0 NPY bytes, and read back from
them for what is said of them.

The query stores each text losslessly as samples, 192 to a row of 64 RGB or 192 grey
pixels. Which of the three formats a payload gets follows from its CRC-32, so equal texts
share all values.

Edge cases: a null or empty text is one row of spaces; texts of any length are one image
each, 192 bytes wide and as high as needed; a broken image raises ``ValueError`` in the
decoder and gives nulls in ``image_features``; a null id stays null; repeated rows and ties
repeat their results; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROW = 192
FORMATS = ("P5", "P6", "BMP")
TILE = (32, 32)
HASH = (8, 9)


def _header(data: bytes, count: int, at: int) -> tuple[list[int], int]:
    """The next ``count`` numbers of a Netpbm header, comments skipped, and the place behind them."""
    found: list[int] = []
    while len(found) < count:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at)
            if at < 0:
                raise ValueError("the header ends in a comment")
            continue
        end = at
        while end < len(data) and 48 <= data[end] <= 57:
            end += 1
        if end == at:
            raise ValueError("not a number in the header")
        found.append(int(data[at:end]))
        at = end
    return found, at


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[:2].decode("ascii", "replace")
    bits, plain, channels = kind in ("P1", "P4"), kind in ("P1", "P2", "P3"), 3 if kind in ("P3", "P6") else 1
    numbers, at = _header(data, 2 if bits else 3, 2)
    width, height, top = *numbers[:2], 1 if bits else numbers[2]
    if width < 1 or height < 1 or not 0 < top < 65536:
        raise ValueError("bad size or maximum")
    n = width * height * channels
    if plain:
        text = b"\n".join(x.split(b"#", 1)[0] for x in data[at:].split(b"\n"))
        values = [c - 48 for c in text if c in (48, 49)] if bits else [int(x) for x in text.split()]
        flat = np.array(values[:n], dtype=np.uint16)
    elif bits:
        rows = np.frombuffer(data, np.uint8, (width + 7) // 8 * height, at + 1).reshape(height, -1)
        flat = np.unpackbits(rows, axis=1)[:, :width].ravel()
    else:
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    if flat.size < n:
        raise ValueError("the samples end early")
    image = flat.reshape(height, width, channels)
    if bits:
        return ((1 - image) * 255).astype(np.uint8)
    if top in (255, 65535):
        return image.astype(np.uint8 if top == 255 else np.uint16)
    return (image.astype(np.uint32) * 255 // top).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    start, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, planes, depth, packing = struct.unpack_from("<iiHHI", data, 18)
    if size < 40 or planes != 1 or depth not in (8, 24) or packing or width < 1 or not height:
        raise ValueError("not an uncompressed 8- or 24-bit BMP")
    stride = (width * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * depth // 8]
    if height > 0:
        rows = rows[::-1]
    if depth == 24:
        return rows.reshape(abs(height), width, 3)[:, :, ::-1].copy()
    colours = struct.unpack_from("<I", data, 46)[0] or 256
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    return palette[rows]


def decode(data: bytes) -> np.ndarray:
    if data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    if data[:2] == b"BM":
        try:
            return _bmp(data)
        except struct.error as e:
            raise ValueError("the header ends early") from e
    raise ValueError("neither Netpbm nor BMP")


def encode(image: np.ndarray, kind: str) -> bytes:
    """8-bit samples as P5, P6 or 24-bit BMP with the top row last."""
    height, width, channels = image.shape
    if channels != (1 if kind == "P5" else 3):
        raise ValueError(f"{kind} takes {1 if kind == 'P5' else 3} channels")
    if kind != "BMP":
        return f"{kind}\n{width} {height}\n255\n".encode() + image.tobytes()
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = image[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each target cell, edges counted by their share."""
    h, w, channels = image.shape
    total = np.zeros((h + 1, w + 1, channels))
    np.cumsum(image, axis=0, out=total[1:, 1:], dtype=np.float64)
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])

    def at(edges: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
        """The integral image at fractional places along the first axis."""
        low = np.minimum(edges.astype(np.int64), n - 1)
        part = (edges - low).reshape(-1, *[1] * (sums.ndim - 1))
        return sums[low] * (1 - part) + sums[low + 1] * part

    rows = np.diff(at(np.linspace(0, h, height + 1), total, h), axis=0)
    cells = np.diff(at(np.linspace(0, w, width + 1), rows.swapaxes(0, 1), w), axis=0).swapaxes(0, 1)
    return cells / (h / height * w / width)


def grey(image: np.ndarray) -> np.ndarray:
    if image.shape[2] == 1:
        return image.astype(np.float64)
    return (image[:, :, :3] @ np.array([0.299, 0.587, 0.114]))[:, :, None]


def difference_hash(image: np.ndarray) -> str:
    """64 bits, one per pair of neighbours in a row of the 8 by 9 grey tile, as 16 hexadecimal digits."""
    cells = np.round(grey(area_resize(image, *HASH))[:, :, 0], 6)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def features(data: bytes) -> tuple[str, bytes]:
    """Difference hash and NPY tile of stored image bytes."""
    image = decode(data)
    tile = np.clip(np.round(area_resize(image, *TILE)), 0, 255).astype(np.uint8)
    return difference_hash(image), npy(tile)


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b" ")


def store(payload: bytes) -> bytes:
    kind = FORMATS[zlib.crc32(payload) % len(FORMATS)]
    samples = np.frombuffer(payload, np.uint8)
    return encode(samples.reshape(-1, ROW, 1) if kind == "P5" else samples.reshape(-1, ROW // 3, 3), kind)


MEDIA = "id {key}, n_bytes long, media binary"


def to_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media): each text as an image file."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                found = [payload_of(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([store(p) for _, p in found], pa.binary())], ["id", "n_bytes", "media"])

    return rows.mapInArrow(run, MEDIA.format(key=rows.schema["id"].dataType.simpleString()))


def image_features(media: DataFrame) -> DataFrame:
    """(id, n_bytes, media) with what is read back from the stored bytes: samples' digests, feature, and the NPY tile with its digest and mean."""
    kind = media.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile", "tile_sha256", "tile_mean")}
                for data in (x.as_py() for x in part.column("media")):
                    try:
                        image = decode(data)
                        payload, (feature, tile) = image.tobytes(), features(data)
                        row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, tile, hashlib.sha256(tile).hexdigest(), round(float(from_npy(tile).mean()), 6))
                    except (ValueError, TypeError):
                        row = (None, None, None, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), None, None, None, None)
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), *[pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]], ["id", "n_bytes", *out])

    return media.select("id", "n_bytes", "media").mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary, tile_sha256 string, tile_mean double")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_features(to_media(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id").drop("tile")
