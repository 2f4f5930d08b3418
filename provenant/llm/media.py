"""Media columns: Netpbm and BMP images as numpy arrays, resized tiles and difference hashes.

`decode` reads PBM, PGM and PPM (plain and raw, 8 and 16 bits) and uncompressed BMP of
8, 24 and 32 bits.  `area_resize` averages exactly the area that each target pixel
covers, by differences of an integral image.  `difference_hash` compares horizontal
neighbours of a 9 by 8 reduction.  `tile` gives the resized image as the bytes of an NPY
file.

Decided cases: null and malformed images give null results in `media_features` and a
ValueError in `decode`; a null text counts as empty in `op4_media`; repeated rows give
repeated results; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, record, table

_SPACE = b" \t\n\x0b\x0c\r"


# -- formats ----------------------------------------------------------------


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """`count` decimal fields after the magic number, and where the last one ends."""
    fields, at = [], 2
    for _ in range(count):
        while True:
            while data[at : at + 1] and data[at] in _SPACE:
                at += 1
            if data[at : at + 1] != b"#":
                break
            at = data.find(b"\n", at) + 1 or len(data)
        m = re.compile(rb"\d+").match(data, at)
        if not m:
            raise ValueError("bad Netpbm header")
        fields.append(int(m[0]))
        at = m.end()
    return fields, at


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    (width, height, *rest), at = _header(data, 2 if kind in (1, 4) else 3)
    top = rest[0] if rest else 1
    if not width or not height or not 0 < top < 65536:
        raise ValueError("bad Netpbm size")
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if kind in (1, 2, 3):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        flat = re.findall(rb"[01]" if kind == 1 else rb"\d+", body)[:n]
        values = np.array(flat, dtype="S").astype(np.uint16) if flat else np.zeros(0, np.uint16)
        if kind == 1:
            values = 1 - values
    elif kind == 4:
        row = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, offset=at + 1)[: row * height]
        if packed.size < row * height:
            raise ValueError("short Netpbm raster")
        values = 1 - np.unpackbits(packed.reshape(height, row), axis=1)[:, :width].ravel()
    else:
        values = np.frombuffer(data, np.uint8 if top < 256 else ">u2", count=min(n, (len(data) - at - 1) // (1 + (top > 255))), offset=at + 1)
    if values.size < n:
        raise ValueError("short Netpbm raster")
    values = values.astype(np.uint8 if top < 256 else np.uint16)
    return values.reshape((height, width, 3) if channels == 3 else (height, width))


def _decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("short BMP header")
    start, head, width, height = struct.unpack_from("<IIii", data, 10)
    bits, packing, _, _, _, colours = struct.unpack_from("<HIIiiI", data, 28)
    rows = abs(height)
    if packing or bits not in (8, 24, 32) or width <= 0 or not rows:
        raise ValueError("unsupported BMP")
    stride = (width * bits // 8 + 3) // 4 * 4
    raster = np.frombuffer(data, np.uint8, offset=start)[: stride * rows]
    if raster.size < stride * rows:
        raise ValueError("short BMP raster")
    raster = raster.reshape(rows, stride)[:, : width * bits // 8]
    if height > 0:
        raster = raster[::-1]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, count=4 * (colours or 256), offset=14 + head).reshape(-1, 4)
        if raster.max(initial=0) >= len(palette):
            raise ValueError("BMP palette too short")
        image = palette[raster][:, :, 2::-1]
        return image[:, :, 0] if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all() else image
    return raster.reshape(rows, width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """Samples as (height, width) or (height, width, 3), red first."""
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
        return _decode_netpbm(data)
    if data[:2] == b"BM":
        return _decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_pgm(samples: np.ndarray) -> bytes:
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_ppm(samples: np.ndarray) -> bytes:
    height, width, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """24-bit BMP of (height, width, 3), rows from below as the format's default."""
    height, width, _ = samples.shape
    stride = (3 * width + 3) // 4 * 4
    raster = np.zeros((height, stride), np.uint8)
    raster[:, : 3 * width] = samples[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + raster.size, 0, 0, 54, 40, width, height, 1, 24, 0, raster.size, 2835, 2835, 0, 0)
    return head + raster.tobytes()


# -- features ---------------------------------------------------------------


def _edges(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(parts + 1) * size / parts
    whole = np.minimum(at.astype(np.int64), size - 1)
    return whole, at - whole


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the source area of each target pixel, float64; also enlarges."""
    image = image.astype(np.float64)
    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1, *image.shape[2:]))
    sums[1:, 1:] = image.cumsum(0).cumsum(1)
    y, fy = _edges(image.shape[0], height)
    x, fx = _edges(image.shape[1], width)
    fy = fy.reshape(-1, *[1] * (image.ndim - 1))
    fx = fx.reshape(1, -1, *[1] * (image.ndim - 2))
    rows = sums[y] * (1 - fy) + sums[y + 1] * fy
    grid = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    area = image.shape[0] * image.shape[1] / (height * width)
    return (grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]) / area


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: is a cell of the 9 by 8 reduction brighter than its left neighbour?"""
    small = area_resize(grey(image), 8, 9)
    return np.packbits((small[:, 1:] > small[:, :-1]).ravel()).tobytes().hex()


def tile(image: np.ndarray, size: int) -> bytes:
    """NPY file of the image resized to `size` by `size` 8-bit samples."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, size, size)), 0, 65535 if image.dtype.itemsize > 1 else 255).astype(image.dtype))
    return out.getvalue()


def media_features(frames: DataFrame, column: str = "image", key: str = "id", size: int = 16) -> DataFrame:
    """(key, height, width, channels, dhash, tile) of encoded images; null fields where one can't be read."""

    def make():
        def one(data: bytes | None):
            try:
                image = decode(data or b"")
            except ValueError:
                return (None,) * 5
            return (*image.shape[:2], 1 if image.ndim == 2 else 3, difference_hash(image), tile(image, size))

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            cells = list(zip(*map(one, batch.column(1).to_pylist()), strict=True)) or [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(cells, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "height", "width", "channels", "dhash", "tile"])

        return step

    kind = frames.schema[key].dataType.simpleString()
    return map_rows(frames.select(key, column), make, f"`{key}` {kind}, height int, width int, channels int, dhash string, tile binary", 64)


#: Samples in a row of the images that texts are stored as.
WIDTH = 64


def store_text(text: str) -> bytes:
    """The UTF-8 bytes as grey samples of a raw PGM, filled up with 0 to whole rows, one row at least."""
    data = text.encode()
    rows = max(1, -(-len(data) // WIDTH))
    return encode_pgm(np.frombuffer(data.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH))


def store_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary): every text as an image."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield record(
                doc_id=batch.column(0),
                n_bytes=pa.array([len(t.encode()) for t in texts], pa.int64()),
                media=pa.array([store_text(t) for t in texts], pa.binary()),
            )

        return step

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, media binary", 128)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text stored as a PGM image, read back, with digests and features of what was read.

    `feature` is the difference hash and the CRC of the 16 by 16 NPY tile.
    """

    def make():
        def one(n: int, media: bytes):
            image = decode(media)
            payload = image.tobytes()
            feature = f"{difference_hash(image)}-{zlib.crc32(tile(image, 16)):08x}"
            return (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            cells = zip(*map(one, batch.column(1).to_pylist(), batch.column(2).to_pylist()), strict=True)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cells, kinds, strict=True))], names=names)

        return step

    stored = store_documents(table(spark, sf_dir, "documents"))
    return map_rows(stored, make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", 128)
