"""Image headers: size, mode and format from a file's first bytes, without decoding its pixels; colours of plain cards.

Sizes are those after an EXIF rotation. Files are read as rows of bytes
(``binaryFile``), so a folder of any size is a distributed scan.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftwork.operators.images import pixels_of
from siftwork.session import prepare

SCHEMA = "path string, width int, height int, mode string, format string, has_icc boolean, orientation int, exif_orientation_applied boolean, error string"
# PNG colour types, and the JPEG markers that hold a frame's size.
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}


def _orientation(tiff: bytes) -> int:
    """The orientation tag of the first directory of an EXIF block; 1 where it has none."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return 1
    (at,) = struct.unpack_from(order + "I", tiff, 4)
    if at + 2 > len(tiff):
        return 1
    (entries,) = struct.unpack_from(order + "H", tiff, at)
    for i in range(entries):
        place = at + 2 + 12 * i
        if place + 12 > len(tiff):
            break
        tag, _, _, value = struct.unpack_from(order + "HHIH", tiff, place)
        if tag == 0x0112:
            return value if 1 <= value <= 8 else 1
    return 1


def _png(data: bytes) -> tuple[int, int, str, bool, int]:
    width, height, _, kind = struct.unpack_from(">IIBB", data, 16)
    at, icc, turned = 8, False, 1
    while at + 8 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        name = data[at + 4 : at + 8]
        icc |= name == b"iCCP"
        if name == b"eXIf":
            turned = _orientation(data[at + 8 : at + 8 + size])
        if name in (b"IDAT", b"IEND"):
            break
        at += 12 + size
    return width, height, PNG_MODES[kind], icc, turned


def _jpeg(data: bytes) -> tuple[int, int, str, bool, int]:
    at, icc, turned = 2, False, 1
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker")
        marker = data[at + 1]
        if marker == 0xFF or 0xD0 <= marker <= 0xD8 or marker == 1:
            at += 1 if marker == 0xFF else 2
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        if marker == 0xE1 and body.startswith(b"Exif\0\0"):
            turned = _orientation(body[6:])
        icc |= marker == 0xE2 and body.startswith(b"ICC_PROFILE\0")
        if marker in FRAMES:
            _, height, width, parts = struct.unpack_from(">BHHB", body)
            return width, height, JPEG_MODES[parts], icc, turned
        at += 2 + size
    raise ValueError("no frame")


def header(data: bytes) -> tuple[int | None, int | None, str | None, str | None, bool | None, int | None, bool | None, str | None]:
    """(width, height, mode, format, has_icc, orientation, exif_orientation_applied, error) of an image file."""
    kinds = {b"\x89PNG\r\n\x1a\n": ("PNG", _png), b"\xff\xd8\xff": ("JPEG", _jpeg)}
    for magic, (name, read) in kinds.items():
        if data.startswith(magic):
            try:
                width, height, mode, icc, turned = read(data)
            except (ValueError, KeyError, struct.error):
                return None, None, None, name, None, None, None, "decode_error"
            swapped = turned >= 5 and width != height  # a turn by half or a mirror leaves the size alone
            return (height if turned >= 5 else width), (width if turned >= 5 else height), mode, name, icc, turned, swapped, None
    name = "GIF" if data[:4] == b"GIF8" else "BMP" if data[:2] == b"BM" else "TIFF" if data[:4] in (b"II*\0", b"MM\0*") else "WEBP" if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else None
    return None, None, None, name, None, None, None, "unread_format" if name else "decode_error"


def inspect(files: DataFrame) -> DataFrame:
    """SCHEMA for files (path, content). An image that cannot be read keeps its row, with an error."""
    prepare(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.bool_(), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = [(p, *header(c or b"")) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def card_pixels(images: DataFrame, columns: int = 5, rows: int = 2) -> DataFrame:
    """(path, kind, pos, hex, rgb, n) of plain cards: every distinct colour with its pixels (kind colour), and the pixel in the middle of each cell (kind centre).

    ``images``: path, height, width, nChannels, data of Spark's image source. One row a colour leaves the task, not one a pixel.
    """
    prepare(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, h, w, channels, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if h is None or h <= 0:
                    continue
                rgb = pixels_of(h, w, channels, data).astype(np.int64)
                code, n = np.unique((rgb[..., 0] << 16) | (rgb[..., 1] << 8) | rgb[..., 2], return_counts=True)
                out += [(path, "colour", None, int(c), int(k)) for c, k in zip(code, n, strict=True)]
                for i in range(columns * rows):
                    y, x = (i // columns) * (h // rows) + h // rows // 2, (i % columns) * (w // columns) + w // columns // 2
                    out.append((path, "centre", i, int((rgb[y, x] * [65536, 256, 1]).sum()), 1))
            codes = [o[3] for o in out]
            columns_ = [
                pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int32()), pa.array([f"#{c:06X}" for c in codes], pa.string()),
                pa.array([[c >> 16, c >> 8 & 255, c & 255] for c in codes], pa.list_(pa.int32())), pa.array([o[4] for o in out], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns_, ["path", "kind", "pos", "hex", "rgb", "n"])

    return images.select("path", "height", "width", "nChannels", "data").mapInArrow(run, "path string, kind string, pos int, hex string, rgb array<int>, n bigint")
