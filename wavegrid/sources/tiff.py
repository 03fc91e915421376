"""TIFF stacks: a reader and writer, and Spark sources on them.

Read are classic files and BigTIFF of either byte order, in strips or tiles, uncompressed or
compressed by LZW, deflate or PackBits, with or without horizontal differences or those of floats'
bytes, of one sample a pixel: integers of 8, 16 and 32 bits and floats of 32 and 64.

A file's pages are frames. Channels come from the first page's ImageDescription: `channels=C`
(pages go frame by frame, channel by channel), the `Pixels` element of OME metadata with its order
of dimensions, or the fields of an ImageJ stack, also one whose frames follow a single directory.
Slices count as frames where there is one frame only. Masks are read the same way, and so are ND2
files (see nd2.py). The functions here hold a file at a time; stacks.py reads large ones in parts.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Callable
from pathlib import PurePosixPath
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.sources.nd2 import decode_nd2

#: Tags of the TIFF 6.0 format that are read here, and sizes of its field types (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 270, 273, 277, 278, 279, 339
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
INTEGERS = {1: "B", 3: "H", 4: "I", 16: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
EXTENSIONS = ("tif", "nd2")


def extension(name: str) -> str:
    """The last suffix; names may hold more dots."""
    ext = PurePosixPath(name).suffix[1:]
    if ext not in EXTENSIONS:
        raise ValueError(f"unsupported image file {name!r}: the extension must be one of {EXTENSIONS}")
    return ext


def encode_tiff(stack: np.ndarray, compression: str | None = None) -> bytes:
    """A stack (T, C, X, Y), (T, X, Y) or (X, Y) of unsigned 8, 16, 32-bit, signed 32-bit integers or 32-bit floats, as it is or by deflate."""
    if compression not in (None, "deflate"):
        raise ValueError(f"unknown compression {compression!r}")
    shaped = stack[None, None] if stack.ndim == 2 else stack[:, None] if stack.ndim == 3 else stack
    t, c, x, y = shaped.shape
    kind = shaped.dtype
    sample = {"u": 1, "i": 2, "f": 3}[kind.kind]
    pages = np.ascontiguousarray(shaped.reshape(t * c, x, y)).astype(kind.newbyteorder("<"))
    note = f"channels={c}\nframes={t}".encode() + b"\0"
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    for k, page in enumerate(pages):
        body = page.tobytes() if compression is None else zlib.compress(page.tobytes())
        size = len(body)
        entries = [(WIDTH, 4, 1, y), (HEIGHT, 4, 1, x), (BITS, 3, 1, kind.itemsize * 8), (COMPRESSION, 3, 1, NONE if compression is None else DEFLATE), (262, 3, 1, 1)]
        start = len(out)
        n = 10 + (k == 0)
        data = start + 2 + 12 * n + 4
        if k == 0:
            entries.append((DESCRIPTION, 2, len(note), data))
            data += len(note) + len(note) % 2
        entries += [(OFFSETS, 4, 1, data), (SAMPLES, 3, 1, 1), (ROWS, 4, 1, x), (COUNTS, 4, 1, size), (FORMAT, 3, 1, sample)]
        out += struct.pack("<H", n)
        for tag, type_, count, value in entries:
            out += struct.pack("<HHIHH", tag, type_, count, value, 0) if type_ == 3 else struct.pack("<HHII", tag, type_, count, value)
        end = data + size + size % 2
        out += struct.pack("<I", end if k + 1 < len(pages) else 0)
        if k == 0:
            out += note + b"\0" * (len(note) % 2)
        out += body + b"\0" * (size % 2)
    return bytes(out)


def unpacked_lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; the width grows one code early, as the format has it."""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, held, bits, last, out = list(start), 9, 0, 0, None, []
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 256:
            table, width, last = list(start), 9, None
            continue
        if code == 257:
            break
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = 9 + sum(len(table) >= n for n in (511, 1023, 2047))
    return b"".join(out)


def unpacked_bits(raw: bytes) -> bytes:
    """Runs of bytes and repeated bytes (PackBits)."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += raw[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


UNPACKED = {NONE: bytes, LZW: unpacked_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpacked_bits}


Fetch = Callable[[int, int], bytes]


def of_bytes(raw: bytes) -> Fetch:
    """Reads n bytes at a place of a file that is held whole."""
    return lambda at, n: raw[at : at + n]


def directories(fetch: Fetch) -> tuple[str, list[dict[int, list]]]:
    """The byte order and the tags of each page."""
    start = fetch(0, 16)
    if start[:2] not in (b"II", b"MM") or len(start) < 8:
        raise ValueError("not a TIFF file")
    e = "<" if start[:2] == b"II" else ">"
    version = struct.unpack_from(f"{e}H", start, 2)[0]
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    # Widths of a count of entries, of an entry and of an offset, classic and BigTIFF.
    number, entry, offset, wide = ("H", 12, "I", 4) if version == 42 else ("Q", 20, "Q", 8)
    size = struct.calcsize(f"{e}{number}")
    at, pages, seen = struct.unpack_from(f"{e}{offset}", start, 4 if version == 42 else 8)[0], [], set()
    while at and at not in seen:
        seen.add(at)
        tags: dict[int, list] = {}
        n = struct.unpack(f"{e}{number}", fetch(at, size))[0]
        body = fetch(at + size, entry * n + wide)
        for k in range(n):
            tag, type_ = struct.unpack_from(f"{e}HH", body, entry * k)
            count = struct.unpack_from(f"{e}{offset}", body, entry * k + 4)[0]
            length = TYPE_SIZE.get(type_, 1) * count
            if type_ != 2 and type_ not in INTEGERS:
                continue
            data = body[entry * k + 4 + wide :]
            if length > wide:
                data = fetch(struct.unpack_from(f"{e}{offset}", data)[0], length)
            if type_ == 2:
                tags[tag] = [data[:count].rstrip(b"\0").decode("utf-8", "replace")]
            else:
                tags[tag] = list(struct.unpack_from(f"{e}{count}{INTEGERS[type_]}", data))
        pages.append(tags)
        at = struct.unpack_from(f"{e}{offset}", body, entry * n)[0]
    if not pages:
        raise ValueError("a TIFF file without pages")
    return e, pages


def sample_type(e: str, tags: dict[int, list]) -> np.dtype:
    if tags.get(SAMPLES, [1])[0] != 1:
        raise ValueError("only TIFF files of one sample a pixel are read")
    bits, sample = tags.get(BITS, [1])[0], tags.get(FORMAT, [1])[0]
    if (sample, bits) not in {(1, 8), (1, 16), (1, 32), (2, 8), (2, 16), (2, 32), (3, 32), (3, 64)}:
        raise ValueError(f"samples of {bits} bits and format {sample} are not read")
    return np.dtype(f"{e}{ {1: 'u', 2: 'i', 3: 'f'}[sample] }{bits // 8}")


class Segment(NamedTuple):
    """A strip or tile of a page: its bytes, where its pixels belong, and its size as stored."""

    page: int
    offset: int
    count: int
    top: int
    left: int
    rows: int
    columns: int
    packing: int
    predictor: int


class Layout(NamedTuple):
    """Where a file's pixels are. order: the page of each frame and channel (T, C), of each frame (T) or of one image ()."""

    dtype: np.dtype
    height: int
    width: int
    order: np.ndarray
    segments: list[Segment]


def page_segments(page: int, tags: dict[int, list], dtype: np.dtype) -> list[Segment]:
    packed, predictor = tags.get(COMPRESSION, [NONE])[0], tags.get(PREDICTOR, [1])[0]
    if packed not in UNPACKED:
        raise ValueError(f"compression {packed} is not read")
    if predictor not in (1, 2, 3) or (predictor == 2) > (dtype.kind != "f") or (predictor == 3) > (dtype.kind == "f"):
        raise ValueError(f"predictor {predictor} is not read")
    x, y = tags[HEIGHT][0], tags[WIDTH][0]
    tiled = TILE_OFFSETS in tags
    rows, columns = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(tags.get(ROWS, [x])[0], x), y)
    offsets = tags[TILE_OFFSETS if tiled else OFFSETS]
    counts = tags.get(TILE_COUNTS if tiled else COUNTS) or [x * y * dtype.itemsize]
    across, out = -(-y // columns), []
    for k, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        top, left = k // across * rows, k % across * columns
        out.append(Segment(page, at, n, top, left, rows if tiled else min(rows, x - top), columns, packed, predictor))
    return out


def layout(fetch: Fetch) -> Layout:
    """The places of a file's pixels, from its directories alone."""
    e, tags = directories(fetch)
    description = tags[0].get(DESCRIPTION, [""])[0]
    dtype, x, y = sample_type(e, tags[0]), tags[0][HEIGHT][0], tags[0][WIDTH][0]
    follow = re.search(r"\bimages=(\d+)", description) if description.startswith("ImageJ=") else None
    if follow and len(tags) == 1 and int(follow[1]) > 1:
        if tags[0].get(COMPRESSION, [NONE])[0] != NONE:
            raise ValueError("an ImageJ stack of one directory must not be compressed")
        n, size = int(follow[1]), x * y * dtype.itemsize
        segments = [Segment(k, tags[0][OFFSETS][0] + k * size, size, 0, 0, x, y, NONE, 1) for k in range(n)]
    else:
        if any((sample_type(e, t), t[HEIGHT][0], t[WIDTH][0]) != (dtype, x, y) for t in tags):
            raise ValueError("pages of several sizes or kinds of samples are not read")
        n, segments = len(tags), [s for k, t in enumerate(tags) for s in page_segments(k, t, dtype)]
    return Layout(dtype, x, y, arranged(np.arange(n)[:, None, None], description)[..., 0, 0], segments)


def segment_pixels(raw: bytes, found: Layout, s: Segment) -> np.ndarray:
    """The pixels of a segment's bytes that are inside the image."""
    size, data = s.rows * s.columns, UNPACKED[s.packing](raw)
    if s.predictor == 3:
        # Planes of bytes, the highest first, as differences along the row.
        rows = np.frombuffer(data, np.uint8, size * found.dtype.itemsize).reshape(s.rows, -1)
        planes = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(s.rows, found.dtype.itemsize, s.columns).transpose(0, 2, 1)
        part = np.ascontiguousarray(planes).view(found.dtype.newbyteorder(">")).reshape(s.rows, s.columns)
    else:
        part = np.frombuffer(data, found.dtype, size).reshape(s.rows, s.columns)
        if s.predictor == 2:
            part = np.cumsum(part, axis=1, dtype=found.dtype.newbyteorder("="))
    return part[: found.height - s.top, : found.width - s.left]


def arranged(pages: np.ndarray, description: str) -> np.ndarray:
    """Pages as (T, C, X, Y) if the description names channels, else as (T, X, Y), or (X, Y) of one page."""
    size = {k: int(m[1]) if (m := re.search(rf"\b{k}=(\d+)", description)) else 1 for k in ("channels", "slices", "frames")}
    shape = (size["frames"], size["slices"], size["channels"])
    if pixels := re.search(r"<(?:\w+:)?Pixels\b[^>]*>", description):
        named = dict(re.findall(r'(\w+)="([^"]*)"', pixels[0]))
        order = named.get("DimensionOrder", "XYCZT")[2:]
        sizes = {d: int(named.get(f"Size{d}", 1)) for d in order}
        shape = tuple(sizes[d] for d in "TZC")
        if math.prod(shape) == len(pages):
            there = [sizes[d] for d in order[::-1]]
            numbers = np.arange(len(pages)).reshape(there).transpose([order[::-1].index(d) for d in "TZC"])
            pages = pages[numbers.ravel()]
    t, z, c = shape
    if c > 1 and len(pages) % c:
        raise ValueError(f"{len(pages)} pages do not have {c} channels each")
    if z > 1 and t > 1:
        raise ValueError("stacks with slices and frames are not read")
    if c > 1:
        return pages.reshape(len(pages) // c, c, *pages.shape[1:])
    return pages if len(pages) > 1 else pages[0]


def decode_tiff(raw: bytes) -> np.ndarray:
    """The pages of a file, see arranged()."""
    fetch = of_bytes(raw)
    found = layout(fetch)
    pages = np.zeros((found.order.size, found.height, found.width), found.dtype)
    for s in found.segments:
        part = segment_pixels(fetch(s.offset, s.count), found, s)
        pages[s.page, s.top : s.top + part.shape[0], s.left : s.left + part.shape[1]] = part
    return pages[found.order]


def decode(name: str, raw: bytes) -> np.ndarray:
    return decode_tiff(raw) if extension(name) == "tif" else decode_nd2(raw)


def as_stack(image: np.ndarray) -> np.ndarray:
    """(T, C, X, Y) of an image; one without channels has one."""
    if image.ndim == 3:
        return image[:, None]
    if image.ndim != 4:
        raise ValueError(f"an image must have 3 or 4 dimensions, not {image.ndim}")
    return image


def files(spark: SparkSession, directory: str) -> DataFrame:
    """(path, name, content) of the image files in a directory, on any store that Spark reads."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,nd2}").load(directory)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def load_images(found: DataFrame) -> DataFrame:
    """(image_id, c, x, y, values, error) of files(); a file that cannot be read gives one row with its error."""

    def read(batches):
        for batch in batches:
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    stack = as_stack(decode(name, raw)).astype(np.float32)
                except Exception as e:  # noqa: BLE001  the error goes into the result
                    yield pa.RecordBatch.from_pylist([{"image_id": name, "error": f"{type(e).__name__}: {e}"}], schema)
                    continue
                t, c, x, y = stack.shape
                # A row of pixels at a time, so that a stack is never held twice.
                for i in range(c):
                    for j in range(x):
                        part = stack[:, i, j, :].T.astype(float)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([name] * y), pa.array([i] * y, pa.int32()), pa.array([j] * y, pa.int32()), pa.array(range(y), pa.int32()),
                                pa.ListArray.from_arrays(pa.array(np.arange(0, y * t + 1, max(t, 1))[: y + 1], pa.int32()), pa.array(part.ravel())), pa.nulls(y, pa.string()),
                            ],
                            schema=schema,
                        )

    schema = pa.schema([("image_id", pa.string()), ("c", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("values", pa.list_(pa.float64())), ("error", pa.string())])
    return found.select("name", "content").mapInArrow(read, "image_id string, c int, x int, y int, values array<double>, error string")


def load_masks(found: DataFrame) -> DataFrame:
    """(image_id, t, x, y, label, error): t is null for a mask of two dimensions."""

    def read(batches):
        for batch in batches:
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    mask = decode(name, raw).astype(np.int64)
                    if mask.ndim not in (2, 3):
                        raise ValueError(f"a mask must have 2 or 3 dimensions, not {mask.ndim}")
                except Exception as e:  # noqa: BLE001  the error goes into the result
                    yield pa.RecordBatch.from_pylist([{"image_id": name, "error": f"{type(e).__name__}: {e}"}], schema)
                    continue
                for t, frame in enumerate(mask[None] if mask.ndim == 2 else mask):
                    x, y = np.indices(frame.shape)
                    n = frame.size
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * n), pa.nulls(n, pa.int32()) if mask.ndim == 2 else pa.array(np.full(n, t), pa.int32()),
                            pa.array(x.ravel(), pa.int32()), pa.array(y.ravel(), pa.int32()), pa.array(frame.ravel(), pa.int64()), pa.nulls(n, pa.string()),
                        ],
                        schema=schema,
                    )

    schema = pa.schema([("image_id", pa.string()), ("t", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("label", pa.int64()), ("error", pa.string())])
    return found.select("name", "content").mapInArrow(read, "image_id string, t int, x int, y int, label bigint, error string")


def mask_name(image: str | object):
    """The name of an image's mask file: {stem}_masks.tif."""
    if isinstance(image, str):
        return re.sub(r"\.(tif|nd2)$", "_masks.tif", image)
    return F.regexp_replace(image, r"\.(tif|nd2)$", "_masks.tif")


def pair_files(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(image_filename, mask_filename, found) of tables with a column `name`; found is false where the mask is missing."""
    wanted = images.where(F.col("name").rlike(r"\.(tif|nd2)$")).select(F.col("name").alias("image_filename"), mask_name(F.col("name")).alias("mask_filename"))
    there = masks.select(F.col("name").alias("mask_filename"), F.lit(True).alias("there")).distinct()
    return wanted.join(there, "mask_filename", "left").select("image_filename", "mask_filename", F.coalesce("there", F.lit(False)).alias("found"))
