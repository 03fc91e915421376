"""ND2 stacks, by the public descriptions of the chunked format (files since 2010).

A file is a row of chunks: the number MAGIC, the length of the name's field, the length of the data,
the name and the data. The last 40 bytes hold a signature and the place of the chunk map, which
names each chunk with its place and length. `ImageAttributesLV!` holds the frames' size, components
and samples, `ImageMetadataLV!` the loops of the experiment, and `ImageDataSeq|n!` frame n: a time
stamp of 8 bytes, then rows of pixels with their components side by side, raw or deflated.

Attributes are lists of typed values under names of UTF-16 characters; levels hold lists of their own.

Components are channels and frames follow the time loop; a loop over slices counts as frames where
there is no other, and several loops of more than one step are not read. Not read: the older format
on JPEG 2000, and lossy compression.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

#: Fixed values of the format.
MAGIC = 0x0ABECEDA
FILE_NAME, FILE_VERSION = b"ND2 FILE SIGNATURE CHUNK NAME01!", b"Ver3.0"
FILE_MAP, CHUNK_MAP = b"ND2 FILEMAP SIGNATURE NAME 0001!", b"ND2 CHUNK MAP SIGNATURE 0000001!"
ATTRIBUTES, EXPERIMENT, FRAME = b"ImageAttributesLV!", b"ImageMetadataLV!", b"ImageDataSeq|%d!"
BOOL, INT, UINT, LONG, ULONG, DOUBLE, POINTER, TEXT, BYTES, LEVEL = 1, 2, 3, 4, 5, 6, 7, 8, 9, 11
SIMPLE = {BOOL: "<?", INT: "<i", UINT: "<I", LONG: "<q", ULONG: "<Q", DOUBLE: "<d", POINTER: "<Q"}
TIME_LOOP, PLACE_LOOP, SLICE_LOOP, EVENT_LOOP = 1, 2, 4, 8
LOSSLESS, LOSSY, UNCOMPRESSED = 0, 1, 2
#: Bytes of the time stamp before a frame's pixels.
STAMP = 8

Fetch = Callable[[int, int], bytes]


def chunk_map(fetch: Fetch, size: int) -> dict[bytes, tuple[int, int]]:
    """Name -> (place, length of the data) of each chunk."""
    if size < 112 or struct.unpack("<I", fetch(0, 4))[0] != MAGIC:
        raise ValueError("not an ND2 file")
    signature, at = struct.unpack("<32sQ", fetch(size - 40, 40))
    if signature != CHUNK_MAP:
        raise ValueError("an ND2 file without a chunk map")
    data, out, p = chunk(fetch, at), {}, 0
    while (end := data.index(b"!", p) + 1) and data[p:end] != CHUNK_MAP:
        out[data[p:end]] = struct.unpack_from("<QQ", data, end)
        p = end + 16
    return out


def chunk_place(fetch: Fetch, at: int) -> tuple[int, int]:
    """The place and length of the data of the chunk at a place."""
    magic, name, data = struct.unpack("<IIQ", fetch(at, 16))
    if magic != MAGIC:
        raise ValueError("an ND2 chunk is not where the map has it")
    return at + 16 + name, data


def chunk(fetch: Fetch, at: int) -> bytes:
    return fetch(*chunk_place(fetch, at))


def values(data: bytes, count: int = 1) -> dict[str, object]:
    """The typed values of a list; of equal names the last."""
    out, at = {}, 0
    for _ in range(count):
        start = at
        kind, letters = data[at], data[at + 1]
        at += 2 + 2 * letters
        name = data[start + 2 : at].decode("utf-16-le").rstrip("\0")
        if kind in SIMPLE:
            out[name] = struct.unpack_from(SIMPLE[kind], data, at)[0]
            at += struct.calcsize(SIMPLE[kind])
        elif kind == TEXT:
            end = at
            while data[end : end + 2] not in (b"\0\0", b""):
                end += 2
            out[name] = data[at:end].decode("utf-16-le")
            at = end + 2
        elif kind == BYTES:
            (n,) = struct.unpack_from("<Q", data, at)
            out[name] = data[at + 8 : at + 8 + n]
            at += 8 + n
        elif kind == LEVEL:
            n, length = struct.unpack_from("<IQ", data, at)
            out[name] = values(data[at + 12 : start + length], n)
            at = start + length + 8 * n
        else:
            raise ValueError(f"ND2 values of type {kind} are not read")
    return out


def loops(experiment: dict) -> list[tuple[int, int]]:
    """(type, steps) of the loops, the outermost first."""
    out, level = [], experiment
    while isinstance(level, dict) and "eType" in level:
        out.append((level["eType"], level.get("uLoopPars", {}).get("uiCount", 1)))
        inner = level.get("ppNextLevelEx")
        level = next((v for v in inner.values() if isinstance(v, dict)), None) if isinstance(inner, dict) and "eType" not in inner else inner
    return out


def attributes(fetch: Fetch, chunks: dict[bytes, tuple[int, int]]) -> dict:
    """The attributes of the frames, checked for what is read."""
    if ATTRIBUTES not in chunks:
        raise ValueError("an ND2 file without image attributes")
    found = values(chunk(fetch, chunks[ATTRIBUTES][0]))["SLxImageAttributes"]
    if EXPERIMENT in chunks:
        several = [k for k, n in loops(values(chunk(fetch, chunks[EXPERIMENT][0])).get("SLxExperiment", {})) if n > 1]
        if len(several) > 1:
            raise ValueError("ND2 files of more than one loop are not read")
    if found.get("eCompression", UNCOMPRESSED) == LOSSY:
        raise ValueError("ND2 files of lossy compression are not read")
    if found["uiBpcInMemory"] not in (8, 16, 32):
        raise ValueError(f"ND2 samples of {found['uiBpcInMemory']} bits are not read")
    return found


def sample_type(found: dict) -> np.dtype:
    bits = found["uiBpcInMemory"]
    return np.dtype(f"<{'f' if bits == 32 and found.get('ePixelType') == 2 else 'u'}{bits // 8}")


def frame_places(fetch: Fetch, chunks: dict[bytes, tuple[int, int]], found: dict) -> list[tuple[int, int]]:
    """(place, bytes) of each frame's pixels, from the map alone: the field of the name is as long for all frames."""
    out, lead = [], {}
    for k in range(found["uiSequenceCount"]):
        name = FRAME % k
        if name not in chunks:
            raise ValueError(f"an ND2 file without frame {k}")
        at, length = chunks[name]
        if len(name) not in lead:
            place, _ = chunk_place(fetch, at)
            lead[len(name)] = place - at
        out.append((at + lead[len(name)] + STAMP, length - STAMP))
    return out


def pixels(raw: bytes, found: dict) -> np.ndarray:
    """(height, width, components) of a frame's bytes."""
    x, y, c, dtype = found["uiHeight"], found["uiWidth"], found["uiComp"], sample_type(found)
    if found.get("eCompression", UNCOMPRESSED) == LOSSLESS:
        raw = zlib.decompress(raw)
    stride = max(found.get("uiWidthBytes", 0), y * c * dtype.itemsize)
    rows = np.frombuffer(raw, np.uint8, x * stride).reshape(x, stride)[:, : y * c * dtype.itemsize]
    return np.ascontiguousarray(rows).view(dtype).reshape(x, y, c)


def decode_nd2(raw: bytes) -> np.ndarray:
    """(T, C, X, Y), or (T, X, Y) of one component."""
    fetch = lambda at, n: raw[at : at + n]
    chunks = chunk_map(fetch, len(raw))
    found = attributes(fetch, chunks)
    frames = [pixels(fetch(*place), found) for place in frame_places(fetch, chunks, found)]
    stack = np.stack(frames).transpose(0, 3, 1, 2)
    return stack[:, 0] if found["uiComp"] == 1 else stack


def _value(name: str, kind: int, value) -> bytes:
    label = (name + "\0").encode("utf-16-le")
    head = struct.pack("<BB", kind, len(label) // 2) + label
    if kind in SIMPLE:
        return head + struct.pack(SIMPLE[kind], value)
    body = b"".join(value)
    starts, at = [], len(head) + 12
    for v in value:
        starts.append(at)
        at += len(v)
    return head + struct.pack("<IQ", len(value), at) + body + struct.pack(f"<{len(value)}Q", *starts)


def encode_nd2(stack: np.ndarray, compressed: bool = False, padding: int = 0, loop: int = TIME_LOOP) -> bytes:
    """A stack (T, C, X, Y) or (T, X, Y) of unsigned 8 or 16-bit integers or 32-bit floats; padding: bytes after each row."""
    shaped = stack[:, None] if stack.ndim == 3 else stack
    t, c, x, y = shaped.shape
    kind = shaped.dtype.newbyteorder("<")
    width = y * c * kind.itemsize
    out, places = bytearray(), []

    def add(name: bytes, data: bytes) -> int:
        at = len(out)
        field = name + b"\0" * (-len(name) % 16)
        out.extend(struct.pack("<IIQ", MAGIC, len(field), len(data)) + field + data)
        places.append((name, at, len(data)))
        return at

    add(FILE_NAME, FILE_VERSION + b"\0" * 58)
    numbers = {"uiWidth": y, "uiWidthBytes": width + padding, "uiHeight": x, "uiComp": c, "uiBpcInMemory": kind.itemsize * 8, "uiBpcSignificant": kind.itemsize * 8, "uiSequenceCount": t}
    items = [_value(k, UINT, v) for k, v in numbers.items()]
    items += [_value("eCompression", INT, LOSSLESS if compressed else UNCOMPRESSED), _value("ePixelType", INT, 2 if kind.kind == "f" else 1)]
    add(ATTRIBUTES, _value("SLxImageAttributes", LEVEL, items))
    add(EXPERIMENT, _value("SLxExperiment", LEVEL, [_value("eType", UINT, loop), _value("uLoopPars", LEVEL, [_value("uiCount", UINT, t)])]))
    for k, frame in enumerate(np.ascontiguousarray(shaped.transpose(0, 2, 3, 1)).astype(kind)):
        rows = np.zeros((x, width + padding), np.uint8)
        rows[:, :width] = frame.reshape(x, -1).view(np.uint8)
        body = zlib.compress(rows.tobytes()) if compressed else rows.tobytes()
        add(FRAME % k, struct.pack("<d", float(k)) + body)
    listed = b"".join(name + struct.pack("<QQ", at, n) for name, at, n in places)
    at = add(FILE_MAP, listed + CHUNK_MAP + struct.pack("<QQ", 0, 0))
    return bytes(out) + CHUNK_MAP + struct.pack("<Q", at)
