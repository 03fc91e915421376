"""Stacks of any size: a Spark data source that reads files in parts, by their offsets.

    read_stacks(spark, folder)            rows of pixels of all frames, as a DataFrame
    series_of(rows), labels_of(rows)      the tables that analyses start from
    write_files(files, folder)            files (name, content) into a folder

`binaryFile` holds a file in one row of one task. Here an input partition is a run of strips,
tiles or frames of about `bytes_per_partition` bytes, found from the file's directory or chunk map
alone, so a stack of any size is read by many tasks, none of which holds more than a part. Filters
on the file's name, channel and frame (=, in, <, <=, >, >=) reach the source: only the segments of
pages that pass are read at all. Files below that size are read whole, several to a partition,
and their directories are not looked at before.

Rows are (image_id, t, c, x, y, pixels, error): up to `columns` pixels of row x from column y on;
t is null for an image of two dimensions. A file that cannot be read gives one row with its error.

Files are opened by pyarrow's file systems: local and mounted folders, and the remote stores that
pyarrow is built for (S3, GCS, Azure, HDFS). For a store that only Spark reads, tiff.files() is the
way in.
"""

from __future__ import annotations

import contextlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from wavegrid.sources import nd2, tiff

SCHEMA = "image_id string, t int, c int, x int, y int, pixels array<double>, error string"
ARROW = pa.schema([("image_id", pa.string()), ("t", pa.int32()), ("c", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("pixels", pa.list_(pa.float64())), ("error", pa.string())])
FORMAT = "wavegrid_stacks"
#: Rows of a batch that the source hands to Spark, and bytes that are read ahead.
BATCH_ROWS, AHEAD = 4096, 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


@contextlib.contextmanager
def reading(path: str):
    """(fetch, size) of a file; small reads are served from what was read ahead."""
    system, at = opened(path)
    with system.open_input_file(at) as f:
        size, held, start = f.size(), b"", 0

        def fetch(place: int, n: int) -> bytes:
            nonlocal held, start
            if n >= AHEAD:
                return f.read_at(n, place) if place < size else b""
            if not start <= place <= place + n <= start + len(held):
                held, start = (f.read_at(min(AHEAD, size - place), place) if place < size else b""), place
            return held[place - start : place - start + n]

        yield fetch, size


@dataclass
class Stack:
    """A file's pixels, by segments: tuples of page, place, bytes, first row and first column, and what their decoding needs.

    frames: of each page, its frame and its first component's channel.
    """

    dims: int
    frames: list[tuple[int | None, int]]
    components: int
    segments: list[tuple]
    found: object

    def pixels(self, raw: bytes, s: tuple) -> np.ndarray:
        """(rows, columns, components)."""
        if isinstance(self.found, tiff.Layout):
            return tiff.segment_pixels(raw, self.found, tiff.Segment(*s))[:, :, None]
        return nd2.pixels(raw, self.found)


def stack_of(name: str, fetch: tiff.Fetch, size: int, part: int) -> Stack:
    """Where the pixels of a file are. Raw segments larger than `part` bytes are cut into runs of rows."""
    if tiff.extension(name) == "nd2":
        chunks = nd2.chunk_map(fetch, size)
        found = nd2.attributes(fetch, chunks)
        places = nd2.frame_places(fetch, chunks, found)
        segments = [(k, at, n, 0, 0) for k, (at, n) in enumerate(places)]
        return Stack(4 if found["uiComp"] > 1 else 3, [(k, 0) for k in range(len(places))], found["uiComp"], segments, found)
    found = tiff.layout(fetch)
    order, frames = found.order, [(None, 0)] * found.order.size
    for at, page in np.ndenumerate(order):
        frames[int(page)] = (at[0] if at else None, at[1] if len(at) > 1 else 0)
    segments = []
    for s in found.segments:
        line = s.columns * found.dtype.itemsize
        if s.packing != tiff.NONE or s.predictor != 1 or s.count <= part:
            segments.append(tuple(s))
            continue
        inside, step = min(s.rows, found.height - s.top), max(1, part // max(1, line))
        for row in range(0, inside, step):
            n = min(step, inside - row)
            segments.append(tuple(s._replace(offset=s.offset + row * line, count=n * line, top=s.top + row, rows=n)))
    return Stack(2 + order.ndim, frames, 1, segments, found._replace(segments=[], order=np.zeros(0, int)))


@dataclass
class Part(InputPartition):
    """Whole small files, or some segments of a large one."""

    files: list[tuple[str, str]] = field(default_factory=list)
    stack: Stack | None = None
    error: str | None = None


class StackReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.part = int(options.get("bytes_per_partition", 64 << 20))
        self.columns = int(options.get("columns", 64))
        self.dims = {int(d) for d in options.get("dimensions", "2,3,4").split(",")}
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Filters on the name, channel and frame are noted; Spark applies all of them again, since errors have no frame."""
        kinds = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in kinds and f.attribute in (("image_id",), ("c",), ("t",)):
                self.tests.append((f.attribute[0], kinds[type(f)], f.value))
            yield f

    def passes(self, **at) -> bool:
        """Whether a row of these values may pass the filters."""
        compare = {"=": lambda a, b: a == b, "in": lambda a, b: a in b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
        return all(at[name] is not None and compare[kind](at[name], value) for name, kind, value in self.tests if name in at)

    def wanted(self, stack: Stack) -> list[tuple]:
        """The segments with a frame and channel that pass."""
        pages = [any(self.passes(t=t, c=c + k) for k in range(stack.components)) for t, c in stack.frames]
        return [s for s in stack.segments if pages[s[0]]]

    def listed(self) -> list[tuple[str, str, int]]:
        """(name, path, bytes) of the folder's image files, or of one file."""
        system, at = opened(self.path)
        info = system.get_file_info(at)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(at))
        prefix = self.path if info.is_file else None
        out = [(f.base_name, prefix or f"{self.path.rstrip('/')}/{f.base_name}", f.size) for f in found if f.is_file and f.extension in tiff.EXTENSIONS and not f.base_name.startswith(("_", "."))]
        return sorted(f for f in out if self.passes(image_id=f[0]))

    def partitions(self) -> list[Part]:
        out, small, size = [], Part(), 0
        for name, path, n in self.listed():
            if n > self.part:
                out += self.parts_of(name, path)
                continue
            if small.files and size + n > self.part:
                out.append(small)
                small, size = Part(), 0
            small.files.append((name, path))
            size += n
        return [*out, small] if small.files or not out else out

    def parts_of(self, name: str, path: str) -> list[Part]:
        """The parts of a large file, from its directory."""
        try:
            with reading(path) as (fetch, size):
                stack = self.checked(stack_of(name, fetch, size, self.part))
        except Exception as e:  # noqa: BLE001  the error goes into the result
            return [Part([(name, path)], None, f"{type(e).__name__}: {e}")]
        out, here, size = [], [], 0
        for s in self.wanted(stack):
            if here and size + s[2] > self.part:
                out.append(here)
                here, size = [], 0
            here.append(s)
            size += s[2]
        return [Part([(name, path)], Stack(stack.dims, stack.frames, stack.components, x, stack.found)) for x in [*out, here] if x]

    def checked(self, stack: Stack) -> Stack:
        if stack.dims not in self.dims:
            expected = " or ".join(map(str, sorted(self.dims)))
            raise ValueError(f"{expected} dimensions are expected, not {stack.dims}")
        return stack

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        for name, path in partition.files:
            error = partition.error
            if error is None:
                try:
                    with reading(path) as (fetch, size):
                        stack = partition.stack or self.checked(stack_of(name, fetch, size, self.part))
                        for s in self.wanted(stack):
                            yield from self.rows(name, stack, s, stack.pixels(fetch(s[1], s[2]), s))
                except (ValueError, KeyError, IndexError, OSError, ArithmeticError, zlib.error, struct_error) as e:
                    error = f"{type(e).__name__}: {e}"
            if error is not None:
                yield pa.RecordBatch.from_pylist([{"image_id": name, "error": error}], ARROW)

    def rows(self, name: str, stack: Stack, s: tuple, pixels: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The rows of a segment, cut to `columns` pixels."""
        (t, first), (height, width, components) = stack.frames[s[0]], pixels.shape
        for k in range(components):
            if not self.passes(t=t, c=first + k):
                continue
            for left in range(0, width, self.columns):
                part = pixels[:, left : left + self.columns, k]
                for top in range(0, height, BATCH_ROWS):
                    block = part[top : top + BATCH_ROWS].astype(float)
                    n, w = block.shape
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * w + 1, w), pa.int32()), pa.array(block.ravel()))
                    x = pa.array(np.arange(s[3] + top, s[3] + top + n), pa.int32())
                    number = lambda v, n=n: pa.nulls(n, pa.int32()) if v is None else pa.array(np.full(n, v), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), number(t), number(first + k), x, number(s[4] + left), lists, pa.nulls(n, pa.string())], schema=ARROW)


struct_error = tiff.struct.error


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    """Writes rows (name, content) as files: under a name of their own first, renamed when all tasks are done."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator) -> Written:
        system, at = opened(self.path)
        system.create_dir(at, recursive=True)
        names = []
        for row in iterator:
            staged = f"_{uuid.uuid4().hex}"
            with system.open_output_stream(f"{at}/{staged}") as f:
                f.write(bytes(row["content"]))
            names.append((staged, row["name"]))
        return Written(names)

    def commit(self, messages) -> None:
        system, at = opened(self.path)
        for staged, name in (x for m in messages if m for x in m.names):
            system.move(f"{at}/{staged}", f"{at}/{name}")

    def abort(self, messages) -> None:
        system, at = opened(self.path)
        for staged, _ in (x for m in messages if m for x in m.names):
            system.delete_file(f"{at}/{staged}")


class StackSource(DataSource):
    """Options: path, bytes_per_partition, columns, dimensions (those of images that are read, as '3,4')."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StackReader:
        return StackReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are added to a folder; the mode must be 'append'")
        return FileWriter(dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    """The session with the source, and with filters that reach Python sources (a setting that concerns only these)."""
    spark.dataSource.register(StackSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_stacks(spark: SparkSession, path: str, **options) -> DataFrame:
    """SCHEMA of the TIFF and ND2 files of a folder, or of one file."""
    return registered(spark).read.format(FORMAT).options(path=path, **{k: str(v) for k, v in options.items()}).load()


def write_files(files: DataFrame, path: str) -> None:
    """Files (name, content) into a folder that all executors reach."""
    registered(files.sparkSession)
    files.select("name", "content").write.format(FORMAT).mode("append").save(path)


def series_of(rows: DataFrame) -> DataFrame:
    """(image_id, c, x, y, values, error): the series of images, as tiff.load_images() gives them.

    One exchange brings the frames of a run of pixels together: frames x `columns` numbers.
    """
    runs = rows.where("error is null").groupBy("image_id", "c", "x", "y").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("t", F.lit(0)).alias("t"), "pixels"))).alias("at"))
    each = runs.select("image_id", "c", "x", "y", "at", F.explode(F.sequence(F.lit(0), F.size(F.element_at("at", 1)["pixels"]) - 1)).alias("i"))
    series = each.select("image_id", "c", "x", (F.col("y") + F.col("i")).alias("y"), F.transform("at", lambda a: F.get(a["pixels"], F.col("i"))).alias("values"), F.lit(None).cast("string").alias("error"))
    none = [F.lit(None).cast(k).alias(n) for n, k in (("c", "int"), ("x", "int"), ("y", "int"), ("values", "array<double>"))]
    # A file may have an error in several parts.
    return series.unionByName(rows.where("error is not null").groupBy("image_id").agg(F.min("error").alias("error")).select("image_id", *none, "error"))


def labels_of(rows: DataFrame) -> DataFrame:
    """(image_id, t, x, y, label, error): the pixels of masks, as tiff.load_masks() gives them."""
    pixels = rows.where("error is null").select("image_id", "t", "x", "y", F.posexplode("pixels").alias("i", "v"))
    labels = pixels.select("image_id", "t", "x", (F.col("y") + F.col("i")).alias("y"), F.col("v").cast("bigint").alias("label"), F.lit(None).cast("string").alias("error"))
    none = [F.lit(None).cast(k).alias(n) for n, k in (("t", "int"), ("x", "int"), ("y", "int"), ("label", "bigint"))]
    return labels.unionByName(rows.where("error is not null").groupBy("image_id").agg(F.min("error").alias("error")).select("image_id", *none, "error"))
