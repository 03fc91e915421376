"""Files that are read in parts, ND2 files, and what a folder's analysis reports."""

import struct
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from tests.test_signals import KINDS, tiff_file
from wavegrid.plans.pipeline import process_files, process_folder
from wavegrid.sources import nd2, stacks, tiff
from wavegrid.streaming import folders

RNG = np.random.default_rng(4)


def pages_of(t, c, x=6, y=11, dtype=np.uint16):
    return RNG.integers(0, 200, (t, c, x, y)).astype(dtype)


def read_rows(path, filters=(), **options):
    """(rows, what was fetched from the file) by the reader itself, without Spark."""
    reader = stacks.StackReader({"path": str(path), **{k: str(v) for k, v in options.items()}})
    assert list(reader.pushFilters(list(filters))) == list(filters)
    parts, fetched, plain = reader.partitions(), [], stacks.reading

    class Noted:
        def __init__(self, path):
            self.inner = plain(path)

        def __enter__(self):
            fetch, size = self.inner.__enter__()
            return lambda at, n: (fetched.append((at, n)), fetch(at, n))[1], size

        def __exit__(self, *args):
            return self.inner.__exit__(*args)

    with mock.patch.object(stacks, "reading", Noted):
        batches = [b for p in parts for b in reader.read(p)]
    return parts, fetched, pa.Table.from_batches(batches, stacks.ARROW).to_pylist()


def cube(rows, shape):
    """(T, C, X, Y) of rows of pixels."""
    out = np.full(shape, np.nan)
    for r in rows:
        out[r["t"] or 0, r["c"], r["x"], r["y"] : r["y"] + len(r["pixels"])] = r["pixels"]
    return out


def test_a_file_of_ten_pages_has_several_partitions(tmp_path):
    stack = pages_of(5, 2)
    (tmp_path / "a.tif").write_bytes(tiff.encode_tiff(stack))
    parts, _, rows = read_rows(tmp_path, bytes_per_partition=300, columns=4)
    assert len(parts) == 5 and (cube(rows, stack.shape) == stack).all()
    found = tiff.layout(tiff.of_bytes((tmp_path / "a.tif").read_bytes()))
    for filters, t, c in (([EqualTo(("c",), 1)], range(5), [1]), ([EqualTo(("c",), 0), GreaterThanOrEqual(("t",), 2), LessThan(("t",), 4)], [2, 3], [0]), ([In(("t",), (0, 4))], [0, 4], [0, 1])):
        parts, fetched, rows = read_rows(tmp_path, filters, bytes_per_partition=300)
        assert {(r["t"], r["c"]) for r in rows} == {(i, j) for i in t for j in c}
        wanted = {found.order[i, j] for i in t for j in c}
        assert {at for at, _ in fetched} == {s.offset for s in found.segments if s.page in wanted}
    assert read_rows(tmp_path, [EqualTo(("image_id",), "b.tif")])[2] == []


@pytest.mark.parametrize("options", KINDS, ids=str)
def test_parts_equal_the_whole(tmp_path, options):
    pages = [RNG.integers(0, 900, (37, 41)).astype(np.uint16) for _ in range(4)]
    (tmp_path / "a.tif").write_bytes(tiff_file(pages, **options))
    for part in (100, 4000, 10**9):
        rows = read_rows(tmp_path / "a.tif", bytes_per_partition=part, columns=9)[2]
        assert (cube(rows, (4, 1, 37, 41))[:, 0] == np.stack(pages)).all() and len(rows) >= 4 * 37 * 5


def test_large_raw_segments_are_cut_into_rows(tmp_path):
    stack = pages_of(2, 1, 50, 20)
    (tmp_path / "a.tif").write_bytes(tiff.encode_tiff(stack))
    parts, fetched, rows = read_rows(tmp_path, bytes_per_partition=400)
    assert len(parts) == 10 and max(n for _, n in fetched) == 400 and (cube(rows, stack.shape) == stack).all()


def test_differences_of_floats():
    """Planes of bytes, the highest first, as differences along the row."""
    page = RNG.normal(size=(5, 7)).astype(np.float32)
    planes = page.astype(">f4").view(np.uint8).reshape(5, 7, 4).transpose(0, 2, 1).reshape(5, 28)
    raw = np.diff(planes, axis=1, prepend=np.zeros((5, 1), np.uint8)).astype(np.uint8).tobytes()
    found = tiff.Layout(np.dtype("<f4"), 5, 7, np.zeros((), int), [])
    assert (tiff.segment_pixels(raw, found, tiff.Segment(0, 0, len(raw), 0, 0, 5, 7, tiff.NONE, 3)) == page).all()


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16, np.float32])
@pytest.mark.parametrize("channels", [1, 2, 3])
def test_nd2_round_trip(tmp_path, dtype, channels):
    stack = pages_of(4, channels, dtype=dtype)
    for name, options in (("a.nd2", {}), ("b.nd2", {"compressed": True}), ("c.nd2", {"padding": 5})):
        raw = nd2.encode_nd2(stack, **options)
        assert (tiff.as_stack(tiff.decode(name, raw)) == stack).all()
        (tmp_path / name).write_bytes(raw)
        for part in (100, 10**9):
            parts, _, rows = read_rows(tmp_path / name, bytes_per_partition=part)
            assert (cube(rows, stack.shape) == stack).all() and len(parts) == (4 if part == 100 else 1)
        rows = read_rows(tmp_path / name, [EqualTo(("c",), channels - 1), EqualTo(("t",), 2)], bytes_per_partition=100)[2]
        assert {(r["t"], r["c"]) for r in rows} == {(2, channels - 1)}


def test_nd2_values():
    """Values of all types, nested levels and texts."""
    def named(kind, name, body):
        label = (name + "\0").encode("utf-16-le")
        return struct.pack("<BB", kind, len(label) // 2) + label + body

    raw = b"".join([
        named(nd2.BOOL, "b", b"\1"), named(nd2.INT, "i", struct.pack("<i", -3)), named(nd2.DOUBLE, "d", struct.pack("<d", 0.5)), named(nd2.TEXT, "s", "µm\0".encode("utf-16-le")),
        named(nd2.BYTES, "y", struct.pack("<Q", 3) + b"abc"), nd2._value("l", nd2.LEVEL, [nd2._value("x", nd2.LONG, 7), nd2._value("m", nd2.LEVEL, [nd2._value("z", nd2.UINT, 9)])]), named(nd2.ULONG, "q", struct.pack("<Q", 2**40)),
    ])
    assert nd2.values(raw, 7) == {"b": True, "i": -3, "d": 0.5, "s": "µm", "y": b"abc", "l": {"x": 7, "m": {"z": 9}}, "q": 2**40}
    with pytest.raises(ValueError, match="type 77"):
        nd2.values(named(77, "a", b""))


def test_nd2_files_that_are_not_read(spark, tmp_path):
    """Each is one row with its error, and the others are read."""
    good = nd2.encode_nd2(pages_of(3, 2))
    (tmp_path / "good.nd2").write_bytes(good)
    (tmp_path / "cut.nd2").write_bytes(good[:-10])
    (tmp_path / "other.nd2").write_bytes(b"x" * 500)
    (tmp_path / "lossy.nd2").write_bytes(good.replace(nd2._value("eCompression", nd2.INT, nd2.UNCOMPRESSED), nd2._value("eCompression", nd2.INT, nd2.LOSSY)))
    inner = nd2._value("ppNextLevelEx", nd2.LEVEL, [nd2._value("eType", nd2.UINT, nd2.SLICE_LOOP), nd2._value("uLoopPars", nd2.LEVEL, [nd2._value("uiCount", nd2.UINT, 4)])])
    plain = nd2._value
    with mock.patch.object(nd2, "_value", lambda name, kind, value: plain(name, kind, [*value, inner] if name == "SLxExperiment" else value)):
        (tmp_path / "loops.nd2").write_bytes(nd2.encode_nd2(pages_of(3, 2)))
    for part in (50, 10**9):
        rows = stacks.read_stacks(spark, str(tmp_path), bytes_per_partition=part)
        errors = {r.image_id: r.error for r in rows.where("error is not null").collect()}
        assert set(errors) == {"cut.nd2", "other.nd2", "lossy.nd2", "loops.nd2"} and "lossy" in errors["lossy.nd2"] and "loop" in errors["loops.nd2"]
        assert stacks.series_of(rows).where("error is null").count() == 2 * 6 * 11
    assert {r.image_id for r in tiff.load_images(tiff.files(spark, str(tmp_path))).where("error is not null").collect()} == set(errors)


def test_series_and_labels_equal_those_of_whole_files(spark, tmp_path):
    for k, (t, c) in enumerate([(3, 2), (5, 1), (1, 3)]):
        (tmp_path / f"{k}.tif").write_bytes(tiff.encode_tiff(pages_of(t, c), "deflate" if k else None))
    (tmp_path / "broken.tif").write_bytes(b"II*\0no")
    (tmp_path / "flat.tif").write_bytes(tiff.encode_tiff(pages_of(1, 1)[0, 0]))
    rows = lambda df: sorted(map(repr, df.collect()))
    for part in (150, 10**9):
        options = {"bytes_per_partition": part, "columns": 4}
        got = stacks.series_of(stacks.read_stacks(spark, str(tmp_path), dimensions="3,4", **options))
        want = tiff.load_images(tiff.files(spark, str(tmp_path)))
        assert rows(got.where("error is null")) == rows(want.where("error is null"))
        assert {r.image_id for r in got.where("error is not null").collect()} == {"broken.tif", "flat.tif"}
        masks = stacks.labels_of(stacks.read_stacks(spark, str(tmp_path), dimensions="2,3", **options))
        want = tiff.load_masks(tiff.files(spark, str(tmp_path)))
        assert rows(masks.where("error is null")) == rows(want.where("error is null"))
        assert {r.image_id for r in masks.where("error is not null").collect()} == {r.image_id for r in want.where("error is not null").collect()}


def test_filters_reach_the_source(spark, tmp_path):
    stack = pages_of(5, 2)
    (tmp_path / "a.tif").write_bytes(tiff.encode_tiff(stack))
    rows = stacks.read_stacks(spark, str(tmp_path), bytes_per_partition=300)
    assert rows.rdd.getNumPartitions() == 5 and rows.where("c = 1 and t = 3").rdd.getNumPartitions() == 1
    assert (cube([r.asDict() for r in rows.where("c = 1 and t = 3").collect()], (5, 2, 6, 11))[3, 1] == stack[3, 1]).all()


def test_written_files_are_added(spark, tmp_path):
    files = spark.createDataFrame([(f"{k}.tif", tiff.encode_tiff(pages_of(2, 1))) for k in range(5)], "name string, content binary").repartition(3)
    stacks.write_files(files, f"{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"{k}.tif" for k in range(5)]
    assert stacks.read_stacks(spark, f"file:{tmp_path}/out").select("image_id").distinct().count() == 5
    with pytest.raises(ValueError, match="append"):
        stacks.StackSource({"path": "x"}).writer(None, True)


def test_unequal_shapes_are_reported(spark, tmp_path):
    """Of four files one is good: too many channels, too few, and a mask of another size are reported."""
    def tone(c, x=4):
        return np.stack([np.full((c, x, x), np.cos(2 * np.pi * 3 * t / 32)) for t in range(32)]).astype(np.float32) + RNG.normal(0, 0.01, (32, c, x, x)).astype(np.float32)

    images = [("good.tif", tone(2)), ("more.tif", tone(3)), ("less.tif", tone(1)), ("mask.tif", tone(2))]
    mask = lambda n: tiff.encode_tiff(np.ones((n, n), np.uint16))
    masks = [(n.replace(".tif", "_masks.tif"), mask(2 if n == "mask.tif" else 4)) for n, _ in images]
    files = [(n, tiff.encode_tiff(s)) for n, s in images]
    kind = "name string, content binary"
    cells, problems = process_files(spark.createDataFrame(files, kind), spark.createDataFrame(masks, kind), 2, cutoff_frequency_bin=1)
    want = {"more.tif": "an image of 3 channels; 2 are expected", "less.tif": "an image of 1 channels; 2 are expected", "mask.tif": "a mask of 2 x 2 pixels for an image of 4 x 4"}
    assert {r.image_filename: r.error for r in problems.collect()} == want
    assert {r.image_filename for r in cells.collect()} == {"good.tif"}
    for folder, rows in (("images", files), ("masks", masks)):
        (tmp_path / folder).mkdir()
        for n, raw in rows:
            (tmp_path / folder / n).write_bytes(raw)
    again, others = process_folder(spark, str(tmp_path / "images"), str(tmp_path / "masks"), 2, bytes_per_partition=200, cutoff_frequency_bin=1)
    assert {r.image_filename: r.error for r in others.collect()} == want
    a, b = ([[round(v, 9) if isinstance(v, float) else v for v in r] for r in sorted(x.collect())] for x in (cells, again))
    assert a == b


def test_a_growing_folder_is_analysed_file_by_file(spark, tmp_path, monkeypatch):
    """Each run takes the new files only; a batch that runs again changes nothing; a file of another length counts anew."""
    for d in ("images", "masks"):
        (tmp_path / d).mkdir()

    def add(name, c=1, frames=32):
        stack = np.stack([np.full((c, 2, 2), np.cos(2 * np.pi * 3 * t / frames)) for t in range(frames)]).astype(np.float32) + RNG.normal(0, 0.01, (frames, c, 2, 2)).astype(np.float32)
        (tmp_path / "images" / name).write_bytes(tiff.encode_tiff(stack))
        (tmp_path / "masks" / tiff.mask_name(name)).write_bytes(tiff.encode_tiff(np.ones((2, 2), np.uint16)))

    seen, plain = [], folders.process_files
    noted = lambda images, masks, *a, **k: (seen.append((sorted(r.name for r in images.select("name").collect()), masks.count())), plain(images, masks, *a, **k))[1]
    monkeypatch.setattr(folders, "process_files", noted)
    out, options = str(tmp_path / "out"), {"cutoff_frequency_bin": 1, "normalize_histogram": False}
    run = lambda: folders.follow_folder(spark, str(tmp_path / "images"), str(tmp_path / "masks"), out, 1, **options)
    cells = lambda: sorted((r.image_filename, r.batch, r.mask_index) for r in folders.cells_of(spark, out).collect())
    with pytest.raises(ValueError, match="nothing"):
        folders.cells_of(spark, out)
    add("a.tif")
    add("b (x).v1.tif")
    run()
    first = cells()
    assert seen == [(["a.tif", "b (x).v1.tif"], 2)] and [c[:2] for c in first] == [("a.tif", 0)] * 2 + [("b (x).v1.tif", 0)] * 2
    run()
    assert len(seen) == 1 and cells() == first
    add("c.tif", c=2)
    add("d.tif")
    run()
    assert seen[1:] == [(["c.tif", "d.tif"], 2)] and {c[:2] for c in cells()} == {c[:2] for c in first} | {("d.tif", 1)}
    assert [(r.image_filename, r.error) for r in folders.problems_of(spark, out).collect()] == [("c.tif", "an image of 2 channels; 1 are expected")]
    # The second batch again, as after a failure, and in a batch of another number.
    batch = spark.read.format("binaryFile").load([str(tmp_path / "images" / n) for n in ("c.tif", "d.tif")])
    before = cells()
    folders.analyse_batch(batch, 1, str(tmp_path / "masks"), out, 1, **options)
    assert cells() == before and seen[-1][0] == ["c.tif", "d.tif"]
    folders.analyse_batch(batch, 2, str(tmp_path / "masks"), out, 1, **options)
    assert cells() == before and seen[-1] == ([], 0)
    add("a.tif", frames=40)
    folders.analyse_batch(spark.read.format("binaryFile").load(str(tmp_path / "images" / "a.tif")), 3, str(tmp_path / "masks"), out, 1, **options)
    assert [c[:2] for c in cells() if c[0] == "a.tif"] == [("a.tif", 3)] * 2 and len(cells()) == len(before)
