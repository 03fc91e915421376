"""Transforms of long series in blocks, and several scales from one pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavegrid.operators import image, longfft

BLOCKS = "image_id string, c int, x int, y int, block int, values array<double>"


def transformed(df, rows, size):
    """(image_id, y) -> coefficients."""
    out = {}
    for r in longfft.long_transform(df, rows, size).collect():
        out.setdefault((r.image_id, r.y), np.full(rows * size, np.nan, complex))[r.d :: rows] = np.array(r.re) + 1j * np.array(r.im)
    return out


def test_a_million_samples_in_blocks(spark):
    x = np.random.default_rng(1).normal(size=1 << 20)
    df = spark.createDataFrame([("i", 0, 0, 0, k, b.tolist()) for k, b in enumerate(x.reshape(64, -1))], BLOCKS).repartition(4)
    got = transformed(df, 64, 1 << 14)["i", 0]
    want = np.fft.fft(x)
    assert np.abs(got - want).max() < 1e-9 * np.abs(want).max()


@pytest.mark.parametrize("rows,size,held", [(1, 8, 1 << 18), (5, 1, 4), (3, 7, 2), (6, 10, 12), (16, 4, 1 << 18)])
def test_blocks_of_any_shape(spark, rows, size, held, monkeypatch):
    monkeypatch.setattr(longfft, "HELD", held)
    rng = np.random.default_rng(rows)
    series = {y: rng.normal(size=(rows, size)) for y in range(3)}
    df = spark.createDataFrame([("i", 0, 0, y, k, b.tolist()) for y, s in series.items() for k, b in enumerate(s)], BLOCKS).repartition(3)
    got = transformed(df, rows, size)
    for y, s in series.items():
        assert np.abs(got["i", y] - np.fft.fft(s.ravel())).max() < 1e-9
    amplitudes = {(r.y, r.k): r.full_amplitude for r in longfft.long_amplitudes(df, rows, size).collect()}
    for y, s in series.items():
        want = np.abs(np.fft.rfft(s.ravel() - s.mean()))
        assert np.abs(np.array([amplitudes[y, k] for k in range(len(want))]) - want).max() < 1e-9


def test_missing_short_and_null_blocks_hold_zeros(spark):
    df = spark.createDataFrame([("i", 0, 0, 0, 0, [1.0, 2.0, None, 4.0]), ("i", 0, 0, 0, 2, [5.0]), ("i", 0, 0, 0, 3, None)], BLOCKS)
    want = np.fft.fft([1, 2, 0, 4, 0, 0, 0, 0, 5, 0, 0, 0, 0, 0, 0, 0])
    assert np.abs(transformed(df, 4, 4)["i", 0] - want).max() < 1e-12
    assert longfft.long_transform(df.limit(0), 4, 4).count() == 0
    with pytest.raises(ValueError, match="at least one block"):
        longfft.long_transform(df, 0, 4)


def test_scales_of_one_pass_equal_those_one_by_one(spark):
    rng = np.random.default_rng(6)
    rows = [("a", c, x, y, rng.normal(size=3).tolist()) for c in range(2) for x in range(9) for y in range(7)]
    s = spark.createDataFrame(rows, "image_id string, c int, x int, y int, values array<double>").repartition(4)
    scales = [0.5, (2, 3), 0.3, (9, 7)]
    read = lambda df: sorted((r.c, r.x, r.y, *np.round(r["values"], 9)) for r in df.collect())
    found = image.downsample_scales(s, 9, 7, scales)
    for k, scale in enumerate(scales):
        assert read(found.where(F.col("scale") == k)) == read(image.downsample_image(s, 9, 7, scale))
