"""Fourier transforms of series that are too long for a row, in blocks (the four-step method).

A series of R C samples is given as R blocks of C samples each. With sample C a + b (sample b of block a) and bin
d + R e, the transform is

    X[d + R e] = sum over b of exp(-2 pi i b e / C) * exp(-2 pi i b d / (R C)) * (sum over a of x[C a + b] exp(-2 pi i a d / R))

so it is R-point transforms across the blocks, a turn of each number, and C-point transforms of the
results. Columns of blocks are brought together for the first, rows of results for the second; a
task holds at most about HELD numbers of a series at a time, however long it is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("image_id", "c", "x", "y")
#: Numbers of a series that meet in one row.
HELD = 1 << 18


def cut_even(size: int, width: int) -> list[tuple[int, int]]:
    """(begin, end) of runs of at most `width`."""
    return [(k, min(size, k + width)) for k in range(0, size, width)]


def pieces(column, runs: Sequence[tuple[int, int]]):
    """The runs of an array column, numbered."""
    return F.array(*[F.struct(F.lit(k).alias("run"), F.slice(column, a + 1, b - a).alias("part")) for k, (a, b) in enumerate(runs)])


def long_transform(blocks: DataFrame, rows: int, size: int) -> DataFrame:
    """(image_id, c, x, y, d, re, im): element e of re and im is bin d + rows e, 0 <= d < rows, 0 <= e < size.

    blocks: (image_id, c, x, y, block, values), `rows` blocks of `size` samples of each series; blocks
    that are missing, shorter or null hold zeros.
    """
    if rows < 1 or size < 1:
        raise ValueError("a series has at least one block of at least one sample")
    columns, bins = cut_even(size, max(1, HELD // rows)), cut_even(rows, max(1, HELD // size))
    length = rows * size

    def across(run: pa.Array, at: pa.Array) -> pa.Array:
        """The transforms across blocks of a run of columns, turned, as numbered parts of bins."""
        out = []
        for k, blocks in zip(run.to_pylist(), at, strict=True):
            a, b = columns[k]
            x = np.zeros((rows, b - a))
            for block, part in zip(blocks.values.field("block").to_pylist(), blocks.values.field("part"), strict=True):
                if part.is_valid and 0 <= block < rows:
                    values = np.asarray(part.values.fill_null(0.0), float)[: b - a]
                    x[block, : len(values)] = values
            # Products of b and d modulo the length, exact in integers.
            turn = np.outer(np.arange(rows, dtype=np.int64), np.arange(a, b, dtype=np.int64)) % length
            y = np.fft.fft(x, axis=0) * np.exp(-2j * np.pi * turn / length)
            out.append([{"bins": i, "re": y[p:q].real.ravel(), "im": y[p:q].imag.ravel()} for i, (p, q) in enumerate(bins)])
        return pa.array(out, pa.list_(pa.struct([("bins", pa.int32()), ("re", pa.list_(pa.float64())), ("im", pa.list_(pa.float64()))])))

    def along(part: pa.Array, at: pa.Array) -> pa.Array:
        """The transforms of a run of bins, a row for each."""
        out = []
        for k, runs in zip(part.to_pylist(), at, strict=True):
            p, q = bins[k]
            y = np.zeros((q - p, size), complex)
            flat = runs.values
            for run, re, im in zip(flat.field("run").to_pylist(), flat.field("re"), flat.field("im"), strict=True):
                a, b = columns[run]
                y[:, a:b] = (np.asarray(re.values) + 1j * np.asarray(im.values)).reshape(q - p, b - a)
            z = np.fft.fft(y, axis=1)
            out.append([{"d": p + i, "re": row.real, "im": row.imag} for i, row in enumerate(z)])
        return pa.array(out, pa.list_(pa.struct([("d", pa.int32()), ("re", pa.list_(pa.float64())), ("im", pa.list_(pa.float64()))])))

    first = F.arrow_udf(across, "array<struct<bins int, re array<double>, im array<double>>>").asNondeterministic()
    second = F.arrow_udf(along, "array<struct<d int, re array<double>, im array<double>>>").asNondeterministic()
    apart = blocks.select(*KEY, "block", F.explode(pieces(F.col("values"), columns)).alias("p")).select(*KEY, "block", "p.run", "p.part")
    # A group is a run of columns of one series: HELD numbers.
    met = apart.groupBy(*KEY, "run").agg(F.collect_list(F.struct("block", "part")).alias("at"))
    turned = met.select(*KEY, "run", F.explode(first("run", "at")).alias("f")).select(*KEY, "run", "f.bins", "f.re", "f.im")
    again = turned.groupBy(*KEY, "bins").agg(F.collect_list(F.struct("run", "re", "im")).alias("at"))
    return again.select(*KEY, F.explode(second("bins", "at")).alias("z")).select(*KEY, "z.d", "z.re", "z.im")


def long_amplitudes(blocks: DataFrame, rows: int, size: int) -> DataFrame:
    """(image_id, c, x, y, k, re, im, full_amplitude) of the bins up to half of the length, after centring."""
    each = long_transform(blocks, rows, size).select(*KEY, "d", F.posexplode(F.arrays_zip("re", "im")).alias("e", "z"))
    k = F.col("d").cast("bigint") + rows * F.col("e").cast("bigint")
    # Centring changes the first bin only.
    part = lambda name: F.when(F.col("k") == 0, 0.0).otherwise(F.col(f"z.{name}")).alias(name)
    found = each.withColumn("k", k).where(F.col("k") <= rows * size // 2).select(*KEY, "k", part("re"), part("im"))
    return found.withColumn("full_amplitude", F.hypot("re", "im"))
