"""Sums and moments of series, element by element, merged from tasks' parts.

Taking series apart into a row for each element makes as many rows as there are voxels. Here a task
adds its series up as arrays, so what is exchanged grows with tasks and frames, not with pixels;
means and squared deviations are merged by the formulas for parts (Chan, Golub and LeVeque 1979).
Null elements do not count; NaN counts and stays; series may be of several lengths.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that a task holds before it passes its parts on.
HELD_NUMBERS = 4_000_000


def matrices(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, elements with 0 for null, whether they count) for each length of lists."""
    sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        flat = values.take(pa.array(at)).flatten()
        on = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(at), size)
        yield at, np.asarray(flat.fill_null(0).to_numpy(zero_copy_only=False), float).reshape(len(at), size), on


def padded(a: np.ndarray, n: int) -> np.ndarray:
    return a if len(a) >= n else np.pad(a, (0, n - len(a)))


def merged(a: tuple | None, b: tuple) -> tuple:
    """(number, mean, sum of squared deviations) of two parts together."""
    if a is None:
        return b
    size = max(len(a[0]), len(b[0]))
    (n, m, s), (k, o, r) = ([padded(x, size) for x in y] for y in (a, b))
    total = n + k
    share = np.divide(k, total, out=np.zeros(size), where=total > 0)
    return total, m + np.where(k > 0, (o - m) * share, 0.0), s + r + np.where((k > 0) & (n > 0), (o - m) ** 2 * n * share, 0.0)


def grouped(batch: pa.RecordBatch, keys: Sequence[str]) -> dict[tuple, list[int]]:
    """Row numbers by key."""
    out: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)):
        out.setdefault(key, []).append(i)
    return out


def lists(parts: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts) if parts else np.empty(0), kind))


def moments(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, t, n, mean, m2): of element t over all series of a key."""
    kinds = dict(series.dtypes)
    types = [series.schema[k].dataType for k in keys]

    def add(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        held, size = {}, 0

        def out():
            each = list(held.items())
            columns = [pa.array([k[i] for k, _ in each], to_arrow_type(types[i])) for i in range(len(keys))]
            return pa.record_batch([*columns, *[lists([v[i] for _, v in each], t) for i, t in enumerate((pa.float64(),) * 3)]], names=[*keys, "n", "mean", "m2"])

        for batch in batches:
            values = batch.column("values")
            for key, rows in grouped(batch, keys).items():
                for _, x, on in matrices(values.take(pa.array(rows))):
                    n = on.sum(axis=0).astype(float)
                    mean = np.divide(x.sum(axis=0), n, out=np.zeros(x.shape[1]), where=n > 0)
                    before = len(held[key][0]) if key in held else 0
                    with np.errstate(invalid="ignore"):
                        held[key] = merged(held.get(key), (n, mean, np.where(on, (x - mean) ** 2, 0.0).sum(axis=0)))
                    size += 3 * (len(held[key][0]) - before)
            if size > HELD_NUMBERS:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    ddl = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n array<double>", "mean array<double>", "m2 array<double>"])
    parts = series.select(*keys, "values").mapInArrow(add, ddl)
    each = parts.select(*keys, F.posexplode(F.arrays_zip("n", "mean", "m2")).alias("t", "p")).where("p.n > 0")
    # A group is one row for each task that has met the key.
    rows = each.groupBy(*keys, "t").agg(F.sort_array(F.collect_list(F.struct("p.n", "p.mean", "p.m2"))).alias("parts"))
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def merge(a, p):
        n, d = a["n"] + p["n"], p["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + d * p["n"] / n).alias("mean"), (a["m2"] + p["m2"] + d * d * a["n"] * p["n"] / n).alias("m2"))

    return rows.select(*keys, "t", F.aggregate("parts", start, merge).alias("m")).select(*keys, "t", "m.n", "m.mean", "m.m2")


def mean_series(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, values): the mean of all series of a key, element by element; an element that none has is null.

    Tasks add up what they hold; one exchange by key brings the sums together.
    """
    kinds, types = dict(series.dtypes), [series.schema[k].dataType for k in keys]

    def summed(last: bool):
        def run(batches):
            from pyspark.sql.pandas.types import to_arrow_type

            held, size = {}, 0

            def out(items):
                columns = [pa.array([k[i] for k, _ in items], to_arrow_type(types[i])) for i in range(len(keys))]
                totals, numbers = [v[0] for _, v in items], [v[1] for _, v in items]
                if not last:
                    return pa.record_batch([*columns, lists(totals, pa.float64()), lists(numbers, pa.float64())], names=[*keys, "total", "n"])
                with np.errstate(invalid="ignore", divide="ignore"):
                    means = lists([t / n for t, n in zip(totals, numbers, strict=True)], pa.float64())
                none = np.concatenate(numbers) == 0
                if none.any():
                    means = pa.ListArray.from_arrays(means.offsets, pa.array(means.values.to_numpy(zero_copy_only=False), pa.float64(), mask=none))
                return pa.record_batch([*columns, means], names=[*keys, "values"])

            for batch in batches:
                found = grouped(batch, keys)
                order = np.concatenate([np.asarray(r) for r in found.values()]) if found else np.empty(0, int)
                ends = np.cumsum([len(r) for r in found.values()])
                mine = lambda name, order=order, batch=batch: matrices(batch.column(name).take(pa.array(order)))
                if last:
                    parts = [(at, x, n) for (at, x, _), (_, n, _) in zip(mine("total"), mine("n"), strict=True)]
                else:
                    parts = [(at, x, on.astype(float)) for at, x, on in mine("values")]
                names = list(found)
                for at, x, n in parts:
                    # Rows of a key stand together, so their sums are runs of the matrix.
                    owner = np.searchsorted(ends, at, side="right")
                    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    for k, t, c in zip(owner[begin], np.add.reduceat(x, begin, axis=0), np.add.reduceat(n, begin, axis=0), strict=True):
                        a = held.get(names[k])
                        if a is None:
                            held[names[k]] = (t, c)
                            size += 2 * len(t)
                        else:
                            w = max(len(t), len(a[0]))
                            held[names[k]] = (padded(a[0], w) + padded(t, w), padded(a[1], w) + padded(c, w))
                # The last pass gets its rows in order of the keys: all but the last key are whole.
                if last and len(held) > 1:
                    items = list(held.items())
                    yield out(items[:-1])
                    held, size = dict(items[-1:]), 0
                elif not last and size > HELD_NUMBERS:
                    yield out(list(held.items()))
                    held, size = {}, 0
            if held:
                yield out(list(held.items()))

        return run

    ddl = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    parts = series.select(*keys, "values").mapInArrow(summed(False), f"{ddl}, total array<double>, n array<double>")
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(summed(True), f"{ddl}, values array<double>")
