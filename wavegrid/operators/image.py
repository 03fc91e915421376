"""Resampling, normalisation, convolution and colour projection of image series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.functions.kept import kept
from wavegrid.functions.numerics import centred, ieee_div
from wavegrid.operators.moments import mean_series, moments


def target_size(size: int, scale: float) -> int:
    """The new extent: at least 1, halves rounded to even."""
    return max(1, int(round(size * scale)))


def _sizes(height: int, width: int, scale) -> tuple[int, int]:
    if isinstance(scale, float):
        return target_size(height, scale), target_size(width, scale)
    if isinstance(scale, int) or len(tuple(scale)) != 2:
        raise ValueError("scale must be a float or a pair (height, width)")
    return int(scale[0]), int(scale[1])


def _windows(spark: SparkSession, size: int, new: int, old_name: str, new_name: str) -> DataFrame:
    """(old, new): the averaging windows [floor(i size / new), ceil((i + 1) size / new)), which may overlap.

    The table has about size + new rows, fixed by the image's extent, so it can be sent to all tasks.
    """
    ends = spark.range(new).select(
        F.col("id").cast("int").alias(new_name),
        F.explode(F.expr(f"sequence(cast(id * {size} div {new} as int), cast(((id + 1) * {size} + {new} - 1) div {new} - 1 as int))")).alias(old_name),
    )
    return F.broadcast(ends)


def downsample_image(series: DataFrame, height: int, width: int, scale) -> DataFrame:
    """Series of a smaller image: each pixel is the mean over its window, frame by frame.

    The windows are an equi-join with a mapping table. Series are added up as arrays where they
    are, so one array for each window and task is exchanged, whatever the windows' size.
    """
    h, w = _sizes(height, width, scale)
    spark = series.sparkSession
    mapped = series.join(_windows(spark, height, h, "x", "nx"), "x").join(_windows(spark, width, w, "y", "ny"), "y").select("image_id", "c", "nx", "ny", "values")
    rows = mean_series(mapped, ["image_id", "c", "nx", "ny"])
    return rows.select("image_id", "c", F.col("nx").alias("x"), F.col("ny").alias("y"), "values")


def downsample_scales(series: DataFrame, height: int, width: int, scales: Sequence) -> DataFrame:
    """(scale, image_id, c, x, y, values): series of several smaller images from one pass over the series; scale is a place in `scales`.

    A pixel is in about one window of each scale, and is added to all of them where it is.
    """
    spark, sizes = series.sparkSession, [_sizes(height, width, s) for s in scales]

    def windows(size: int, new: list[int], old_name: str, new_name: str) -> DataFrame:
        """(old, [(scale, new)]): the windows of all scales that a row or column is in; as many rows as the image has."""
        each = [_windows(spark, size, n, old_name, new_name).select(old_name, F.struct(F.lit(k).alias("scale"), new_name).alias("w")) for k, n in enumerate(new)]
        rows = each[0]
        for other in each[1:]:
            rows = rows.unionByName(other)
        return F.broadcast(rows.groupBy(old_name).agg(F.collect_list("w").alias(f"_{new_name}")))

    rows = series.join(windows(height, [h for h, _ in sizes], "x", "nx"), "x").join(windows(width, [w for _, w in sizes], "y", "ny"), "y")
    both = F.flatten(F.transform("_nx", lambda a: F.transform(F.filter("_ny", lambda b: b["scale"] == a["scale"]), lambda b: F.struct(a["scale"].alias("scale"), a["nx"].alias("nx"), b["ny"].alias("ny")))))
    mapped = rows.select("image_id", "c", "values", F.explode(both).alias("w")).select("w.scale", "image_id", "c", "w.nx", "w.ny", "values")
    found = mean_series(mapped, ["scale", "image_id", "c", "nx", "ny"])
    return found.select("scale", "image_id", "c", F.col("nx").alias("x"), F.col("ny").alias("y"), "values")


def downsample_mask(labels: DataFrame, height: int, width: int, scale) -> DataFrame:
    """The nearest source pixel's label, floor(i size / new), for each pixel of the smaller mask."""
    h, w = _sizes(height, width, scale)
    spark = labels.sparkSession

    def nearest(size: int, new: int, old_name: str, new_name: str) -> DataFrame:
        return F.broadcast(spark.range(new).select(F.expr(f"cast(id * {size} div {new} as int)").alias(old_name), F.col("id").cast("int").alias(new_name)))

    out = labels.join(nearest(height, h, "x", "_nx"), "x").join(nearest(width, w, "y", "_ny"), "y")
    return out.select(*[F.col({"x": "_nx", "y": "_ny"}.get(c, c)).alias(c) for c in labels.columns])


def frame_statistics(series: DataFrame) -> DataFrame:
    """(image_id, c, mean, sd): arrays over frames of the mean and sample standard deviation of all pixels."""
    each = moments(series, ["image_id", "c"])
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / F.greatest(F.col("n") - 1, F.lit(1.0)))).otherwise(F.lit(float("nan")))
    at = F.map_from_entries(F.collect_list(F.struct("t", F.struct("mean", sd.alias("sd")))))
    rows = each.groupBy("image_id", "c").agg(at.alias("at"), (F.max("t") + 1).alias("frames"))
    # A frame without a pixel has no mean.
    read = lambda name, none: F.transform(F.sequence(F.lit(0), F.col("frames") - 1), lambda t: F.coalesce(F.try_element_at("at", t)[name], F.lit(none)))
    return rows.select("image_id", "c", read("mean", None).alias("mean"), read("sd", float("nan")).alias("sd"))


#: Numbers of per-image statistics that are sent to all tasks at most; parts that an image's pixels are dealt to otherwise.
SENT_NUMBERS, PARTS = 4_000_000, 64


def with_statistics(series: DataFrame, statistics: DataFrame, keys: list[str], numbers: Column) -> DataFrame:
    """series with the columns of statistics, a small table of one row for each of keys.

    The statistics are computed at once, kept and counted (`numbers` of a row). They are sent to
    all tasks up to SENT_NUMBERS, so that no pixel moves; beyond, each image's pixels are dealt to
    PARTS parts, so that no image meets in one task.
    """
    found = kept(statistics)
    if (found.agg(F.sum(numbers)).first()[0] or 0) <= SENT_NUMBERS:
        return series.join(F.broadcast(found), keys)
    part = F.pmod(F.xxhash64("x", "y"), F.lit(PARTS)).cast("int")
    each = found.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return series.withColumn("_part", part).join(each, [*keys, "_part"]).drop("_part")


def normalize_frames(series: DataFrame) -> DataFrame:
    """Each frame minus its mean, over its standard deviation. A flat frame gives NaN."""
    joined = with_statistics(series, frame_statistics(series), ["image_id", "c"], 2 * F.size("mean"))
    shifted = F.zip_with("values", "mean", lambda v, m: v - m)
    return joined.select(*[c for c in series.columns if c != "values"], F.zip_with(shifted, "sd", ieee_div).alias("values"))


def mean_center(series: DataFrame) -> DataFrame:
    """Each series minus its mean over time."""
    return series.withColumn("values", centred(F.col("values")))


def temporal_mean(series: DataFrame) -> DataFrame:
    """(image_id, c, x, y, mean)."""
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return series.select("image_id", "c", "x", "y", (total / F.size("values")).alias("mean"))


def convolve_time(series: DataFrame, kernel: Sequence[float]) -> DataFrame:
    """Cross-correlation with an odd kernel along time, zeros outside."""
    if len(kernel) % 2 == 0:
        raise ValueError("the kernel must have an odd length")
    half = len(kernel) // 2

    def at(i: Column) -> Column:
        terms = [F.when((i + (k - half) >= 0), F.get("values", i + (k - half))) for k in range(len(kernel))]
        total = F.lit(0.0)
        for w, x in zip(kernel, terms, strict=True):
            total = total + F.lit(float(w)) * F.coalesce(x, F.lit(0.0))
        return total

    return series.withColumn("values", F.transform("values", lambda _, i: at(i)))


def minmax_norm(series: DataFrame) -> DataFrame:
    """Each image's values brought to 0..1 by its smallest and largest value over all channels and frames."""
    ends = series.groupBy("image_id").agg(F.min(F.array_min("values")).alias("lo"), F.max(F.array_max("values")).alias("hi"))
    return with_statistics(series, ends, ["image_id"], F.lit(2)).select(
        *[c for c in series.columns if c != "values"], F.transform("values", lambda v: ieee_div(v - F.col("lo"), F.col("hi") - F.col("lo"))).alias("values")
    )


def turbo(u: float) -> tuple[float, float, float]:
    """The turbo colour map at u in 0..1, by its published polynomial approximation."""
    red = (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943)
    green = (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604)
    blue = (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973)
    return tuple(min(1.0, max(0.0, sum(a * u**k for k, a in enumerate(p)))) for p in (red, green, blue))


#: Coefficients of published polynomial approximations (in the public domain), from the constant on: red, green, blue (fixed values).
POLYNOMIALS = {
    "viridis": (
        (0.2777273272, 0.1050930431, -0.3308618287, -4.634230499, 6.228269936, 4.776384998, -5.435455856),
        (0.005407344545, 1.40461353, 0.2148475595, -5.799100973, 14.17993337, -13.74514538, 4.645852612),
        (0.3340998053, 1.384590163, 0.09509516302, -19.33244096, 56.69055260, -65.35303263, 26.31243525),
    ),
    "plasma": (
        (0.05873234392, 2.176514634, -2.689460476, 6.130348346, -11.10743619, 10.02306558, -3.658713843),
        (0.02333670893, 0.2383834171, -7.455851136, 42.34618815, -82.66631109, 71.4136177, -22.93153465),
        (0.5433401827, 0.75396046, 3.1107999397, -28.51885465, 60.13984767, -54.07218656, 18.19190779),
    ),
}


def polynomial(name: str, u: float) -> tuple[float, float, float]:
    return tuple(min(1.0, max(0.0, sum(a * u**k for k, a in enumerate(p)))) for p in POLYNOMIALS[name])


def named_map(name: str):
    """The colour map of a name, a function of 0..1: turbo, viridis, plasma, gray, and any name that matplotlib knows, if it is installed."""
    if name == "turbo":
        return turbo
    if name == "gray":
        return lambda u: (u, u, u)
    if name in POLYNOMIALS:
        return lambda u: polynomial(name, u)
    try:
        from matplotlib import colormaps
    except ImportError as e:
        raise ValueError(f"unknown colour map {name!r} (other names need matplotlib)") from e
    if name not in colormaps:
        raise ValueError(f"unknown colour map {name!r}")
    return colormaps[name]


def colors(frames: int, cmap="turbo") -> list[tuple[float, float, float]]:
    """A colour for each frame. cmap: the name of a map, a function of 0..1, or a list of colours to sample from."""
    place = [0.0] if frames == 1 else [t / (frames - 1) for t in range(frames)]
    if isinstance(cmap, str):
        cmap = named_map(cmap)
    if callable(cmap):
        return [tuple(cmap(u)[:3]) for u in place]
    if isinstance(cmap, (list, tuple)):
        return [tuple(cmap[min(len(cmap) - 1, math.floor(u * len(cmap)))][:3]) for u in place]
    raise ValueError(f"unknown colour map {cmap!r}")


def color_by_axis(series: DataFrame, frames: int, cmap="turbo", proj: str = "max", minmax: bool = True) -> DataFrame:
    """(image_id, c, x, y, r, g, b): each frame in its colour, projected over time by 'max' or 'sum'."""
    if proj not in ("max", "sum"):
        raise ValueError("proj must be 'max' or 'sum'")
    rows = minmax_norm(series) if minmax else series
    table = list(zip(*colors(frames, cmap), strict=True))

    def component(levels: Sequence[float]) -> Column:
        lut = F.array(*[F.lit(float(v)) for v in levels])
        lit = F.zip_with("values", lut, lambda v, k: v * k)
        return F.array_max(lit) if proj == "max" else F.aggregate(lit, F.lit(0.0), lambda a, v: a + v)

    return rows.select("image_id", "c", "x", "y", *[component(v).alias(n) for v, n in zip(table, "rgb", strict=True)])
