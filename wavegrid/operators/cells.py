"""Features of segmented cells: thresholded masks, per-label statistics and trajectories."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.functions.numerics import above, group_mean, group_sd
from wavegrid.operators.image import temporal_mean

PIXEL = ["image_id", "x", "y"]


def threshold_name(feature: str, threshold: float) -> str:
    return f"thresh_{feature}_at_{threshold}"


def threshold_tests(columns: Sequence[str], cutoffs: Mapping[str, float]) -> list[tuple[str, str, float]]:
    """(mask name, feature, threshold) of the cutoffs whose feature is there; others are skipped with a warning.

    cutoffs: by feature name without `queried_`; full_amplitude is another name of amplitude.
    """
    tests = []
    for name, threshold in cutoffs.items():
        feature = "queried_" + {"full_amplitude": "amplitude"}.get(name, name)
        if feature in columns:
            tests.append((threshold_name(feature, threshold), feature, threshold))
        else:
            warnings.warn(f"{feature} is not among the features; its threshold is skipped", stacklevel=3)
    return tests


def _derived(name: str) -> Column:
    """The name of a derived mask; masks other than 'all' are prefixed by their name."""
    return F.concat(F.when(F.col("mask_name") == "all", "").otherwise(F.concat("mask_name", F.lit("_"))), F.lit(name))


def _masks(tests: Sequence[tuple[str, str, float]], values: Mapping[str, Column]) -> Column:
    """The mask of a row and those derived from it, with its label or 0."""
    passed = [F.when(above(values[f], t), F.col("label")).otherwise(F.lit(0).cast("bigint")) for _, f, t in tests]
    return F.array(
        F.struct(F.col("mask_name"), F.col("label")),
        *[F.struct(_derived(n).alias("mask_name"), p.alias("label")) for (n, _, _), p in zip(tests, passed, strict=True)],
    )


def threshold_masks(labels: DataFrame, queried: DataFrame, cutoffs: Mapping[str, float], carrier_index: int) -> DataFrame:
    """labels and, for each cutoff, a mask where pixels whose carrier value is not above it have label 0."""
    tests = threshold_tests(queried.columns, cutoffs)
    if not tests:
        return labels
    carrier = queried.where(F.col("c") == carrier_index).select(*PIXEL, *dict.fromkeys(f for _, f, _ in tests))
    joined = labels.join(carrier, PIXEL, "left")
    masks = _masks(tests, {f: F.col(f) for _, f, _ in tests})
    return joined.select(*PIXEL, F.explode(masks).alias("m")).select("image_id", "m.mask_name", "x", "y", "m.label")


#: Labels that are counted out in one row.
LABELS = 10_000


def counted_out(tops: DataFrame) -> DataFrame:
    """tops with `label`, from 0 to `top` instead of it: runs of LABELS labels first, so that no row holds all."""
    rest = [c for c in tops.columns if c != "top"]
    runs = tops.select(*rest, "top", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top"), F.lit(LABELS).cast("bigint"))).alias("_from"))
    return runs.select(*rest, F.explode(F.sequence("_from", F.least(F.col("_from") + (LABELS - 1), F.col("top")))).alias("label"))


def label_domain(labels: DataFrame, tests: Sequence[tuple[str, str, float]] = ()) -> DataFrame:
    """(image_id, mask_name, label): every label from 0 to the image's largest, for each mask and each derived one."""
    largest = labels.groupBy("image_id").agg(F.max("label").alias("top"), F.collect_set("mask_name").alias("masks"))
    masks = largest.select("image_id", F.explode("masks").alias("mask_name"), "top")
    masks = masks.select("image_id", F.explode(F.array(F.col("mask_name"), *[_derived(n) for n, _, _ in tests])).alias("mask_name"), "top")
    return counted_out(masks)


def cell_stats(
    labels: DataFrame, queried: DataFrame, features: Sequence[str], levels: DataFrame | None = None, integer_mean: str = "floor",
    cutoffs: Mapping[str, float] | None = None, carrier_index: int = 0, channels: DataFrame | None = None,
) -> DataFrame:
    """(image_id, mask_name, label, c, feature, stat, value): mean and sd over each label's pixels.

    Labels that no pixel has come out as 0. levels: (image_id, c, x, y, mean), averaged without a
    standard deviation. argmaxes is averaged with the floor unless integer_mean is 'exact'. With
    cutoffs, the masks of threshold_masks() are derived in place, so that the features are read
    once. Sums are pre-aggregated before the exchange, so a label with most pixels is no hot key.
    channels: (image_id, c) of the images, which are taken from levels or, at the cost of the
    features being computed again, from queried.
    """
    if integer_mean not in ("floor", "exact"):
        raise ValueError("integer_mean must be 'floor' or 'exact'")
    tests = threshold_tests(queried.columns, cutoffs or {})
    aggregates: list[tuple[str, str, Column]] = []
    for f in features:
        aggregates.append((f, "mean", group_mean(F.col(f), f == "argmaxes" and integer_mean == "floor")))
        aggregates.append((f, "sd", group_sd(F.col(f))))
    # A window's group is one pixel's channels.
    pixel = Window.partitionBy(*PIXEL)
    carrier = {f: F.max(F.when(F.col("c") == carrier_index, F.col(f))).over(pixel) for _, f, _ in tests}
    values = queried.select(*PIXEL, "c", *features, *[v.alias(f"_{f}") for f, v in carrier.items()])
    if levels is not None:
        values = values.join(levels.select(*PIXEL, "c", F.col("mean").alias("levels")), [*PIXEL, "c"])
        aggregates.append(("levels", "mean", F.avg("levels")))
    joined = values.join(labels, PIXEL)
    if tests:
        masks = _masks(tests, {f: F.col(f"_{f}") for f in carrier})
        joined = joined.withColumn("_m", F.explode(masks)).withColumns({"mask_name": F.col("_m.mask_name"), "label": F.col("_m.label")})
    wide = joined.groupBy("image_id", "mask_name", "label", "c").agg(*[a.alias(f"{f}|{s}") for f, s, a in aggregates])
    entries = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(s).alias("stat"), F.col(f"`{f}|{s}`").cast("double").alias("value")) for f, s, _ in aggregates]))
    long = wide.select("image_id", "mask_name", "label", "c", entries.alias("e")).select("image_id", "mask_name", "label", "c", "e.*")
    if channels is None:
        channels = (queried if levels is None else levels).select("image_id", "c").distinct()
    kinds = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(s).alias("stat")) for f, s, _ in aggregates]))
    full = label_domain(labels, tests).join(channels, "image_id").select("image_id", "mask_name", "label", "c", kinds.alias("e")).select("image_id", "mask_name", "label", "c", "e.*")
    keys = ["image_id", "mask_name", "label", "c", "feature", "stat"]
    return full.join(long.withColumn("_in", F.lit(True)), keys, "left").select(*keys, F.when(F.col("_in"), F.col("value")).otherwise(0.0).alias("value"))


def cell_levels(labels: DataFrame, series: DataFrame) -> DataFrame:
    """(image_id, mask_name, label, c, value): mean over pixels of the temporal mean of the raw series."""
    wide = temporal_mean(series).join(labels, PIXEL).groupBy("image_id", "mask_name", "label", "c").agg(F.avg("mean").alias("value"))
    full = label_domain(labels).join(series.select("image_id", "c").distinct(), "image_id")
    keys = ["image_id", "mask_name", "label", "c"]
    return full.join(wide, keys, "left").select(*keys, F.coalesce("value", F.lit(0.0)).alias("value"))


def track_runs(labels: DataFrame) -> DataFrame:
    """(image_id, x, y, runs) from (image_id, t, x, y, label): one row a pixel, whose runs are arrays of (start, frames, label).

    A run is of frames that follow each other and have one label.
    """
    pixels = labels.groupBy(*PIXEL).agg(F.sort_array(F.collect_list(F.struct("t", "label"))).alias("at"))
    before = lambda i: F.get("at", i - 1)
    begins = lambda p, i: (i == 0) | (p["label"] != before(i)["label"]) | (p["t"] != before(i)["t"] + 1)
    numbered = F.transform("at", lambda p, i: F.struct(i.alias("i"), begins(p, i).alias("begins")))
    starts = F.transform(F.filter(numbered, lambda p: p["begins"]), lambda p: p["i"])
    rows = pixels.select(*PIXEL, "at", starts.alias("starts"))
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("at"))
    run = lambda i, k: F.struct(F.get("at", i)["t"].alias("start"), (end(k) - i).alias("frames"), F.get("at", i)["label"].alias("label"))
    return rows.select(*PIXEL, F.transform("starts", run).alias("runs"))


def tracks(series: DataFrame, labels: DataFrame) -> DataFrame:
    """(image_id, label, c, t, mean, sd): trajectories of labels, from a static mask or one with frames (column t).

    Series and labels meet as one row a pixel, and are taken apart where they have met.
    """
    if "t" in labels.columns:
        met = series.join(track_runs(labels), PIXEL).select("image_id", "c", "values", F.explode("runs").alias("r"))
        parts = met.select("image_id", F.col("r.label").alias("label"), "c", F.col("r.start").alias("start"), F.slice("values", F.col("r.start") + 1, F.col("r.frames")).alias("part"))
        each = parts.select("image_id", "label", "c", "start", F.posexplode("part").alias("i", "v"))
        each = each.select("image_id", "label", "c", (F.col("start") + F.col("i")).alias("t"), "v")
    else:
        each = series.join(labels.select(*PIXEL, "label"), PIXEL).select("image_id", "label", "c", F.posexplode("values").alias("t", "v"))
    stats = each.groupBy("image_id", "label", "c", "t").agg(F.avg("v").alias("mean"), group_sd(F.col("v")).alias("sd"))
    tops = labels.groupBy("image_id").agg(F.max("label").alias("top"))
    frames = series.groupBy("image_id", "c").agg(F.max(F.size("values")).alias("n"))
    full = counted_out(tops.join(frames, "image_id"))
    full = full.select("image_id", "label", "c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("t"))
    keys = ["image_id", "label", "c", "t"]
    joined = full.join(stats.withColumn("_in", F.lit(True)), keys, "left")
    return joined.select(*keys, *[F.when(F.col("_in"), F.col(s)).otherwise(0.0).alias(s) for s in ("mean", "sd")])
