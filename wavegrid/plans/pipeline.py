"""Whole analyses: one table of images, or a folder of image and mask files, to per-cell tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.functions.kept import kept
from wavegrid.operators.cells import cell_stats, threshold_name
from wavegrid.operators.fft import FEATURES, QUERIED, Sampling, check_cutoff, checked, peak_query, spectrum
from wavegrid.operators.image import downsample_image, downsample_mask, temporal_mean
from wavegrid.operators.table import channel_names as named_channels
from wavegrid.operators.table import create_wide
from wavegrid.sources import stacks, tiff


def process_images(
    series: DataFrame, labels: DataFrame, channels: int, cutoff_frequency_bin: int = 0, carrier_index: int = 0, channel_names: Sequence[str] | None = None,
    threshold_cutoffs: Mapping[str, float] | None = None, masks: Sequence[str] = ("all",), features: Sequence[str] = FEATURES, normalize_histogram: bool = True,
    max_bin: int | None = None, sampling: Sampling | None = None, peak_method: str = "normalized_amplitude", downsample_by: tuple[int, int, object] | None = None,
    integer_mean: str = "floor", return_fft_features: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """The wide per-cell table of all images (ids: label, image, mask file); with return_fft_features also the spectra.

    masks: the mask names in `labels`. downsample_by: (height, width, scale). Levels come from the
    images before normalisation. Column names follow from the arguments; the only job that runs
    before an action is that of the frames' statistics, with normalize_histogram (see kept()).
    """
    names = named_channels(channel_names, channels)
    if not 0 <= carrier_index < channels:
        raise ValueError("carrier_index is not a channel")
    check_cutoff(cutoff_frequency_bin, max_bin)
    chosen = checked(features)
    if downsample_by is not None:
        series, labels = downsample_image(series, *downsample_by), downsample_mask(labels, *downsample_by)
    queried = peak_query(series, cutoff_frequency_bin, carrier_index, chosen, normalize_histogram, max_bin, sampling, peak_method)
    columns = [*[QUERIED[f] for f in FEATURES if f in chosen], "argmaxes", *(["frequencies"] if sampling is not None else [])]
    known = [(k, t) for k, t in (threshold_cutoffs or {}).items() if "queried_" + {"full_amplitude": "amplitude"}.get(k, k) in columns]
    all_masks = [*masks]
    for m in masks:
        all_masks += [("" if m == "all" else f"{m}_") + threshold_name("queried_" + {"full_amplitude": "amplitude"}.get(k, k), t) for k, t in known]
    cells = cell_stats(labels, queried, columns, temporal_mean(series), integer_mean, threshold_cutoffs, carrier_index)
    ids = cells.withColumns({"image_filename": F.col("image_id"), "mask_filename": tiff.mask_name(F.col("image_id"))})
    kinds = [*[(f, s) for f in columns for s in ("mean", "sd")], ("levels", "mean")]
    wide = create_wide(ids, names, kinds, all_masks)
    return (wide, spectrum(series, chosen, normalize_histogram, max_bin)) if return_fft_features else wide


def shapes(rows: DataFrame, *more) -> DataFrame:
    """(file, height, width, pixels, ...) of each file's pixels, counted before the exchange."""
    return rows.groupBy(F.col("image_id").alias("file")).agg((F.max("x") + 1).alias("height"), (F.max("y") + 1).alias("width"), F.count(F.lit(1)).alias("pixels"), *more)


def unequal_shapes(series: DataFrame, labels: DataFrame, of_image: DataFrame, channels: int) -> DataFrame:
    """(image_filename, error) of the images whose channels, frames or pixels are not as expected, or not those of their masks."""
    frames = F.size("values")
    images = shapes(series, (F.max("c") + 1).alias("channels"), F.min(frames).alias("least"), F.max(frames).alias("most"))
    masks = shapes(labels.where("t is null"), F.lit(0).alias("_")).join(of_image, F.col("file") == F.col("image_id"))
    masks = masks.select("image_filename", *[F.col(c).alias(f"mask_{c}") for c in ("height", "width", "pixels")])
    both = images.withColumnRenamed("file", "image_filename").join(masks, "image_filename", "left")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    size = lambda h, w: text(F.col(h), " x ", F.col(w))
    error = (
        F.when(F.col("channels") != channels, text("an image of ", F.col("channels"), f" channels; {channels} are expected"))
        .when(F.col("least") != F.col("most"), text("an image whose channels have ", F.col("least"), " to ", F.col("most"), " frames"))
        .when(F.col("pixels") != F.col("channels") * F.col("height") * F.col("width"), F.lit("an image without some of its pixels"))
        .when((F.col("mask_height") != F.col("height")) | (F.col("mask_width") != F.col("width")), text("a mask of ", size("mask_height", "mask_width"), " pixels for an image of ", size("height", "width")))
        .when(F.col("mask_pixels") != F.col("mask_height") * F.col("mask_width"), F.lit("a mask without some of its pixels"))
    )
    return both.select("image_filename", error.alias("error")).where("error is not null")


def analysed(pairs: DataFrame, series: DataFrame, labels: DataFrame, channels: int, **options) -> tuple[DataFrame, DataFrame]:
    """(wide per-cell table, (image_filename, error) of the images that are left out), from pair_files(), load_images() and load_masks() or what stacks.py gives."""
    of_image = pairs.where("found").select(F.col("mask_filename").alias("image_id"), "image_filename")
    series, labels = kept(series), kept(labels)
    of_labels = labels.join(of_image, "image_id")
    moving = of_labels.where("t is not null").groupBy("image_filename").agg((F.max("t") + 1).alias("frames"))
    bad = series.where("error is not null").select(F.col("image_id").alias("image_filename"), "error")
    bad = bad.unionByName(of_labels.where("error is not null").select("image_filename", "error"))
    bad = bad.unionByName(moving.select("image_filename", F.concat(F.lit("a mask of "), "frames", F.lit(" frames; one is expected")).alias("error")))
    unequal = unequal_shapes(series.where("error is null"), labels.where("error is null"), of_image, channels)
    # A file with an error may have some of its pixels.
    bad = kept(bad.unionByName(unequal.join(bad.select("image_filename").distinct(), "image_filename", "left_anti")))
    missing = pairs.where("not found").select("image_filename", F.concat(F.lit("no mask file "), "mask_filename").alias("error"))
    left_out = bad.select(F.col("image_filename").alias("image_id")).distinct()
    good = of_labels.where("error is null and t is null").select(F.col("image_filename").alias("image_id"), F.lit("all").alias("mask_name"), "x", "y", "label")
    readable = series.where("error is null").drop("error")
    return process_images(readable.join(left_out, "image_id", "left_anti"), good.join(left_out, "image_id", "left_anti"), channels, **options), bad.unionByName(missing)


def process_files(images: DataFrame, masks: DataFrame, channels: int, **options) -> tuple[DataFrame, DataFrame]:
    """process_folder() of tables of files (name, content)."""
    pairs = tiff.pair_files(images.select("name"), masks.select("name"))
    paired = pairs.where("found")
    chosen = images.join(paired.select(F.col("image_filename").alias("name")), "name", "left_semi")
    wanted = masks.join(paired.select(F.col("mask_filename").alias("name")).distinct(), "name", "left_semi")
    return analysed(pairs, tiff.load_images(chosen), tiff.load_masks(wanted), channels, **options)


def process_folder(spark: SparkSession, images_directory: str, masks_directory: str, channels: int, bytes_per_partition: int | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(wide per-cell table of all images, (image_filename, error) of those that were left out).

    All files are read, once, and analysed in one plan. Reported, without stopping the others, are
    an image without a mask, one that cannot be read, one of other channels than expected or of
    other pixels than its mask, and one whose mask has frames. With bytes_per_partition, files are
    read in parts by stacks.py, as files over 2 GB must be.
    """
    if bytes_per_partition is None:
        return process_files(tiff.files(spark, images_directory), tiff.files(spark, masks_directory), channels, **options)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    listed = [spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,nd2}").load(d).select(name) for d in (images_directory, masks_directory)]
    pairs = kept(tiff.pair_files(*listed))
    images = stacks.read_stacks(spark, images_directory, bytes_per_partition=bytes_per_partition, dimensions="3,4")
    masks = stacks.read_stacks(spark, masks_directory, bytes_per_partition=bytes_per_partition, dimensions="2,3")
    chosen = [pairs.where("found").select(F.col(n).alias("image_id")).distinct() for n in ("image_filename", "mask_filename")]
    return analysed(pairs, stacks.series_of(images.join(chosen[0], "image_id", "left_semi")), stacks.labels_of(masks.join(chosen[1], "image_id", "left_semi")), channels, **options)
