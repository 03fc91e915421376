"""The registered queries, each over whole tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.functions.kept import shared_folder
from wavegrid.operators import cells, cwt, fft, image, longfft, table
from wavegrid.plans import model
from wavegrid.plans.pipeline import process_files, process_images
from wavegrid.sources import stacks, tiff
from wavegrid.sources.nd2 import encode_nd2
from wavegrid.streaming import folders, frames, spectra
from wavegrid.streaming.spectra import FRAMES

#: Parameters of the queries on embeddings: search from bin 1, channel 0 is the carrier.
CUTOFF, CARRIER, THRESHOLD = 1, 0, 0.15
KERNEL = (0.25, 0.5, 0.25)
SAMPLING = fft.Sampling(fs=2, N=32)
#: Wavelet queries: 8 scales, two to an octave, from the highest frequency; places 1 to 6 are searched.
SCALES = [float((cwt.BETA / cwt.GAMMA) ** (1 / cwt.GAMMA) / np.pi * 2 ** (k / 2)) for k in range(8)]
LOW, HIGH, BANKS = 1, 7, 3
#: cwt_freq_hz: 16 scales, four to an octave, from the highest frequency; places 2 to 13 are searched.
FINE_SCALES = [float((cwt.BETA / cwt.GAMMA) ** (1 / cwt.GAMMA) / np.pi * 2 ** (k / 4)) for k in range(16)]
FINE_LOW, FINE_HIGH = 2, 14
#: The end of the default grid's places in cwt_default_grid.
GRID_END = 100
#: The centre of the Morlet wavelet in cwt_morlet.
MORLET = 3.0


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def keys(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def elements(series: DataFrame, name: str, position: str = "t", digits: int = 6) -> DataFrame:
    """(x, y, c, position, name) of a column of arrays."""
    return series.select(*keys("x", "y", "c"), F.posexplode(name).alias(position, "value")).select("x", "y", "c", *keys(position), rounded("value", digits).alias("value"))


def spectrum(spark: SparkSession, sf_dir: str, features, **options) -> DataFrame:
    return fft.spectrum(model.embedding_series(spark, sf_dir), features, normalize_histogram=False, **options)


def queried(spark: SparkSession, sf_dir: str, sampling=None) -> DataFrame:
    return fft.peak_query(model.embedding_series(spark, sf_dir), CUTOFF, CARRIER, normalize_histogram=False, sampling=sampling)


def series_mean_center(spark, sf_dir):
    return elements(image.mean_center(model.embedding_series(spark, sf_dir)), "values")


def frame_normalize(spark, sf_dir):
    return elements(image.normalize_frames(model.event_series(spark, sf_dir)), "values")


def one_feature(feature: str, **options):
    def query(spark, sf_dir):
        return elements(spectrum(spark, sf_dir, [feature], **options), feature, "k")

    return query


def fft_phase(spark, sf_dir):
    rows = spectrum(spark, sf_dir, ["phase"]).select(*keys("x", "y", "c"), F.posexplode("phase").alias("k", "p")).where("k between 1 and 15")
    return rows.select("x", "y", "c", *keys("k"), rounded(F.cos("p")).alias("cos_phase"), rounded(F.sin("p")).alias("sin_phase"))


def fft_constant_pixel(spark, sf_dir):
    series = model.embedding_series(spark, sf_dir)
    constant = series.limit(0).unionByName(
        spark.range(1).select(F.lit("E").alias("image_id"), F.lit(0).alias("c"), F.lit(-1).alias("x"), F.lit(-1).alias("y"), F.array_repeat(F.lit(1.0), 32).alias("values"))
    )
    rows = fft.spectrum(series.unionByName(constant), ["full_amplitude", "normalized_amplitude"], normalize_histogram=False)
    flags = F.exists("normalized_amplitude", lambda v: F.isnan(v))
    return rows.select(*keys("x", "y", "c"), flags.alias("undefined"), rounded(F.array_max("full_amplitude")).alias("largest"))


def fft_by_join(spark, sf_dir):
    rows = fft.spectrum_by_join(model.embedding_series(spark, sf_dir), 32)
    return rows.select(*keys("x", "y", "c", "k"), rounded("full_amplitude").alias("value"))


def fft_peak(spark, sf_dir):
    rows = fft.query_features(spectrum(spark, sf_dir, ["normalized_amplitude"]), CUTOFF, CARRIER)
    return rows.select(*keys("x", "y", "c", "argmaxes"), rounded("queried_normalized_amplitude").alias("value"))


def fft_peak_fallback(spark, sf_dir):
    """Bins are ranked by the z-score where normalised amplitudes are not computed."""
    rows = fft.peak_query(model.embedding_series(spark, sf_dir), CUTOFF, CARRIER, ["z_score"], normalize_histogram=False)
    return rows.select(*keys("x", "y", "c", "argmaxes"), rounded("queried_z_score").alias("value"))


def fft_query_features(spark, sf_dir):
    rows = queried(spark, sf_dir)
    d = F.col("queried_phase_difference")
    return rows.select(
        *keys("x", "y", "c", "argmaxes"), rounded("queried_amplitude").alias("amplitude"), rounded("queried_normalized_amplitude").alias("normalized_amplitude"),
        rounded("queried_z_score").alias("z_score"), rounded(F.cos(d)).alias("cos_difference"), rounded(F.sin(d)).alias("sin_difference"),
    )


def fft_frequencies(spark, sf_dir):
    return queried(spark, sf_dir, SAMPLING).select(*keys("x", "y", "c"), rounded("frequencies").alias("frequency"))


def threshold_mask(spark, sf_dir):
    masks = cells.threshold_masks(model.embedding_labels(spark, sf_dir), queried(spark, sf_dir), {"normalized_amplitude": THRESHOLD}, CARRIER)
    return masks.select("mask_name", *keys("x", "y", "label"))


CELL_FEATURES = ["queried_amplitude", "queried_normalized_amplitude", "queried_z_score"]


def long_cells(rows: DataFrame) -> DataFrame:
    return rows.select("mask_name", *keys("label", "c"), "feature", "stat", rounded("value").alias("value"))


def channels_of(spark, sf_dir) -> DataFrame:
    return model.embedding_series(spark, sf_dir).select("image_id", "c").distinct()


def cell_stats(spark, sf_dir):
    return long_cells(cells.cell_stats(model.embedding_labels(spark, sf_dir), queried(spark, sf_dir), CELL_FEATURES, channels=channels_of(spark, sf_dir)))


def cell_stats_thresholded(spark, sf_dir):
    rows = cells.cell_stats(
        model.embedding_labels(spark, sf_dir), queried(spark, sf_dir), CELL_FEATURES, cutoffs={"normalized_amplitude": THRESHOLD}, carrier_index=CARRIER,
        channels=channels_of(spark, sf_dir),
    )
    return long_cells(rows)


def cell_levels(spark, sf_dir):
    rows = cells.cell_levels(model.sales_labels(spark, sf_dir), model.sales_series(spark, sf_dir))
    return rows.select(*keys("label", "c"), rounded("value", 4).alias("value"))


def cell_argmax_floor_mean(spark, sf_dir):
    return long_cells(cells.cell_stats(model.embedding_labels(spark, sf_dir), queried(spark, sf_dir), ["argmaxes"], channels=channels_of(spark, sf_dir)))


NAMES = ("a", "b")


def wide(spark, sf_dir) -> DataFrame:
    return process_images(
        model.embedding_series(spark, sf_dir), model.embedding_labels(spark, sf_dir), 2, CUTOFF, CARRIER, NAMES, {"normalized_amplitude": THRESHOLD},
        features=["full_amplitude", "normalized_amplitude"], normalize_histogram=False,
    )


def cells_wide(spark, sf_dir):
    rows = wide(spark, sf_dir)
    values = [c for c in rows.columns if c not in table.IDS]
    return rows.select(*keys("mask_index"), *[rounded(F.col(f"`{c}`")).alias(c) for c in values])


def cells_long(spark, sf_dir):
    rows = table.reshape_to_longform(wide(spark, sf_dir), NAMES)
    return rows.select(*keys("mask_index"), "channel", "feature", "stat", "mask_type", rounded("value").alias("value"))


def batch_union(spark, sf_dir):
    """Levels of two images of different numbers of channels, in one wide table: what one lacks is null."""
    parts = []
    for series, labels, names in (
        (model.embedding_series(spark, sf_dir), model.embedding_labels(spark, sf_dir), ("a", "b")),
        (model.sales_series(spark, sf_dir), model.sales_labels(spark, sf_dir), ("a", "b", "d")),
    ):
        rows = cells.cell_levels(labels, series).withColumns({"feature": F.lit("levels"), "stat": F.lit("mean"), "image_filename": F.col("image_id")})
        parts.append(table.create_wide(rows, names, [("levels", "mean")], ["all"]))
    rows = table.union_all(parts)
    return rows.select("image_filename", *keys("mask_index"), *[rounded(f"{n}_levels_mean", 4).alias(f"{n}_levels_mean") for n in ("a", "b", "d")])


def extent(series: DataFrame) -> tuple[int, int]:
    return tuple(v + 1 for v in series.agg(F.max("x"), F.max("y")).first())


def downsample_image(spark, sf_dir):
    series = model.embedding_series(spark, sf_dir)
    return elements(image.downsample_image(series, *extent(series), 0.5), "values")


#: Scales of downsample_scales.
SHARES = (0.5, 0.25, 0.2)


def downsample_scales(spark, sf_dir):
    series = model.embedding_series(spark, sf_dir)
    rows = image.downsample_scales(series, *extent(series), SHARES)
    each = rows.select(*keys("scale", "x", "y", "c"), F.posexplode("values").alias("t", "value"))
    return each.select("scale", "x", "y", "c", *keys("t"), rounded("value").alias("value"))


#: Samples of a block and the bins that fft_long_series gives.
BLOCK, LOW_BINS = 256, 48


def fft_long_series(spark, sf_dir):
    """The values of all events, in the order of event_id, as one series in blocks (zeros after the last): its lowest bins."""
    events = model.table(spark, sf_dir, "events")
    last = events.agg(F.max("event_id")).first()[0] or 0
    at = F.sort_array(F.collect_list(F.struct((F.col("event_id") % BLOCK).alias("i"), "value")))
    by_place = F.map_from_entries(at)
    values = F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.coalesce(F.try_element_at("at", i.cast("bigint")), F.lit(0.0)))
    blocks = events.groupBy((F.col("event_id") / BLOCK).cast("int").alias("block")).agg(by_place.alias("at")).select("block", values.alias("values"))
    keyed = blocks.select(F.lit("V").alias("image_id"), F.lit(0).alias("c"), F.lit(0).alias("x"), F.lit(0).alias("y"), "block", "values")
    rows = longfft.long_amplitudes(keyed, last // BLOCK + 1, BLOCK).where(F.col("k") < LOW_BINS)
    return rows.select("k", rounded("full_amplitude", 4).alias("value"))


def embedding_frames(spark, sf_dir) -> tuple[DataFrame, int, int]:
    """The embeddings image as frame rows, whose group is one frame of one channel; its height and width."""
    series = model.embedding_series(spark, sf_dir)
    at = F.sort_array(F.collect_list(F.struct("x", "y", "value")))
    height, width = extent(series)
    rows = model.voxels(series).groupBy("image_id", "t", "c").agg(F.transform(at, lambda p: p["value"]).alias("pixels"))
    return rows.withColumn("width", F.lit(width)), height, width


def frame_elements(rows: DataFrame) -> DataFrame:
    each = rows.select(*keys("c", "t", "width"), F.posexplode("pixels").alias("i", "value"))
    return each.select(F.expr("i div width").alias("x"), F.expr("i % width").cast("bigint").alias("y"), "c", "t", rounded("value").alias("value"))


def frames_normalize(spark, sf_dir):
    return frame_elements(frames.normalize_frame_rows(embedding_frames(spark, sf_dir)[0]))


def frames_downsample(spark, sf_dir):
    return frame_elements(frames.downsample_frame_rows(*embedding_frames(spark, sf_dir), 0.5))


def downsample_mask(spark, sf_dir):
    labels = model.embedding_labels(spark, sf_dir)
    return image.downsample_mask(labels, *extent(labels), 0.5).select(*keys("x", "y", "label"))


def convolve_time(spark, sf_dir):
    return elements(image.convolve_time(model.sales_series(spark, sf_dir), KERNEL), "values", digits=10)


def minmax_norm(spark, sf_dir):
    return elements(image.minmax_norm(model.event_series(spark, sf_dir)), "values")


def color_projection(proj: str):
    def query(spark, sf_dir):
        axes = model.event_axes(spark, sf_dir)
        rows = image.color_by_axis(model.event_series(spark, sf_dir, axes), axes[1], proj=proj)
        return rows.select(*keys("x", "y", "c"), *[rounded(n).alias(n) for n in "rgb"])

    return query


def wavelet_rows(spark, sf_dir, outputs: dict, **options) -> DataFrame:
    plain = {"normalize_histogram": False, "mean_centering": True, "padding": None, "min_scale": LOW, "max_scale": HIGH, "scales": SCALES}
    return cwt.cwt_features(model.embedding_series(spark, sf_dir), 32, carrier_channel=CARRIER, channel_outputs=outputs, **(plain | options))


def wavelets(spark, sf_dir, outputs, **options) -> DataFrame:
    rows = wavelet_rows(spark, sf_dir, {0: outputs, 1: outputs}, **options)
    each = rows.select(*keys("x", "y"), F.col("channel").cast("bigint").alias("c"), *keys("bank"), "output", F.posexplode("values").alias("t", "value"))
    return each.select("x", "y", "c", "bank", *keys("t"), "output", "value")


def cwt_output(output: str, digits: int = 6, **options):
    def query(spark, sf_dir):
        return wavelets(spark, sf_dir, [output], **options).select("x", "y", "c", "t", rounded("value", digits).alias("value"))

    return query


def cwt_phase(spark, sf_dir):
    rows = wavelets(spark, sf_dir, ["phase"])
    return rows.select("x", "y", "c", "t", rounded(F.cos("value")).alias("cos_phase"), rounded(F.sin("value")).alias("sin_phase"))


def cwt_channel_outputs(spark, sf_dir):
    """Other outputs for each channel, under names."""
    rows = wavelet_rows(spark, sf_dir, {0: ["freq"], 1: ["amp"]}, channel_names=NAMES)
    return rows.select(*keys("x", "y"), "channel", "output", F.posexplode("values").alias("t", "value")).select("x", "y", "channel", "output", *keys("t"), rounded("value").alias("value"))


def cwt_default_grid(spark, sf_dir):
    """The scales from the default's first place on, of a series of 32 frames."""
    series = model.embedding_series(spark, sf_dir)
    rows = cwt.cwt_features(series, 32, max_scale=GRID_END, channel_outputs={0: ["amp"]}, normalize_histogram=False, mean_centering=True, padding=None)
    return elements(rows.select(F.lit(0).alias("c"), "x", "y", "values"), "values")


def cwt_as_series(spark, sf_dir):
    """Amplitudes as a series table again, with the channels in another order."""
    rows = wavelet_rows(spark, sf_dir, {0: ["amp"], 1: ["amp"]}, blocks=7)
    return elements(cwt.as_series(rows, [("1", "amp", 0), ("0", "amp", 0)]), "values")


def cwt_phase_difference(spark, sf_dir):
    rows = wavelets(spark, sf_dir, ["phase_difference"])
    return rows.select("x", "y", "c", "t", rounded(F.cos("value")).alias("cos_difference"), rounded(F.sin("value")).alias("sin_difference"))


def cwt_bank(method: str):
    def query(spark, sf_dir):
        rows = wavelets(spark, sf_dir, ["amp"], num_filter_banks=BANKS, bank_method=method)
        return rows.select("x", "y", "c", "bank", "t", rounded("value").alias("value"))

    return query


def track_rows(rows: DataFrame) -> DataFrame:
    return rows.select(*keys("label", "c", "t"), rounded("mean").alias("mean"), rounded("sd").alias("sd"))


def track_mean_sd(spark, sf_dir):
    return track_rows(cells.tracks(model.event_series(spark, sf_dir), model.event_labels(spark, sf_dir)))


def track_moving_mask(spark, sf_dir):
    axes = model.event_axes(spark, sf_dir)
    return track_rows(cells.tracks(model.event_series(spark, sf_dir, axes), model.event_tracks(spark, sf_dir, axes[1])))


def file_pairing(spark, sf_dir):
    """A file for each nation, a mask file for those of even key."""
    nations = model.table(spark, sf_dir, "nation")
    images = nations.select(F.concat("n_name", F.lit(".v1."), F.when(F.col("n_regionkey") == 0, "nd2").otherwise("tif")).alias("name"))
    masks = nations.where("n_nationkey % 2 = 0").select(F.concat("n_name", F.lit(".v1_masks.tif")).alias("name"))
    return tiff.pair_files(images, masks)


#: Rows of pixels in a file of tiff_roundtrip.
BAND = 8


def embedding_files(series: DataFrame, compression: str | None = None, channels: int = 2) -> DataFrame:
    """(name, content): a TIFF file for each band of BAND rows of pixels, each written by a task of its own; its name is the band's number."""
    return band_files(series, "tif", lambda stack: tiff.encode_tiff(stack if channels > 1 else stack[:, 0], compression), channels)


def band_files(series: DataFrame, ending: str, encode, channels: int = 2, dtype=np.float32) -> DataFrame:
    """(name, content) of each band's file, as encode makes it of (T, C, X, Y)."""
    width = extent(series)[1]

    def write(rows):
        import pandas as pd

        band = int(rows.x.iloc[0]) // BAND
        stack = np.zeros((32, channels, int(rows.x.max()) - band * BAND + 1, width), dtype)
        for r in rows.itertuples():
            stack[:, r.c, r.x - band * BAND, r.y] = r.values
        return pd.DataFrame({"name": [f"{band}.{ending}"], "content": [encode(stack)]})

    return series.groupBy(F.expr(f"x div {BAND}")).applyInPandas(write, "name string, content binary")


def embedding_mask_files(labels: DataFrame) -> DataFrame:
    """(name, content): the mask file of each band, whose unlabelled pixels are 0."""
    width = extent(labels)[1]

    def write(rows):
        import pandas as pd

        band = int(rows.x.iloc[0]) // BAND
        mask = np.zeros((int(rows.x.max()) - band * BAND + 1, width), np.uint16)
        mask[rows.x - band * BAND, rows.y] = rows.label
        return pd.DataFrame({"name": [f"{band}_masks.tif"], "content": [tiff.encode_tiff(mask)]})

    return labels.groupBy(F.expr(f"x div {BAND}")).applyInPandas(write, "name string, content binary")


def band_elements(files: DataFrame) -> DataFrame:
    """The elements of the image that files of bands make up."""
    return elements(in_band(tiff.load_images(files)), "values")


def tiff_roundtrip(spark, sf_dir):
    """The embeddings image written as TIFF files of a few rows of pixels each, read again as series."""
    return band_elements(embedding_files(model.embedding_series(spark, sf_dir)))


def tiff_deflate(spark, sf_dir):
    return band_elements(embedding_files(model.embedding_series(spark, sf_dir), "deflate"))


def tiff_singleton_channel(spark, sf_dir):
    """Files without a channel axis have one channel."""
    return band_elements(embedding_files(model.embedding_series(spark, sf_dir).where("c = 0"), channels=1))


def mask_scan(spark, sf_dir):
    rows = tiff.load_masks(embedding_mask_files(model.embedding_labels(spark, sf_dir)))
    return rows.select(F.col("image_id").alias("mask_filename"), *keys("x", "y", "label"))


def in_band(rows: DataFrame) -> DataFrame:
    """Rows of files of bands, with x counted in the whole image."""
    return rows.withColumn("x", F.col("x") + BAND * F.regexp_extract("image_id", r"^\d+", 0).cast("int"))


def written_bands(spark, files: DataFrame) -> str:
    """The shared folder that files are written to."""
    place = f"{shared_folder(spark)}/bands-{uuid.uuid4().hex}"
    stacks.write_files(files, place)
    return place


#: Bytes of a partition of the queries on stacks: a band's file has several.
PART = 20_000


def stack_scan(spark, sf_dir):
    """The embeddings image as files that are read in parts, by offsets."""
    place = written_bands(spark, embedding_files(model.embedding_series(spark, sf_dir)))
    return elements(in_band(stacks.series_of(stacks.read_stacks(spark, place, bytes_per_partition=PART))), "values")


def stack_filtered(spark, sf_dir):
    """One channel and some frames: only their pages are read."""
    place = written_bands(spark, embedding_files(model.embedding_series(spark, sf_dir)))
    rows = stacks.read_stacks(spark, place, bytes_per_partition=PART, columns=10).where("c = 1 and t >= 8 and t < 16")
    each = in_band(rows).select("x", "y", "c", "t", F.posexplode("pixels").alias("i", "v"))
    return each.select(*keys("x"), (F.col("y") + F.col("i")).cast("bigint").alias("y"), *keys("c", "t"), rounded("v").alias("value"))


def whole_values(series: DataFrame) -> DataFrame:
    """Embeddings as integers of 16 bits."""
    return series.withColumn("values", F.transform("values", lambda v: F.floor((v + 2) * 10_000)))


def nd2_scan(spark, sf_dir):
    """The embeddings image as ND2 files, read whole."""
    files = band_files(whole_values(model.embedding_series(spark, sf_dir)), "nd2", lambda stack: encode_nd2(stack, compressed=True), dtype=np.uint16)
    return elements(in_band(tiff.load_images(files)), "values")


def nd2_stack_scan(spark, sf_dir):
    """ND2 files of raw frames with padded rows, read in parts; one channel."""
    place = written_bands(spark, band_files(whole_values(model.embedding_series(spark, sf_dir)), "nd2", lambda stack: encode_nd2(stack, padding=6), dtype=np.uint16))
    return elements(in_band(stacks.series_of(stacks.read_stacks(spark, place, bytes_per_partition=PART).where("c = 1"))), "values")


def folder(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Bands as files with masks, and for each nation a copy of a band that cannot be analysed: no mask, cut off, a mask of frames, other channels, another format, or a mask of other pixels."""
    series, labels = model.embedding_series(spark, sf_dir), model.embedding_labels(spark, sf_dir)
    images, masks = embedding_files(series), embedding_mask_files(labels)
    width = extent(series)[1]
    moving, small = tiff.encode_tiff(np.ones((2, BAND, width), np.uint16)), tiff.encode_tiff(np.ones((BAND - 1, width), np.uint16))
    one_channel = tiff.encode_tiff(np.ones((32, BAND, width), np.float32))
    kind = F.col("n_nationkey") % 6
    name = F.concat("n_name", F.when(kind == 4, ".nd2").otherwise(".tif"))
    first = images.where("name = '0.tif'").crossJoin(model.table(spark, sf_dir, "nation"))
    content = F.when(kind == 1, F.substring("content", 1, 7)).when(kind == 3, F.lit(one_channel)).otherwise(F.col("content"))
    others = first.select(name.alias("name"), content.alias("content"))
    mask = masks.where("name = '0_masks.tif'").crossJoin(model.table(spark, sf_dir, "nation")).where(kind > 0)
    content = F.when(kind == 2, F.lit(moving)).when(kind == 5, F.lit(small)).otherwise(F.col("content"))
    other_masks = mask.select(F.concat("n_name", F.lit("_masks.tif")).alias("name"), content.alias("content"))
    return process_files(
        images.unionByName(others), masks.unionByName(other_masks), 2,
        cutoff_frequency_bin=CUTOFF, carrier_index=CARRIER, channel_names=NAMES, features=["full_amplitude", "normalized_amplitude"], normalize_histogram=False,
    )


FOLDER_COLUMNS = ("a_queried_amplitude_mean", "b_queried_amplitude_sd", "b_argmaxes_mean", "a_levels_mean")


def folder_cells(spark, sf_dir):
    return folder(spark, sf_dir)[0].select("image_filename", "mask_filename", *keys("mask_index"), *[rounded(c).alias(c) for c in FOLDER_COLUMNS])


def folder_problems(spark, sf_dir):
    return folder(spark, sf_dir)[1]


#: Frames of the window of stream_spectrum.
WINDOW = 16


def stream_spectrum(spark, sf_dir):
    """The embeddings image as a stream of frames, half of which come later: the last window's spectrum of each pixel."""
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    voxels = model.voxels(model.embedding_series(spark, sf_dir)).withColumn("t", F.col("t").cast("bigint"))
    for first in (0, 16):
        voxels.where(f"t >= {first} and t < {first + 16}").write.mode("append").parquet(f"{place}/frames")
        spectra.follow_spectra(spark.readStream.schema(FRAMES).parquet(f"{place}/frames"), f"{place}/out", WINDOW)
    return elements(spectra.spectra_of(spark, f"{place}/out"), "full_amplitude", "k")


def folder_increments(spark, sf_dir):
    """The bands of even numbers, then the others: a second run reads the new files only."""
    series, labels = model.embedding_series(spark, sf_dir), model.embedding_labels(spark, sf_dir)
    place = f"{shared_folder(spark)}/grown-{uuid.uuid4().hex}"
    stacks.write_files(embedding_mask_files(labels), f"{place}/masks")
    images = embedding_files(series)
    for odd in (0, 1):
        stacks.write_files(images.where(F.regexp_extract("name", r"^\d+", 0).cast("int") % 2 == odd), f"{place}/images")
        folders.follow_folder(
            spark, f"{place}/images", f"{place}/masks", f"{place}/out", 2, cutoff_frequency_bin=CUTOFF, carrier_index=CARRIER, channel_names=NAMES,
            features=["full_amplitude", "normalized_amplitude"], normalize_histogram=False,
        )
    rows = folders.cells_of(spark, f"{place}/out")
    return rows.select("image_filename", *keys("batch", "mask_index"), *[rounded(c).alias(c) for c in FOLDER_COLUMNS])


QUERIES = {
    "series_mean_center": series_mean_center,
    "frame_normalize": frame_normalize,
    "fft_full_amplitude": one_feature("full_amplitude"),
    "fft_normalized_amplitude": one_feature("normalized_amplitude"),
    "fft_z_score": one_feature("z_score"),
    "fft_max_bin": one_feature("normalized_amplitude", max_bin=6),
    "fft_phase": fft_phase,
    "fft_constant_pixel": fft_constant_pixel,
    "fft_by_join": fft_by_join,
    "fft_peak": fft_peak,
    "fft_peak_fallback": fft_peak_fallback,
    "fft_query_features": fft_query_features,
    "fft_frequencies": fft_frequencies,
    "threshold_mask": threshold_mask,
    "cell_stats": cell_stats,
    "cell_stats_thresholded": cell_stats_thresholded,
    "cell_levels": cell_levels,
    "cell_argmax_floor_mean": cell_argmax_floor_mean,
    "cells_wide": cells_wide,
    "cells_long": cells_long,
    "batch_union": batch_union,
    "downsample_image": downsample_image,
    "downsample_scales": downsample_scales,
    "fft_long_series": fft_long_series,
    "downsample_mask": downsample_mask,
    "frames_normalize": frames_normalize,
    "frames_downsample": frames_downsample,
    "stream_spectrum": stream_spectrum,
    "convolve_time": convolve_time,
    "minmax_norm": minmax_norm,
    "color_projection_max": color_projection("max"),
    "color_projection_sum": color_projection("sum"),
    "track_mean_sd": track_mean_sd,
    "track_moving_mask": track_moving_mask,
    "file_pairing": file_pairing,
    "tiff_roundtrip": tiff_roundtrip,
    "tiff_deflate": tiff_deflate,
    "tiff_singleton_channel": tiff_singleton_channel,
    "mask_scan": mask_scan,
    "folder_cells": folder_cells,
    "folder_problems": folder_problems,
    "folder_increments": folder_increments,
    "stack_scan": stack_scan,
    "stack_filtered": stack_filtered,
    "nd2_scan": nd2_scan,
    "nd2_stack_scan": nd2_stack_scan,
    "cwt_amp": cwt_output("amp"),
    "cwt_freq_index": cwt_output("freq"),
    "cwt_z_score": cwt_output("z_score"),
    "cwt_phase_difference": cwt_phase_difference,
    "cwt_phase": cwt_phase,
    "cwt_freq_hz": cwt_output("freq", sampling=SAMPLING, wavelet=(cwt.GAMMA, cwt.BETA), min_scale=FINE_LOW, max_scale=FINE_HIGH, scales=FINE_SCALES),
    "cwt_normalized_amp": cwt_output("amp", normalize_amplitudes=True),
    "cwt_default_preprocessing": cwt_output("amp", 5, normalize_histogram=True, mean_centering=True, padding="reflect"),
    "cwt_morlet": cwt_output("amp", wavelet=("morlet", MORLET)),
    "cwt_channel_outputs": cwt_channel_outputs,
    "cwt_default_grid": cwt_default_grid,
    "cwt_as_series": cwt_as_series,
    "cwt_bank_maxpool": cwt_bank("max_pool"),
    "cwt_bank_sort": cwt_bank("sort"),
}
