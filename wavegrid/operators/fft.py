"""Fourier features of series, and their query at the dominant frequency of a carrier channel."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.functions.numerics import angle_between, first_peak
from wavegrid.operators.image import mean_center, normalize_frames

FEATURES = ("full_amplitude", "normalized_amplitude", "z_score", "phase")
#: The name of a feature at the queried bin.
QUERIED = {"full_amplitude": "queried_amplitude", "normalized_amplitude": "queried_normalized_amplitude", "z_score": "queried_z_score", "phase": "queried_phase_difference"}


@dataclass(frozen=True)
class Sampling:
    """fs: samples per unit of time; N: samples of the series that frequencies refer to."""

    fs: float
    N: int

    def frequency(self, k: Column) -> Column:
        return k * F.lit(float(self.fs)) / F.lit(int(self.N))


def checked(features: Sequence[str]) -> list[str]:
    unknown = [f for f in features if f not in FEATURES]
    if unknown or not features:
        raise ValueError(f"unknown features {unknown}; choose from {FEATURES}" if unknown else "no features are chosen")
    return list(dict.fromkeys(features))


def spectra(values: np.ndarray, features: Sequence[str], max_bin: int | None = None) -> dict[str, np.ndarray]:
    """Features of the rows of a matrix, after centring. Statistics are over all bins, the cut comes last."""
    return features_of(np.fft.rfft(values - values.mean(axis=1, keepdims=True), axis=1), features, max_bin)


def features_of(x: np.ndarray, features: Sequence[str], max_bin: int | None = None) -> dict[str, np.ndarray]:
    """Features of the rows of complex coefficients."""
    amp = np.abs(x)
    out = {}
    with np.errstate(divide="ignore", invalid="ignore"):
        if "full_amplitude" in features:
            out["full_amplitude"] = amp
        if "normalized_amplitude" in features:
            out["normalized_amplitude"] = amp / amp.sum(axis=1, keepdims=True)
        if "z_score" in features:
            sd = amp.std(axis=1, ddof=1, keepdims=True) if amp.shape[1] > 1 else np.full((len(amp), 1), np.nan)
            out["z_score"] = (amp - amp.mean(axis=1, keepdims=True)) / sd
        if "phase" in features:
            out["phase"] = np.angle(x)
    return {k: v[:, :max_bin] for k, v in out.items()}


def rows_of(values: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of series in a batch; null and empty series are left out."""
    sizes = np.array([len(v) if v.is_valid else 0 for v in values])
    out = []
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        out.append((at, np.asarray(values.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(at), size)))
    return out


def lists_of(n: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """n lists, of which those numbered in parts are the rows of the matrices beside; others are null."""
    arrays, place, base = [pa.array([], pa.list_(pa.float64()))], np.zeros(n, np.int64), 0
    missing = np.ones(n, bool)
    for at, matrix in parts:
        offsets = np.arange(len(at) + 1, dtype=np.int32) * matrix.shape[1]
        arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel())))
        place[at] = base + np.arange(len(at))
        missing[at] = False
        base += len(at)
    return pa.concat_arrays(arrays).take(pa.array(place, mask=missing))


def spectrum(series: DataFrame, features: Sequence[str] = FEATURES, normalize_histogram: bool = True, max_bin: int | None = None) -> DataFrame:
    """Series keys and one array for each feature (element k: bin k). A null or empty series gives nulls.

    Spark has no Fourier transform, so whole Arrow batches of series go through numpy; only the
    features asked for come back.
    """
    chosen = checked(features)
    source = normalize_frames(series) if normalize_histogram else series

    def transform(values: pa.Array) -> pa.Array:
        found = [(at, spectra(matrix, chosen, max_bin)) for at, matrix in rows_of(values)]
        return pa.StructArray.from_arrays([lists_of(len(values), [(at, by[f]) for at, by in found]) for f in chosen], names=chosen)

    udf = F.arrow_udf(transform, "struct<" + ", ".join(f"{f} array<double>" for f in chosen) + ">").asNondeterministic()
    return source.withColumn("_s", udf("values")).select("image_id", "c", "x", "y", *[F.col(f"_s.{f}").alias(f) for f in chosen])


def spectrum_by_join(series: DataFrame, frames: int) -> DataFrame:
    """(image_id, c, x, y, k, full_amplitude): the transform in SQL alone, by a table of twiddle factors.

    Slower than spectrum() and without Python; the table has frames * (frames / 2 + 1) rows.
    """
    spark = series.sparkSession
    angle = F.lit(2 * math.pi) * ((F.col("k") * F.col("t")) % F.lit(frames)) / F.lit(frames)
    twiddle = spark.range(frames // 2 + 1).select(F.col("id").cast("int").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("t"))
    twiddle = twiddle.select("k", "t", F.cos(angle).alias("re"), (-F.sin(angle)).alias("im"))
    # About 500 000 rows of four numbers are sent to all tasks at most; Spark joins larger tables by an exchange.
    twiddle = F.broadcast(twiddle) if frames <= 1000 else twiddle
    each = mean_center(series).select("image_id", "c", "x", "y", F.posexplode("values").alias("t", "v")).join(twiddle, "t")
    sums = each.groupBy("image_id", "c", "x", "y", "k").agg(F.sum(F.col("v") * F.col("re")).alias("re"), F.sum(F.col("v") * F.col("im")).alias("im"))
    return sums.select("image_id", "c", "x", "y", "k", F.hypot("re", "im").alias("full_amplitude"))


def peak_feature(peak_method: str, features: Sequence[str]) -> str:
    """The feature that ranks bins: peak_method, or what stands in for it where it is not computed."""
    if peak_method in features:
        return peak_method
    for other in ("normalized_amplitude", "z_score"):
        if other in features:
            warnings.warn(f"{peak_method} is not among the features; bins are ranked by {other}", stacklevel=3)
            return other
    raise ValueError(f"{peak_method} is not among the features {list(features)}")


def query_features(
    spectrum_rows: DataFrame, cutoff_frequency_bin: int, carrier_index: int, sampling: Sampling | None = None, peak_method: str = "normalized_amplitude"
) -> DataFrame:
    """Each channel's features at the carrier's dominant bin (from the cutoff on).

    argmaxes and frequencies are each channel's own dominant bin; everything else is read at the
    carrier's. Phase differences are relative to the carrier, in [0, 2 pi).
    """
    features = [f for f in FEATURES if f in spectrum_rows.columns]
    ranked = peak_feature(peak_method, features)
    if cutoff_frequency_bin < 0:
        raise ValueError("cutoff_frequency_bin must not be negative")
    own = spectrum_rows.withColumn("argmaxes", first_peak(F.col(ranked), cutoff_frequency_bin))
    # A window's group is one pixel's channels, so no group grows with the data.
    pixel = Window.partitionBy("image_id", "x", "y")
    carrier = lambda column: F.max(F.when(F.col("c") == carrier_index, column)).over(pixel)
    at = own.withColumn("_bin", carrier(F.col("argmaxes")))
    out = at.select(
        "image_id", "c", "x", "y", "argmaxes",
        *[F.get(f, F.col("_bin")).alias(QUERIED[f]) for f in features if f != "phase"],
        *([F.get("phase", F.col("_bin")).alias("_phase")] if "phase" in features else []),
    )
    if "phase" in features:
        out = out.withColumn(QUERIED["phase"], angle_between(F.col("_phase"), carrier(F.col("_phase")))).drop("_phase")
    if sampling is not None:
        out = out.withColumn("frequencies", sampling.frequency(F.col("argmaxes")))
    return out


def check_cutoff(cutoff_frequency_bin: int, max_bin: int | None) -> None:
    if max_bin is not None and cutoff_frequency_bin >= max_bin:
        raise ValueError("cutoff_frequency_bin leaves no bin below max_bin")


def peak_query(
    series: DataFrame, cutoff_frequency_bin: int, carrier_index: int, features: Sequence[str] = FEATURES, normalize_histogram: bool = True,
    max_bin: int | None = None, sampling: Sampling | None = None, peak_method: str = "normalized_amplitude",
) -> DataFrame:
    """query_features(spectrum(series)) in one step: only what is read at the peaks leaves Python.

    One exchange brings a pixel's channels together, before the transform; spectra are never
    moved or kept.
    """
    chosen = checked(features)
    ranked = peak_feature(peak_method, chosen)
    check_cutoff(cutoff_frequency_bin, max_bin)
    source = normalize_frames(series) if normalize_histogram else series
    names = ["argmaxes", *[QUERIED[f] for f in chosen]]

    def query(channels: pa.Array) -> pa.Array:
        flat = channels.flatten()
        cs, n = flat.field("c").to_numpy(zero_copy_only=False), len(flat)
        sizes = np.array([len(x) if x.is_valid else 0 for x in channels], np.int64)
        owner = np.repeat(np.arange(len(channels)), sizes)
        found = [(at, spectra(matrix, list({*chosen, ranked}), max_bin)) for at, matrix in rows_of(flat.field("values"))]
        peak = np.full(n, -1)
        for at, by in found:
            tail = by[ranked][:, cutoff_frequency_bin:]
            if tail.shape[1]:
                peak[at] = tail.argmax(axis=1) + cutoff_frequency_bin
        # Each pixel's first row of the carrier's channel, and the bin that all its channels are read at.
        carrier, of_carrier = np.full(len(channels), -1), np.flatnonzero(cs == carrier_index)[::-1]
        carrier[owner[of_carrier]] = of_carrier
        own = carrier[owner]
        at_bin = np.where(own >= 0, peak[own], -1)
        read = {f: np.zeros(n) for f in chosen}
        known = np.zeros(n, bool)
        for at, by in found:
            here = at_bin[at]
            on = (here >= 0) & (here < by[ranked].shape[1])
            known[at[on]] = True
            for f in chosen:
                read[f][at[on]] = by[f][np.flatnonzero(on), here[on]]
        if "phase" in read:
            read["phase"] = np.mod(read["phase"] - np.where(own >= 0, read["phase"][own], 0.0), 2 * math.pi)
        columns = [pa.array(cs, pa.int32()), pa.array(peak, pa.int32(), mask=peak < 0), *[pa.array(read[f], mask=~known) for f in chosen]]
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names=["c", *names]))

    ddl = "array<struct<c int, argmaxes int, " + ", ".join(f"{QUERIED[f]} double" for f in chosen) + ">>"
    pixels = source.groupBy("image_id", "x", "y").agg(F.sort_array(F.collect_list(F.struct("c", "values"))).alias("channels"))
    found = pixels.withColumn("found", F.arrow_udf(query, ddl).asNondeterministic()("channels")).select("image_id", "x", "y", F.explode("found").alias("f"))
    out = found.select("image_id", "f.c", "x", "y", *[f"f.{n}" for n in names])
    return out.withColumn("frequencies", sampling.frequency(F.col("argmaxes"))) if sampling is not None else out
