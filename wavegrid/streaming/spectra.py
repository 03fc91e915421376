"""Spectra of streams of frames: of each pixel's last `window` frames, kept up to date frame by frame.

    follow_spectra(frames, out, window=64)      runs a stream of (image_id, t, c, x, y, value) to its end
    spectra_of(spark, out)                      each pixel's last spectrum

The state of a pixel is a ring of its last frames' values and the coefficients of their transform.
A new frame costs one step for each bin, X_k <- (X_k - oldest + newest) exp(2 pi i k / window); after
each `window` frames the coefficients are computed anew, so that rounding does not add up. Centring
the series changes the first bin only, which is 0 then. A timer on the stream's frames forgets a
pixel that is more than `idle` frames behind the newest one.

Frames of a batch are put in order of t. A frame that is not later than the last one, or is null,
is left out and counted (`late`); where frames are missing the window begins anew, since a spectrum
is of frames that follow each other. A pixel has no spectrum before its window is full.

State is kept by Spark (RocksDB) with the stream's progress in `out`, so a run that begins again goes
on where the last one ended; a batch that is run again replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from wavegrid.operators.fft import checked, features_of

KEY = ("image_id", "c", "x", "y")
FRAMES = "image_id string, t bigint, c int, x int, y int, value double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sliding:
    """The last frames of a pixel and their coefficients. ring: values by t modulo the window."""

    def __init__(self, window: int, last: int | None = None, held: int = 0, late: int = 0, ring=(), re=(), im=()):
        self.window, self.last, self.held, self.late = window, last, held, late
        self.ring = np.array(ring, float) if len(ring) else np.zeros(window)
        self.x = np.array(re, float) + 1j * np.array(im, float) if len(re) else np.zeros(window // 2 + 1, complex)
        self.turn = np.exp(2j * np.pi * np.arange(window // 2 + 1) / window)

    def add(self, t: int, value: float | None) -> None:
        if value is None or self.last is not None and t <= self.last:
            self.late += 1
            return
        if self.last is not None and t != self.last + 1:
            self.ring[:], self.x[:], self.held = 0.0, 0.0, 0
        place = t % self.window
        oldest, self.ring[place] = self.ring[place], value
        self.last, self.held = t, min(self.window, self.held + 1)
        if place and np.isfinite(self.x).all():
            self.x = (self.x - oldest + value) * self.turn
        else:
            # From time to time anew, and always after a value that is no number.
            self.renew()

    def renew(self) -> None:
        """The coefficients from the ring, whose oldest value is the first sample."""
        self.x = np.fft.rfft(np.roll(self.ring, -((self.last + 1) % self.window)))

    def features(self, chosen: Sequence[str]) -> dict[str, np.ndarray]:
        x = self.x.copy()
        if np.isfinite(x[0]):
            x[0] = 0.0
        return {k: v[0] for k, v in features_of(x[None], chosen).items()}


class Spectra(StatefulProcessor):
    def __init__(self, window: int, features: Sequence[str], idle: int):
        self.window, self.features, self.idle = window, list(features), idle

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("frames", "last bigint, held bigint, late bigint, ring array<double>, re array<double>, im array<double>")

    def handleInputRows(self, key, rows, timers) -> Iterator:
        import pandas as pd

        now = Sliding(self.window, *self.state.get()) if self.state.exists() else Sliding(self.window)
        batch = pd.concat(list(rows)).sort_values("t", kind="stable")
        for t, value, known in zip(batch["t"].tolist(), batch["value"].tolist(), batch["known"].tolist(), strict=True):
            now.add(int(t), float(value) if known else None)
        if now.last is None:
            return
        self.state.update((now.last, now.held, now.late, now.ring.tolist(), now.x.real.tolist(), now.x.imag.tolist()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # A frame counts as a second of event time.
        self.handle.registerTimer(1000 * (now.last + self.idle))
        full = now.held >= self.window
        found = now.features(self.features) if full else {}
        yield pd.DataFrame([{**dict(zip(KEY, key, strict=True)), "t": now.last, "late": now.late, **{f: found[f].tolist() if full else None for f in self.features}}])

    def handleExpiredTimer(self, key, timers, expired) -> Iterator:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def spectra_stream(frames: DataFrame, window: int, features: Sequence[str] = ("full_amplitude",), idle: int = 86_400) -> DataFrame:
    """(image_id, c, x, y, t, late, features): for each pixel with new frames, the spectrum of the last `window` of them, null before it is full."""
    if window < 2:
        raise ValueError("a window has at least two frames")
    chosen = checked(features)
    # NaN is a value, null is none: pandas would not tell them apart.
    rows = frames.select(*KEY, F.col("t").cast("bigint").alias("t"), F.col("value").cast("double").alias("value"), F.col("value").isNotNull().alias("known"))
    rows = rows.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", f"{int(idle)} seconds")
    ddl = "image_id string, c int, x int, y int, t bigint, late bigint, " + ", ".join(f"{f} array<double>" for f in chosen)
    return rows.groupBy(*KEY).transformWithStateInPandas(Spectra(window, chosen, int(idle)), ddl, "Update", "EventTime")


def follow_spectra(frames: DataFrame, out: str, window: int, features: Sequence[str] = ("full_amplitude",), idle: int = 86_400) -> None:
    """Runs a stream over the frames that are there and writes each batch's spectra into a folder of its own."""
    spark = frames.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        rows = spectra_stream(frames, window, features, idle)
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/spectra/batch={number}")
        run = rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
    run.awaitTermination()


def spectra_of(spark: SparkSession, out: str) -> DataFrame:
    """Each pixel's last spectrum."""
    rows = spark.read.parquet(f"{out}/spectra")
    last = rows.groupBy(*KEY).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*KEY, "batch"]).drop("batch")
