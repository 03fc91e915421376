"""Signals with known answers, and the operators' edge cases."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavegrid.functions import numerics
from wavegrid.operators import cells, cwt, fft, image, moments, table
from wavegrid.plans import pipeline
from wavegrid.sources import tiff
from wavegrid.streaming import frames, spectra

T = 32
SERIES = "image_id string, c int, x int, y int, values array<double>"


def tone(k, amplitude=1.0, phase=0.0, n=T):
    return (amplitude * np.cos(2 * math.pi * k * np.arange(n) / n + phase)).tolist()


def make(spark, rows):
    return spark.createDataFrame([("i", c, x, y, v) for c, x, y, v in rows], SERIES)


def labels(spark, rows, schema="image_id string, mask_name string, x int, y int, label bigint"):
    return spark.createDataFrame(rows, schema)


def test_tone_is_found_at_its_bin(spark):
    s = make(spark, [(0, 0, 0, tone(5, 2.0, 0.3)), (1, 0, 0, tone(5, 1.0, 0.3 + 1.1))])
    rows = {r.c: r for r in fft.peak_query(s, 1, 0, normalize_histogram=False, sampling=fft.Sampling(4, T)).collect()}
    assert rows[0].argmaxes == 5 and rows[0].queried_amplitude == pytest.approx(2.0 * T / 2)
    assert rows[0].queried_normalized_amplitude == pytest.approx(1.0) and rows[0].queried_phase_difference == 0
    assert rows[1].queried_phase_difference == pytest.approx(1.1) and rows[1].frequencies == pytest.approx(5 * 4 / T)


def test_other_channels_are_read_at_the_carriers_bin(spark):
    s = make(spark, [(0, 0, 0, tone(3)), (1, 0, 0, (np.array(tone(7)) + 0.25 * np.array(tone(3))).tolist())])
    for rows in (fft.peak_query(s, 1, 0, normalize_histogram=False), fft.query_features(fft.spectrum(s, normalize_histogram=False), 1, 0)):
        other = next(r for r in rows.collect() if r.c == 1)
        assert other.argmaxes == 7 and other.queried_amplitude == pytest.approx(0.25 * T / 2)


def test_fused_query_equals_the_query_of_spectra(spark):
    rng = np.random.default_rng(0)
    s = make(spark, [(c, x, y, rng.normal(size=31).tolist()) for c in range(3) for x in range(4) for y in range(3)])
    columns = ["c", "x", "y", "argmaxes", *fft.QUERIED.values()]
    one = fft.peak_query(s, 2, 1, normalize_histogram=True, max_bin=9).select(columns).toPandas()
    two = fft.query_features(fft.spectrum(s, max_bin=9), 2, 1).select(columns).toPandas()
    key = ["c", "x", "y"]
    np.testing.assert_allclose(one.sort_values(key).to_numpy(float), two.sort_values(key).to_numpy(float), atol=1e-9)


def test_constant_series_and_null_series(spark):
    s = make(spark, [(0, 0, 0, [1.0] * T), (0, 0, 1, None), (0, 0, 2, [])])
    rows = {r.y: r for r in fft.spectrum(s, normalize_histogram=False).collect()}
    assert set(rows[0].full_amplitude) == {0.0} and all(map(math.isnan, rows[0].normalized_amplitude)) and all(map(math.isnan, rows[0].z_score))
    assert rows[1].full_amplitude is None and rows[2].phase is None
    assert fft.peak_query(s, 1, 0, normalize_histogram=False).count() == 3


def test_flat_frame_gives_nan(spark):
    s = make(spark, [(0, 0, 0, [1.0, 2.0]), (0, 0, 1, [1.0, 4.0])])
    rows = image.normalize_frames(s).collect()
    assert all(math.isnan(r["values"][0]) for r in rows) and sorted(r["values"][1] for r in rows) == pytest.approx([-math.sqrt(0.5), math.sqrt(0.5)])


def test_first_peak_and_division(spark):
    nan = float("nan")
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([nan, 1.0, nan],), ([5.0, 1.0, 2.0],)], "v array<double>")
    assert [r[0] for r in df.select(numerics.first_peak(F.col("v"), 0)).collect()] == [1, 0, 0]
    assert [r[0] for r in df.select(numerics.first_peak(F.col("v"), 1)).collect()] == [1, 2, 2]
    got = spark.sql("select double(0) a, double(0) b union all select 1, 0 union all select -1, 0 union all select null, 1 union all select 3, 2")
    a, b, c, d, e = [r[0] for r in got.select(numerics.ieee_div(F.col("a"), F.col("b"))).collect()]
    assert math.isnan(a) and b == math.inf and c == -math.inf and d is None and e == 1.5


def test_thresholds_stats_and_dense_labels(spark):
    q = spark.createDataFrame(
        [("i", 0, x, 0, v, a) for x, (v, a) in enumerate([(0.5, 2), (float("nan"), 3), (0.1, 2), (0.9, 3)])],
        "image_id string, c int, x int, y int, queried_amplitude double, argmaxes int",
    )
    lab = labels(spark, [("i", "all", 0, 0, 1), ("i", "all", 1, 0, 1), ("i", "all", 2, 0, 3), ("i", "all", 3, 0, 3)])
    masks = cells.threshold_masks(lab, q, {"full_amplitude": 0.1}, 0)
    got = {(r.mask_name, r.x): r.label for r in masks.collect()}
    name = "thresh_queried_amplitude_at_0.1"
    assert [got[name, x] for x in range(4)] == [1, 0, 0, 3]
    with pytest.warns(UserWarning):
        assert cells.threshold_masks(lab, q, {"nothing": 1.0}, 0).count() == 4
    stats = {(r.mask_name, r.label, r.feature, r.stat): r.value for r in cells.cell_stats(masks, q, ["queried_amplitude", "argmaxes"]).collect()}
    assert stats["all", 2, "queried_amplitude", "mean"] == 0 and stats["all", 2, "queried_amplitude", "sd"] == 0
    assert stats["all", 1, "argmaxes", "mean"] == 2 and stats["all", 1, "argmaxes", "sd"] == pytest.approx(math.sqrt(0.5), rel=1e-5)
    assert math.isnan(stats["all", 1, "queried_amplitude", "mean"]) and stats[name, 3, "queried_amplitude", "mean"] == 0.9 and stats[name, 3, "queried_amplitude", "sd"] == 0
    direct = cells.cell_stats(lab, q, ["queried_amplitude", "argmaxes"], cutoffs={"full_amplitude": 0.1})
    assert repr(sorted(stats.items())) == repr(sorted(((r.mask_name, r.label, r.feature, r.stat), r.value) for r in direct.collect()))
    exact = cells.cell_stats(lab, q, ["argmaxes"], integer_mean="exact").where("label = 1 and stat = 'mean'").first()
    assert exact.value == 2.5


def test_resampling(spark):
    s = make(spark, [(0, x, 0, [float(x), 10.0 * x]) for x in range(5)])
    got = {r.x: r["values"] for r in image.downsample_image(s, 5, 1, (3, 1)).collect()}
    assert got == {0: [0.5, 5.0], 1: [2.0, 20.0], 2: [3.5, 35.0]}
    lab = labels(spark, [("i", "all", x, 0, (1 << 40) + x) for x in range(5)])
    assert sorted((r.x, r.label - (1 << 40)) for r in image.downsample_mask(lab, 5, 1, (3, 1)).collect()) == [(0, 0), (1, 1), (2, 3)]
    assert image.target_size(25, 0.5) == 12 and image.target_size(5, 0.01) == 1
    with pytest.raises(ValueError):
        image.downsample_image(s, 5, 1, 2)


def test_convolution(spark):
    s = make(spark, [(0, 0, 0, [1.0, 2.0, 3.0])])
    assert image.convolve_time(s, [1, 0, 0]).first()["values"] == [0.0, 1.0, 2.0]
    with pytest.raises(ValueError):
        image.convolve_time(s, [1, 1])


def test_colors(spark):
    s = make(spark, [(0, 0, 0, [0.0, 1.0])])
    r = image.color_by_axis(s, 2, cmap=[(1, 0, 0), (0, 1, 0)], proj="sum").first()
    assert (r.r, r.g, r.b) == (0.0, 1.0, 0.0)
    for wrong in ({"proj": "min"}, {"cmap": "no such map"}):
        with pytest.raises(ValueError):
            image.color_by_axis(s, 2, **wrong)


def test_wavelet_peaks_at_a_tone():
    n, k, amplitude = 512, 20, 2.5
    scales = cwt.log_scales(n)
    w = np.abs(cwt.transform(np.array([tone(k, amplitude, n=n)]), scales, padding=None))[0, :, n // 2]
    best = int(w.argmax())
    assert w[best] == pytest.approx(amplitude, rel=1e-2) and cwt.scale_frequencies(scales, n)[best] == pytest.approx(k, rel=0.02)


@pytest.mark.parametrize("wavelet", ["morlet", ("morlet", 6.0), "bump", ("bump", 8.0, 2.0), "morse", (3.0, 20.0)])
def test_other_wavelets_peak_at_a_tone(wavelet):
    n, k, amplitude = 1024, 40, 1.7
    scales = cwt.log_scales(n, 48, wavelet)
    w = np.abs(cwt.transform(np.array([tone(k, amplitude, n=n)]), scales, padding=None, wavelet=wavelet))[0, :, n // 2]
    best = int(w.argmax())
    assert w[best] == pytest.approx(amplitude, rel=2e-2) and cwt.scale_frequencies(scales, n, wavelet)[best] == pytest.approx(k, rel=0.03)
    # A constant has no part in an analytic wavelet of mean 0; l2 is l1 times the root of the scale.
    assert np.abs(cwt.transform(np.full((1, n), 3.0), scales, padding=None, wavelet=wavelet)).max() < 1e-6
    two = np.abs(cwt.transform(np.array([tone(k, amplitude, n=n)]), scales, None, wavelet, "l2"))[0, :, n // 2]
    assert np.allclose(two, w * np.sqrt(scales))


def test_wavelet_formulas():
    """Gains by the published formulas, one frequency at a time."""
    for w in (3.0, 4.2, 5.0, 5.9, 13.4):
        assert cwt.Wavelet.of("morlet").gain(np.array([w]))[0] == pytest.approx(2 * (math.exp(-0.5 * (w - 13.4) ** 2) - math.exp(-0.5 * 13.4**2) * math.exp(-0.5 * w * w)))
        assert cwt.Wavelet.of("bump").gain(np.array([w]))[0] == pytest.approx(2 * math.exp(1 - 1 / (1 - (w - 5) ** 2)) if abs(w - 5) < 1 else 0)
        assert cwt.Wavelet.of((3, 60)).gain(np.array([w]))[0] == pytest.approx(2 * (math.e * 3 / 60) ** (60 / 3) * w**60 * math.exp(-(w**3)))


@pytest.mark.parametrize("wavelet", [None, "morlet", "bump", (3.0, 20.0)])
def test_scale_bounds_are_those_of_the_energies(wavelet):
    """Summed up directly, at the scales themselves, in frequency and in time."""
    chosen = cwt.Wavelet.of(wavelet)
    for frames in (16, 50):
        smallest, largest = cwt.scale_bounds(frames, wavelet, 0.6, 0.3)
        w = (np.arange(200_000) + 0.5) * (math.pi * 40 / 200_000)
        energy = chosen.gain(smallest * w) ** 2
        assert abs(energy[w <= math.pi].sum() / energy.sum() - 0.6) < 2e-3
        t, w = np.arange(-1500, 1500) * (largest / 50), (np.arange(2000) + 0.5) * (8 * chosen.peak / largest / 2000)
        wave = np.array([np.sum(chosen.gain(largest * w) * np.cos(w * x)) for x in t]) + 1j * np.array([np.sum(chosen.gain(largest * w) * np.sin(w * x)) for x in t])
        energy = np.abs(wave) ** 2
        assert abs(energy[np.abs(t) <= cwt.padded_length(frames) / 2].sum() / energy.sum() - 0.3) < 1e-2


def test_default_scales_exist_from_sixteen_frames_on(spark):
    for frames in (16, 20, 32, 64, 361):
        grid = cwt.piecewise_scales(frames)
        ratio = np.log2(grid[1:] / grid[:-1]) * 32
        assert len(grid[80:180]) > 20 and set(np.round(ratio, 6)) <= {1.0, 4.0} and (np.diff(ratio) > -1e-6).all()
    series = make(spark, [(0, 0, 0, tone(3, n=16))])
    row = cwt.cwt_features(series, 16, normalize_histogram=False, mean_centering=True).where("output = 'amp'").first()
    assert len(row["values"]) == 16 and max(row["values"]) > 0
    with pytest.raises(ValueError, match="shares"):
        cwt.scale_bounds(16, None, 1.5)


def read_by_hand(data, scales, low, high, banks, method):
    """amp, phase difference, power and z-score from whole transforms of all scales at once."""
    w = {c: cwt.transform(v, scales) for c, v in data.items()}
    at = low + cwt.bank_places(np.abs(w[0][:, low:high]), banks, method)
    read = {c: np.take_along_axis(x, at, axis=1) for c, x in w.items()}
    a = np.abs(w[1])
    return {
        "amp": np.abs(read[1]) / a.sum(axis=1, keepdims=True), "phase_difference": np.mod(np.angle(read[1]) - np.angle(read[0]), 2 * math.pi),
        "z_score": (np.abs(read[1]) / a.sum(axis=1, keepdims=True) - a.mean(axis=1, keepdims=True)) / a.std(axis=1, ddof=1, keepdims=True), "freq": at.astype(float),
    }


@pytest.mark.parametrize("method,banks", [("max_pool", 1), ("max_pool", 5), ("sort", 4)])
def test_scales_in_runs_equal_all_at_once(monkeypatch, method, banks):
    """What is held is bounded, whatever the number of scales, and the outputs are the same."""
    rng = np.random.default_rng(banks)
    data = {c: rng.normal(size=(3, 50)) for c in range(2)}
    scales = cwt.piecewise_scales(50)
    want = read_by_hand(data, scales, 30, 90, banks, method)
    plain, sizes = cwt.Padded.at, []
    monkeypatch.setattr(cwt.Padded, "at", lambda self, s: (sizes.append(self.spectrum.size * len(s)), plain(self, s))[1])
    for held in (8_000_000, 2000, 1):
        monkeypatch.setattr(cwt, "HELD", held)
        sizes.clear()
        got = cwt.query_block(data, scales, 30, 90, banks, True, 0, {0: ["amp"], 1: list(want)}, method, None, "reflect", cwt.Wavelet.of(None), "l1")[1]
        assert max(sizes) <= max(held, 3 * 128)
        for o, v in want.items():
            assert np.abs(got[o] - v).max() < 1e-9, o


def test_wavelet_banks_agree_for_one_bank(spark):
    rng = np.random.default_rng(1)
    s = make(spark, [(c, x, 0, rng.normal(size=T).tolist()) for c in range(2) for x in range(5)] + [(0, 9, 9, None)])
    options = {"frames": T, "min_scale": 3, "max_scale": 40, "channel_outputs": {0: ["amp", "freq"], 1: ["amp", "phase_difference", "z_score"]}}
    order = ["channel", "output", "bank", "x", "y"]
    a = cwt.cwt_features(s, **options).orderBy(order).toPandas()
    b = cwt.cwt_features(s, bank_method="sort", blocks=3, **options).orderBy(order).toPandas()
    assert len(a) == 25 and np.allclose(np.stack(a["values"]), np.stack(b["values"]))
    series = cwt.as_series(cwt.cwt_features(s, **options), [("1", "amp", 0), ("0", "amp", 0)])
    assert series.select("c").distinct().count() == 2


def test_wavelet_arguments(spark):
    s = make(spark, [(0, 0, 0, tone(3))])
    for wrong in (
        {"bank_method": "mean"}, {"carrier_channel": 1, "channel_outputs": {0: ["amp"]}}, {"channel_outputs": {0: ["loudness"]}},
        {"bank_method": "sort", "num_filter_banks": 50}, {"num_filter_banks": 0}, {"wavelet": "haar"}, {"wavelet": ("bump", 5.0)}, {"norm": "l3"},
    ):
        with pytest.raises(ValueError):
            cwt.cwt_features(s, T, 0, 10, **wrong)
    with pytest.warns(UserWarning):
        cwt.cwt_features(s, T, 0, 10, sampling=fft.Sampling(2, T))


def test_feature_arguments(spark):
    s = make(spark, [(0, 0, 0, tone(3))])
    with pytest.raises(ValueError):
        fft.spectrum(s, ["loudness"])
    with pytest.raises(ValueError):
        fft.peak_query(s, 5, 0, max_bin=5)
    with pytest.warns(UserWarning, match="full_amplitude"):
        fft.peak_query(s, 1, 0, ["z_score"], peak_method="full_amplitude")
    with pytest.raises(ValueError):
        table.channel_names(["a"], 2)


def test_tracks_of_missing_labels(spark):
    s = make(spark, [(0, 0, 0, [1.0, 3.0]), (0, 0, 1, [2.0, 5.0])])
    moving = labels(spark, [("i", 0, 0, 0, 2), ("i", 0, 0, 1, 2), ("i", 1, 0, 0, 0), ("i", 1, 0, 1, 2)], "image_id string, t int, x int, y int, label bigint")
    got = {(r.label, r.t): (r.mean, r.sd) for r in cells.tracks(s, moving).collect()}
    assert got[2, 1] == (5.0, 0.0) and got[0, 1] == (3.0, 0.0) and got[1, 0] == (0.0, 0.0) and got[2, 0][0] == 1.5
    static = moving.where("t = 0").drop("t")
    assert {r.mean for r in cells.tracks(s, static).where("label = 2").collect()} == {1.5, 4.0}


def test_long_form_names(spark):
    columns = ["minD_queried_normalized_amplitude_mean", "channel_0_levels_mean", "a_argmaxes_sd___thresh_queried_z_score_at_0.02"]
    wide = spark.createDataFrame([(1, "f", "m", 1.0, 2.0, 3.0)], "mask_index bigint, image_filename string, mask_filename string, " + ", ".join(f"`{c}` double" for c in columns))
    got = {(r.channel, r.feature, r.stat, r.mask_type) for r in table.reshape_to_longform(wide, ["minD", "channel_0", "a"]).collect()}
    assert got == {("minD", "queried_normalized_amplitude", "mean", "all"), ("channel_0", "levels", "mean", "all"), ("a", "argmaxes", "sd", "thresh_queried_z_score_at_0.02")}
    compat = {(r.channel, r.feature, r.mask_type) for r in table.reshape_to_longform(wide, compat=True).collect()}
    assert ("normalized", "amplitude", "all") in compat and ("0", "levels", "all") in compat and ("a", "argmaxes", "__thresh_queried_z_score_at_0.02") in compat


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16, np.int32, np.float32])
def test_tiff_round_trip(dtype):
    rng = np.random.default_rng(2)
    for shape in ((3, 2, 4, 5), (3, 4, 5), (4, 5), (1, 1, 3, 3)):
        stack = (rng.random(shape) * 200).astype(dtype)
        back = tiff.decode_tiff(tiff.encode_tiff(stack))
        assert back.dtype == dtype and np.array_equal(back.reshape(-1), stack.reshape(-1))
    assert tiff.decode_tiff(tiff.encode_tiff(np.zeros((3, 2, 4, 5), dtype))).shape == (3, 2, 4, 5)


def test_folder(spark, tmp_path):
    images, masks = tmp_path / "images", tmp_path / "masks"
    images.mkdir()
    masks.mkdir()
    stack = np.zeros((T, 2, 2, 3), np.float32)
    for c in range(2):
        for x in range(2):
            for y in range(3):
                stack[:, c, x, y] = tone(4, 1 + x + y, 0.5 * c)
    mask = np.array([[0, 1, 1], [2, 2, 2]], np.uint16)
    for name in ("a.v1.tif", "b.tif"):
        (images / name).write_bytes(tiff.encode_tiff(stack))
        (masks / tiff.mask_name(name)).write_bytes(tiff.encode_tiff(mask))
    (images / "no_mask.tif").write_bytes(tiff.encode_tiff(stack))
    (images / "broken.tif").write_bytes(b"II*\0 nothing")
    (masks / "broken_masks.tif").write_bytes(tiff.encode_tiff(mask))
    (images / "notes.txt").write_text("not an image")
    cells_table, problems = pipeline.process_folder(
        spark, str(images), str(masks), 2, cutoff_frequency_bin=1, carrier_index=1, channel_names=["minE", "minD"],
        threshold_cutoffs={"normalized_amplitude": 0.02}, features=["z_score", "normalized_amplitude", "phase"], normalize_histogram=False,
    )
    rows = cells_table.collect()
    assert {(r.image_filename, r.mask_filename, r.mask_index) for r in rows} == {(f"{s}.tif", f"{s}_masks.tif", k) for s in ("a.v1", "b") for k in range(3)}
    name = "minD_queried_normalized_amplitude_mean___thresh_queried_normalized_amplitude_at_0.02"
    assert all(r[name] == pytest.approx(1.0, rel=1e-4) for r in rows if r.mask_index) and "minE_levels_mean" in cells_table.columns
    assert all(r["minE_argmaxes_mean"] == 4 for r in rows if r.mask_index)
    assert {r.image_filename for r in problems.collect()} == {"no_mask.tif", "broken.tif"}


def test_unknown_extension_and_nd2():
    with pytest.raises(ValueError):
        tiff.decode("a.png", b"")
    with pytest.raises(ValueError, match="ND2"):
        tiff.decode("a.nd2", b"")


def test_frames_as_a_stream(spark, tmp_path):
    schema = "image_id string, t int, c int, width int, pixels array<double>"
    rows = spark.createDataFrame([("i", t, 0, 2, [1.0 * t, 2.0, 3.0, 4.0 + t]) for t in range(3)], schema)
    rows.write.parquet(str(tmp_path / "in"))
    stream = frames.normalize_frame_rows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("frames").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {r.t: r.pixels for r in spark.table("frames").collect()}
    for t in range(3):
        v = np.array([1.0 * t, 2.0, 3.0, 4.0 + t])
        assert got[t] == pytest.approx(((v - v.mean()) / v.std(ddof=1)).tolist())
    small = frames.downsample_frame_rows(rows, 2, 2, 0.5).where("t = 0").first()
    assert small.pixels == [2.25] and small.width == 1


def test_entry_works(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


# --- TIFF as other programs write it


def packed_lzw(raw):
    """TIFF's LZW: codes of 9 to 12 bits, the highest bit first, the width growing one code early."""
    table, width, codes, w = {bytes([i]): i for i in range(256)}, 9, [(256, 9)], b""
    n = 258
    for byte in raw:
        if w + bytes([byte]) in table:
            w += bytes([byte])
            continue
        codes.append((table[w], width))
        table[w + bytes([byte])] = n
        n += 1
        width = 9 + sum(n > k for k in (511, 1023, 2047))
        w = bytes([byte])
        if n == 4094:
            codes.append((256, width))
            table, width, n = {bytes([i]): i for i in range(256)}, 9, 258
    codes += [(table[w], width)] if w else []
    bits = "".join(f"{c:0{k}b}" for c, k in codes)
    n += bool(w)
    bits += f"{257:0{9 + sum(n > k for k in (511, 1023, 2047))}b}"
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def packed_bits(raw):
    out = bytearray()
    for part in (raw[i : i + 100] for i in range(0, len(raw), 100)):
        out += bytes([257 - len(part), part[0]]) if len(part) > 1 and len(set(part)) == 1 else bytes([len(part) - 1]) + part
    return bytes(out) + b"\x80"


def tiff_file(pages, order="<", big=False, packing=1, tile=None, rows=None, predictor=1, description=None, extra=b""):
    """A file of 2-dimensional pages, in strips of `rows` rows or in tiles."""
    pack = {1: bytes, 5: packed_lzw, 8: zlib.compress, 32773: packed_bits}[packing]
    number, entry, offset, wide = ("Q", 20, "Q", 8) if big else ("H", 12, "I", 4)
    out = bytearray(struct.pack(f"{order}2sH", b"II" if order == "<" else b"MM", 43 if big else 42))
    out += struct.pack(f"{order}HH", 8, 0) if big else b""
    link = len(out)
    out += struct.pack(f"{order}{offset}", 0)
    for k, page in enumerate(pages):
        x, y = page.shape
        height, width = tile or (rows or x, y)
        parts = []
        for top in range(0, x, height):
            for left in range(0, y, width):
                part = page[top : top + height, left : left + width]
                if tile:
                    part = np.pad(part, ((0, height - part.shape[0]), (0, width - part.shape[1])))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), part.dtype))
                parts.append(pack(np.ascontiguousarray(part).astype(page.dtype.newbyteorder(order)).tobytes()))
        at = []
        for part in parts:
            at.append(len(out))
            out += part
        out += extra if k == 0 else b""
        place = (324, 325) if tile else (273, 279)
        tags = {256: (4, [y]), 257: (4, [x]), 258: (3, [page.itemsize * 8]), 259: (3, [packing]), 277: (3, [1]), 317: (3, [predictor]), 339: (3, [{"u": 1, "i": 2, "f": 3}[page.dtype.kind]]),
                place[0]: (4, at), place[1]: (4, [len(p) for p in parts])}
        tags |= {322: (3, [width]), 323: (3, [height])} if tile else {278: (4, [height])}
        if description and k == 0:
            tags[270] = (2, description.encode() + b"\0")
        entries = b""
        for tag, (type_, values) in sorted(tags.items()):
            raw = bytes(values) if type_ == 2 else struct.pack(f"{order}{len(values)}{'H' if type_ == 3 else 'I'}", *values)
            if len(raw) > wide:
                spot = len(out)
                out += raw
                raw = struct.pack(f"{order}{offset}", spot)
            entries += struct.pack(f"{order}HH{offset}", tag, type_, len(values)) + raw.ljust(wide, b"\0")
        struct.pack_into(f"{order}{offset}", out, link, len(out))
        out += struct.pack(f"{order}{number}", len(tags)) + entries
        link = len(out)
        out += struct.pack(f"{order}{offset}", 0)
    return bytes(out)


KINDS = [dict(packing=p, **layout) for p in (1, 5, 8, 32773) for layout in ({}, {"rows": 5}, {"tile": (16, 16)}, {"order": ">", "rows": 7}, {"big": True, "tile": (16, 32)}, {"predictor": 2, "rows": 4}, {"big": True, "order": ">", "predictor": 2})]


@pytest.mark.parametrize("options", KINDS, ids=str)
def test_tiff_of_each_kind(options):
    rng = np.random.default_rng(2)
    pages = [rng.integers(0, 50, (37, 41)).astype(np.uint16).cumsum(axis=1).astype(np.uint16) for _ in range(3)]
    pages[1][:] = 7
    got = tiff.decode_tiff(tiff_file(pages, **options))
    assert got.shape == (3, 37, 41) and (got == np.stack(pages)).all()


def test_long_lzw():
    rng = np.random.default_rng(3)
    for raw in (bytes(rng.integers(0, 256, 60_000, dtype=np.uint8)), bytes(200_000), bytes(rng.integers(0, 3, 60_000, dtype=np.uint8)), b""):
        assert tiff.unpacked_lzw(packed_lzw(raw)) == raw and tiff.unpacked_bits(packed_bits(raw)) == raw


def test_tiff_arrangements():
    pages = [np.full((2, 3), k, np.uint8) for k in range(6)]
    imagej = tiff.decode_tiff(tiff_file(pages, description="ImageJ=1.53\nimages=6\nchannels=2\nframes=3\n"))
    assert imagej.shape == (3, 2, 2, 3) and imagej[1, 1, 0, 0] == 3
    rest = np.stack(pages[1:]).tobytes()
    single = tiff.decode_tiff(tiff_file(pages[:1], description="ImageJ=1.53\nimages=6\nslices=6\n", extra=rest))
    assert single.shape == (6, 2, 3) and single[:, 0, 0].tolist() == [0, 1, 2, 3, 4, 5]
    for order, expect in (("XYCZT", 3), ("XYZTC", 4), ("XYTCZ", 4)):
        xml = f'<?xml version="1.0"?><OME><Image><Pixels ID="P" DimensionOrder="{order}" SizeX="3" SizeY="2" SizeC="2" SizeZ="1" SizeT="3" Type="uint8"/></Image></OME>'
        got = tiff.decode_tiff(tiff_file(pages, description=xml))
        assert got.shape == (3, 2, 2, 3) and got[1, 1, 0, 0] == expect
    with pytest.raises(ValueError, match="slices and frames"):
        tiff.decode_tiff(tiff_file(pages, description="ImageJ=1\nimages=6\nslices=2\nframes=3"))
    with pytest.raises(ValueError, match="not a TIFF"):
        tiff.decode_tiff(b"PNG")


def test_mask_with_frames_is_reported(spark):
    still, moving = np.array([[1, 1, 2]], np.uint16), np.ones((2, 1, 3), np.uint16)
    stack = np.zeros((T, 1, 1, 3), np.float32)
    stack[:, 0, 0] = np.array(tone(3))[:, None]
    kind = "name string, content binary"
    files = spark.createDataFrame([(f"{n}.tif", tiff.encode_tiff(stack)) for n in "ab"], kind)
    masks = spark.createDataFrame([("a_masks.tif", tiff.encode_tiff(still)), ("b_masks.tif", tiff.encode_tiff(moving))], kind)
    table, problems = pipeline.process_files(files, masks, 1, normalize_histogram=False)
    assert {(r.image_filename, r.mask_index) for r in table.collect()} == {("a.tif", k) for k in range(3)}
    assert [tuple(r) for r in problems.collect()] == [("b.tif", "a mask of 2 frames; one is expected")]


def test_statistics_of_many_images_are_joined_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [("abc"[k % 3], k % 2, k // 6, k % 7, rng.normal(size=4).tolist()) for k in range(84)]
    s = spark.createDataFrame(rows, "image_id string, c int, x int, y int, values array<double>")
    read = lambda df: sorted((r.image_id, r.c, r.x, r.y, *np.round(r["values"], 9)) for r in df.collect())
    sent = [read(f(s)) for f in (image.normalize_frames, image.minmax_norm)]
    monkeypatch.setattr(image, "SENT_NUMBERS", 0)
    for f, want in zip((image.normalize_frames, image.minmax_norm), sent, strict=True):
        out = f(s)
        assert read(out) == want and "_part" not in out.columns


def ragged(spark):
    """Series of several lengths, with null elements, NaN, null series and large means."""
    rng = np.random.default_rng(6)
    rows = []
    for x in range(7):
        for y in range(5):
            values = [None if rng.random() < 0.1 else 1e9 + float(v) for v in rng.normal(size=4 + (x == 3))]
            rows.append(("a" if x else "b", y % 2, x, y, values))
    rows += [("n", 0, 0, 0, [1.0, math.nan]), ("n", 0, 0, 1, [3.0, 4.0]), ("z", 0, 0, 0, None), ("one", 0, 0, 0, [5.0, None])]
    return rows, spark.createDataFrame(rows, SERIES).repartition(5)


@pytest.mark.parametrize("held", [4_000_000, 1])
def test_merged_moments_equal_those_of_all(spark, monkeypatch, held):
    monkeypatch.setattr(moments, "HELD_NUMBERS", held)
    rows, series = ragged(spark)
    each = {}
    for i, c, _, _, values in rows:
        for t, v in enumerate(values or ()):
            if v is not None:
                each.setdefault((i, c, t), []).append(v)
    got = {(r.image_id, r.c, r.t): r for r in moments.moments(series, ["image_id", "c"]).collect()}
    assert set(got) == set(each)
    for k, v in each.items():
        n, mean, m2 = len(v), sum(v) / len(v), sum((x - np.mean(v)) ** 2 for x in v)
        assert got[k].n == n and (math.isnan(mean) or abs(got[k].mean - mean) < 1e-6 and abs(got[k].m2 - m2) < 1e-6) and math.isnan(got[k].mean) == math.isnan(mean)
    means = {(r.image_id, r.c): r["values"] for r in moments.mean_series(series, ["image_id", "c"]).collect()}
    for (i, c), values in means.items():
        for t, v in enumerate(values):
            want = each.get((i, c, t))
            assert (v is None) == (want is None) and (v is None or abs(v - np.mean(want)) < 1e-6 or math.isnan(v) and math.isnan(np.mean(want)))
    assert set(means) == {k[:2] for k in each}


def test_statistics_are_exchanged_by_task_not_by_pixel(spark):
    """What is exchanged has a row for each task and frame, however many pixels there are."""
    series = spark.range(4000, numPartitions=3).selectExpr("'i' as image_id", "0 as c", "cast(id as int) as x", "0 as y", "array(1.0D, cast(id as double), 2.0D) as values")
    parts = moments.moments(series, ["image_id", "c"])
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.index("Exchange") < plan.index("MapInArrow")
    assert [(r.t, r.n, r.mean) for r in sorted(parts.collect())] == [(0, 4000.0, 1.0), (1, 4000.0, 1999.5), (2, 4000.0, 2.0)]


def test_runs_of_moving_labels(spark):
    rows = [("i", t, 0, 0, lab) for t, lab in [(0, 3), (1, 3), (2, 0), (3, 0), (5, 0), (6, 3)]] + [("i", 2, 0, 1, 9)]
    got = cells.track_runs(spark.createDataFrame(rows, "image_id string, t int, x int, y int, label bigint")).collect()
    assert {(r.x, r.y): [tuple(x) for x in r.runs] for r in got} == {(0, 0): [(0, 2, 3), (2, 2, 0), (5, 1, 0), (6, 1, 3)], (0, 1): [(2, 1, 9)]}


def test_moving_labels_meet_series_once_a_pixel(spark):
    rng = np.random.default_rng(8)
    series = [("i", c, 0, y, rng.normal(size=9).tolist()) for c in range(2) for y in range(6)]
    labels = [("i", t, 0, y, int(rng.integers(0, 4))) for t in range(12) for y in range(6) if rng.random() < 0.8]
    moving = spark.createDataFrame(labels, "image_id string, t int, x int, y int, label bigint")
    got = {(r.label, r.c, r.t): (r.mean, r.sd) for r in cells.tracks(spark.createDataFrame(series, SERIES), moving).collect()}
    assert len(got) == 4 * 2 * 9
    of = {(t, y): lab for _, t, _, y, lab in labels}
    for (lab, c, t), (mean, sd) in got.items():
        v = [s[4][t] for s in series if s[1] == c and of.get((t, s[3])) == lab]
        assert abs(mean - (np.mean(v) if v else 0)) < 1e-9 and abs(sd - (math.sqrt(np.var(v) * len(v) / (max(len(v) - 1, 1) + 1e-6)) if v else 0)) < 1e-9


def test_many_labels_are_counted_out_in_runs(spark, monkeypatch):
    monkeypatch.setattr(cells, "LABELS", 7)
    tops = spark.createDataFrame([("a", 20), ("b", 0), ("c", 6), ("d", 7)], "image_id string, top bigint")
    rows = cells.counted_out(tops).collect()
    assert sorted((r.image_id, r.label) for r in rows) == [(i, k) for i, n in (("a", 20), ("b", 0), ("c", 6), ("d", 7)) for k in range(n + 1)]


def test_features_are_computed_once(spark):
    """Cells without pixels do not cost a second transform."""
    series = make(spark, [(c, 0, y, tone(3 + c)) for c in range(2) for y in range(4)])
    masks = labels(spark, [("i", "all", 0, y, y % 2) for y in range(4)])
    wide = pipeline.process_images(series, masks, 2, 1, normalize_histogram=False)
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_windows_are_the_same_in_small_parts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [("a", 0, x, y, rng.normal(size=3).tolist()) for x in range(9) for y in range(7)]
    s = spark.createDataFrame(rows, "image_id string, c int, x int, y int, values array<double>").repartition(4)
    read = lambda df: sorted((r.x, r.y, *np.round(r["values"], 9)) for r in df.collect())
    want = read(image.downsample_image(s, 9, 7, (2, 3)))
    monkeypatch.setattr(moments, "HELD_NUMBERS", 1)
    assert read(image.downsample_image(s, 9, 7, (2, 3))) == want and len(want) == 6


def test_named_color_maps():
    near = lambda name, u: [round(v, 2) for v in image.named_map(name)(u)]
    assert near("viridis", 0.0) == [0.28, 0.01, 0.33] and near("viridis", 1.0) == pytest.approx([0.99, 0.91, 0.14], abs=0.03)
    assert near("plasma", 1.0) == pytest.approx([0.94, 0.98, 0.13], abs=0.05) and near("gray", 0.5) == [0.5, 0.5, 0.5]


def test_frames_are_resampled_as_images_are(spark):
    rng = np.random.default_rng(7)
    frame = rng.normal(size=(11, 6))
    rows = spark.createDataFrame([("i", 0, 0, 6, frame.ravel().tolist())], "image_id string, t int, c int, width int, pixels array<double>")
    got = frames.downsample_frame_rows(rows, 11, 6, 0.4).first()
    h, w = image.target_size(11, 0.4), image.target_size(6, 0.4)
    want = [[frame[i * 11 // h : -(-(i + 1) * 11 // h), j * 6 // w : -(-(j + 1) * 6 // w)].mean() for j in range(w)] for i in range(h)]
    assert got.width == w and got.pixels == pytest.approx(np.array(want).ravel().tolist())


@pytest.mark.parametrize("window", [2, 7, 16])
def test_sliding_coefficients_equal_those_of_the_window(window):
    rng = np.random.default_rng(window)
    now, values = spectra.Sliding(window), []
    for t in range(5 * window):
        values.append(1e3 + rng.normal())
        now.add(t + 3, values[-1])
        if t + 1 >= window:
            want = np.fft.rfft(np.array(values[-window:]) - np.mean(values[-window:]))
            assert np.abs(now.features(["full_amplitude"])["full_amplitude"] - np.abs(want)).max() < 1e-7
    now.add(4, 0.0)
    now.add(5 * window + 3, None)
    assert now.late == 2 and now.held == window
    # A gap begins anew; NaN stays in the window as long as it is in it.
    now.add(5 * window + 9, math.nan)
    assert now.held == 1
    for t in range(window):
        now.add(5 * window + 10 + t, float(t))
    assert now.held == window and np.abs(now.x - np.fft.rfft(np.arange(float(window)))).max() < 1e-9


def test_spectra_of_a_stream_go_on_after_a_restart(spark, tmp_path):
    """Frames that come in two runs, with late, null and missing ones, against the batch spectrum of the last window."""
    rng = np.random.default_rng(11)
    values = {(c, y): rng.normal(size=20) for c in range(2) for y in range(3)}
    rows = [("i", t, c, 0, y, None if (c, y, t) == (1, 2, 19) else float(v[t])) for (c, y), v in values.items() for t in range(20) if (c, y, t) != (0, 1, 13)]
    provider = spark.conf.get(spectra.PROVIDER)
    for first, last in ((0, 11), (9, 20)):
        spark.createDataFrame([r for r in rows if first <= r[1] < last], spectra.FRAMES).coalesce(2).write.mode("append").parquet(f"{tmp_path}/frames")
        stream = spark.readStream.schema(spectra.FRAMES).parquet(f"{tmp_path}/frames")
        spectra.follow_spectra(stream, f"{tmp_path}/out", 8, ["full_amplitude", "phase"])
    assert spark.conf.get(spectra.PROVIDER) == provider
    got = {(r.c, r.y): r for r in spectra.spectra_of(spark, f"{tmp_path}/out").collect()}
    assert set(got) == set(values)
    for (c, y), r in got.items():
        end = 19 if (c, y) == (1, 2) else 20
        if (c, y) == (0, 1):
            assert r.full_amplitude is None and r.t == 19
            continue
        want = fft.spectra(values[c, y][None, end - 8 : end], ["full_amplitude", "phase"])
        assert r.t == end - 1 and r.late == 2 + (end == 19)
        assert np.abs(np.array(r.full_amplitude) - want["full_amplitude"][0]).max() < 1e-9
        assert np.abs(np.exp(1j * np.array(r.phase[1:4])) - np.exp(1j * want["phase"][0, 1:4])).max() < 1e-9
    with pytest.raises(ValueError, match="two frames"):
        spectra.spectra_stream(stream, 1)
