"""Continuous wavelet features of pixels, read along a carrier channel's scales.

The transform of an analytic wavelet is evaluated in the frequency domain: W(s, t) is the inverse
transform of X(w) psi(s w), where psi(w) = 0 for w <= 0. The default is the generalized Morse
wavelet, psi(w) = 2 (e gamma / beta)^(beta / gamma) w^beta exp(-w^gamma) (Olhede and Walden 2002;
Lilly and Olhede 2009); Morlet and bump wavelets can be chosen (see Wavelet).
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrid.operators.fft import Sampling
from wavegrid.operators.image import downsample_image, mean_center, normalize_frames

OUTPUTS = ("amp", "freq", "phase", "phase_difference", "z_score")
GAMMA, BETA = 3.0, 60.0


@dataclass(frozen=True)
class Wavelet:
    """An analytic wavelet, by its gain over angular frequency, whose largest value is 2 (the amplitude of a tone is its own).

    `morse` (gamma, beta): w^beta exp(-w^gamma); `morlet` (mu): exp(-(w - mu)^2 / 2), less what
    makes its mean 0; `bump` (mu, s): exp(1 - 1 / (1 - ((w - mu) / s)^2)) within s of mu.
    """

    kind: str = "morse"
    parameters: tuple[float, ...] = ()

    DEFAULTS: ClassVar[dict[str, tuple[float, ...]]] = {"morse": (GAMMA, BETA), "morlet": (13.4,), "bump": (5.0, 1.0)}

    @classmethod
    def of(cls, given) -> Wavelet:
        """From a Wavelet, a kind, (kind, parameters...), (gamma, beta) or nothing."""
        if isinstance(given, Wavelet):
            return given
        kind, *parameters = ("morse",) if given is None else (given,) if isinstance(given, str) else given if isinstance(given[0], str) else ("morse", *given)
        if kind not in cls.DEFAULTS:
            raise ValueError(f"unknown wavelet {kind!r}; choose from {tuple(cls.DEFAULTS)}")
        if parameters and len(parameters) != len(cls.DEFAULTS[kind]):
            raise ValueError(f"a {kind} wavelet has {len(cls.DEFAULTS[kind])} parameters")
        return cls(kind, tuple(map(float, parameters or cls.DEFAULTS[kind])))

    @property
    def peak(self) -> float:
        """The angular frequency of the largest gain."""
        if self.kind == "morse":
            gamma, beta = self.parameters
            return (beta / gamma) ** (1 / gamma)
        return self.parameters[0]

    def gain(self, w: np.ndarray) -> np.ndarray:
        """The gain at w > 0."""
        if self.kind == "morse":
            gamma, beta = self.parameters
            return 2 * np.exp(beta / gamma * (1 + math.log(gamma / beta)) + beta * np.log(w) - w**gamma)
        if self.kind == "morlet":
            (mu,) = self.parameters
            return 2 * (np.exp(-((w - mu) ** 2) / 2) - np.exp(-(mu**2 + w**2) / 2))
        mu, s = self.parameters
        inside = np.abs(w - mu) < s
        out = np.zeros_like(w)
        out[inside] = 2 * np.exp(1 - 1 / (1 - ((w[inside] - mu) / s) ** 2))
        return out


def log_scales(frames: int, voices: int = 32, wavelet=None) -> np.ndarray:
    """Scales from the highest frequency to two periods of the series, `voices` to an octave."""
    peak = Wavelet.of(wavelet).peak
    smallest, largest = peak / math.pi, peak * frames / (4 * math.pi)
    n = max(1, int(math.floor(voices * math.log2(max(largest / smallest, 1.0)))) + 1)
    return smallest * 2 ** (np.arange(n) / voices)


def padded_length(frames: int) -> int:
    """Samples of a series with its padding: a power of two, about twice as many."""
    return 1 << (2 * frames - 1).bit_length() if frames > 1 else frames


#: Points at which a wavelet's energy is summed up, and the angular frequencies that they reach, as multiples of its peak's.
ENERGY_POINTS, ENERGY_REACH = 1 << 14, 16


def energy_below(wavelet: Wavelet, w: float) -> float:
    """The share of the wavelet's energy at angular frequencies up to w."""
    at = (np.arange(ENERGY_POINTS) + 0.5) * (ENERGY_REACH * wavelet.peak / ENERGY_POINTS)
    energy = wavelet.gain(at) ** 2
    return float(energy[at <= w].sum() / energy.sum())


def energy_within(wavelet: Wavelet, half: float) -> float:
    """The share of the wavelet's energy at times up to `half` from its centre (at scale 1)."""
    step = 2 * math.pi / (2 * ENERGY_REACH * wavelet.peak)
    w = 2 * math.pi * np.fft.fftfreq(ENERGY_POINTS, step)
    gain = np.zeros(ENERGY_POINTS)
    gain[w > 0] = wavelet.gain(w[w > 0])
    energy = np.abs(np.fft.ifft(gain)) ** 2
    t = np.abs(np.fft.fftfreq(ENERGY_POINTS, 1 / ENERGY_POINTS)) * step
    return float(energy[t <= half].sum() / energy.sum())


def bisected(test, low: float, high: float) -> float:
    """The largest value, to a part in 2^40, for which test holds; it holds at low and, from some value on, no more."""
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if test(middle) else (low, middle)
    return low


def scale_bounds(frames: int, wavelet=None, nyquist_share: float = 0.5, time_share: float = 0.25) -> tuple[float, float]:
    """The smallest scale with at least `nyquist_share` of its wavelet's energy below the highest frequency, and the largest with at least
    `time_share` of its energy within the padded series.

    A scale s stretches the wavelet by s in time and narrows it by s in frequency, so both are
    found from the energies at scale 1.
    """
    chosen = Wavelet.of(wavelet)
    if not 0 < nyquist_share < 1 or not 0 < time_share < 1:
        raise ValueError("shares of energy are between 0 and 1")
    reach = ENERGY_REACH * chosen.peak
    below = bisected(lambda w: energy_below(chosen, w) < nyquist_share, 0.0, reach)
    half = bisected(lambda t: energy_within(chosen, t) < time_share, 0.0, ENERGY_POINTS * math.pi / reach)
    smallest, largest = below / math.pi, padded_length(frames) / 2 / half
    return smallest, max(smallest, largest)


def piecewise_scales(frames: int, voices: int = 32, wavelet=None, thinned: float = 1.0, thinning: int = 4, **shares) -> np.ndarray:
    """Scales between scale_bounds(), `voices` to an octave; in the largest `thinned` octaves every `thinning`-th of them.

    Neighbours among the largest scales differ by less than the series can tell apart.
    """
    smallest, largest = scale_bounds(frames, wavelet, **shares)
    n = int(math.floor(voices * math.log2(largest / smallest) + 1e-9)) + 1
    k = np.arange(n)
    turn = max(0, n - 1 - int(round(thinned * voices)))
    return smallest * 2 ** (k[(k <= turn) | ((k - turn) % thinning == 0)] / voices)


def scale_frequencies(scales: np.ndarray, fs: float, wavelet=None) -> np.ndarray:
    """The frequency at which each scale's wavelet peaks."""
    return Wavelet.of(wavelet).peak / np.asarray(scales) / (2 * math.pi) * fs


def wavelet_bank(scales: np.ndarray, n: int, wavelet=None, norm: str = "l1") -> np.ndarray:
    """The gain of each scale at the transform's frequencies, 0 for w <= 0; with norm `l2` times the root of the scale."""
    if norm not in ("l1", "l2"):
        raise ValueError("norm must be 'l1' or 'l2'")
    w = 2 * math.pi * np.fft.fftfreq(n)
    if n % 2 == 0:
        w[n // 2] = math.pi
    scales = np.asarray(scales, float)
    x = scales[:, None] * w[None, :]
    out = np.zeros_like(x)
    on = x > 0
    out[on] = Wavelet.of(wavelet).gain(x[on])
    return out * np.sqrt(scales)[:, None] if norm == "l2" else out


class Padded:
    """The spectrum of the rows of a matrix, padded; coefficients of any scales are made from it."""

    def __init__(self, values: np.ndarray, padding: str | None = "reflect", wavelet=None, norm: str = "l1"):
        self.n, self.left, self.wavelet, self.norm = values.shape[1], 0, wavelet, norm
        if padding is not None and self.n > 1:
            total = padded_length(self.n)
            self.left = (total - self.n) // 2
            values = np.pad(values, ((0, 0), (self.left, total - self.n - self.left)), mode=padding)
        self.spectrum = np.fft.fft(values, axis=1)

    def at(self, scales: np.ndarray) -> np.ndarray:
        """(rows, scales, frames) of complex coefficients."""
        bank = wavelet_bank(scales, self.spectrum.shape[1], self.wavelet, self.norm)
        return np.fft.ifft(self.spectrum[:, None, :] * bank[None, :, :], axis=2)[:, :, self.left : self.left + self.n]


def transform(values: np.ndarray, scales: np.ndarray, padding: str | None = "reflect", wavelet=None, norm: str = "l1") -> np.ndarray:
    """(rows, scales, frames) of complex coefficients."""
    return Padded(values, padding, wavelet, norm).at(scales)


def bank_places(amp: np.ndarray, banks: int, method: str) -> np.ndarray:
    """(rows, banks, frames): the scale that each bank reads, of carrier amplitudes (rows, scales, frames).

    max_pool: the first largest within each of `banks` adaptive windows over the scales;
    sort: the scales of the largest amplitudes, in falling order, the first of equal ones before.
    """
    s = amp.shape[1]
    if method == "max_pool":
        ends = [(i * s // banks, -(-(i + 1) * s // banks)) for i in range(banks)]
        return np.stack([a + amp[:, a:b].argmax(axis=1) for a, b in ends], axis=1)
    return np.argsort(-amp, axis=1, kind="stable")[:, :banks]


def checked_outputs(channel_outputs: Mapping[int, Sequence[str]], carrier: int, banks: int, slice_size: int, method: str) -> None:
    if method not in ("max_pool", "sort"):
        raise ValueError("bank_method must be 'max_pool' or 'sort'")
    if carrier not in channel_outputs:
        raise ValueError("the carrier must be among the channels of channel_outputs")
    unknown = sorted({o for os in channel_outputs.values() for o in os if o not in OUTPUTS})
    if unknown:
        raise ValueError(f"unknown outputs {unknown}; choose from {OUTPUTS}")
    if not 1 <= banks:
        raise ValueError("there must be at least one filter bank")
    if slice_size < 1 or method == "sort" and banks > slice_size:
        raise ValueError("there are fewer scales between min_scale and max_scale than filter banks")


#: Complex numbers of coefficients that are held at once, as far as one scale has no more.
HELD = 8_000_000


def scale_runs(begin: int, end: int, numbers: int) -> list[tuple[int, int]]:
    """Runs of scales whose coefficients, `numbers` for each scale, are held at once."""
    step = max(1, HELD // max(1, numbers))
    return [(k, min(end, k + step)) for k in range(begin, end, step)]


def carrier_places(carrier: Padded, scales: np.ndarray, low: int, high: int, banks: int, method: str, runs: Sequence[tuple[int, int]]) -> np.ndarray:
    """bank_places() of the carrier's amplitudes between two scales, from one run of scales after the other."""
    best, top = None, None
    ends = [(low + i * (high - low) // banks, low - (-(i + 1) * (high - low) // banks)) for i in range(banks)]
    for a, b in runs:
        amp = np.abs(carrier.at(scales[a:b]))
        if method == "sort":
            # Scales seen before come first, so that of equal amplitudes the smaller scale stays ahead.
            every = amp if top is None else np.concatenate([top, amp], axis=1)
            number = np.broadcast_to(np.arange(a, b)[None, :, None], amp.shape)
            number = number if best is None else np.concatenate([best, number], axis=1)
            order = np.argsort(-every, axis=1, kind="stable")[:, :banks]
            top, best = np.take_along_axis(every, order, axis=1), np.take_along_axis(number, order, axis=1)
            continue
        if top is None:
            top, best = np.full((len(amp), banks, amp.shape[2]), -np.inf), np.zeros((len(amp), banks, amp.shape[2]), np.int64)
        for k, (p, q) in enumerate(ends):
            p, q = max(p, a), min(q, b)
            if p < q:
                part = amp[:, p - a : q - a]
                at = part.argmax(axis=1)
                most = np.take_along_axis(part, at[:, None], axis=1)[:, 0]
                new = (most > top[:, k]) | (np.isnan(most) & ~np.isnan(top[:, k]))
                top[:, k], best[:, k] = np.where(new, most, top[:, k]), np.where(new, at + p, best[:, k])
    return best - low


def scale_statistics(channel: Padded, scales: np.ndarray, runs: Sequence[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, 1, frames) of the sum, mean and sample deviation of amplitudes over all scales, merged from runs of scales."""
    n, mean, squares = 0, 0.0, 0.0
    for a, b in runs:
        amp = np.abs(channel.at(scales[a:b]))
        k, m = b - a, amp.mean(axis=1, keepdims=True)
        squares = squares + ((amp - m) ** 2).sum(axis=1, keepdims=True) + (m - mean) ** 2 * (n * k / (n + k))
        mean, n = mean + (m - mean) * (k / (n + k)), n + k
    return mean * n, mean, np.sqrt(squares / (n - 1)) if n > 1 else np.full_like(mean, np.nan)


def query_block(
    data: Mapping[int, np.ndarray], scales: np.ndarray, min_scale: int, max_scale: int, banks: int, normalize_amplitudes: bool, carrier: int,
    channel_outputs: Mapping[int, Sequence[str]], method: str, frequencies: np.ndarray | None, padding: str | None, wavelet: Wavelet, norm: str,
) -> dict[int, dict[str, np.ndarray]]:
    """channel -> output -> (rows, banks, frames). Power sums, means and deviations are over all scales.

    The z-score of normalised amplitudes uses the mean and deviation of those not normalised. Scales
    are taken in runs, so what is held does not grow with scales x frames.
    """
    high = min(max_scale, len(scales))
    padded = {c: Padded(data[c], padding, wavelet, norm) for c in channel_outputs}
    numbers = padded[carrier].spectrum.size
    inside, every = scale_runs(min_scale, high, numbers), scale_runs(0, len(scales), numbers)
    at = carrier_places(padded[carrier], scales, min_scale, high, banks, method, inside)

    def read(c: int) -> np.ndarray:
        """Coefficients at the carrier's scales."""
        out = np.zeros(at.shape, complex)
        for a, b in inside:
            here = (at + min_scale >= a) & (at + min_scale < b)
            if here.any():
                found = np.take_along_axis(padded[c].at(scales[a:b]), np.where(here, at + min_scale - a, 0), axis=1)
                out[here] = found[here]
        return out

    out: dict[int, dict[str, np.ndarray]] = {}
    with np.errstate(divide="ignore", invalid="ignore"):
        of_carrier = read(carrier)
        reference = np.angle(of_carrier)
        for c, outputs in channel_outputs.items():
            here = of_carrier if c == carrier else read(c)
            p = np.abs(here)
            if normalize_amplitudes or "z_score" in outputs:
                power, mean, sd = scale_statistics(padded[c], scales, every)
            if normalize_amplitudes:
                p = p / power
            got = {}
            for o in outputs:
                if o == "amp":
                    got[o] = p
                elif o == "phase":
                    got[o] = np.angle(here)
                elif o == "phase_difference":
                    got[o] = np.mod(np.angle(here) - reference, 2 * math.pi)
                elif o == "z_score":
                    got[o] = (p - mean) / sd
                else:
                    got[o] = (at + min_scale).astype(float) if frequencies is None else frequencies[at + min_scale]
            out[c] = got
    return out


def cwt_features(
    series: DataFrame, frames: int, min_scale: int = 80, max_scale: int = 180, num_filter_banks: int = 1, normalize_amplitudes: bool = False,
    carrier_channel: int = 0, channel_outputs: Mapping[int, Sequence[str]] | None = None, bank_method: str = "max_pool", sampling: Sampling | None = None,
    normalize_histogram: bool = True, mean_centering: bool = False, downsample_by: tuple[int, int, object] | None = None, channel_names: Sequence[str] | None = None,
    scales: Sequence[float] | None = None, wavelet=None, padding: str | None = "reflect", blocks: int | None = None, voices: int = 32, norm: str = "l1",
) -> DataFrame:
    """(image_id, channel, output, bank, x, y, values): one array over frames for each pixel, channel, output and bank.

    min_scale and max_scale are places in `scales` (piecewise_scales(frames, voices) unless given),
    of which the default ones exist from 16 frames on.
    wavelet: as Wavelet.of() takes it; norm: 'l1' or 'l2'. downsample_by: (height, width, scale). blocks: partitions for the transform;
    Spark's own number unless given. Only the channels asked for leave the scan, and a pixel's
    channels are brought together by one exchange; coefficients stay within a batch.
    """
    outputs = {c: list(dict.fromkeys(o)) for c, o in (channel_outputs or {carrier_channel: ["amp", "freq", "phase"]}).items()}
    if sampling is not None and wavelet is None:
        warnings.warn("no wavelet is given; frequencies are those of the default generalized Morse wavelet", stacklevel=2)
    chosen = Wavelet.of(wavelet)
    grid = np.asarray(scales if scales is not None else piecewise_scales(frames, voices, chosen), float)
    wavelet_bank(grid[:1], frames, chosen, norm)
    checked_outputs(outputs, carrier_channel, num_filter_banks, len(grid[min_scale:max_scale]), bank_method)
    frequencies = scale_frequencies(grid, sampling.fs, chosen) if sampling is not None else None
    source = series
    if downsample_by is not None:
        source = downsample_image(source, *downsample_by)
    # All channels count in the frames' statistics only one by one, so others may go first.
    source = source.where(F.col("c").isin(*outputs))
    if normalize_histogram:
        source = normalize_frames(source)
    if mean_centering:
        source = mean_center(source)
    names = {c: (channel_names[c] if channel_names is not None else str(c)) for c in outputs}
    kinds = [(c, o) for c, os in outputs.items() for o in os]
    # Coefficients of a batch stay below 128 MB.
    step = max(1, int(128e6 / (16 * len(grid) * max(frames, 1) * 4 * len(outputs))))

    def query(channels: pa.Array) -> pa.Array:
        names_of = [(names[k], o, b) for k, o in kinds for b in range(num_filter_banks)]
        parts = []
        for begin in range(0, len(channels), step):
            part = channels.slice(begin, step)
            flat = part.flatten()
            owner = np.repeat(np.arange(len(part)), [len(x) if x.is_valid else 0 for x in part])
            c = flat.field("c").to_numpy(zero_copy_only=False)
            values = flat.field("values")
            data, present = {}, np.ones(len(part), bool)
            for k in outputs:
                at = np.flatnonzero(c == k)
                lengths = np.array([len(values[int(i)]) if values[int(i)].is_valid else -1 for i in at])
                good = at[lengths == frames]
                here = np.zeros((len(part), frames))
                if len(good):
                    here[owner[good]] = np.asarray(values.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(good), frames)
                data[k] = here
                on = np.zeros(len(part), bool)
                on[owner[good]] = True
                present &= on
            got = query_block(data, grid, min_scale, max_scale, num_filter_banks, normalize_amplitudes, carrier_channel, outputs, bank_method, frequencies, padding, chosen, norm)
            # (pixels, outputs, banks, frames) as one array, with the names of its lists beside.
            at = np.flatnonzero(present)
            values = pa.array(np.stack([got[k][o][at] for k, o in kinds], axis=1).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) * len(names_of) + 1, dtype=np.int32) * frames), values)
            columns = [pa.array([x[i] for x in names_of] * len(at), t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))]
            each = pa.StructArray.from_arrays([*columns, lists], names=["channel", "output", "bank", "values"])
            offsets = np.concatenate([[0], np.cumsum(present)]).astype(np.int32) * len(names_of)
            parts.append(pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~present, False)), each))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    kind = pa.list_(pa.struct([("channel", pa.string()), ("output", pa.string()), ("bank", pa.int32()), ("values", pa.list_(pa.float64()))]))
    pixels = source.groupBy("image_id", "x", "y").agg(F.sort_array(F.collect_list(F.struct("c", "values"))).alias("channels"))
    if blocks is not None:
        pixels = pixels.repartition(blocks, "image_id", "x", "y")
    found = pixels.withColumn("found", F.arrow_udf(query, "array<struct<channel string, output string, bank int, values array<double>>>").asNondeterministic()("channels"))
    return found.select("image_id", "x", "y", F.explode("found").alias("f")).select("image_id", "f.channel", "f.output", "f.bank", "x", "y", "f.values")


def as_series(features: DataFrame, order: Sequence[tuple[str, str, int]]) -> DataFrame:
    """Outputs as the channels of one series table: (channel, output, bank) number k becomes channel k."""
    number = F.array(*[F.lit(f"{c}|{o}|{b}") for c, o, b in order])
    key = F.concat_ws("|", "channel", "output", F.col("bank").cast("string"))
    rows = features.withColumn("c", (F.array_position(number, key) - 1).cast("int")).where("c >= 0")
    return rows.select("image_id", "c", "x", "y", "values")
