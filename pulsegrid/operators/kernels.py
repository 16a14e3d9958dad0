"""Signal kernels that SQL can't express (FIR, Hilbert, tapers, Radon), as Arrow-batched functions.

A long signal is cut into chunks with a halo (``plans.ordered``) where the kernel is local, so chunks are independent tasks;
where a kernel needs the whole record (Hilbert transform, spectra of one window) the group is one record or window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.plans.ordered import chunk_with_halo


def fir(band: Sequence[float | None] | float, fs: float, transition: float | str = "25%", attenuation: float = 60.0) -> np.ndarray:
    """Kaiser-window FIR taps, odd in number: (lo, hi) band-pass, descending band-stop, an open or zero end high- or low-pass."""
    lo, hi = (0.0, float(band)) if np.isscalar(band) else (0.0 if b is None or not np.isfinite(b) or b <= 0 else float(b) for b in band)
    if lo == hi:
        raise ValueError("a band needs two different frequencies")
    if fs <= 2 * max(lo, hi):
        raise ValueError("band too high for this sampling frequency")
    width = fs / 2 - lo if not hi else hi if not lo else abs(hi - lo)
    t = width * float(transition.rstrip("%")) / 100 if isinstance(transition, str) else transition
    beta = 0.1102 * (attenuation - 8.7) if attenuation > 50 else 0.5842 * (attenuation - 21) ** 0.4 + 0.07886 * (attenuation - 21) if attenuation > 21 else 0.0
    n = math.ceil((attenuation - 7.95) / 2.285 / (math.pi * t * 2 / fs) + 1)
    n += (n + 1) % 2
    m = np.arange(n) - n // 2
    low = lambda f: 2 * f / fs * np.sinc(2 * f / fs * m)
    delta = (m == 0).astype(float)
    h = delta - low(lo) if not hi else low(hi) if not lo else low(hi) - low(lo) if hi > lo else delta - (low(lo) - low(hi))
    return h * np.kaiser(n, beta)


def zero_phase(y: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Convolution of the same length, odd reflection at both ends."""
    half = len(taps) // 2
    h = min(half, len(y) - 1)
    if len(y) == 0 or h < 1:
        return y * taps.sum()
    left, right = 2 * y[0] - y[h:0:-1], 2 * y[-1] - y[-2 : -h - 2 : -1]
    pad = np.concatenate([np.full(half - h, left[0]), left, y, right, np.full(half - h, right[-1])])
    return np.convolve(pad, taps, mode="valid")


def filter_signal(df: DataFrame, keys: Sequence[str], taps: np.ndarray, chunk: int = 1 << 15) -> DataFrame:
    """Add ``filtered`` to keys, i, y. Chunks carry half a filter length of their neighbours, so seams don't show."""
    half = len(taps) // 2
    chunk = max(chunk, half + 1)
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.select(*keys, 'i', 'y').schema)}, filtered double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        pdf["filtered"] = zero_phase(pdf["y"].to_numpy(float), taps)
        return pdf.loc[pdf["_core"], [*keys, "i", "y", "filtered"]]

    chunks = chunk_with_halo(df.select(*keys, "i", "y"), "i", chunk, half)
    return chunks.groupBy(*keys, "_chunk").applyInPandas(run, schema)


def analytic_envelope(y: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal, zero-padded to the next 2^k 3^m."""
    n = min(2 ** math.ceil(math.log2(len(y) / 3**m)) * 3**m for m in range(5) if len(y) >= 3**m) if len(y) > 1 else 1
    n = max(n, len(y))
    h = np.zeros(n)
    h[0], h[1 : (n + 1) // 2] = 1, 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(y, n) * h))[: len(y)]


def arrays(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long signals as one array per key, in sample order (one record must fit a task)."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda s: s["y"]).alias("samples"))


def per_record(df: DataFrame, keys: Sequence[str], column: str, function, schema: str) -> DataFrame:
    """``function(samples) -> dict of columns`` for each record held as an array; ``schema`` describes the new columns."""
    names = [p.split()[0] for p in schema.split(",")]
    full = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", " + schema

    def run(batches):
        for pdf in batches:
            out = []
            for *ids, x in pdf[[*keys, column]].itertuples(index=False, name=None):
                if x is None or len(x) == 0:
                    continue
                made = function(np.asarray(x, float))
                out += [(*ids, *values) for values in zip(*[made[c] for c in names])]
            yield pd.DataFrame(out, columns=[*keys, *names])

    return df.select(*keys, column).mapInPandas(run, full)


def envelope(df: DataFrame, keys: Sequence[str], column: str, fs: float, band=None) -> DataFrame:
    """Envelope of each (optionally band-filtered) record: keys, i, envelope."""
    taps = fir(band, fs) if band is not None else None

    def one(x: np.ndarray) -> dict:
        e = analytic_envelope(zero_phase(x, taps) if taps is not None else x)
        return {"i": range(len(e)), "envelope": e.tolist()}

    return per_record(df, keys, column, one, "i int, envelope double")


def contrast_bands(df: DataFrame, keys: Sequence[str], column: str, fs: float, target, contrast, weights=None) -> DataFrame:
    """Power in the target band minus the weighted mean power in the contrast bands."""
    bands = [fir(b, fs, "10%") for b in [target, *contrast]]
    w = np.full(len(contrast), 1 / len(contrast)) if weights is None else np.asarray(weights) / np.sum(weights)

    def one(x: np.ndarray) -> dict:
        p = [zero_phase(x, t) ** 2 for t in bands]
        return {"i": range(len(x)), "contrast": (p[0] - np.tensordot(w, p[1:], 1)).tolist()}

    return per_record(df, keys, column, one, "i int, contrast double")


def factors(v: int, largest: int = 12) -> list[int]:
    """Greedy factors of at most ``largest``."""
    out = []
    while v > 1:
        f = next((x for x in range(min(largest, v), 1, -1) if v % x == 0), None)
        if f is None:
            raise RuntimeError(f"{v} has a prime factor over {largest}")
        out.append(f)
        v //= f
    return out


def decimate(df: DataFrame, keys: Sequence[str], column: str, q: int) -> DataFrame:
    """Every q-th sample after zero-phase low-pass filters, one factor at a time."""
    steps = [(f, fir(0.8 * 0.5 / f, 1.0)) for f in factors(q)]

    def one(x: np.ndarray) -> dict:
        for f, taps in steps:
            x = zero_phase(x, taps)[::f]
        return {"i": range(len(x)), "y": x.tolist()}

    return per_record(df, keys, column, one, "i int, y double")


def resample(df: DataFrame, keys: Sequence[str], column: str, n: int) -> DataFrame:
    """Fourier resampling to n samples."""

    def one(x: np.ndarray) -> dict:
        X, m = np.fft.rfft(x), min(n, len(x))
        Y = np.zeros(n // 2 + 1, complex)
        Y[: m // 2 + 1] = X[: m // 2 + 1]
        if m % 2 == 0 and n != len(x):
            Y[m // 2] *= 0.5 if n > len(x) else 1.0
            if n < len(x):
                Y[m // 2] = X[m // 2].real
        return {"i": range(n), "y": (np.fft.irfft(Y, n) * n / len(x)).tolist()}

    return per_record(df, keys, column, one, "i int, y double")


def interpolate(df: DataFrame, keys: Sequence[str], column: str, factor: int) -> DataFrame:
    """Zeros between samples, then a low-pass with gain ``factor``."""
    taps = factor * fir(0.5 / factor * 0.99, 1.0)

    def one(x: np.ndarray) -> dict:
        z = np.zeros(len(x) * factor)
        z[::factor] = x
        return {"i": range(len(z)), "y": zero_phase(z, taps).tolist()}

    return per_record(df, keys, column, one, "i int, y double")


@lru_cache(maxsize=32)
def tapers(n: int, nw: float, k: int) -> np.ndarray:
    """Discrete prolate spheroidal sequences (k x n) from the tridiagonal eigenproblem."""
    i = np.arange(n)
    m = np.diag(((n - 1 - 2 * i) / 2) ** 2 * math.cos(2 * math.pi * nw / n))
    off = i[1:] * (n - i[1:]) / 2
    m[i[1:], i[:-1]] = m[i[:-1], i[1:]] = off
    v = np.linalg.eigh(m)[1][:, ::-1][:, :k].T
    return np.array([t * (1 if (t.sum() if j % 2 == 0 else (np.arange(n) * -t).sum()) >= 0 else -1) for j, t in enumerate(v)])


def taper_transform(x: np.ndarray, fs: float, bandwidth: float | None = None, pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Tapered Fourier transforms (tapers x frequencies) and the frequencies."""
    n = len(x)
    tw = min(3.0, (n - 1) / 2) if bandwidth is None else max(1, int(bandwidth * n / fs))
    k = max(1, int(2 * tw - 1))
    nfft = max(2 ** (math.ceil(math.log2(n + 1)) + pad - 1), n)
    J = np.fft.fft(tapers(n, tw, k) * math.sqrt(fs) * x, nfft, axis=1) / fs
    f = fs * np.arange(nfft) / nfft
    keep = f <= fs / 2
    return J[:, keep], f[keep]


def spectrum(df: DataFrame, keys: Sequence[str], column: str, fs: float, bandwidth: float | None = None, pad: int = 0) -> DataFrame:
    """Multitaper spectrum of each record (or window): keys, freq, power."""

    def one(x: np.ndarray) -> dict:
        J, f = taper_transform(x - x.mean(), fs, bandwidth, pad)
        return {"freq": f.tolist(), "power": (2 * (np.abs(J) ** 2).mean(axis=0)).tolist()}

    return per_record(df, keys, column, one, "freq double, power double")


def spectrogram(df: DataFrame, keys: Sequence[str], column: str, fs: float, window: int, shift: int) -> DataFrame:
    """Multitaper spectra of sliding windows, exploded before the kernel so that windows spread over tasks."""
    starts = F.sequence(F.lit(0), F.size(column) - window, F.lit(shift))
    wins = df.filter(F.size(column) >= window).select(*keys, F.explode(starts).alias("w"), column)
    return spectrum(wins.select(*keys, "w", F.slice(column, F.col("w") + 1, window).alias(column)), [*keys, "w"], column, fs)


def coherence(df: DataFrame, keys: Sequence[str], x: str, y: str, fs: float) -> DataFrame:
    """Multitaper coherence magnitude and phase of two records in a row."""
    pair = df.select(*keys, F.concat(x, y).alias("_xy"))

    def one(xy: np.ndarray) -> dict:
        a, b = np.split(xy, 2)
        Ja, f = taper_transform(a - a.mean(), fs)
        Jb, _ = taper_transform(b - b.mean(), fs)
        c = (np.conj(Ja) * Jb).mean(0) / np.sqrt((np.abs(Ja) ** 2).mean(0) * (np.abs(Jb) ** 2).mean(0))
        return {"freq": f.tolist(), "coherence": np.abs(c).tolist(), "phase": np.angle(c).tolist()}

    return per_record(pair.filter(F.size("_xy") % 2 == 0), keys, "_xy", one, "freq double, coherence double, phase double")


def coherogram(df: DataFrame, keys: Sequence[str], x: str, y: str, fs: float, window: int, shift: int) -> DataFrame:
    """Multitaper coherence of sliding windows of two records in a row (cut to the shorter one), exploded before the kernel."""
    n = F.least(F.size(x), F.size(y))
    wins = df.filter(n >= window).select(*keys, x, y, F.explode(F.sequence(F.lit(0), n - window, F.lit(shift))).alias("w"))
    cut = wins.select(*keys, "w", *[F.slice(c, F.col("w") + 1, window).alias(c) for c in (x, y)])
    return coherence(cut, [*keys, "w"], x, y, fs)


@dataclass(frozen=True)
class MultitaperOptions:
    """Settings of a spectrum: bandwidth (Hz), number of tapers, pass band, padding, error bars (none, theory, jackknife) and their p-value."""

    bandwidth: float | None = None
    ntapers: int | None = None
    fpass: tuple[float, float] | None = None
    pad: int = 0
    error: str = "none"
    pvalue: float = 0.05

    def bandwidth_range(self, n: int, fs: float) -> tuple[float, float]:
        return fs / n, fs / 2 * (n - 1) / n

    def validate(self, n: int, fs: float, correct: bool = False) -> MultitaperOptions:
        """These settings for records of n samples; what lies outside the limits is an error, or with ``correct`` moved to them."""
        lo, hi = self.bandwidth_range(n, fs)
        bandwidth = min(3.0, (n - 1) / 2) * fs / n if self.bandwidth is None else self.bandwidth
        most = max(1, math.floor(2 * bandwidth * n / fs - 1))
        ntapers = most if self.ntapers is None else self.ntapers
        fits = lo <= bandwidth <= hi and 1 <= ntapers <= most
        if self.error not in ("none", "theory", "jackknife") or not 0 < self.pvalue < 1 or not (fits or correct):
            raise ValueError(f"invalid settings for {n} samples at {fs} Hz: {self}")
        bandwidth = min(max(bandwidth, lo), hi)
        return replace(self, bandwidth=bandwidth, ntapers=min(max(ntapers, 1), max(1, math.floor(2 * bandwidth * n / fs - 1))))

    def nfft(self, n: int) -> int:
        return max(2 ** (math.ceil(math.log2(n + 1)) + self.pad - 1), n)


def frequencies(df: DataFrame, fs: float, options: MultitaperOptions) -> DataFrame:
    """Each row (with its number of samples ``n``) for every frequency of its spectrum within the pass band, as ``freq``."""
    power = F.ceil(F.log2(F.col("n") + 1.0)) + (options.pad - 1)
    nfft = F.greatest(F.pow(F.lit(2.0), power.cast("double")).cast("int"), F.col("n"))
    lo, hi = options.fpass or (0.0, fs / 2)
    d = df.withColumn("_nfft", nfft).withColumn("_f", F.explode(F.sequence(F.lit(0), F.floor(F.col("_nfft") / 2).cast("int"))))
    return d.withColumn("freq", F.col("_f") * fs / F.col("_nfft")).filter(F.col("freq").between(lo, hi)).drop("_f", "_nfft")


def _below(f, p: float, lo: float, hi: float) -> float:
    """Where an increasing distribution function reaches p, by bisection."""
    while f(hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < p else (lo, mid)
    return (lo + hi) / 2


@lru_cache(maxsize=256)
def chi2_quantile(p: float, dof: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom (a finite sum of Poisson terms)."""
    if dof % 2:
        raise ValueError("even degrees of freedom only")
    tail = lambda x: sum(math.exp(j * math.log(x / 2) - x / 2 - math.lgamma(j + 1)) for j in range(dof // 2)) if x > 0 else 1.0
    return _below(lambda x: 1 - tail(x), p, 0.0, 1.0)


@lru_cache(maxsize=256)
def t_quantile(p: float, dof: int) -> float:
    """Quantile (p > 0.5) of Student's t, from its finite trigonometric sums."""

    def cdf(t: float) -> float:
        a, c = math.atan(t / math.sqrt(dof)), math.cos(math.atan(t / math.sqrt(dof))) ** 2
        term, total = 1.0, 0.0
        for j in range(dof // 2 if dof % 2 == 0 else (dof - 1) // 2):
            total += term
            term *= c * ((2 * j + 1) / (2 * j + 2) if dof % 2 == 0 else (2 * j + 2) / (2 * j + 3))
        inside = math.sin(a) * total if dof % 2 == 0 else 2 / math.pi * (a + math.sin(a) * math.cos(a) * total)
        return 0.5 + inside / 2

    return _below(cdf, p, 0.0, 1.0)


def spectrum_error(df: DataFrame, keys: Sequence[str], column: str, fs: float, options: MultitaperOptions) -> DataFrame:
    """Multitaper spectrum with its error bars: keys, freq, power, lower, upper.

    ``theory``: power is chi-square with two degrees of freedom a taper; ``jackknife``: spread of the log power without one taper
    each, times a quantile of t; ``none``: nulls.
    """

    def one(x: np.ndarray) -> dict:
        own = options.validate(len(x), fs, correct=True)
        nfft = own.nfft(len(x))
        J = np.fft.fft(tapers(len(x), own.bandwidth * len(x) / fs, own.ntapers) * math.sqrt(fs) * (x - x.mean()), nfft, axis=1) / fs
        f = fs * np.arange(nfft) / nfft
        lo, hi = own.fpass or (0.0, fs / 2)
        keep = (f >= lo) & (f <= hi)
        p = 2 * np.abs(J[:, keep]) ** 2
        power, k = p.mean(axis=0), len(p)
        lower = upper = [None] * len(power)
        if own.error == "theory":
            lower, upper = (2 * k / chi2_quantile(1 - own.pvalue / 2, 2 * k) * power).tolist(), (2 * k / chi2_quantile(own.pvalue / 2, 2 * k) * power).tolist()
        elif own.error == "jackknife" and k > 1:
            with np.errstate(divide="ignore", invalid="ignore"):
                left_out = np.log((p.sum(axis=0) - p) / (k - 1))
                spread = t_quantile(1 - own.pvalue / 2, k - 1) * np.sqrt((k - 1) / k * ((left_out - left_out.mean(axis=0)) ** 2).sum(axis=0))
            lower, upper = (power * np.exp(-spread)).tolist(), (power * np.exp(spread)).tolist()
        return {"freq": f[keep].tolist(), "power": power.tolist(), "lower": lower, "upper": upper}

    return per_record(df, keys, column, one, "freq double, power double, lower double, upper double")


def radon(image: np.ndarray, theta: np.ndarray, rho: np.ndarray, dx: float = 1.0, dy: float = 1.0, method: str = "sum") -> np.ndarray:
    """Line integrals x cos(theta) + y sin(theta) = rho of an image (rows = x, columns = y, centred), linear interpolation."""
    nx, ny = image.shape
    x, y = (np.arange(nx) - (nx - 1) / 2) * dx, (np.arange(ny) - (ny - 1) / 2) * dy
    out = np.full((len(theta), len(rho)), np.nan)
    for i, t in enumerate(theta):
        c, s = math.cos(t), math.sin(t)
        by_x = abs(s) > dx / math.hypot(dx, dy)
        at = ((rho[:, None] - x * c) / s / dy + (ny - 1) / 2) if by_x else ((rho[:, None] - y * s) / c / dx + (nx - 1) / 2)
        n, k = (ny, np.arange(nx)) if by_x else (nx, np.arange(ny))
        ok = (at >= 0) & (at <= n - 1)
        lo = np.clip(np.floor(at).astype(int), 0, n - 2)
        f = at - lo
        v = image[k, lo] * (1 - f) + image[k, lo + 1] * f if by_x else image[lo, k] * (1 - f) + image[lo + 1, k] * f
        count = ok.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            total = {"product": lambda: np.where(ok, v, 1).prod(1), "logsum": lambda: np.where(ok, np.log(np.maximum(v, 1e-300)), 0).sum(1)}.get(method, lambda: np.where(ok, v, 0).sum(1))()
            total = total / count if method == "mean" else total * (dx / abs(s) if by_x else dy / abs(c)) if method == "integral" else total
        out[i] = np.where(count > 0, total, np.nan)
    return out


def fit_line(df: DataFrame, keys: Sequence[str], ntheta: int = 45, nrho: int = 31) -> DataFrame:
    """The line of the largest Radon sum through each image held as array<array<double>> ``image``: theta, rho, slope, intercept, score."""
    full = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", theta double, rho double, slope double, intercept double, score double"

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                image = np.array([np.asarray(r, float) for r in row.image])
                half = math.hypot(*image.shape) / 2
                theta, rho = np.linspace(0, math.pi, ntheta, endpoint=False), np.linspace(-half, half, nrho)
                r = radon(image, theta, rho)
                i, j = np.unravel_index(np.nanargmax(r), r.shape)
                s, c = math.sin(theta[i]), math.cos(theta[i])
                out.append((*[getattr(row, k) for k in keys], theta[i], rho[j], -c / s if s else None, rho[j] / s if s else None, r[i, j] / image.shape[0]))
            yield pd.DataFrame(out, columns=[*keys, "theta", "rho", "slope", "intercept", "score"])

    return df.select(*keys, "image").mapInPandas(run, full)


def bresenham(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """Cells of a line on a grid."""
    n = max(abs(x1 - x0), abs(y1 - y0))
    return [(x0, y0)] if n == 0 else [(x0 + (2 * i * (x1 - x0) + n * (1 if x1 >= x0 else -1)) // (2 * n) if x1 >= x0 else x0 - (2 * i * (x0 - x1) + n) // (2 * n), y0 + (2 * i * (y1 - y0) + n) // (2 * n) if y1 >= y0 else y0 - (2 * i * (y0 - y1) + n) // (2 * n)) for i in range(n + 1)]


def circular_regression(df: DataFrame, keys: Sequence[str], x: str, theta: str, slopes: Sequence[float]) -> DataFrame:
    """theta ~ a + b x by a grid of slopes: for each slope the best a is the mean direction of theta - b x, so one aggregate pass
    gives the loss of all slopes; keys, slope, intercept, r."""
    terms = []
    for b in slopes:
        d = F.col(theta) - b * F.col(x)
        c, s = F.avg(F.cos(d)), F.avg(F.sin(d))
        terms.append(F.struct(F.hypot(c, s).alias("r"), F.lit(float(b)).alias("slope"), F.atan2(s, c).alias("intercept")))
    return df.groupBy(*keys).agg(F.array_max(F.array(*terms)).alias("_m")).select(*keys, "_m.slope", "_m.intercept", "_m.r")
