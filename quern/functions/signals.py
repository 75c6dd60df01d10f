"""Signals as arrays: descriptions, running sums, filters, spectra and alignments.

What array functions can say stays in the JVM; transforms and searches go to numpy in
Arrow batches. Signals are arrays of doubles; a null signal gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_DOUBLES = T.ArrayType(T.DoubleType())
_MATRIX = T.ArrayType(_DOUBLES)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def describe(signal: Column) -> Column:
    """``(n, rms, peak, sha256)``; the digest is of the values as texts."""
    n = F.size(signal)
    return F.struct(
        n.alias("n"), F.sqrt(_sum(F.transform(signal, lambda v: v * v)) / n).alias("rms"), F.array_max(F.transform(signal, F.abs)).alias("peak"),
        F.sha2(F.array_join(F.transform(signal, lambda v: v.cast("string")), ","), 256).alias("sha256"),
    )


def difference(left: Column, right: Column) -> Column:
    """``(exact, max_absolute, mean_absolute, rms)`` of two signals; null if their lengths differ."""
    d = F.zip_with(left, right, lambda a, b: b - a)
    n = F.size(left)
    out = F.struct(
        F.forall(d, lambda v: v == 0).alias("exact"), F.array_max(F.transform(d, F.abs)).alias("max_absolute"),
        (_sum(F.transform(d, F.abs)) / n).alias("mean_absolute"), F.sqrt(_sum(F.transform(d, lambda v: v * v)) / n).alias("rms"),
    )
    return F.when(F.size(left) == F.size(right), out)


def running_sums(signal: Column) -> Column:
    """Sums of the first 0, 1, 2 ... values."""
    none = F.array(F.lit(0.0))
    return F.aggregate(signal, none, lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + v))


def segment_energy(sums: Column, squares: Column, start: Column, size: Column) -> Column:
    """Energy of a segment about its mean, from the running sums of the signal and its squares."""
    total = F.get(sums, start + size) - F.get(sums, start)
    return F.greatest(F.get(squares, start + size) - F.get(squares, start) - total * total / size, F.lit(0.0))


def _applied(f: Callable[..., np.ndarray | None], kind: T.DataType):
    @pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(np.stack(x) if len(x) and isinstance(x[0], np.ndarray) else np.asarray(x, dtype=float)) for x in s], dtype=object)

    return run


def median_filtered(x: np.ndarray, width: int, axis: int = -1) -> np.ndarray:
    """Running median of an odd width, the signal mirrored at its ends."""
    pad = [(0, 0)] * x.ndim
    pad[axis] = (width // 2, width // 2)
    view = np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, mode="reflect"), width, axis=axis)
    return np.median(view, axis=-1)


def spectrum(x: np.ndarray, width: int, hop: int) -> np.ndarray:
    """Magnitudes, bins by frames, of Hann windows ``hop`` apart, the signal mirrored at its ends."""
    padded = np.pad(x, width // 2, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(padded, width)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)
    return np.abs(np.fft.rfft(frames * window, axis=1)).T


def harmonic_percussive(magnitude: np.ndarray, width: int = 31) -> tuple[np.ndarray, np.ndarray]:
    """Shares of a spectrogram that last in time and that spread in frequency."""
    harmonic, percussive = median_filtered(magnitude, width, 1) ** 2, median_filtered(magnitude, width, 0) ** 2
    whole = harmonic + percussive + 1e-10
    return magnitude * harmonic / whole, magnitude * percussive / whole


def feature_stack(residual: np.ndarray, harmonic: np.ndarray, percussive: np.ndarray, floor: float = 1e-5, range_db: float = 80.0) -> np.ndarray:
    """Seven channels: the three parts in decibels under one common clamp, first and second steps
    of the first in time, the difference of the others, and the size of the first steps."""
    level = 20 * np.log10(np.maximum(np.stack([residual, harmonic, percussive]), floor))
    r, h, p = np.maximum(level, level.max() - range_db)
    step = np.pad(np.diff(r, axis=1), ((0, 0), (1, 0)))
    return np.stack([r, h, p, step, np.pad(np.diff(step, axis=1), ((0, 0), (1, 0))), h - p, np.abs(step)])


def hull_places(curve: np.ndarray, width: int = 10) -> np.ndarray:
    """Places of the least value of every run of ``width``, with both ends."""
    if len(curve) < width:
        return np.unique([0, len(curve) - 1])
    runs = np.lib.stride_tricks.sliding_window_view(curve, width)
    return np.unique(np.r_[0, np.argmin(runs, axis=1) + np.arange(len(runs)), len(curve) - 1])


def _through(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A quadratic through each three neighbouring points, else a line."""
    if len(x) < 3:
        return np.interp(at, x, y)
    i = np.clip(np.searchsorted(x, at) - 1, 0, len(x) - 3)
    a, b, c = x[i], x[i + 1], x[i + 2]
    return y[i] * (at - b) * (at - c) / ((a - b) * (a - c)) + y[i + 1] * (at - a) * (at - c) / ((b - a) * (b - c)) + y[i + 2] * (at - a) * (at - b) / ((c - a) * (c - b))


def above_hull(curve: np.ndarray, width: int = 10, floor: float = -45.0) -> np.ndarray:
    """How far a spectral profile stands over a smooth curve through its lower hull."""
    places, at = hull_places(curve, width), np.arange(len(curve), dtype=float)
    return np.maximum(curve - np.maximum(_through(places.astype(float), curve[places], at), floor), 0)


def fingerprint(profile: np.ndarray, width: int = 10, most: float = 5.0) -> np.ndarray:
    """The part over the hull, clipped, divided by its largest value."""
    over = np.minimum(above_hull(profile, width), most)
    return over / (1e-6 + over.max(initial=0))


def best_lag(a: np.ndarray, b: np.ndarray, reach: int, least: int) -> tuple[int, float, int]:
    """``(lag, correlation, overlap)`` of the shift up to ``reach`` either way at which the common
    parts, of ``least`` values at least, correlate most; a silent part correlates with nothing."""
    best = (0, 0.0, 0)
    for lag in range(-reach, reach + 1):
        x, y = a[max(lag, 0) :], b[max(-lag, 0) :]
        n = min(len(x), len(y))
        if n < least:
            continue
        x, y = x[:n] - x[:n].mean(), y[:n] - y[:n].mean()
        energy = np.sqrt((x @ x) * (y @ y))
        r = float(x @ y / energy) if energy > 1e-12 else 0.0
        if abs(r) > abs(best[1]) + 1e-12:
            best = (lag, r, n)
    return best


def median_filter(signal: Column, width: int) -> Column:
    """``median_filtered`` as a column, in the JVM; ``width`` is odd and at most twice the length."""
    n, half = F.size(signal), width // 2

    def mirrored(i: Column) -> Column:
        return F.when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i)

    at = F.sequence(F.lit(0), n - 1)
    return F.transform(at, lambda i: F.array_sort(F.transform(F.sequence(i - half, i + half), lambda j: F.get(signal, mirrored(j))))[half])


def stft(signal: Column, width: int, hop: int) -> Column:
    return _applied(lambda x: list(spectrum(x, width, hop)), _MATRIX)(signal)


def profile_fingerprint(profile: Column, width: int = 10) -> Column:
    return _applied(lambda x: fingerprint(x, width), _DOUBLES)(profile)


def hull(profile: Column, width: int = 10) -> Column:
    return _applied(lambda x: hull_places(x, width), T.ArrayType(T.LongType()))(profile)


def separated(signal: Column, width: int, hop: int, median: int = 3) -> Column:
    """Total magnitudes of the harmonic and the percussive part, and of the whole."""
    def parts(x: np.ndarray) -> np.ndarray:
        m = spectrum(x, width, hop)
        return np.array([y.sum() for y in (*harmonic_percussive(m, median), m)])

    return _applied(parts, _DOUBLES)(signal)


def feature_means(signal: Column, width: int, hop: int, median: int = 3) -> Column:
    """Mean of each of the seven feature channels."""
    def parts(x: np.ndarray) -> np.ndarray:
        m = spectrum(x, width, hop)
        return feature_stack(m, *harmonic_percussive(m, median)).mean(axis=(1, 2))

    return _applied(parts, _DOUBLES)(signal)


def aligned(a: Column, b: Column, reach: int, least: int) -> Column:
    """``best_lag`` of two signals as a struct."""
    @pandas_udf("lag int, correlation double, overlap int")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [best_lag(np.asarray(p, dtype=float), np.asarray(q, dtype=float), reach, least) for p, q in zip(x, y)]
        return pd.DataFrame(rows, columns=["lag", "correlation", "overlap"])

    return run(a, b)


def cache_rules(signal: str, length: int, most: float = 1.0) -> dict[str, Column]:
    """Rules of a cached signal: its length, finite values, none beyond the clip."""
    x = F.col(signal)
    return {
        f"{length} values": F.size(x) == length,
        "values are finite": F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))),
        "no value beyond the clip": F.coalesce(F.array_max(F.transform(x, F.abs)) <= most, F.lit(False)),
    }
