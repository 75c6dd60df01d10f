import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import signals as s


def naive_dft(x, width, hop):
    padded = np.pad(x, width // 2, mode="reflect")
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)
    out = []
    for at in range(0, len(padded) - width + 1, hop):
        w = padded[at : at + width] * window
        out.append([abs(sum(w[n] * np.exp(-2j * np.pi * k * n / width) for n in range(width))) for k in range(width // 2 + 1)])
    return np.array(out).T


def test_spectrum_equals_a_naive_transform():
    x = np.random.default_rng(0).normal(size=70)
    assert np.allclose(s.spectrum(x, 16, 4), naive_dft(x, 16, 4))


def test_parts_of_a_spectrogram():
    m = np.zeros((20, 30))
    m[7] = 1.0  # a tone
    m[:, 11] = 1.0  # a click
    tone, click = s.harmonic_percussive(m, 5)
    assert tone[7, 2] > 0.99 and click[3, 11] > 0.99 and tone[3, 11] < 0.01 and click[7, 2] < 0.01
    stack = s.feature_stack(m, tone, click)
    assert stack.shape == (7, 20, 30) and np.allclose(stack[6], abs(stack[3])) and np.allclose(stack[5], stack[1] - stack[2])
    assert np.allclose(stack[3][:, 1:], np.diff(stack[0], axis=1)) and (stack[3][:, 0] == 0).all()


def test_median_filter_on_both_paths(spark):
    x = np.random.default_rng(1).normal(size=25)
    want = s.median_filtered(x, 7)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    assert np.allclose(df.select(s.median_filter(F.col("x"), 7)).first()[0], want)
    padded = np.pad(x, 3, mode="reflect")
    assert np.allclose(want, [np.median(padded[i : i + 7]) for i in range(25)])


def test_hull_and_fingerprint():
    base = np.linspace(-30, -10, 200)
    curve = base.copy()
    curve[[60, 61, 150]] += 4.0
    places = s.hull_places(curve, 10)
    assert places[0] == 0 and places[-1] == 199 and 150 not in places
    over = s.above_hull(curve, 10)
    assert over[150] == pytest.approx(4, abs=0.2) and over[100] == pytest.approx(0, abs=0.2)
    print_ = s.fingerprint(curve, 10)
    assert print_.max() == pytest.approx(1, abs=1e-3) and s.fingerprint(np.zeros(50)).max() == 0
    x = np.array([0.0, 1.0, 3.0, 4.0])
    assert np.allclose(s._through(x, x**2, np.array([0.5, 2.0, 3.5])), np.array([0.25, 4.0, 12.25]))


def test_lag_search_finds_the_shift():
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    lag, r, n = s.best_lag(x, x[17:] * 0.5 + 0.01, 30, 100)
    assert (lag, n) == (17, 383) and r > 0.999
    assert s.best_lag(np.zeros(50), np.zeros(50), 5, 10)[1] == 0.0


def test_descriptions_and_sums(spark):
    df = spark.createDataFrame([([3.0, -4.0], [3.0, -4.0]), ([1.0], [2.0, 3.0]), (None, None)], "x array<double>, y array<double>")
    rows = df.select(s.describe(F.col("x")).alias("d"), s.difference(F.col("x"), F.col("y")).alias("e"), s.running_sums(F.col("x")).alias("r")).collect()
    assert rows[0]["d"]["rms"] == pytest.approx(np.sqrt(12.5)) and rows[0]["d"]["peak"] == 4.0 and rows[0]["e"]["exact"] and rows[0]["r"] == [0.0, 3.0, -1.0]
    assert rows[1]["e"] is None and rows[2]["r"] is None
