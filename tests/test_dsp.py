import numpy as np
import pytest

from wavemark.operators import dsp, signal_blocks as B
from wavemark.operators.dsp import Settings

RATE = 500.0


def tone(hz, seconds=12, rate=RATE):
    return np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def loop(x, b, a, z):
    out, (z1, z2) = [], z
    for v in x:
        y = b[0] * v + z1
        z1, z2 = b[1] * v - a[1] * y + z2, b[2] * v - a[2] * y
        out.append(y)
    return np.array(out)


def test_pieces_give_the_plain_recursion():
    r = np.random.default_rng(0)
    for n in (1, 2, 17, 1000):
        x = r.normal(size=n)
        for b, a in dsp.bandpass_sections(5, 80, RATE):
            assert np.allclose(dsp.biquad(x, b, a, np.array([0.3, -0.2])), loop(x, b, a, (0.3, -0.2)), atol=1e-9)


def test_bandpass_has_the_analytic_magnitude():
    f = np.linspace(0.5, 249, 200)
    z = np.exp(-2j * np.pi * f / RATE)
    h = np.ones_like(z)
    for b, a in dsp.bandpass_sections(5, 80, RATE):
        h *= (b[0] + b[1] * z + b[2] * z**2) / (a[0] + a[1] * z + a[2] * z**2)
    warp = lambda x: 2 * RATE * np.tan(np.pi * x / RATE)
    lo, hi = warp(5.0), warp(80.0)
    s = (warp(f) ** 2 - lo * hi) / (warp(f) * (hi - lo))
    assert np.allclose(np.abs(h), 1 / np.sqrt(1 + s**8), atol=1e-9)


def test_notch_and_regression_take_out_the_tone_alone():
    x = tone(10) + 2 * tone(60)
    for s in (Settings(True, method="notch", frequencies=(60.0,)), Settings(True, method="regression", frequencies=(60.0,))):
        y = dsp.prepare(x, RATE, s)[1000:-1000]
        p = np.abs(np.fft.rfft(y * np.hanning(len(y))))
        q = np.abs(np.fft.rfft(x[1000:-1000] * np.hanning(len(y))))
        f = np.fft.rfftfreq(len(y), 1 / RATE)
        at = lambda hz: np.argmin(np.abs(f - hz))
        assert 20 * np.log10(q[at(60)] / p[at(60)]) > 15
        assert abs(p[at(10)] / q[at(10)] - 1) < 0.05


def test_regression_doesnt_depend_on_the_block():
    x, s = np.random.default_rng(1).normal(size=10_000), Settings(True, method="regression", frequencies=(60.0,), window_sec=1.0)
    whole = dsp.regression(x, RATE, s)
    part = dsp.regression(x[2000:8000], RATE, s, 2000)
    assert np.allclose(whole[3000:7000], part[1000:5000], atol=1e-12)


def test_gaps():
    assert dsp.fill_gaps(np.array([1, np.nan, 3])).tolist() == [1, 2, 3]
    assert dsp.fill_gaps(np.array([np.nan, np.nan])).tolist() == [0, 0]


def test_power_meets_parseval():
    x = np.random.default_rng(42).normal(size=4096)
    p = dsp.segment_power(x, RATE, hann=False)
    assert p.sum() * RATE / 4096 == pytest.approx(((x - x.mean()) ** 2).mean())


def test_plateaus_distance_and_prominence():
    find = lambda x: dsp.plateau_middles(np.array(x, float), dsp.candidate_masks(np.array(x, float), -1e9, -2e9)[0]).tolist()
    assert find([1, 3, 5, 5, 3, 1]) == [2] and find([5, 5, 1]) == [] and find([0, 2, 2, 3, 0]) == [3]
    assert dsp.keep_distant(np.array([1, 3, 9]), np.array([4.0, 5.0, 1.0]), 3).tolist() == [False, True, True]
    assert dsp.prominence(np.array([0, 3, 1, 5, 0.5]), 1, 10) == 2 and dsp.prominence(np.array([0, 3, 1, 5, 0.5]), 3, 10) == 4.5


def table(spark, x, channel=1, rate=RATE):
    rows = [(channel, i, i * 1e6 / rate, float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "channel int, sample_index long, time_us double, value double")


def column(df):
    return np.array([r.value for r in df.orderBy("sample_index").collect()])


def test_blocks_agree_with_the_whole(spark):
    x = tone(10, 20) + tone(60, 20) + 0.1 * np.random.default_rng(3).normal(size=10_000)
    s = Settings(True, bandpass=True, low_hz=5.0, high_hz=100.0)
    got, want = column(B.filtered(table(spark, x), s, RATE, block=2500)), dsp.prepare(x, RATE, s)
    assert np.abs(got - want)[500:-500].max() < 2e-3
    r = Settings(True, method="regression", frequencies=(60.0,), window_sec=2.0)
    for block in (700, 2500, 250_000):
        assert np.allclose(column(B.regression(table(spark, x), r, RATE, block)), dsp.regression(x, RATE, r), atol=1e-9)


def test_psd_of_a_tone(spark):
    x = tone(50, 30)
    rows = B.psd(table(spark, x), RATE, most=1000).orderBy("bin").collect()
    assert max(rows, key=lambda r: r.power).freq == 50.0
    starts = range(0, len(x) - 999, 500)
    want = np.mean([dsp.segment_power(x[a : a + 1000], RATE) for a in starts], 0)
    assert np.allclose([r.power for r in rows], want)
    assert B.spectrogram(table(spark, x), RATE).select("segment").distinct().count() == len(range(0, len(x) - 511, 256))


def test_peaks_are_the_same_for_any_block(spark):
    x = 0.2 * np.random.default_rng(20260805).normal(size=4000)
    for at, v in ((500, 9.0), (520, 8.0), (1500, -9.0), (1504, 7.0), (3000, 8.5)):
        x[at] = v
    x[3001] = 8.5
    found = [[(r.sample_index, r.negative) for r in B.find_peaks(table(spark, x), 100.0, distance_sec=0.5, block=b).orderBy("sample_index").collect()] for b in (400, 733, 100_000)]
    assert found[0] == found[1] == found[2] == [(500, False), (1500, True), (3000, False)]


def test_settings_rules():
    for bad in (Settings(bandpass=True, low_hz=9, high_hz=5), Settings(method="x"), Settings(method="regression"), Settings(frequencies=(300.0,)), Settings(overlap=1.0)):
        with pytest.raises(ValueError):
            dsp.validate(bad, RATE)
    assert dsp.padding(Settings(True, bandpass=True, low_hz=5.0), 625.0) == 375
    assert dsp.regressed_frequencies(Settings(True, method="regression", frequencies=(60.0, 120.0), all_harmonics=True), RATE) == [60, 120, 180, 240]


def test_prominence_by_windows_equals_the_kernel(spark):
    from wavemark.operators import windows as W

    x = np.random.default_rng(9).normal(size=400)
    got = {r.sample_index: r.prominence for r in B.prominences(W.local_extrema(table(spark, x), 0.5, -9.0), 15).collect()}
    assert got and all(abs(v - dsp.prominence(x, k, 15)) < 1e-12 for k, v in got.items())


def test_blocks_hold_nulls_gaps_and_several_channels(spark, monkeypatch):
    from wavemark.operators import pieces

    monkeypatch.setattr(pieces, "HELD", 50)  # several pieces of a block in a task
    r = np.random.default_rng(2)
    rows = [(c, int(i), None if i % 50 == 3 else float(i), None if i % 17 == 0 else float(r.normal())) for c in (1, 4) for i in range(300) if i // 40 != 3]
    df = spark.createDataFrame(rows, "channel int, sample_index long, time_us double, value double").repartition(5)

    def run(channel, number, at, time, value):
        own = at // 32 == number
        return {"channel": np.full(int(own.sum()), channel, np.int32), "sample_index": at[own], "n": np.full(int(own.sum()), len(at))}

    got = sorted(tuple(x) for x in pieces.over_blocks(df, 32, 10, run, "channel int, sample_index long, n long").collect())
    there = {c: [i for k, i, *_ in rows if k == c] for c in (1, 4)}
    assert got == sorted((c, i, sum(i // 32 * 32 - 10 <= j < i // 32 * 32 + 42 for j in there[c])) for c in there for i in there[c])
    same = B.filtered(df, None, 1000.0, 32).orderBy("channel", "sample_index").collect()
    assert [(x.channel, x.sample_index, x.time_us) for x in same] == sorted([(c, i, t) for c, i, t, _ in rows], key=lambda x: x[:2])


def test_regression_windows_solved_together_equal_those_solved_alone():
    r = np.random.default_rng(12)
    for n, offset, s in ((900, 0, Settings(True, method="regression", frequencies=(60.0,), window_sec=0.3)), (2500, 417, Settings(True, method="regression", frequencies=(50.0, 60.0), window_sec=1.0, overlap=0.75, all_harmonics=True)), (90, 30, Settings(True, method="regression", frequencies=(60.0,), window_sec=0.3))):
        x = r.normal(size=n) + 3 * np.sin(2 * np.pi * 60 * np.arange(n) / RATE)
        frequencies, (size, hop) = dsp.regressed_frequencies(s, RATE), dsp.window_shape(s, RATE)
        shape, noise, weight = np.hanning(size + 2)[1:-1], np.zeros(n), np.zeros(n)
        for start in range(0, offset + n, hop):
            a, b = max(start - offset, 0), min(start + size - offset, n)
            if b - a >= 2 * len(frequencies) + 2:
                w = shape[a + offset - start : b + offset - start]
                noise[a:b] += dsp.sinusoids(x[a:b], RATE, frequencies) * w
                weight[a:b] += w
        want = x - np.where(weight > 0, noise / np.where(weight > 0, weight, 1), 0)
        assert np.allclose(dsp.regression(x, RATE, s, offset), want, atol=1e-9)
    with pytest.raises(ValueError, match="gaps"):
        dsp.without_sinusoids(np.array([1.0, np.nan]), 0, RATE, [60.0], 10, 5, range(1))
