"""The registered queries that SQL can't express, compared with NumPy over whole channels, brute force or the files."""

import hashlib
import os
from collections import defaultdict

import numpy as np
import pytest

from wavemark.catalog import QUERIES
from wavemark.operators import dsp, signal_blocks as B
from wavemark.plans import signal_queries as S
from wavemark.sources import adapters as A, project as P

SF = os.environ.get("WHOLE_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
RATE = 1000.0


def by_channel(rows, value="value"):
    found = defaultdict(dict)
    for r in rows:
        assert r.sample_index not in found[r.channel]
        found[r.channel][r.sample_index] = r[value]
    return found


@pytest.fixture(scope="module")
def whole(spark):
    """channel -> (times, values) in order."""
    rows = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    first = rows["ts"].min()
    found = {}
    for kind, one in rows.groupby("event_type"):
        us = ((one["ts"] - first).dt.total_seconds() * 1e6).round().to_numpy()
        found[A.CHANNELS[kind]] = us, one["value"].to_numpy(np.float64)
    return found


def same(rows, want, atol=2e-3):
    """Every wanted sample is there once and none else; values agree, away from a block's edges exactly to the filters' context."""
    got = by_channel(rows)
    assert {c: sorted(v) for c, v in got.items()} == {c: sorted(v) for c, v in want.items()}
    for c, values in want.items():
        assert max(abs(got[c][i] - v) for i, v in values.items()) < atol * 50, c  # values reach some hundreds


def filtered(whole, settings):
    return {c: dsp.prepare(v, RATE, settings) for c, (_, v) in whole.items()}


def in_blocks(whole, settings):
    """Each block with the context that the settings ask for; a narrow notch rings on beyond it."""
    out, pad = {}, dsp.padding(settings, RATE)
    for c, (_, v) in whole.items():
        parts = []
        for a in range(0, len(v), S.BLOCK):
            left = max(a - pad, 0)
            parts.append(dsp.prepare(v[left : a + S.BLOCK + pad], RATE, settings, left)[a - left : a - left + S.BLOCK])
        out[c] = np.concatenate(parts)
    return out


def picked(values, which):
    return {c: {i: float(v[i]) for i in range(len(v)) if which(c, i)} for c, v in values.items()}


def test_gaps_are_filled_over_whole_channels(spark, whole):
    dirty = by_channel(A.samples_dirty(spark, SF).collect())
    want = {c: dsp.fill_gaps(np.array([np.nan if d[i] is None else d[i] for i in range(len(d))])) for c, d in dirty.items()}
    same(QUERIES["sp_prepare"](spark, SF).collect(), picked(want, lambda c, i: True), 1e-12)


GAPS = {1: [(999, 1000), (1000, 1001), (1998, 2003)], 2: [(0, 1), (499, 1501)], 3: [(0, 1100)], 4: [(1700, 2500)], 5: [(0, 2500)], 6: [(0, 600), (601, 1999), (2000, 2500)]}


@pytest.mark.parametrize("settings", [None, S.BAND, S.NOTCH])
def test_gaps_at_and_over_block_edges(spark, settings):
    """Gaps that touch, cross and swallow blocks: values are those of the whole channel filled, then filtered in blocks."""
    n, block, r = 2500, 500, np.random.default_rng(5)
    values = {c: r.normal(size=n) for c in GAPS}
    for c, gaps in GAPS.items():
        for a, b in gaps:
            values[c][a:b] = r.choice([np.nan, np.inf], size=b - a)
    rows = [(c, i, 1000.0 * i, None if c % 2 and np.isnan(v[i]) else float(v[i])) for c, v in values.items() for i in range(n)]
    df = spark.createDataFrame(rows, "channel int, sample_index long, time_us double, value double").repartition(3, "sample_index")
    pad = dsp.padding(settings, RATE)
    want = {}
    for c, v in values.items():
        v = dsp.fill_gaps(v)
        parts = [dsp.prepare(v[max(a - pad, 0) : a + block + pad], RATE, settings)[a - max(a - pad, 0) :][:block] for a in range(0, n, block)]
        want[c] = dict(enumerate(np.concatenate(parts)))
    same(B.filtered(df, settings, RATE, block).collect(), want, 1e-9)


def test_filters(spark, whole):
    band, notch = filtered(whole, S.BAND), in_blocks(whole, S.NOTCH)
    every = lambda c, i: True
    same(QUERIES["sp_bandpass"](spark, SF).collect(), picked(band, every))
    same(QUERIES["sp_notch"](spark, SF).collect(), picked(notch, every), 1e-9)
    same(QUERIES["sp_segment_filtered"](spark, SF).collect(), picked(band, lambda c, i: 86_400e6 <= whole[c][0][i] <= 5 * 86_400e6))
    same(QUERIES["sp_plot_segment"](spark, SF).collect(), picked(band, lambda c, i: 200 <= i < 1200 and (i - 200) % 5 == 0))
    same(QUERIES["sp_coarse"](spark, SF).collect(), picked(band, lambda c, i: i % 9 == 0))
    same(QUERIES["sp_display_segment"](spark, SF).collect(), picked(notch, lambda c, i: i % 4 == 0))
    rows = QUERIES["sp_export_waveform"](spark, SF).collect()
    same(rows, picked(band, every))
    assert all(r.record_sec == whole[r.channel][0][r.sample_index] / 1e6 for r in rows)


def test_overview_is_strided_before_it_is_filtered(spark, whole):
    thin = dsp.Settings(True, bandpass=True, low_hz=1.0, high_hz=20.0)
    want = {c: dsp.prepare(v[::7], RATE / 7, thin) for c, (_, v) in whole.items()}
    same(QUERIES["sp_overview_filtered"](spark, SF).collect(), picked(want, lambda c, i: True))


def test_regression_of_whole_channels(spark, whole):
    same(QUERIES["sp_regression"](spark, SF).collect(), picked(filtered(whole, S.SINES), lambda c, i: True), 1e-9)


def density(x):
    n = len(x)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    f = np.arange(n // 2 + 1)
    wave = np.exp(-2j * np.pi * np.outer(f, np.arange(n)) / n)
    p = np.abs(wave @ ((x - x.mean()) * w)) ** 2 / (RATE * (w**2).sum())
    return p * np.where((f == 0) | (2 * f == n), 1, 2)


def segments(v, most):
    size = min(most, len(v))
    return [v[a : a + size] for a in range(0, len(v) - size + 1, size - size // 2)]


def test_spectra(spark, whole):
    for name, most in (("sp_psd", 4096), ("sp_spectrogram", 512)):
        got = defaultdict(dict)
        for r in QUERIES[name](spark, SF).collect():
            got[r.channel][(r.segment if name == "sp_spectrogram" else 0, r.bin)] = r.power
        for c, (_, v) in whole.items():
            power = [density(x) for x in segments(v, most)]
            power = power if name == "sp_spectrogram" else [np.mean(power, 0)]
            assert set(got[c]) == {(k, b) for k, p in enumerate(power) for b in range(len(p))}
            assert all(got[c][k, b] == pytest.approx(power[k][b], rel=1e-6, abs=1e-9) for k, b in got[c])


def near_ones_go(found, distance, key):
    """Best first, each keeps off all nearer than the distance."""
    taken = []
    for x in sorted(found, key=key):
        if all(abs(x[0] - t[0]) >= distance for t in taken):
            taken.append(x)
    return sorted(taken)


def prominence(v, k, reach):
    bases = []
    for step in (-1, 1):
        low, i = v[k], k + step
        while 0 <= i < len(v) and abs(i - k) <= reach and v[i] <= v[k]:
            low, i = min(low, v[i]), i + step
        bases.append(low)
    return v[k] - max(bases)


def test_peaks(spark, whole):
    got = defaultdict(list)
    for r in QUERIES["sp_find_peaks"](spark, SF).collect():
        got[r.channel].append((r.sample_index, r.negative, round(r.value, 6), round(r.prominence, 6)))
    for c, (_, v) in whole.items():
        mean, sigma, found = v.mean(), v.std(), []
        for sign in (1, -1):
            x = sign * v
            tops = [(i, x[i]) for i in range(1, len(x) - 1) if x[i] >= x[i - 1] and x[i] >= x[i + 1] and x[i] >= sign * mean + 2 * sigma]
            tops = [(i, h) for i, h in tops if (x[i - 1] < h and x[i + 1] < h)]  # no plateaus among these values
            keep = near_ones_go(tops, 10, lambda t: (-t[1], -t[0]))
            found += [(i, sign < 0, v[i], p) for i, _ in keep if (p := prominence(x, i, 50)) >= 1.5 * sigma]
        kept = near_ones_go(found, 10, lambda t: (-t[3], -abs(t[2]), t[0]))
        assert sorted(got[c]) == [(i, n, round(float(a), 6), round(float(p), 6)) for i, n, a, p in kept]
    assert sum(map(len, got.values())) > 50


def test_near_candidates(spark, whole):
    tops = {c: [(i, v[i]) for i in range(1, len(v) - 1) if v[i] >= v[i - 1] and v[i] >= v[i + 1] and v[i] >= 60] for c, (_, v) in whole.items()}
    for name, key in (("topk_peak_nms", lambda t: (-t[1], t[0])), ("topk_peak_distance", lambda t: (-t[1], -t[0]))):
        got = by_channel(QUERIES[name](spark, SF).collect())
        assert {c: sorted(v.items()) for c, v in got.items()} == {c: near_ones_go(t, 8, key) for c, t in tops.items()}


def plain_fingerprint(path):
    data, sample = open(path, "rb").read(), 1 << 20
    out = hashlib.sha256(str(len(data)).encode())
    for at in sorted({0, (len(data) - sample) // 2, len(data) - sample}) if len(data) > sample else [0]:
        out.update(at.to_bytes(8, "little") + data[at : at + sample])
    return len(data), out.hexdigest()


def test_fingerprints(spark, tmp_path):
    got = {(r["size"], r.sample_sha256) for r in QUERIES["fn_fingerprint"](spark, SF).collect()}
    assert got == {plain_fingerprint(f"{SF}/{n}.parquet") for n in ("region", "nation", "events")}
    assert {r.sample_sha256 for r in QUERIES["join_source_fingerprint"](spark, SF).collect()} == {plain_fingerprint(f"{SF}/{n}.parquet")[1] for n in ("region", "nation")}
    big = tmp_path / "big"
    big.write_bytes(os.urandom(3 << 20))
    (tmp_path / "empty").write_bytes(b"")
    paths = [str(big), str(tmp_path / "empty")]
    assert [(r["size"], r.sample_sha256) for r in P.fingerprints(spark, paths).collect()] == [plain_fingerprint(p) for p in paths]


def test_a_changed_source_is_an_error(spark, tmp_path):
    source, path = tmp_path / "rec.csv", f"file://{tmp_path}/p.zip"
    source.write_text("one")
    m = A.markers(spark, SF)
    P.save_project(spark, path, [str(source)], {"data": {"lfp_filter_settings": {"line_noise_hz": 50}}, "sync": {"offset": 1e9}}, m)
    markers, settings, pair = P.restore(spark, path)
    assert sorted(r.marker_id for r in markers.collect()) == sorted(r.marker_id for r in m.collect()) and settings["line_noise_frequencies_hz"] == [50.0]
    assert pair.first().offset_sec < 1e9
    source.write_text("two")
    with pytest.raises(Exception, match="the source changed"):
        P.restore(spark, path)


def test_chunks_are_spark_s_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = sorted(QUERIES["scan_chunks_pyarrow"](spark, SF).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    longest = max(r["count"] for r in A.samples(spark, SF).groupBy("channel").count().collect())
    assert len(got) > 3 and sum(r.n for r in got) == longest
    at = 0
    for r in got:
        assert (r.first_us, r.last_us) == (at * 1000.0, (at + r.n - 1) * 1000.0)
        at += r.n
